import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron sigma tau upsilon chi psi omega".split()


def prose(seed: int, words: int, width: int = 12) -> str:
    rng = random.Random(seed)
    made = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(words)]
    return "\n".join(" ".join(made[i : i + width]) for i in range(0, words, width))


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, copies, near copies, ties and repeated rows."""
    base = prose(1, 120)
    near = base.replace(base.split()[40], "changed", 1)
    rows = [
        (1, base, "en", "a", len(base)),
        (2, base, "en", "a", len(base)),
        (3, near, "en", "b", len(near)),
        (4, prose(4, 60), "de", None, 1),
        (5, None, "de", "a", None),
        (6, "", None, "b", 0),
        (7, " \n\t\x0b \n", "en", "b", 6),
        (8, prose(8, 12000), "en", "a", 1),
        (9, "word " * 300, "en", "c", 1500),
        (10, "ünïcode 日本語 \U0001f600 a@b.co +1 (663) 555-6869, 4465758382889437, 8.196.197.208\nA@B.CO", "fr", "c", 9),
        (None, prose(11, 40), "en", "a", 1),
        (None, None, None, None, None),
        (13, "one line only", "en", "a", 13),
        (13, "one line only", "en", "a", 13),
        (14, "x" * 5000, "en", "a", 5000),
        (15, "\r\n\r\n", "en", "a", 4),
    ]
    # enough clean documents that no host is judged by its edge cases
    return rows + [(20 + i, prose(20 + i, 30), "en", "abc"[i % 3], 1) for i in range(30)]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(edge_docs):
    """The edge rows with extra columns named like the operators' own."""
    names = "kept fp rid shard slot size ids start length bucket row gone group fingerprint component_id record Label".split()
    return edge_docs.withColumns({n: F.lit(7) for n in names})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
