import random

from pyspark.sql import functions as F

from sluice.operators import similar

WORDS = "steel copper small large blue red valve pump hose ring gear bolt plate case drum box".split()


def grams(v, n=3):
    return {v[i : i + n] for i in range(max(1, len(v) - n + 1))}


def brute(rows, least=0.8):
    """Smallest id of an earlier row with an equal or similar value."""
    values = [(i, " ".join(v.lower().split()) if v is not None else None) for i, v in rows]
    out = {}
    for i, v in values:
        near = [
            j
            for j, w in values
            if j < i and v is not None and w is not None
            and len(grams(v) & grams(w)) >= least * len(grams(v) | grams(w)) - 1e-9
        ]
        out[i] = min(near, default=None)
    return out


def dirty(seed, n):
    rng = random.Random(seed)
    rows, made = [], []
    for i in range(n):
        if made and rng.random() < 0.4:
            v = list(rng.choice(made))
            for _ in range(rng.randint(0, 1)):
                v[rng.randrange(len(v))] = rng.choice("abcxyz ")
            v = "".join(v)
        else:
            v = " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 9)))
            made.append(v)
        rows.append((i, v.upper() if rng.random() < 0.2 else v))
    return rows


def test_flags_match_brute_force(spark):
    rows = dirty(3, 400) + [(1000, None), (1001, None), (1002, ""), (1003, "  "), (1004, "ab"), (1005, "AB ")]
    df = spark.createDataFrame(rows, "id long, name string").repartition(4).withColumn("_value", F.lit(1)).drop("_value")
    got = {r.id: r.similar_to for r in similar.flag_similar(df, "name", "id").collect()}
    first = {}
    for i, v in rows:
        if v is not None:
            first.setdefault(" ".join(v.lower().split()), i)
    want = brute(rows)
    # a copy of a value points to what the value's first row points to, or to that row
    for i, v in rows:
        if v is not None:
            f = first[" ".join(v.lower().split())]
            head = f if want[f] is None else want[f]
            want[i] = head if head < i else None
    wrong = [i for i in want if got[i] != want[i]]
    flagged = [i for i in want if want[i] is not None]
    assert len(got) == len(rows) and got[1001] is None
    assert len(flagged) > 80 and len(wrong) <= 0.02 * len(flagged), wrong
    assert all(got[i] is None for i in want if want[i] is None)


def test_crowds_of_copies_and_templates_stay_cheap(spark):
    """Values alike but not similar enough share only frequent shingles: the rare ones pair none of them."""
    template = "the standard housing of the article with number "
    rng = random.Random(2)
    far = [(i, template + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(22))) for i in range(400)]
    near = [(1000 + i, "one and the same description of a very common part, variant " + str(i % 10)) for i in range(300)]
    df = spark.createDataFrame(far + near, "id long, name string")
    got = {r.id: r.similar_to for r in similar.flag_similar(df, "name", "id").collect()}
    assert all(got[i] is None for i, _ in far)
    assert got[1000] is None and all(got[i] == 1000 for i, _ in near[1:])


def test_warnings_reject_no_row(spark):
    df = spark.createDataFrame([(1, "blue ring"), (2, "Blue  ring"), (3, "gear")], "id long, name string")
    out = similar.flag_similar(df, "name", "id")
    rows = {r.id: r.w for r in out.withColumn("w", similar.warnings(out, "name")).collect()}
    assert rows[1] == [] and rows[3] == [] and rows[2][0].severity == "WARNING" and rows[2][0].rule == "NEAR_DUPLICATE"


def test_nothing_to_flag(spark):
    df = spark.createDataFrame([], "id long, name string")
    assert similar.flag_similar(df, "name", "id").count() == 0
