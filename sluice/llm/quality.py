"""Quality rules on documents with host-level verdicts.

Per-document rules are counted with array functions, inside the row. Their
failures are then aggregated by host (the ``source`` column), the failure
rate of each host is shrunk towards the corpus by an empirical beta prior
(moments of the host rates, less the sampling noise), and the verdict is
joined back: a host that fails as a whole loses all its documents, a host
that fails well above the corpus is held to the strict rules.

Defined results: a null text is an empty text; a null host is one host of its
own; empty tables give empty tables; repeated rows count once each; extra
columns pass through, and a column that clashes with an added one is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import SPACES, Scratch, fresh, let, maybe_broadcast, text_of, words_of

WINDOW = 5


@dataclass(frozen=True)
class HostPolicy:
    """Thresholds of the host verdict; rates are shrunk failure rates in [0, 1]."""

    reject_rate: float = 0.5
    strict_rate: float = 0.25
    strict_factor: float = 2.0
    max_symbols_per_word: float = 0.3
    max_dup_line_share: float = 0.5


def _repeat_words(words: Column) -> Column:
    """Words covered by 5-word windows that occur twice or more in the text."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))
        )

    def covered(win: Column) -> Column:
        ranked = F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            return F.filter(
                s,
                lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
            )

        def spread(p: Column) -> Column:
            # a window covers WINDOW words, or fewer where the next repeated window starts earlier
            steps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        places = let(ranked, lambda s: F.sort_array(F.transform(repeated(s), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(let(places, spread))

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(let(hashes, windows), covered)).cast("long")


def rule_columns(text: Column) -> dict[str, Column]:
    """The per-document counts; every count covers the whole text."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return {
        "n_symbols": (F.size(F.split(text, "[#*$%&|<>]")) - 1).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def with_rules(docs: DataFrame, policy: HostPolicy = HostPolicy()) -> DataFrame:
    """Add the rule counts, ``base_failed`` and ``strict_failed`` to every document."""
    w = fresh("_words", docs.columns)
    text = text_of(F.col("text"))
    out = docs.withColumn(w, words_of(text))
    out = out.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            **rule_columns(text),
            "n_repeat_words": _repeat_words(F.col(w)),
        }
    ).drop(w)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    strict = (F.col("n_symbols") > policy.max_symbols_per_word * F.col("n_words")) | (
        F.col("n_dup_lines") > policy.max_dup_line_share * F.size(F.split(text, "\n"))
    )
    return out.withColumns({"base_failed": base, "strict_failed": base | strict})


def host_verdicts(flagged: DataFrame, scratch: Scratch, policy: HostPolicy = HostPolicy()) -> DataFrame:
    """One row per host: documents, failures, shrunk rate, verdict (``ok``, ``strict`` or ``reject``).

    The per-host sums are combined before the shuffle, so a host with a third
    of all documents is one row per task. The prior is two moments of the
    host table, fetched as one row.
    """
    hosts = scratch.write(
        flagged.groupBy(F.col("source").alias("host")).agg(
            F.count("*").alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failed")
        ),
        "hosts",
    )
    rate = F.col("failed") / F.col("docs")
    m = hosts.agg(
        F.count("*").alias("hosts"),
        F.avg(rate).alias("mean"),
        F.var_pop(rate).alias("var"),
        F.avg(1 / F.col("docs")).alias("inverse_docs"),
    ).first()
    alpha, beta = beta_prior(m["hosts"], m["mean"], m["var"], m["inverse_docs"])
    shrunk = (F.col("failed") + F.lit(alpha)) / (F.col("docs") + F.lit(alpha + beta))
    strict_at = max(policy.strict_rate, policy.strict_factor * alpha / (alpha + beta))
    return hosts.withColumn("rate", shrunk).withColumn(
        "verdict",
        F.when(F.col("rate") > policy.reject_rate, "reject").when(F.col("rate") > strict_at, "strict").otherwise("ok"),
    )


def beta_prior(hosts: int, mean: float | None, var: float | None, inverse_docs: float | None) -> tuple[float, float]:
    """Beta(alpha, beta) by moments of the host rates; the binomial noise of finite hosts is taken off the variance."""
    if not hosts or mean is None:
        return 1.0, 1.0
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    noise = mean * (1 - mean) * inverse_docs
    spread = max(var - noise, mean * (1 - mean) * 1e-4)
    strength = max(mean * (1 - mean) / spread - 1, 1.0)
    return mean * strength, (1 - mean) * strength


def judge(
    docs: DataFrame, policy: HostPolicy = HostPolicy(), carry: list[str] | None = None, store: bool = True
) -> DataFrame:
    """Documents with rule counts, host verdict and ``kept``; ``carry`` names the input columns to return (default all).

    The counted rows are stored once, since the host sums and the result
    both read them; without ``store`` they are counted twice instead, for
    rows that carry their texts. Only hosts whose verdict is not ``ok`` are joined back:
    broadcast when counted small, by a skew-splitting shuffle join otherwise.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rules = with_rules(docs, policy)
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "strict_failed"]
    host = fresh("_host", rules.columns)
    names = [c for c in (docs.columns if carry is None else carry) if c not in added] + added
    flagged = rules.select(*names, F.col("source").alias(host))
    if store:
        flagged = scratch.write(flagged, "flagged")
    else:
        # behind an explode, a filter on the verdict does not count the rules once more
        flags = F.explode(F.array(F.struct("base_failed", "strict_failed"))).alias("flags")
        rest = [c for c in flagged.columns if c not in ("base_failed", "strict_failed")]
        flagged = flagged.select(*rest, flags).select(*rest, "flags.*")
    verdicts = host_verdicts(flagged.select(F.col(host).alias("source"), "base_failed"), scratch, policy)
    marked = scratch.write(verdicts.where("verdict <> 'ok'"), "marked")
    key, verdict = fresh("_key", flagged.columns), fresh("_verdict", flagged.columns)
    side = maybe_broadcast(marked.select(F.col("host").alias(key), F.col("verdict").alias(verdict)))
    joined = flagged.join(side, flagged[host].eqNullSafe(side[key]), "left")
    kept = ~F.col("base_failed") & (
        F.col(verdict).isNull() | ((F.col(verdict) == "strict") & ~F.col("strict_failed"))
    )
    return joined.withColumns({"host_verdict": F.coalesce(F.col(verdict), F.lit("ok")), "kept": kept}).drop(
        key, verdict, host
    )
