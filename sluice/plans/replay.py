"""Reprocessing of rejected rows (D14): rejects are read back from the run tables, mended and run again.

A reject is known by the run that first rejected it, its source file and its
row number; every later reject of it carries that identity and the number of
the attempt. A replay that took a row and did not reject it again has resolved
it, so the row is loaded once and never replayed after that. Rows that reached
the most attempts stay in the table and are no longer taken.
"""

from __future__ import annotations

import copy
import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import load, strategy
from sluice.plans.config import PipelineConfig
from sluice.plans.pipelines import RunResult, run_pipeline
from sluice.plans.runs import SUCCESS_STATUSES, RunStore
from sluice.sources.json import variant_columns

IDENTITY = ["first_execution_id", "source_file", "source_row_number"]


def attempts(store: RunStore) -> DataFrame:
    """All rejects with their identity and attempt filled in (first rejects are their own)."""
    r = store.read("rejects")
    return r.withColumns({
        "first_execution_id": F.coalesce("first_execution_id", "execution_id"),
        "attempt": F.coalesce("attempt", F.lit(1)),
    })


def _matches(left: DataFrame, right: DataFrame, columns: list[str], how: str) -> DataFrame:
    renamed, cond = strategy.null_safe_on(left, right.select(*columns).distinct(), columns)
    return left.join(renamed, cond, how)


def resolved(store: RunStore) -> DataFrame:
    """Identities of rows that a finished replay took and did not reject again."""
    done = store.read("executions").where(F.col("status").isin(*SUCCESS_STATUSES)).select("execution_id").distinct()
    taken = store.read("replays").join(done, "execution_id", "left_semi")
    return _matches(taken, attempts(store), ["execution_id", *IDENTITY], "left_anti").select(*IDENTITY).distinct()


def open_rejects(store: RunStore, max_attempts: int, pipeline_id: str | None = None) -> DataFrame:
    """The latest reject of every row that is not resolved and has attempts left."""
    rejects = attempts(store)
    if pipeline_id is not None:
        own = store.read("executions").where(F.col("pipeline_id") == pipeline_id).select("execution_id").distinct()
        rejects = rejects.join(own, "execution_id", "left_semi")
    last = rejects.groupBy(*IDENTITY).agg(F.max("attempt").alias("attempt"))
    latest = _matches(rejects, last, [*IDENTITY, "attempt"], "left_semi")
    return _matches(latest, resolved(store), IDENTITY, "left_anti").where(F.col("attempt") < max_attempts)


def source_rows(rejects: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rejects as the rows that the source gave: the JSON's fields with their types, ``_row``, ``_source`` and identity.

    ``columns`` adds fields that are null in all rows, which the JSON leaves out.
    """
    parsed = rejects.withColumn("_v", F.parse_json("raw_data"))
    cells = variant_columns(parsed, "_v")
    missing = {c: F.lit(None).cast("string") for c in columns or [] if c not in cells}
    return parsed.select(
        *[c.alias(n) for n, c in {**cells, **missing}.items()],
        F.col("source_row_number").alias("_row"),
        F.col("source_file").alias("_source"),
        F.col("first_execution_id").alias("_first_execution_id"),
        F.col("attempt").alias("_attempt"),
    )


def reprocess(
    spark: SparkSession,
    cfg: PipelineConfig,
    store: RunStore,
    target: load.BucketedTable | None,
    mend: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    max_attempts: int = 3,
    as_of: dt.date | None = None,
    execution_id: str | None = None,
) -> RunResult | None:
    """Run the pipeline's open rejects again after ``mend``; None where there are none.

    The share of bad rows is no reason to stop: the rows were bad before.
    """
    rejects = strategy.materialize(open_rejects(store, max_attempts, cfg.id))
    latest = rejects.orderBy(F.col("rejected_at").desc(), F.col("execution_id").desc()).limit(1).collect()
    if not latest:
        return None
    rows = strategy.materialize(mend(source_rows(rejects, cfg.validation.mandatory_columns)))
    lenient = copy.deepcopy(cfg)
    lenient.validation.abort_on_threshold_breach = False
    execution_id = execution_id or str(uuid.uuid4())
    retries = rejects.agg(F.max("attempt")).first()[0]
    result = run_pipeline(spark, lenient, rows, target, as_of, execution_id, store,
                          parent_execution_id=latest[0]["execution_id"], retry_count=retries)
    store.append("replays", rows.select(
        F.lit(execution_id).alias("execution_id"),
        F.col("_first_execution_id").alias("first_execution_id"),
        F.col("_source").alias("source_file"),
        F.col("_row").alias("source_row_number"),
        F.col("_attempt").alias("attempt"),
    ))
    return result
