"""Run history tables and the monitoring queries over them.

Runs, steps, errors, audit rows and rejects are small append-only Parquet
tables with fixed schemas (``RUN_SCHEMA`` ...). Monitoring reads are plain
DataFrame queries: aggregates with map-side combine, top-k per pipeline via
``row_number() <= n`` (Spark inserts a partial WindowGroupLimit before the
shuffle, so a busy pipeline does not funnel all its runs into one task), and
paging with ``offset``/``limit`` on a total order.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.dates import in_allowed_windows
from sluice.operators.quality import error_rate_pct

# Fixed vocabularies.
EXECUTION_STATUSES = ("PENDING", "RUNNING", "SUCCESS", "FAILED", "PARTIAL", "SKIPPED", "RETRYING")
TERMINAL_STATUSES = ("SUCCESS", "FAILED", "PARTIAL", "SKIPPED")
ACTIVE_STATUSES = ("RUNNING", "RETRYING")
SUCCESS_STATUSES = ("SUCCESS", "PARTIAL")
ERROR_TYPES = ("TECHNICAL", "FUNCTIONAL", "DATA_QUALITY", "EXTERNAL_INTEGRATION")
STEP_NAMES = ("INIT", "EXTRACT", "VALIDATE_SCHEMA", "TRANSFORM", "VALIDATE_BUSINESS", "LOAD", "CLOSE", "AUDIT")
METRIC_KEYS = ("records_read", "records_transformed", "records_rejected", "records_loaded", "error_rate")

RUN_SCHEMA = T.StructType([
    T.StructField("execution_id", T.StringType()),
    T.StructField("pipeline_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("trigger_type", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("finished_at", T.TimestampType()),
    T.StructField("total_read", T.LongType()),
    T.StructField("total_transformed", T.LongType()),
    T.StructField("total_rejected", T.LongType()),
    T.StructField("total_loaded", T.LongType()),
    T.StructField("error_summary", T.StringType()),
    T.StructField("retry_count", T.IntegerType()),
    T.StructField("parent_execution_id", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])
STEP_SCHEMA = T.StructType([
    T.StructField("execution_id", T.StringType()),
    T.StructField("step_name", T.StringType()),
    T.StructField("step_order", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("finished_at", T.TimestampType()),
    T.StructField("records_processed", T.LongType()),
])
ERROR_SCHEMA = T.StructType([
    T.StructField("execution_id", T.StringType()),
    T.StructField("step_name", T.StringType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])
AUDIT_SCHEMA = T.StructType([
    T.StructField("execution_id", T.StringType()),
    T.StructField("pipeline_id", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])
REJECT_SCHEMA = T.StructType([
    T.StructField("execution_id", T.StringType()),
    T.StructField("source_row_number", T.LongType()),
    T.StructField("step", T.StringType()),
    T.StructField("raw_data", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("errors", T.StringType()),
    T.StructField("rejected_at", T.TimestampType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("first_execution_id", T.StringType()),
    T.StructField("attempt", T.IntegerType()),
])
REPLAY_SCHEMA = T.StructType([
    T.StructField("execution_id", T.StringType()),
    T.StructField("first_execution_id", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("source_row_number", T.LongType()),
    T.StructField("attempt", T.IntegerType()),
])


class RunStore:
    """Append-only run tables under one root folder (shared storage)."""

    TABLES = {"executions": RUN_SCHEMA, "steps": STEP_SCHEMA, "errors": ERROR_SCHEMA, "audit": AUDIT_SCHEMA,
              "replays": REPLAY_SCHEMA}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def append(self, name: str, rows: list[dict] | DataFrame) -> None:
        schema = self.TABLES.get(name, REJECT_SCHEMA)
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(
            [tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)
        if name == "rejects":
            # by row within a file, so that a page reads the row groups from its first row on
            df.sortWithinPartitions("source_row_number").write.mode("append").partitionBy("execution_id").parquet(self.path(name))
        else:
            df.write.mode("append").parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        schema = self.TABLES.get(name, REJECT_SCHEMA)
        try:
            return self.spark.read.schema(schema).parquet(self.path(name))
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)  # no run written yet


# ------------------------------------------------------------- queries


def pipeline_health(runs: DataFrame) -> DataFrame:
    """Per pipeline: active runs and the latest successful finish."""
    return runs.groupBy("pipeline_id").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("status").isin(*ACTIVE_STATUSES)).alias("active_runs"),
        F.max(F.when(F.col("status").isin(*SUCCESS_STATUSES), F.col("finished_at"))).alias("last_success_at"),
    )


def error_rates(runs: DataFrame, by: Sequence[str] = ("pipeline_id",)) -> DataFrame:
    """Rejected * 100 / read at scale 2 HALF_UP, 0.00 when nothing read."""
    g = runs.groupBy(*by).agg(F.sum("total_read").cast("long").alias("total_read"),
                              F.sum("total_rejected").cast("long").alias("total_rejected"))
    return g.withColumn("error_rate", error_rate_pct(F.col("total_rejected"), F.col("total_read")))


def _duration_ms() -> Column:
    micros = F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return (micros / 1000).cast("decimal(20,2)")


def run_metrics(runs: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """One row per (execution, metric), sorted by name on read."""
    rate = error_rate_pct(F.col("total_rejected"), F.col("total_read")).cast("decimal(20,2)")
    base = runs.select(
        "execution_id",
        F.col("total_read").cast("decimal(20,2)").alias("records_read"),
        F.col("total_transformed").cast("decimal(20,2)").alias("records_transformed"),
        F.col("total_rejected").cast("decimal(20,2)").alias("records_rejected"),
        F.col("total_loaded").cast("decimal(20,2)").alias("records_loaded"),
        rate.alias("error_rate"),
        _duration_ms().alias("duration_total_ms"),
    )
    metrics = base.unpivot("execution_id", [*METRIC_KEYS, "duration_total_ms"], "metric_name", "metric_value")
    if steps is not None:
        per_step = steps.filter(F.col("step_name").isin("EXTRACT", "TRANSFORM", "LOAD")).select(
            "execution_id",
            F.concat(F.lit("duration_"), F.lower("step_name"), F.lit("_ms")).alias("metric_name"),
            _duration_ms().alias("metric_value"),
        )
        metrics = metrics.unionByName(per_step)
    return metrics


def decide_status(current: Column, critical_errors: Column, rejected: Column) -> Column:
    """Final run status (R1): a terminal non-success status is kept; any
    CRITICAL error fails the run; rejects make it PARTIAL; else SUCCESS."""
    return (F.when(current.isin("FAILED", "SKIPPED"), current)
            .when(critical_errors > 0, F.lit("FAILED"))
            .when(rejected > 0, F.lit("PARTIAL"))
            .otherwise(F.lit("SUCCESS")))


def latest_runs(runs: DataFrame, n: int, by: str = "pipeline_id", order: Sequence[Column] | None = None) -> DataFrame:
    """The ``n`` most recent runs of every pipeline (O1), n >= 1."""
    if n < 1:
        raise ValueError("limit must be >= 1")
    order = order or (F.col("created_at").desc(), F.col("execution_id").desc())
    w = Window.partitionBy(by).orderBy(*order)
    return runs.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def page(df: DataFrame, page_no: int, size: int, order: Sequence[Column]) -> DataFrame:
    """One page of a totally ordered frame (O2): page >= 0, 1 <= size <= 200."""
    if page_no < 0 or not 1 <= size <= 200:
        raise ValueError("page must be >= 0 and size within 1..200")
    return df.orderBy(*order).offset(page_no * size).limit(size)


def page_with_total(df: DataFrame, page_no: int, size: int, order: Sequence[Column]) -> tuple[DataFrame, int, int]:
    """A page with the number of all rows and of pages (O2)."""
    total = df.count()
    return page(df, page_no, size, order), total, -(-total // size)


def page_after(df: DataFrame, order: Sequence[str], after: Sequence | None, size: int) -> DataFrame:
    """The ``size`` rows that follow the key ``after`` in the order of the columns (None: the first rows).

    A page costs the rows that follow it, never those before: the bound on
    the first column reaches the scan, and only ``size`` rows per task go on.
    The columns must tell rows apart and hold no nulls.
    """
    if not 1 <= size <= 200:
        raise ValueError("size must be within 1..200")
    if after is not None:
        beyond, same = F.lit(False), F.lit(True)
        for c, v in zip(order, after, strict=True):
            bound = F.lit(v).cast(df.schema[c].dataType)
            beyond, same = beyond | (same & (F.col(c) > bound)), same & (F.col(c) == bound)
        df = df.where(F.col(order[0]) >= F.lit(after[0]).cast(df.schema[order[0]].dataType)).where(beyond)
    return df.orderBy(*order).limit(size)


def rejects_after(store: RunStore, execution_id: str, after_row: tuple | None = None, size: int = 50) -> DataFrame:
    """A page of a run's rejects behind a row ``(source_row_number, source_file)``: one partition of the table is read (O2)."""
    rejects = store.read("rejects").where(F.col("execution_id") == execution_id)
    return page_after(rejects.withColumn("source_file", F.coalesce("source_file", F.lit(""))),
                      ["source_row_number", "source_file"], after_row, size)


def steps_of(store: RunStore, execution_id: str) -> DataFrame:
    """A run's steps in their order (O3)."""
    return store.read("steps").where(F.col("execution_id") == execution_id).orderBy("step_order")


def audit_of(store: RunStore, execution_id: str) -> DataFrame:
    """A run's audit rows, oldest first (O3)."""
    return store.read("audit").where(F.col("execution_id") == execution_id).orderBy("created_at", "action")


def errors_of(store: RunStore, execution_id: str) -> DataFrame:
    """A run's errors, oldest first (O3)."""
    return store.read("errors").where(F.col("execution_id") == execution_id).orderBy("created_at", "message")


def metrics_of(store: RunStore, execution_id: str) -> DataFrame:
    """A run's metrics by name, step durations included (O3)."""
    runs = store.read("executions").where(F.col("execution_id") == execution_id)
    steps = store.read("steps").where(F.col("execution_id") == execution_id)
    return run_metrics(runs, steps).orderBy("metric_name")


def retry_eligible(runs: DataFrame, errors: DataFrame | None, max_retries: int, retry_on: Sequence[str]) -> DataFrame:
    """Failed runs that may be retried (R5): retry count below the maximum
    and the last error's type in ``retry_on`` (empty = any). The last error
    per run is a ``max_by`` aggregate, not a window."""
    r = runs
    if errors is not None:
        last = errors.groupBy("execution_id").agg(F.max_by("error_type", F.struct("created_at", "error_type")).alias("last_error_type"))
        r = r.join(last, "execution_id", "left")
    type_ok = F.lit(True) if not retry_on else F.coalesce(F.col("last_error_type").isin(*retry_on), F.lit(False))
    return r.withColumn("retry_eligible", (F.col("status") == "FAILED") & (F.col("retry_count") < max_retries) & type_ok)


def retry_chain(runs: DataFrame) -> DataFrame:
    """Each run with its parent's status (R3): self join on the unique id.

    First attempts have no parent; they stay out of the join, where their
    nulls would meet in one partition.
    """
    parent = runs.select(F.col("execution_id").alias("parent_execution_id"), F.col("status").alias("parent_status"))
    retries = runs.where(F.col("parent_execution_id").isNotNull()).join(parent, "parent_execution_id", "left")
    firsts = runs.where(F.col("parent_execution_id").isNull()).withColumn("parent_status", F.lit(None).cast("string"))
    return retries.unionByName(firsts)


def retry_chains(runs: DataFrame) -> DataFrame:
    """Every run with the first run of its chain, its depth in it, the chain's attempts and final status.

    A recursion from the runs without a (known) parent down to their
    retries. The final status is that of the deepest run, the latest of
    several at that depth.
    """
    spark = runs.sparkSession
    # the default bound on a recursion's rows would refuse long histories
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    chain = spark.sql(
        """WITH RECURSIVE chain(root_execution_id, execution_id, depth) AS (
  SELECT r.execution_id, r.execution_id, 0 FROM {runs} r LEFT ANTI JOIN {runs} p ON r.parent_execution_id = p.execution_id
  UNION ALL
  SELECT c.root_execution_id, r.execution_id, c.depth + 1 FROM chain c JOIN {retries} r ON r.parent_execution_id = c.execution_id)
SELECT * FROM chain""",
        runs=runs, retries=runs.where(F.col("parent_execution_id").isNotNull()),
    )
    known = chain.join(runs.select("execution_id", "status", "created_at"), "execution_id")
    ends = known.groupBy("root_execution_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.max_by("status", F.struct("depth", "created_at", "execution_id")).alias("final_status"),
    )
    return known.join(ends, "root_execution_id").select(
        "execution_id", "root_execution_id", "depth", "attempts", "final_status")


def window_allowed(ts: Column, windows: Sequence[dict], zone: str = "UTC") -> Column:
    return in_allowed_windows(ts, windows, zone)


def runs_per_status(runs: DataFrame, as_of: dt.date, days: int = 7) -> DataFrame:
    """Runs per day and status over the last ``days`` days."""
    start = F.date_sub(F.lit(as_of), days - 1)
    r = runs.filter((F.to_date("started_at") >= start) & (F.to_date("started_at") <= F.lit(as_of)))
    return r.groupBy(F.to_date("started_at").alias("day"), "status").agg(F.count(F.lit(1)).alias("runs"))


def dead_letter_summary(rejects: DataFrame, keys: Sequence[str], max_attempts: int,
                        at: str = "rejected_at", reason: str = "reason") -> DataFrame:
    """Rejects grouped by business key across executions (D14): attempts,
    first and last rejection, the latest reason, and whether another retry
    is allowed. One aggregate with map-side combine; no window."""
    g = rejects.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.min(at).alias("first_rejected_at"),
        F.max(at).alias("last_rejected_at"),
        F.max_by(F.col(reason), F.struct(F.col(at), F.col(reason))).alias("last_reason"),
    )
    return g.withColumn("retryable", F.col("attempts") < F.lit(max_attempts))


def step_throughput(runs: DataFrame, count_col: str = "total_read") -> DataFrame:
    """Records per second and rejected share per run."""
    from sluice.operators.quality import div_round

    micros = F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    rps = div_round(F.col(count_col) * 1000000, micros, 2).cast("decimal(20,2)")
    return runs.select("execution_id", rps.alias("records_per_second"),
                       error_rate_pct(F.col("total_rejected"), F.col(count_col)).alias("rejected_pct"))


def with_pipeline_names(runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Execution rows with their pipeline's name; the id when the pipeline
    is unknown (J6). The pipeline table is small and unique per id."""
    names = pipelines.select(F.col("pipeline_id").alias("_pid"), F.col("name").alias("_pname"))
    j = runs.join(names, runs["pipeline_id"] == names["_pid"], "left")
    return j.withColumn("pipeline_name", F.coalesce(F.col("_pname"), F.col("pipeline_id"))).drop("_pid", "_pname")


def rejected_per_execution(rejects: DataFrame) -> DataFrame:
    """Rejected row count of every execution (A10)."""
    return rejects.groupBy("execution_id").agg(F.count(F.lit(1)).alias("rejected"))


def active_runs(runs: DataFrame) -> DataFrame:
    """Runs still in progress (F1)."""
    return runs.filter(F.col("status").isin(*ACTIVE_STATUSES))


def active_pipelines(pipelines: DataFrame) -> DataFrame:
    """Pipelines whose status is ACTIVE (F1)."""
    return pipelines.filter(F.col("status") == "ACTIVE")
