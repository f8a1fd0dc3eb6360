"""Run a pipeline on files as they land, with Structured Streaming.

The reference triggers a batch run per schedule; here a file-source stream
picks up new files and every micro-batch goes through ``run_pipeline``
(validation, transforms, gates, load into the bucketed target, run
records) inside ``foreachBatch``. Progress is tracked by the stream's
checkpoint, which lies beside the target unless named: a folder that the next
session finds again. A restarted job resumes from it without losing or
repeating a file. A batch that was replayed is known by its execution id,
which holds the stream's own id (kept in its checkpoint) and the batch
number, so the batches of another stream are never taken for it.
"""

from __future__ import annotations

import datetime as dt
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import load
from sluice.plans.config import PipelineConfig
from sluice.sources.csv import CsvFormat, read_csv
from sluice.plans.runs import SUCCESS_STATUSES

KEPT_RESULTS = 100
FILE_COLUMNS = "path string, modificationTime timestamp, length long, content binary"
FILES_PER_TRIGGER = 1000


def landing_stream(spark: SparkSession, folder: str, cfg: PipelineConfig, columns: list[str] | None = None,
                   max_files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Streaming frame of landed files: one row each (``path``), their contents unread.

    A batch's files go through the batch reader (``read_landed``), so header
    names, header mapping, quoted line breaks, long rows and line numbers are
    those of a batch run. ``columns`` names the columns of files without a
    header.
    """
    reader = spark.readStream.format("binaryFile").schema(FILE_COLUMNS) \
        .option("maxFilesPerTrigger", str(max_files_per_trigger))
    names = ",".join(columns or [])
    return reader.load(folder).select("path", F.lit(names).alias("columns"))


def read_landed(spark: SparkSession, batch: DataFrame, cfg: PipelineConfig) -> DataFrame | None:
    """The rows of a batch's files as the CSV reader gives them; None for a batch without files.

    Its paths are at most ``maxFilesPerTrigger``.
    """
    files = batch.select("path", "columns").collect()
    if not files:
        return None
    rows = read_csv(spark, sorted(f["path"] for f in files), cfg.source)
    named = [c for c in files[0]["columns"].split(",") if c]
    if cfg.source.has_header or not named:
        return rows
    return rows.withColumnsRenamed({f"column_{i}": c for i, c in enumerate(CsvFormat.of(cfg.source).names(named), 1)})


def run_on_batches(spark: SparkSession, stream: DataFrame, cfg: PipelineConfig, target: load.BucketedTable,
                   run_store=None, as_of: dt.date | None = None, name: str | None = None,
                   available_now: bool = True, processing_time: str | None = None, checkpoint: str | None = None):
    """Start the stream; each micro-batch is one pipeline execution.

    ``checkpoint`` is the stream's checkpoint folder; it must stay the same
    over restarts (default: ``_streams/<name>`` under the target's root).
    Returns the query and the outcomes of its latest batches.
    """
    from sluice.plans.pipelines import run_pipeline

    results: deque = deque(maxlen=KEPT_RESULTS)

    def each(batch: DataFrame, batch_id: int) -> None:
        # set by Spark for the thread that runs the batch; the same after a restart from the checkpoint
        stream_id = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        exec_id = f"{cfg.id}-{stream_id}-batch-{batch_id}"
        if run_store is not None:
            loaded = (F.col("execution_id") == exec_id) & F.col("status").isin(*SUCCESS_STATUSES)
            done = run_store.read("executions").filter(loaded).limit(1).count()
            if done:
                return  # replayed batch after a restart: already loaded
        raw = read_landed(spark, batch, cfg)
        if raw is None:
            return
        result = run_pipeline(spark, cfg, raw, target, as_of, exec_id, run_store)
        if result.exception is not None:
            raise result.exception  # the stream stops before the batch counts as done
        result.close()  # counters only: a stream must not hold on to its batches
        results.append(result)

    writer = stream.writeStream.foreachBatch(each).option(
        "checkpointLocation", checkpoint or f"{target.root}/_streams/{name or cfg.id}")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time or "1 minute")
    query = writer.start()
    if available_now:
        query.awaitTermination()
    return query, results
