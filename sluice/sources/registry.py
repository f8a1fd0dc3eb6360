"""Source dispatch by configured type (CSV, JSON, API, DATABASE, EXCEL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluice.plans.config import SourceConfig

Reader = Callable[[SparkSession, SourceConfig], DataFrame]
READERS: dict[str, Reader] = {}


def register_reader(source_type: str, fn: Reader) -> None:
    READERS[source_type.upper()] = fn


def _csv(spark, cfg):
    from sluice.sources.csv import read_csv

    return read_csv(spark, cfg.location, cfg)


def _json(spark, cfg):
    from pyspark.sql import functions as F

    from sluice.sources.json import read_json_files

    path = cfg.properties.get("responseArrayPath")
    if path:
        from pyspark.sql import types as T

        schema = cfg.properties.get("itemSchema")
        item = T._parse_datatype_string(schema) if schema else None
        df = read_json_files(spark, cfg.location, array_path=path, item_type=item)
        return df.withColumn("_row", F.col("_pos") + 1).drop("_pos")
    from sluice.operators.dedup import with_row_id

    # rejects and duplicate checks need a row number; a scan's ids are unique
    return with_row_id(read_json_files(spark, cfg.location), "_row")


def _api(spark, cfg):
    from sluice.operators.strategy import materialize
    from sluice.sources.api import read_api

    # fetched once: later jobs read the checkpoint, not the endpoint again
    return materialize(read_api(spark, cfg.location, cfg.properties, cfg.properties.get("itemSchema")))


def _database(spark, cfg):
    from sluice.sources.jdbc import partitioning, read_jdbc, with_source_rows

    p = cfg.properties
    df = read_jdbc(spark, cfg.location, p["query"], p, fetch_size=int(p.get("fetchSize", "500")),
                   query_timeout_s=int(p.get("queryTimeoutSeconds", "30")), **partitioning(p))
    return with_source_rows(df, cfg.location)


def _excel(spark, cfg):
    from sluice.operators.strategy import materialize
    from sluice.sources.xlsx import read_xlsx

    return materialize(read_xlsx(spark, cfg.location, cfg.properties, cfg.has_header))


for _t, _f in (("CSV", _csv), ("JSON", _json), ("API", _api), ("DATABASE", _database), ("EXCEL", _excel)):
    register_reader(_t, _f)


def extract(spark: SparkSession, cfg: SourceConfig) -> DataFrame:
    """The source's rows with their lineage (S15): ``_source``, the file or location they come from, and
    ``_extracted_at``, one instant for all rows of the run."""
    import datetime as dt

    from pyspark.sql import functions as F

    reader = READERS.get(cfg.type.upper())
    if reader is None:
        raise ValueError(f"No extractor supports source type {cfg.type}")
    rows = reader(spark, cfg)
    if "_source" not in rows.columns:
        rows = rows.withColumn("_source", F.lit(cfg.location))
    if "_extracted_at" not in rows.columns:
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        rows = rows.withColumn("_extracted_at", F.lit(now).cast("timestamp"))
    return rows


def watermark(target: DataFrame, column: str):
    """Largest value of ``column`` already loaded (one scalar aggregate)."""
    from pyspark.sql import functions as F

    return target.agg(F.max(column).alias("w")).first()["w"]


def incremental(source: DataFrame, column: str, since) -> DataFrame:
    """Rows newer than ``since`` (D12). The bound is a literal, so file
    sources push it down to the scan (``PushedFilters``)."""
    from pyspark.sql import functions as F

    if since is None:
        return source
    bound = F.lit(since).cast(source.schema[column].dataType)
    return source.filter(F.col(column) > bound)
