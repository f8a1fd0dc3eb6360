"""JDBC query scan with typed named parameters.

``:name`` placeholders are replaced by SQL literals rendered from their
declared (or inferred) type, quoted and escaped, before the query is sent as
a JDBC ``query`` option. Large sources set ``partitionColumn`` with bounds,
so that Spark opens ``numPartitions`` parallel range scans.
"""

from __future__ import annotations

import datetime as dt
import os
import re
import uuid
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

DRIVERS = {
    "postgresql": "org.postgresql.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "derby": "org.apache.derby.jdbc.EmbeddedDriver",
}
# a quoted string, a quoted name or a comment (left as they are), or a named parameter
TOKENS = re.compile(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/)|(?<!:):([A-Za-z_][A-Za-z0-9_]*)", re.DOTALL)
DEFAULT_FETCH_SIZE = 500
DEFAULT_QUERY_TIMEOUT_S = 30


def driver_for(url: str) -> str | None:
    for key, cls in DRIVERS.items():
        if f":{key}:" in url:
            return cls
    return None


def _instant(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(dt.timezone.utc).replace(tzinfo=None)


# declared parameter types and how a trimmed, non-empty value is read
PARSERS = {
    ("STRING",): str,
    ("INT", "INTEGER", "LONG", "BIGINT"): int,
    ("DECIMAL", "BIGDECIMAL"): Decimal,
    ("DOUBLE",): float,
    ("BOOLEAN", "BOOL"): lambda text: text.lower() == "true",
    ("UUID",): uuid.UUID,
    ("DATE", "LOCALDATE"): dt.date.fromisoformat,
    ("TIMESTAMP", "LOCALDATETIME"): dt.datetime.fromisoformat,
    ("INSTANT",): _instant,
}
# undeclared ones: the first shape that a value has
SHAPES = (
    (re.compile(r"true|false", re.IGNORECASE), lambda text: text.lower() == "true"),
    (re.compile(r"-?[0-9]{1,18}"), int),
    (re.compile(r"-?[0-9]+\.[0-9]+"), Decimal),
)


def typed_value(raw: str | None, typ: str | None):
    """Value of a query parameter: trimmed; blank or ``null`` is null; read by its declared type or by its shape."""
    text = (raw or "").strip()
    if not text or text.lower() == "null":
        return None
    if typ and typ.strip():
        for names, parse in PARSERS.items():
            if typ.strip().upper() in names:
                return parse(text)
        raise ValueError(f"Unsupported query parameter type: {typ}")
    return next((parse(text) for shape, parse in SHAPES if shape.fullmatch(text)), text)


def sql_literal(v, backslash_escapes: bool = False) -> str:
    """A SQL literal; databases that read backslashes in strings as escapes get them doubled."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, Decimal, float)):
        return str(v)
    if isinstance(v, dt.datetime):
        return f"TIMESTAMP '{v.isoformat(sep=' ')}'"
    if isinstance(v, dt.date):
        return f"DATE '{v.isoformat()}'"
    text = str(v).replace("\\", "\\\\") if backslash_escapes else str(v)
    return "'" + text.replace("'", "''") + "'"


def query_params(props: dict) -> dict:
    """``queryParam.X`` values typed by ``queryParamType.X`` or ``queryParamTypes.X``."""
    out = {}
    for k, v in props.items():
        if k.startswith("queryParam."):
            name = k[len("queryParam."):]
            typ = props.get(f"queryParamType.{name}") or props.get(f"queryParamTypes.{name}")
            out[name] = typed_value(v, typ)
    return out


def render(query: str, params: dict, backslash_escapes: bool = False) -> str:
    """The query with its ``:name`` parameters as literals; quoted text and comments are left alone."""

    def literal(m: re.Match) -> str:
        if m[1] is not None:
            return m[1]
        if m[2] not in params:
            raise KeyError(f"missing query parameter {m[2]}")
        return sql_literal(params[m[2]], backslash_escapes)

    return TOKENS.sub(literal, query)


def credential(value: str | None) -> str | None:
    """A literal, or ``env:NAME`` / ``${NAME}`` read from the environment."""
    if value is None:
        return None
    if value.startswith("env:"):
        return os.environ.get(value[4:])
    m = re.fullmatch(r"\$\{([A-Za-z0-9_]+)\}", value)
    return os.environ.get(m.group(1)) if m else value


def read_jdbc(spark: SparkSession, url: str, query: str, props: dict | None = None, user: str | None = None,
              password: str | None = None, fetch_size: int = DEFAULT_FETCH_SIZE,
              query_timeout_s: int = DEFAULT_QUERY_TIMEOUT_S, partition_column: str | None = None,
              lower_bound=None, upper_bound=None, num_partitions: int | None = None) -> DataFrame:
    props = props or {}
    sql = render(query, query_params(props), backslash_escapes=":mysql:" in url)
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", str(fetch_size)) \
        .option("queryTimeout", str(query_timeout_s))
    drv = props.get("driver") or driver_for(url)
    if drv:
        reader = reader.option("driver", drv)
    u = credential(user or props.get("user") or props.get("username")) or os.environ.get(props.get("usernameEnv", ""))
    p = credential(password or props.get("password")) or os.environ.get(props.get("passwordEnv", ""))
    if u:
        reader = reader.option("user", u)
    if p:
        reader = reader.option("password", p)
    if partition_column:
        reader = reader.option("dbtable", f"({sql}) q").option("partitionColumn", partition_column) \
            .option("lowerBound", str(lower_bound)).option("upperBound", str(upper_bound)) \
            .option("numPartitions", str(num_partitions or 8))
    else:
        reader = reader.option("query", sql)
    return reader.load()


def partitioning(props: dict) -> dict:
    """``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` of a source, all or none of them."""
    names = {"partition_column": "partitionColumn", "lower_bound": "lowerBound", "upper_bound": "upperBound"}
    given = {k: props[v] for k, v in names.items() if props.get(v) not in (None, "")}
    if given and len(given) < len(names):
        raise ValueError(f"a partitioned read needs {sorted(names.values())}")
    return {**given, "num_partitions": int(props.get("numPartitions", 8))} if given else {}


def with_source_rows(df: DataFrame, source: str) -> DataFrame:
    """Sequential ``_row`` from 1 in result order, plus ``_source``.

    The result is stored first: a second query could return its rows in
    another order, and other jobs must see the same numbers.
    """
    from pyspark.sql import functions as F

    from sluice.operators.strategy import materialize, sequential_ids

    return sequential_ids(materialize(df), "_row").withColumn("_source", F.lit(source))


def query_tables(spark: SparkSession, query: str, props: dict | None = None) -> DataFrame:
    """Parameterised query over tables/views registered in the session,
    with Spark's native named parameter markers (``:name``): values are
    bound as typed literals by Spark, never spliced into the text."""
    return spark.sql(query, args=query_params(props or {}))
