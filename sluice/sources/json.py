"""JSON envelopes: explode the array at a dotted path, read a cursor.

Bodies may be a column of JSON text (API responses landed as rows) or JSON
files; either way the array is parsed, with an explicit schema or as VARIANT,
and exploded, one output row per element, with no per-row Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def envelope_schema(array_path: str, item_type: T.DataType) -> T.StructType:
    """Schema reaching ``array_path`` (dotted) with an array of items."""
    parts = array_path.split(".")
    node: T.DataType = T.ArrayType(item_type)
    for name in reversed(parts):
        node = T.StructType([T.StructField(name, node)])
    return node


def explode_envelope(df: DataFrame, body_col: str, array_path: str, item_type: T.DataType,
                     keep: list[str] | None = None, strict: bool = True) -> DataFrame:
    """One row per element of the array at ``array_path`` inside each JSON
    body. With ``strict`` a body where the path does not reach an array
    raises, as the reference's extractor does."""
    parsed = F.from_json(F.col(body_col), envelope_schema(array_path, item_type))
    arr = parsed
    for name in array_path.split("."):
        arr = arr.getField(name)
    if strict:
        raw_node = F.get_json_object(F.col(body_col), "$." + array_path)
        is_array = F.coalesce(F.trim(raw_node).startswith("["), F.lit(False))
        arr = F.when(is_array, arr).otherwise(
            F.raise_error(F.concat(F.lit(f"Response path '{array_path}' is not an array"))))
    keep = keep or []
    out = df.select(*[F.col(c) for c in keep], F.posexplode(arr).alias("_pos", "_item"))
    if isinstance(item_type, T.StructType):
        return out.select(*keep, "_pos", *[F.col("_item").getField(f.name).alias(f.name) for f in item_type.fields])
    return out


def variant_columns(df: DataFrame, column: str) -> dict[str, Column]:
    """Typed columns for the fields of a VARIANT column of objects, found by one aggregate over all rows.

    A field has the type that the documents give it; one whose values have
    different types stays a VARIANT, one that is null everywhere is text.
    """
    told = df.agg(F.schema_of_variant_agg(column)).first()[0]
    if not told or not told.startswith("OBJECT<"):
        return {}
    found = T._parse_datatype_string(told.replace("OBJECT<", "STRUCT<"))
    out = {}
    for f in found.fields:
        kind = "string" if isinstance(f.dataType, T.NullType) else f.dataType.simpleString()
        name = f.name.replace("\\", "\\\\").replace("'", "\\'")
        out[f.name] = F.variant_get(F.col(column), f"$['{name}']", "variant" if "void" in kind else kind)
    return out


def explode_untyped(df: DataFrame, body_col: str, array_path: str, keep: list[str] | None = None) -> DataFrame:
    """One row per element of the array at ``array_path``, its fields as columns, with no schema given.

    Bodies are parsed to VARIANT, and the elements' schema is aggregated over
    all of them, so the columns have the documents' types. A body where the
    path does not reach an array raises; elements that are no objects come as
    one column ``value``.
    """
    keep = keep or []
    path = "$" + "".join(f"['{p}']" for p in array_path.split("."))
    node = F.variant_get(F.parse_json(F.col(body_col)), path, "variant")
    is_array = F.coalesce(F.schema_of_variant(node).startswith("ARRAY<"), F.lit(False))
    checked = df.select(*[F.col(c) for c in keep], F.when(is_array, node).otherwise(
        F.raise_error(F.concat(F.lit(f"Response path '{array_path}' is not an array"))).cast("variant")).alias("_array"))
    kept = "".join(f"`{c}`, " for c in keep)
    items = df.sparkSession.sql(
        f"SELECT {kept}t.pos AS _pos, t.value AS _item FROM {{checked}}, LATERAL variant_explode(_array) AS t", checked=checked)
    cells = variant_columns(items, "_item") or {"value": F.col("_item")}
    return items.select(*keep, "_pos", *[c.alias(n) for n, c in cells.items()])


def cursor_value(body: Column, path: str = "meta.next_cursor") -> Column:
    """Text at a dotted path, null when absent, JSON null or blank."""
    v = F.get_json_object(body, "$." + path)
    return F.when(F.trim(v) != "", v)


def read_json_files(spark: SparkSession, path: str, schema: T.StructType | None = None,
                    array_path: str | None = None, item_type: T.DataType | None = None) -> DataFrame:
    """JSON files (one document each, multi-line); exploded when
    ``array_path`` is given, by the item type or, without one, by the
    documents' own types. Also serves the JSON source type; rows carry their
    file as ``_source``."""
    if array_path:
        docs = spark.read.text(path, wholetext=True).select(F.col("value").alias("_body"),
                                                             F.col("_metadata.file_path").alias("_source"))
        if item_type is None:
            return explode_untyped(docs, "_body", array_path, keep=["_source"])
        return explode_envelope(docs, "_body", array_path, item_type, keep=["_source"])
    reader = spark.read.option("multiLine", "true")
    if schema is not None:
        reader = reader.schema(schema)
    rows = reader.json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("_source"))


def to_json_text(cols: list[str] | None = None) -> Column:
    return F.to_json(F.struct(*(cols or ["*"])))


def is_valid_json(col: Column) -> Column:
    return F.try_parse_json(col).isNotNull()
