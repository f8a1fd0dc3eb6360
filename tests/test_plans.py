"""Physical-plan properties the scale design relies on."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_catalogs_are_broadcast_after_a_bound_check(spark):
    p = plan_of(entry.queries()["catalog_lookup"](spark, SF))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_large_catalog_is_not_broadcast(spark):
    spark.conf.set("sluice.broadcast.rowLimit", "1")
    try:
        df = entry.queries()["catalog_lookup"](spark, SF)
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("sluice.broadcast.rowLimit", "1000000")


def test_incremental_watermark_reaches_the_scan(spark):
    p = plan_of(entry.queries()["incremental_extract"](spark, SF))
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts," in p


def test_top_k_per_pipeline_is_limited_before_the_shuffle(spark):
    df = entry.queries()["latest_runs"](spark, SF)
    p = df._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in p


def test_duplicate_check_uses_no_window_over_the_key(spark):
    df = entry.queries()["keep_first_dedup"](spark, SF)
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_error_arrays_stay_in_codegen(spark):
    from pyspark.sql import functions as F

    from sluice.operators import rules
    from sluice.plans.config import ValidationConfig

    df = spark.range(10).select(F.col("id").cast("string").alias("a"))
    v = rules.validate_schema(df, ValidationConfig(mandatory_columns=["a"], column_types={"a": "INTEGER"}))
    fb = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.codegen.CodegenFallback")
    found = []

    def walk(e):
        if fb.isInstance(e):
            found.append(e.getClass().getSimpleName())
        ch = e.children()
        for i in range(ch.size()):
            walk(ch.apply(i))

    plan = v._jdf.queryExecution().optimizedPlan()
    ex = plan.expressions()
    for i in range(ex.size()):
        walk(ex.apply(i))
    assert found == []
