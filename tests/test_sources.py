import datetime as dt
import json
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.plans.config import SourceConfig
from sluice.sources import csv as csv_src
from sluice.sources import jdbc
from sluice.sources.json import cursor_value, explode_envelope


def write(path, text):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)
    return path


def test_csv_reader_null_tokens_quotes_and_row_numbers(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "a.csv"),
              'TransactionID,CustomerID,notes,amount\nTX-001,C-1,hello,10\n\nTX-002,C-2,NULL,20\n"TX,003",C-3, - ,30\n,,,\n')
    cfg = SourceConfig(properties={"nullValues": ",NULL,N/A,-"})
    df = csv_src.read_csv(spark, p, cfg)
    got = [(r._row, r.TransactionID, r.notes) for r in df.orderBy("_row").collect()]
    assert got == [(2, "TX-001", "hello"), (4, "TX-002", None), (5, "TX,003", None)]


def test_csv_ragged_rows_and_header_mapping(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "b.csv"), "item_key,desc,\nI1,short\nI2,long row,x,extra\n")
    cfg = SourceConfig(properties={"headerMapping.desc": "description"})
    df = csv_src.read_csv(spark, p, cfg, width=4)
    assert df.columns[:4] == ["item_key", "description", "column_3", "column_4"]
    rows = {r.item_key: r for r in df.collect()}
    assert rows["I1"].column_3 is None and rows["I2"].column_4 == "extra"


def test_csv_line_numbers_many_splits(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "big.csv")
    with open(p, "w") as fh:
        fh.write("id,v\n")
        for i in range(50000):
            fh.write(f"{i},{'x' * 20}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = csv_src.read_csv(spark, p, SourceConfig())
        # try_cast: filters are merged, so an ANSI cast could see the header line
        bad = df.filter(F.col("_row") != F.col("id").try_cast("long") + 2).count()
        assert bad == 0 and df.count() == 50000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_preview(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "c.csv"), "a,b\n1,2\n3,4\n5,6\n")
    rows, total = csv_src.preview(csv_src.read_csv(spark, p, SourceConfig()), 2)
    assert total == 3 and [json.loads(r) for r in rows] == [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}]


def test_json_envelope(spark):
    body = json.dumps({"customers": [{"customer_id": "1", "first_name": "a"}, {"customer_id": "2", "first_name": "b"},
                                     {"customer_id": "3", "first_name": "c"}], "meta": {"next_cursor": None}})
    df = spark.createDataFrame([(body,)], ["body"])
    item = T.StructType([T.StructField("customer_id", T.StringType()), T.StructField("first_name", T.StringType())])
    out = explode_envelope(df, "body", "customers", item)
    assert [r.customer_id for r in out.orderBy("_pos").collect()] == ["1", "2", "3"]
    assert df.select(cursor_value(F.col("body"))).first()[0] is None
    nested = spark.createDataFrame([('{"data": {"items": [1, 2]}, "meta": {"next_cursor": "c2"}}',)], ["body"])
    assert [r[1] for r in explode_envelope(nested, "body", "data.items", T.LongType()).collect()] == [1, 2]
    assert nested.select(cursor_value(F.col("body"))).first()[0] == "c2"
    bad = spark.createDataFrame([('{"customers": {"x": 1}}',)], ["body"])
    with pytest.raises(Exception):
        explode_envelope(bad, "body", "customers", item).collect()


def _api_spec(tmpdir_path, spec):
    p = os.path.join(tmpdir_path, "pages.json")
    write(p, json.dumps(spec))
    return p


def test_api_cursor_pages(spark, tmpdir_path):
    from sluice.sources.api import read_api

    log = os.path.join(tmpdir_path, "log.jsonl")
    p = _api_spec(tmpdir_path, {"log": log, "pages": {
        "": {"customers": [{"customer_id": "1"}, {"customer_id": "2"}], "meta": {"next_cursor": "c2"}},
        "c2": {"customers": [{"customer_id": "3"}], "meta": {"next_cursor": None}}}})
    props = {"responseArrayPath": "customers", "paginationType": "CURSOR", "authType": "BEARER",
             "authToken": "t", "fetcher": "tests.fake_api:fetch"}
    df = read_api(spark, "fake://" + p, props, "customer_id string")
    # one action, no sort: a range sort would sample (fetch) the pages twice
    assert sorted((r._row, r.customer_id) for r in df.collect()) == [(1, "1"), (2, "2"), (3, "3")]
    from tests import fake_api

    lines = fake_api.log_lines(log)
    assert len(lines) == 2 and lines[1]["q"]["cursor"] == "c2" and lines[0]["auth"] == "Bearer t"


def test_api_retry_then_fail(spark, tmpdir_path):
    from sluice.sources.api import fetch_page, ApiError
    from tests import fake_api

    p = _api_spec(tmpdir_path, {"fail_first": 1, "pages": {"": {"customers": [{"customer_id": "1"}]}}})
    props = {"responseArrayPath": "customers", "fetcher": "tests.fake_api:fetch", "maxRetries": "2"}
    assert fetch_page(props, "fake://" + p, {})["customers"] == [{"customer_id": "1"}]
    assert fake_api.calls(p) == 2
    q = _api_spec(os.path.join(tmpdir_path), {"status": 401, "pages": {}})
    with pytest.raises(ApiError):
        fetch_page(props, "fake://" + q, {})


def test_api_offset_pages(spark, tmpdir_path):
    from sluice.sources.api import pages

    p = _api_spec(tmpdir_path, {"pages": {"page=0": {"items": [1, 2]}, "page=1": {"items": [3]}}})
    props = {"responseArrayPath": "items", "paginationType": "OFFSET", "fetcher": "tests.fake_api:fetch"}
    assert [items for _, items in pages(props, "fake://" + p)] == [[1, 2], [3]]


def test_jdbc_parameters():
    params = jdbc.query_params({"queryParam.status": "OPEN", "queryParam.minAmount": "10.00",
                                "queryParamType.minAmount": "DECIMAL", "queryParam.n": "5", "queryParam.f": "true",
                                "queryParam.d": "2026-03-01", "queryParamTypes.d": "DATE", "queryParam.x": "O'Brien"})
    assert params == {"status": "OPEN", "minAmount": Decimal("10.00"), "n": 5, "f": True,
                      "d": dt.date(2026, 3, 1), "x": "O'Brien"}
    sql = jdbc.render("SELECT * FROM t WHERE s = :status AND a >= :minAmount AND d = :d AND x = :x AND y::text = 'a'",
                      params)
    assert sql == ("SELECT * FROM t WHERE s = 'OPEN' AND a >= 10.00 AND d = DATE '2026-03-01' AND x = 'O''Brien' "
                   "AND y::text = 'a'")
    assert jdbc.driver_for("jdbc:postgresql://h/db") == "org.postgresql.Driver"


def test_xlsx_reader(spark, tmpdir_path):
    from sluice.sources.xlsx import read_xlsx, write_xlsx

    p = os.path.join(tmpdir_path, "inv.xlsx")
    write_xlsx(p, "Inventory", [
        ["sku", "warehouse_id", "quantity_on_hand", "quantity_reserved", "unit_cost", "cost_currency", "last_updated"],
        ["abc 00123", "WH001", 5, 1, 10.5, "USD", dt.date(2026, 3, 23)],
        [None, None, None, None, None, None, None],
        ["SKU-1", "WH002", 4, 0, 5.0, "USD", dt.datetime(2026, 3, 23, 10, 30)],
    ])
    df = read_xlsx(spark, p, {"sheetName": "Inventory", "dataStartRow": "2"})
    got = [(r._row, r.sku, r.quantity_on_hand, r.unit_cost, r.last_updated) for r in df.orderBy("_row").collect()]
    assert got == [(2, "abc 00123", "5", "10.5", "2026-03-23"), (4, "SKU-1", "4", "5", "2026-03-23 10:30:00")]


def test_api_offset_pages_in_parallel(spark, tmpdir_path):
    from sluice.sources.api import read_api

    p = _api_spec(tmpdir_path, {"pages": {"page=0": {"items": [{"v": 1}, {"v": 2}]}, "page=1": {"items": [{"v": 3}]}}})
    props = {"responseArrayPath": "items", "paginationType": "OFFSET", "fetcher": "tests.fake_api:fetch",
             "maxPages": "3", "pageSize": "2"}
    df = read_api(spark, "fake://" + p, props, "v int")
    assert df.rdd.getNumPartitions() == 3
    assert sorted((r._row, r.v) for r in df.collect()) == [(1, 1), (2, 2), (3, 3)]


def test_query_tables_with_named_parameters(spark):
    spark.createDataFrame([("O-001", "OPEN", Decimal("12.50")), ("O-002", "OPEN", Decimal("10.00")),
                           ("O-003", "CLOSED", Decimal("99.00"))], "order_id string, status string, amount decimal(12,2)") \
        .createOrReplaceTempView("source_orders")
    df = jdbc.query_tables(spark, "SELECT order_id FROM source_orders WHERE status = :status AND amount >= :minAmount",
                           {"queryParam.status": "OPEN", "queryParam.minAmount": "10.00",
                            "queryParamType.minAmount": "DECIMAL"})
    assert sorted(r.order_id for r in df.collect()) == ["O-001", "O-002"]


def test_csv_latin1_encoding(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "l1.csv")
    with open(p, "wb") as fh:
        fh.write("name,city\nJosé,Bogotá\n".encode("latin-1"))
    df = csv_src.read_csv(spark, p, SourceConfig(encoding="ISO-8859-1"))
    assert [(r.name, r.city) for r in df.collect()] == [("José", "Bogotá")]


def test_csv_nothing_is_cut(spark, tmpdir_path):
    from sluice.sources import registry as sources

    folder = os.path.join(tmpdir_path, "ragged")
    os.makedirs(folder)
    write(os.path.join(folder, "a.csv"), 'k,v\n1,x\n2,y,extra\n3,"q,z"\n')
    write(os.path.join(folder, "b.csv"), "k,v\n4,w,,far\n\n5\n")
    df = sources.extract(spark, SourceConfig(type="CSV", location=folder))
    assert df.columns[:4] == ["k", "v", "column_3", "column_4"]
    got = {r.k: (r.v, r.column_3, r.column_4, r._row) for r in df.collect()}
    assert got == {"1": ("x", None, None, 2), "2": ("y", "extra", None, 3), "3": ("q,z", None, None, 4),
                   "4": ("w", None, "far", 2), "5": (None, None, None, 4)}


def test_csv_quoted_line_breaks(spark, tmpdir_path):
    from sluice.sources import registry as sources

    folder = os.path.join(tmpdir_path, "broken")
    os.makedirs(folder)
    write(os.path.join(folder, "a.csv"), 'k,v\n1,"two\nlines, one cell"\n2,plain\n')
    write(os.path.join(folder, "b.csv"), "k,v\n3,z\n")
    df = sources.extract(spark, SourceConfig(type="CSV", location=folder))
    got = {r.k: (r.v, r._row) for r in df.collect()}
    assert got == {"1": ("two\nlines, one cell", 2), "2": ("plain", 4), "3": ("z", 2)}


def test_csv_headers_must_agree(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "headers")
    os.makedirs(folder)
    write(os.path.join(folder, "a.csv"), "k,v\n1,x\n")
    write(os.path.join(folder, "b.csv"), "v,k\nx,1\n")
    with pytest.raises(csv_src.HeaderMismatch):
        csv_src.read_csv(spark, folder, SourceConfig())


def test_csv_headerless_latin1(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "l1.csv")
    with open(p, "wb") as fh:
        fh.write("caf\u00e9,1\n\u00fcber,2,x\n".encode("latin-1"))
    df = csv_src.read_csv(spark, p, SourceConfig(encoding="ISO-8859-1", has_header=False))
    assert df.columns[:3] == ["column_1", "column_2", "column_3"]
    assert [(r.column_1, r.column_3, r._row) for r in df.orderBy("_row").collect()] == [("caf\u00e9", None, 1), ("\u00fcber", "x", 2)]


def test_jdbc_values_as_the_feed_means_them():
    assert [jdbc.typed_value(v, None) for v in (" null ", "", " x ", "+5", "5.", "1e3", "-7", "-1.50", "TRUE")] == [
        None, None, "x", "+5", "5.", "1e3", -7, Decimal("-1.50"), True]
    assert jdbc.typed_value(" 12 ", "LONG") == 12 and jdbc.typed_value(" NULL ", "DATE") is None
    assert jdbc.typed_value("2026-03-01T01:00:00Z", "INSTANT") == dt.datetime(2026, 3, 1, 1)
    with pytest.raises(ValueError):
        jdbc.typed_value("x", "BLOB")
    sql = jdbc.render("SELECT ':a', \":a\", x::text -- :a\nFROM t WHERE y = :a /* :b */", {"a": "o'\\n"}, True)
    assert sql == "SELECT ':a', \":a\", x::text -- :a\nFROM t WHERE y = 'o''\\\\n' /* :b */"


def test_jdbc_partitions_from_config():
    assert jdbc.partitioning({}) == {}
    props = {"partitionColumn": "id", "lowerBound": "0", "upperBound": "100", "numPartitions": "4"}
    assert jdbc.partitioning(props) == {
        "partition_column": "id", "lower_bound": "0", "upper_bound": "100", "num_partitions": 4}
    with pytest.raises(ValueError):
        jdbc.partitioning({"partitionColumn": "id"})


def test_api_reads_beyond_the_expected_pages(spark, tmpdir_path):
    from sluice.sources.api import auth_headers, read_api

    p = _api_spec(tmpdir_path, {"pages": {"page=0": {"items": [{"v": 1}]}, "page=1": {"items": [{"v": 2}]},
                                          "page=2": {"items": [{"v": 3}]}, "page=3": {"items": []}}})
    props = {"responseArrayPath": "items", "paginationType": "OFFSET", "fetcher": "tests.fake_api:fetch",
             "expectedPages": "2", "pageSize": "1"}
    assert sorted(r.v for r in read_api(spark, "fake://" + p, props, "v int").collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        auth_headers({"authType": "DIGEST"})
    assert auth_headers({"authType": "BASIC", "authUsername": "u", "authPassword": "p"})["Authorization"] == "Basic dTpw"


def test_workbooks_with_other_headers_are_refused(spark, tmpdir_path):
    from sluice.sources.xlsx import read_xlsx, write_xlsx

    folder = os.path.join(tmpdir_path, "books")
    os.makedirs(folder)
    write_xlsx(os.path.join(folder, "a.xlsx"), "s", [["k", "v"], ["a", 1]])
    write_xlsx(os.path.join(folder, "b.xlsx"), "s", [["v", "k", "w"], [2, "b", 3]])
    with pytest.raises(Exception, match="header"):
        read_xlsx(spark, folder, {}, True).collect()
    write_xlsx(os.path.join(folder, "b.xlsx"), "s", [["k", "v"], ["b", 2, 3]])
    with pytest.raises(Exception, match="more cells"):
        read_xlsx(spark, folder, {}, True).collect()
    write_xlsx(os.path.join(folder, "b.xlsx"), "s", [["k", "v"], ["b", 2]])
    assert sorted(r.k for r in read_xlsx(spark, folder, {}, True).collect()) == ["a", "b"]
