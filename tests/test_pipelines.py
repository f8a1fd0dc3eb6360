import datetime as dt
import json
import os
from decimal import Decimal

from pyspark.sql import functions as F

from sluice.operators import load, quality
from sluice.plans import pipelines
from sluice.plans.config import builtin
from sluice.plans.runs import RunStore
from sluice.sources import registry as sources

AS_OF = dt.date(2026, 3, 31)


def sales_csv(path):
    lines = ["transaction_id,customer_id,product_id,amount,currency,sale_date,salesperson_id,channel,"
             "product_quantity,discount_rate,notes"]
    cur = ["USD", "EUR", "COP"]
    for i in range(1, 101):
        lines.append(f"TXN-{i:04d},C-10{i % 4},P-10{i % 3},{10 + i}.50,{cur[i % 3]},2026-03-{1 + i % 28:02d},"
                     f"S-00{1 + i % 3},{1 + i % 5},{1 + i % 3},{i % 16},{'' if i % 7 else 'N/A'}")
    lines += [
        "TXN-0101,C-100,P-999,10.00,USD,2026-03-10,S-001,1,1,0,",
        "TXN-0102,C-999,P-100,10.00,USD,2026-03-10,S-001,1,1,0,",
        "TXN-0103,C-100,P-100,10.00,USD,2026-03-10,S-999,1,1,0,",
        "TXN-0104,C-100,P-100,10.00,USD,2026-03-10,S-001,1,1,150,",
        "TXN-0105,C-100,P-100,10.00,USD,2099-01-01,S-001,1,1,0,",
    ]
    with open(path, "w") as fh:
        fh.write("\n".join(lines) + "\n")


def test_sales_end_to_end(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "sales.csv")
    sales_csv(src)
    cfg = builtin("sales", {"SLUICE_SALES_SOURCE_PATH": src})
    raw = sources.extract(spark, cfg.source)
    target = load.BucketedTable(spark, os.path.join(tmpdir_path, "sales_t"), cfg.target.business_key, 8)
    store = RunStore(spark, os.path.join(tmpdir_path, "runs"))
    res = pipelines.run_pipeline(spark, cfg, raw, target, AS_OF, "exec-1", store)
    assert (res.read, res.loaded, res.rejected, res.status) == (105, 100, 5, "PARTIAL")
    rules_hit = {r.rule for r in quality.rejects_by_rule(res.rejects()).collect()}
    assert rules_hit == {"CATALOG_LOOKUP", "ACTIVE_REFERENCE", "RANGE_CHECK", "FUTURE_DATE"}
    assert store.read("audit").count() == 1
    assert store.read("rejects").filter(F.col("execution_id") == "exec-1").count() == 5
    row = target.read().filter(F.col("transaction_id") == "TXN-0001").first()
    # 11.50 EUR * 1.10 = 12.65 USD; qty 2; discount 1 %
    assert (row.amount, row.currency, row.quantity, row.subtotal) == (Decimal("12.65"), "USD", 2, Decimal("25.05"))
    assert row.tax_amount == Decimal("4.76") and row.total_amount == Decimal("29.81") and row.status == "OPEN"
    assert target.read().count() == 100


def test_sales_threshold_abort(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "sales.csv")
    sales_csv(src)
    cfg = builtin("sales", {"SLUICE_SALES_SOURCE_PATH": src})
    cfg.validation.error_threshold_percent = 1.0
    res = pipelines.run_pipeline(spark, cfg, sources.extract(spark, cfg.source), None, AS_OF, "exec-2")
    assert res.status == "FAILED" and "threshold" in res.errors[0]


def test_customer_end_to_end_with_closed_guard(spark, tmpdir_path):
    def page_file(name, pages):
        p = os.path.join(tmpdir_path, name)
        with open(p, "w") as fh:
            json.dump({"pages": pages}, fh)
        return "fake://" + p

    def cust(cid, num, first, last, email, status, phone="3001234567"):
        return {"customer_id": cid, "document_type": "cc", "document_number": num, "first_name": first,
                "last_name": last, "email": email, "phone": phone, "country_code": "COL",
                "registration_date": "2026-01-10", "status": status}

    cfg = builtin("customer")
    cfg.source.properties.update({"fetcher": "tests.fake_api:fetch", "authToken": "t"})
    schema = ", ".join(f"{c} string" for c in cust("", "", "", "", "", "").keys())
    cfg.source.properties["itemSchema"] = schema
    target = load.BucketedTable(spark, os.path.join(tmpdir_path, "cust_t"), cfg.target.business_key, 4)
    cfg.source.location = page_file("p1.json", {"": {"customers": [cust("1", "1001", "ana", "old", "old@x.com", "C")],
                                                     "meta": {"next_cursor": None}}})
    first = pipelines.run_pipeline(spark, cfg, sources.extract(spark, cfg.source), target, AS_OF, "e1")
    assert (first.read, first.loaded, first.status) == (1, 1, "SUCCESS")
    cfg.source.location = page_file("p2.json", {
        "": {"customers": [cust("1", "1001", "ana", "new", "new@x.com", "A"),
                           cust("2", "1002", "mARia elena", "o'brien-smith", "MARIA@EXAMPLE.COM", "A")],
             "meta": {"next_cursor": "c2"}},
        "c2": {"customers": [cust("3", "1003", "luis", "perez", "luis@x.com", "I", "+1 555 123")],
               "meta": {"next_cursor": None}}})
    res = pipelines.run_pipeline(spark, cfg, sources.extract(spark, cfg.source), target, AS_OF, "e2")
    assert (res.read, res.loaded, res.rejected, res.status, res.skipped) == (3, 2, 0, "SUCCESS", 1)
    rows = {r.document_number: r for r in target.read().collect()}
    assert len(rows) == 3
    assert rows["1001"].email == "old@x.com" and rows["1001"].status == "CLOSED"
    m = rows["1002"]
    assert (m.first_name, m.last_name, m.email, m.phone, m.country_code, m.crm_customer_id) == (
        "Maria Elena", "O'Brien-Smith", "maria@example.com", "+573001234567", "CO", "2")
    assert rows["1003"].phone == "+1555123" and rows["1003"].customer_type == "INDIVIDUAL"


def test_inventory_end_to_end(spark, tmpdir_path):
    from sluice.sources.xlsx import write_xlsx

    p = os.path.join(tmpdir_path, "inv.xlsx")
    write_xlsx(p, "Inventory", [
        ["sku", "warehouse_id", "quantity_on_hand", "quantity_reserved", "unit_cost", "cost_currency", "last_updated"],
        ["abc 00123", "WH001", 5, 1, 10.5, "USD", dt.date(2026, 3, 23)],
        ["ABC-123", "CENTRAL", 7, 2, 12.0, "USD", dt.date(2026, 3, 24)],
        ["SKU-1", "WH002", 4, 0, 5.0, "USD", dt.date(2026, 3, 23)],
        ["SKU-1", "WH002", 6, 0, 5.5, "USD", dt.date(2026, 3, 25)],
    ])
    cfg = builtin("inventory", {"SLUICE_INVENTORY_SOURCE_PATH": p})
    target = load.BucketedTable(spark, os.path.join(tmpdir_path, "inv_t"), cfg.target.business_key, 4)
    res = pipelines.run_pipeline(spark, cfg, sources.extract(spark, cfg.source), target, AS_OF, "e1")
    assert (res.read, res.loaded, res.rejected, res.status) == (4, 2, 0, "SUCCESS")
    rows = {(r.sku, r.warehouse_id): r for r in target.read().collect()}
    a = rows[("ABC-123", "W-001")]
    assert (a.quantity_on_hand, a.quantity_reserved, a.unit_cost, a.cost_currency) == (12, 3, Decimal("12.00"), "USD")
    assert rows[("SKU-1", "W-002")].unit_cost == Decimal("5.50")


def test_item_end_to_end(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "items.csv")
    with open(p, "w") as fh:
        fh.write("item_key,item_name,desc,unit_price,man_country,supplier,unit\n"
                 "i00001,Tomato  Soup,tasty   soup,11.5,colombia,acme imports,CANS\n"
                 "I00002,Rice,,2.25,peru,rice co,BAGS\n"
                 "I00003,Beans,,-1.00,mexico,bean co,CANS\n"
                 "I00004,Oil,,7,chile,oil co,BOTTLES\n")
    cfg = builtin("item", {"SLUICE_ITEM_SOURCE_PATH": p})
    target = load.BucketedTable(spark, os.path.join(tmpdir_path, "item_t"), cfg.target.business_key, 4)
    res = pipelines.run_pipeline(spark, cfg, sources.extract(spark, cfg.source), target, AS_OF, "e1")
    assert (res.read, res.loaded, res.rejected, res.status) == (4, 3, 1, "PARTIAL")
    r = {x.item_key: x for x in target.read().collect()}["I00001"]
    assert (r.supplier_name, r.unit, r.unit_price, r.description, r.manufacturer_country) == (
        "Acme Imports", "cans", Decimal("11.50"), "tasty soup", "Colombia")
    rej = res.rejects().first()
    assert rej._step == "TRANSFORM" and rej.errors[0].message == "unit_price must be non-negative"


def test_item_target_constraints_reject_per_row(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "items.csv")
    with open(p, "w") as fh:
        fh.write("item_key,item_name,desc,unit_price,man_country,supplier,unit\n"
                 "I1,Soup,,1.5,peru,acme,CANS\nI2,A very long item name,,2,peru,acme,BAGS\n")
    cfg = builtin("item", {"SLUICE_ITEM_SOURCE_PATH": p})
    cfg.target.max_lengths = {"item_name": 10}
    cfg.target.fail_fast_on_chunk_error = False
    cfg.validation.error_threshold_percent = 100.0
    target = load.BucketedTable(spark, os.path.join(tmpdir_path, "item_t"), cfg.target.business_key, 4)
    res = pipelines.run_pipeline(spark, cfg, sources.extract(spark, cfg.source), target, AS_OF, "e1")
    assert (res.read, res.loaded, res.rejected, res.status) == (2, 1, 1, "PARTIAL")
    rej = res.rejects().first()
    assert rej._step == "LOAD" and rej.errors[0].rule == "LENGTH_CONSTRAINT"
    cfg.target.fail_fast_on_chunk_error = True
    res2 = pipelines.run_pipeline(spark, cfg, sources.extract(spark, cfg.source), target, AS_OF, "e2")
    assert res2.status == "FAILED"


def test_generic_pipeline_and_cumulative_gate(spark, tmpdir_path):
    from sluice.plans.config import load_yaml

    p = os.path.join(tmpdir_path, "g.csv")
    with open(p, "w") as fh:
        fh.write("Order ID,Amount,Status\nA1,10.005,open\nA2,abc,open\nA3,5,weird\nA4,7,OPEN\n")
    yml = f"""
pipeline:
  id: generic-1
  name: generic-orders
  source-config: {{type: CSV, location: "{p}"}}
  target-config: {{load-strategy: INSERT, business-key: [order_id]}}
  validation-config:
    mandatory-columns: [Order ID]
    error-threshold-percent: 30
    threshold-scope: cumulative
  transformation-config:
    monetary-fields: [amount]
    rounding-fields: [amount]
    code-mappings: {{status: {{open: OPEN, OPEN: OPEN}}}}
    mapping-policies: {{status: REJECT}}
"""
    cfg = load_yaml(yml)
    target = load.BucketedTable(spark, os.path.join(tmpdir_path, "g_t"), ["order_id"], 4)
    res = pipelines.run_pipeline(spark, cfg, sources.extract(spark, cfg.source), target, AS_OF, "e1")
    # two transform rejects (bad amount, unmapped status): 50 % of the input breaks the cumulative 30 % gate
    assert res.status == "FAILED" and res.reports["cumulative"].rejected == 2
    cfg.validation.threshold_scope = "step"  # as coded in the reference: transform rejects never count
    res = pipelines.run_pipeline(spark, cfg, sources.extract(spark, cfg.source), target, AS_OF, "e2")
    assert (res.read, res.loaded, res.rejected, res.status) == (4, 2, 2, "PARTIAL")
    amounts = {r.order_id: r.amount for r in target.read().collect()}
    assert amounts == {"A1": Decimal("10.01"), "A4": Decimal("7.00")}
