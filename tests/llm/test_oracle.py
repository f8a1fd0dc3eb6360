import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "scripts"))

from check_oracle import TABLES, rows_of  # noqa: E402

from sluice.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    ours = queries.QUERIES[name](spark, SF)
    theirs = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert rows_of(ours.columns, [tuple(r) for r in ours.collect()]) == rows_of(columns, theirs.fetchall())
