"""The queries that SQL can express against DuckDB, on the smallest tables."""

import duckdb
import pytest

from tesserae.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    relation = con.execute(ORACLES[name])
    columns = [c[0] for c in relation.description]
    df = QUERIES[name](spark, FOLDER)
    assert sorted(columns) == sorted(df.columns)
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    want = sorted(str([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in relation.fetchall())
    assert sorted(str([plain(r[c]) for c in sorted(columns)]) for r in df.collect()) == want
