import duckdb
import pytest

from rillwave import queries

NAMES = ["ema", "cti", "hl_normalizer", "roofing", "reflex", "reflex_w9", "long_cti", "long_hl_normalizer", "fisher", "pfe", "tree_readme", "final_values", "ready_rows", "orders_rsi"]


def test_each_query_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql()) and len(queries.queries()) > 50


@pytest.mark.parametrize("name", NAMES)
def test_queries_match_duckdb(spark, name):
    sf = "/root/testdata/sf0.001"
    df = queries.queries()[name](spark, sf)
    con = duckdb.connect()
    for table in ("events", "orders"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    key = lambda row: [(x is not None, round(x, 6) + 0.0 if isinstance(x, float) else x or 0) for x in row]
    assert sorted(map(key, got)) == sorted(map(key, want))
