import math

import duckdb
import pytest

import __spark_entry__ as entry
from tracewell.plans import bound

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    value = lambda v: "null" if v is None else f"{float(v):.6f}" if isinstance(v, float) or hasattr(v, "is_nan") and not math.isnan(v) else str(v)
    return sorted(tuple(map(value, r)) for r in rows)


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(bound.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df, want = bound.queries()[name](spark, DATA), duck.sql(bound.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert plain(df.select(*cols).collect()) == plain(want.select(*(f'"{c}"' for c in cols)).fetchall())
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double"}
    assert {c: kinds.get(str(t), str(t)) for c, t in zip(want.columns, want.types, strict=True)} == dict(df.dtypes)


def test_queries_without_sql_have_rows(spark):
    for name in set(bound.queries()) - set(bound.oracle_sql()):
        assert bound.queries()[name](spark, DATA).columns
