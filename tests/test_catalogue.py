"""Every catalogue query with SQL gives the SQL's rows on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return "nan" if math.isnan(v) else repr(round(float(v), 6))
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def names():
    from quillon.plans import QUERIES, SQL

    return [pytest.param(n, n in SQL, id=n) for n in QUERIES]


@pytest.mark.parametrize(("name", "has_sql"), names())
def test_query(spark, duck, sf, name, has_sql):
    from quillon.plans import QUERIES, SQL

    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()]
    if not has_sql:
        assert got
        return
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    assert sorted(map(str, got)) == sorted(str(tuple(map(plain, r))) for r in want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_plans_push_down(spark, sf):
    from quillon.plans import QUERIES

    def plan(name):
        return QUERIES[name](spark, sf)._jdf.queryExecution().toString()

    assert "PushedFilters: [IsNotNull" in plan("sem_topk_filtered") and "TakeOrderedAndProject" in plan("sem_topk")
    assert "WindowGroupLimit" in plan("sem_best_per_source")
    assert "CartesianProduct" not in plan("orphans_not_in") and "NestedLoop" not in plan("not_exists_one")
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in plan("by_year_month")


def test_pivot_join_deals_rows_by_their_number(spark, tmp_path, monkeypatch):
    """Tasks follow the number of lines; keys that occur twice or are null count as in the SQL."""
    from quillon.operators import relational as R
    from quillon.plans import QUERIES, SQL

    made = {
        "orders": ("o_orderkey long, o_orderpriority string", [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, None), (None, "a"), (4, "b")]),
        "lineitem": ("l_orderkey long, l_partkey long", [(1, 1), (1, 1), (1, 2), (2, 9), (2, None), (None, 1), (4, 3)] * 9),
        "part": ("p_partkey long, p_brand string", [(1, "x"), (1, "x"), (1, "y"), (2, "y"), (3, None), (None, "z")]),
    }
    c = duckdb.connect()
    for name, (kind, rows) in made.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    monkeypatch.setattr(R, "TASK_ROWS", 5)
    df = QUERIES["pivot_join"](spark, str(tmp_path))
    assert "hashpartitioning(l_orderkey" in (plan := df._jdf.queryExecution().toString()) and ", 13), REPARTITION_BY_NUM" in plan
    key = lambda r: tuple(map(str, r))
    want = c.sql(SQL["pivot_join"]).select("o_orderpriority", "p_brand", "n", "orders").fetchall()
    assert sorted(map(key, df.select("o_orderpriority", "p_brand", "n", "orders").collect())) == sorted(map(key, want))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
