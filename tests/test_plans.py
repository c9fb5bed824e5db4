"""Every plan with SQL against that SQL in DuckDB, on the smallest tables; the plans' shapes; and the driver's contract."""

import os

import pytest

import __spark_entry__
from strandex import plans

duckdb = pytest.importorskip("duckdb")
SQL = plans.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "hour") else v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, con, data, name):
    df = __spark_entry__.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = con.execute(SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in order) for r in rel.fetchall())
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(SQL)))
def test_runs(spark, data, name):
    rows = plans.queries()[name](spark, data).collect()
    assert rows and all(any(v is not None for v in r) for r in rows) and len({tuple(map(str, r)) for r in rows}) == len(rows)
    spark.catalog.clearCache()


def test_entry(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert __spark_entry__.entry(spark).columns == ["doc_id", "score"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_shapes(spark, data):
    q = plans.queries()
    top = plan(q["vector_top_k"](spark, data))
    assert "TakeOrderedAndProject" in top and "Exchange" not in top
    assert "TakeOrderedAndProject" in plan(q["keyset_page_orders"](spark, data)) and "PushedFilters: [Or" in plan(q["keyset_page_orders"](spark, data))
    files = plan(q["search_filters"](spark, data))
    assert "ReadSchema: struct<id:string,file_name:string,source_path:string,modified_utc:timestamp>" in files and "StringStartsWith(sourc" in files
    for name in ("latest_job", "issue_lifecycles", "context_window"):
        assert "CartesianProduct" not in plan(q[name](spark, data)) and "NestedLoop" not in plan(q[name](spark, data))
    assert "Window" not in plan(q["latest_job"](spark, data))
