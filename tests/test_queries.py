"""Every registered query equals its SQL on the same Parquet (DuckDB)."""

import duckdb
import pytest

import __spark_entry__ as driver

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
QUERIES, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    res = duck.execute(SQL[name])
    names = [d[0] for d in res.description]
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in res.fetchall()), key=key)
    assert sorted(names) == cols
    assert got == want


def test_entry(spark):
    assert driver.entry(spark).count() == 200


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_ridge_query_runs(spark, sf_dir):
    model = {r["feature"]: r for r in QUERIES["ridge_fit"](spark, sf_dir).collect()}
    assert model["__meta__"]["n"] > 100
    assert any(f.startswith("own_pick:") for f in model)


STREAMS = {n for n in QUERIES if n.endswith("_stream")}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS - {"ridge_fit"}))
def test_plan_is_distributed(spark, sf_dir, name):
    """No nested-loop or cross join and no Python in any batch plan."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for word in ("BroadcastNestedLoopJoin", "CartesianProduct", "ArrowEvalPython", "BatchEvalPython", "MapInPandas",
                 "FlatMapGroupsInPandas"):
        assert word not in plan
