"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from sluice.plans import registry

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set TimeZone='UTC'")
    for f in os.listdir(DIR):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, float):
        return "%.8g" % v
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    out = QUERIES[name](spark, DIR)
    mine = sorted(tuple(plain(r[c]) for c in sorted(out.columns)) for r in out.collect())
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == sorted(out.columns)
    assert mine == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def test_queries_without_sql_run(spark):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, DIR).count() >= 0


def test_centres_gather_no_vectors(spark):
    from sluice.plans import fields

    found = fields._centres(spark, DIR)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").toPandas()
    firsts = rows.sort_values("vec_id").groupby("label").head(2)
    assert sorted((r.label, list(r.vector)) for r in found.collect()) == sorted((r.label, list(r.embedding)) for r in firsts.itertuples())
