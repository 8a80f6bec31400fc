"""Every registered vector and text query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from vexel.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("embeddings", "documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, name):
    got = QUERIES[name](spark, DATA)
    rel = con.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(rel.columns)
    order = [rel.columns.index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr([r[k] for k in order]) for r in rel.fetchall())


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


def test_single_query_plan_keeps_k_rows_and_prunes(spark, capsys):
    QUERIES["knn_cosine"](spark, DATA).explain("formatted")
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan and "Join" not in plan and "label" not in plan


def test_filters_reach_the_file(spark, tmp_path, capsys):
    from vexel.operators import VectorStore

    VectorStore(spark).add([("a", [1.0])]).save(f"{tmp_path}/s")
    VectorStore.load(spark, f"{tmp_path}/s").get("a").explain("formatted")
    assert "EqualTo(id,a)" in capsys.readouterr().out
