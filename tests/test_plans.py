"""Every plan with SQL gives what DuckDB gives on the same tables."""

import duckdb
import pytest

from plumbline.plans import core, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_duckdb(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted((tuple(r[c] for c in want.columns) for r in got.collect()), key=str)
    assert rows == sorted(want.fetchall(), key=str)
    assert rows or name == "loss_attribution"


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_every_plan_names_what_it_covers():
    assert all(p.ids for p in core.PLANS.values())


def test_exact_search_makes_no_pairs(spark):
    from plumbline.operators.knn import exact_top_k

    text = exact_top_k(core.get(spark, SF, "queries"), core.get(spark, SF, "base"), 10)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text and "WindowGroupLimit" in text


def test_scan_prunes_and_pushes(spark):
    text = core.get(spark, SF, "queries")._jdf.queryExecution().toString()
    assert "props" not in text and "PushedFilters: [" in text
