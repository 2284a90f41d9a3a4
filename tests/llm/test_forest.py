"""Nearest neighbours against all pairs, and the pipeline."""

import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import forest, queries

from . import data

SMALL = "/root/testdata/sf0.001"


def _vectors(n=900, d=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((30, d))
    x = centres[rng.integers(0, 30, n)] + 0.5 * rng.standard_normal((n, d))
    x[500:520] = x[10]  # copies
    return x


def test_recall_and_scores(spark):
    x = _vectors()
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = forest.nearest(table, lambda i: i % 10 == 0, block=256).collect()
    norm, hit, total = np.sqrt((x * x).sum(axis=1)), 0, 0
    for q in range(0, len(x), 10):
        rows = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
        score = (x @ x[q]) / (norm * norm[q])
        score[q] = -9
        assert all(abs(score[r["vec_id"]] - r["score"]) < 1e-12 and r["vec_id"] != q for r in rows)
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        hit += len({r["vec_id"] for r in rows} & set(np.lexsort((np.arange(len(x)), -np.round(score, 12)))[:5].tolist()))
        total += 5
    assert hit / total >= 0.9


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (None, [1.0, 2.0]), (9, [1.0]), (100, [0.0, 0.0])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, vector string, id int")
    got = {(r["query_id"], r["vec_id"]) for r in forest.nearest(table, lambda i: i % 50 == 0).collect()}
    assert got == {(0, 50), (0, 3), (50, 0), (50, 3)}
    assert forest.nearest(table.limit(0), lambda i: i % 50 == 0).count() == 0


def test_prefix_ranges_hold_what_shares_the_prefix():
    x = _vectors(200)
    f = forest.Forest(np.arange(200), x, trees=3)
    strings = [forest.hash_strings(x[:7] / np.sqrt((x[:7] ** 2).sum(axis=1))[:, None], p) for p in f.planes]
    for length in (0, 1, 5, 20, 64):
        low, high = f._ranges(strings, np.full(7, length))
        for t in range(3):
            for q in range(7):
                shift = np.uint64(64 - length)
                same = np.ones(200, dtype=bool) if not length else (f.sorted[t] >> shift) == (strings[t][q] >> shift)
                assert np.flatnonzero(same).tolist() == list(range(low[t, q], high[t, q]))


def test_pipeline_stages_keep_columns(spark, tmp_path):
    docs = data.table(spark)
    labels = spark.createDataFrame([(1, 1), (16, 1)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() > 0
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SMALL).collect()
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append(r["length"])
    assert out and all(sum(v) <= 1024 and sum(v) & (sum(v) - 1) == 0 for v in by.values())


@pytest.mark.parametrize("name", ["op8_mix_sources", "op9_quality_rules"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SMALL)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())
