"""Checks of the ground truth look at the whole base."""

from plumbline.operators import knn
from plumbline.plans import core


def relations(spark):
    at = lambda x: [float(x)] + [0.0] * 63
    queries = spark.createDataFrame([(0, at(0), 0)], "query_id long, qe array<double>, q_label long")
    base = spark.createDataFrame([(k, at(k), 0) for k in range(1, 10)] + [(k, at(10), 0) for k in range(11, 61)] + [(99, at(20), 0)], "base_id long, be array<double>, b_label long")
    return queries, base


def test_all_ties_at_the_tenth_distance_count(spark):
    queries, base = relations(spark)
    gt = knn.exact_top_k(queries, base, 11)
    got = core.run(spark, "range_neighbors", gt=gt, queries=queries, base=base).collect()
    assert [(r["query_id"], r["d10"], r["closer"], r["tied"]) for r in got] == [(0, 100.0, 9, 50)]
    asked = queries.selectExpr("query_id AS id", "qe AS vector", "100D AS bound")
    blocks = knn.count_within(asked, base.selectExpr("base_id AS id", "be AS vector"), block=7).collect()
    assert [(r["closer"], r["tied"]) for r in blocks] == [(9, 50)]


def test_second_ground_truth_finds_what_the_first_missed(spark):
    queries, base = relations(spark)
    gt = knn.exact_top_k(queries, base.filter("base_id <> 1"), 11)
    got = core.run(spark, "gt_disagreement", gt=gt, queries=queries, base=base).collect()
    assert [(r["query_id"], r["missing"], r["extra"], r["within"]) for r in got] == [(0, 1, 1, True)]
