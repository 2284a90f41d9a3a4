"""Definitions of measures on small inputs, with values worked out by hand."""

import pytest

from plumbline.plans import core
from plumbline.plans.core import RELATIONS, SPARK, over

EXACT = [float(k) for k in range(1, 25)]
#: The tenth item scores 12.5 and the fifth 13.5: five pairs across the boundary are inverted, items 10 and 11 come in.
COARSE = [13.5 if k == 4 else 12.5 if k == 9 else d for k, d in enumerate(EXACT)]
#: Only the tenth item is overtaken, by item 10.
FINE = [11.5 if k == 9 else d for k, d in enumerate(EXACT)]


def pools(spark, models, truth=range(10), sfx=""):
    """``ranked``, ``perq``, ``inversions`` and more of one query."""
    rows = [(0, k, k, d, m, s[k]) for m, s in models.items() for k, d in enumerate(EXACT)]
    scored = spark.createDataFrame(rows, "query_id long, pos long, base_id long, exact double, model string, score double")
    gt = spark.createDataFrame([(0, i, float(k), k + 1) for k, i in enumerate(truth)], "query_id long, base_id long, d double, rk int")
    made = {f"scored{sfx}": scored, "gt": gt}
    for name in ("ranked", "perq", "inversions"):
        made[f"{name}{sfx}"] = over(spark, RELATIONS[f"{name}{sfx}"].body(SPARK), made)
    return made


@pytest.fixture(scope="module")
def two(spark):
    made = pools(spark, {"coarse": COARSE, "fine": FINE})
    made["random_pairs"] = over(spark, RELATIONS["random_pairs"].body(SPARK), made)
    return made | {"metrics": over(spark, RELATIONS["metrics"].body(SPARK), made)}


def run(spark, name, made, **where):
    rows = core.run(spark, name, **{n: made[n] for n in core.PLANS[name].needs}).collect()
    return [r for r in rows if all(r[k] == v for k, v in where.items())]


def test_boundary(spark, two):
    (r,) = run(spark, "boundary_inversions", two, model="coarse")
    assert (r["inversions"], r["overtaken_items"], r["max_overtakers"], r["max_violation"]) == (5, 2, 3, 2.5) and r["fraction"] == pytest.approx(5 / 140)
    calm = pools(spark, {"coarse": EXACT})
    calm["random_pairs"] = over(spark, RELATIONS["random_pairs"].body(SPARK), calm)
    calm["metrics"] = over(spark, RELATIONS["metrics"].body(SPARK), calm)
    (r,) = run(spark, "boundary_inversions", calm)
    assert (r["inversions"], r["max_violation"]) == (0, -1.0)  # the nearest pair across the boundary, still in order
    (r,) = run(spark, "intruder_overtakes", calm)
    assert (r["overtakes"], r["most_over_one"]) == (0, 0)
    (r,) = run(spark, "intruder_overtakes", two, model="coarse")
    assert (r["overtakes"], r["most_over_one"]) == (4, 2)


def test_errors(spark, two):
    (r,) = run(spark, "candidate_errors", two, model="coarse")
    assert r["mae"] == pytest.approx(11 / 24) and (r["window_mae"], r["window_max"], r["error_per_margin"], r["boundary_advantage"], r["overtaken"]) == (1.0, 8.5, 1.0, 2.5, True)
    assert (r["within_1"], r["within_5"], r["within_10"], r["cross_pairs"], r["omitted"]) == (0, 0, 1, 140, 0)


def test_transition(spark, two):
    (r,) = run(spark, "precision_transition", two)
    flags = ("stable_both", "rescued_improved", "persistent_harmful", "regressed", "fully_rescued", "partially_improved_persistent", "unchanged_harmful")
    assert (r["coarse_loss"], r["fine_loss"], r["delta_loss"]) == (2, 1, 1) and [r[f] for f in flags] == [False, True, True, False, False, True, False]
    assert (r["delta_inversions"], r["delta_displaced"], r["delta_max_violation"]) == (4, 1, 2.0)
    assert r["delta_window_mae"] == pytest.approx(1 - 1.5 / 11) and r["delta_mae"] == pytest.approx(9.5 / 24) and r["delta_fraction"] == pytest.approx(4 / 140)
    (r,) = run(spark, "inversion_transition", two)
    assert (r["corrected_pairs"], r["persistent_pairs"], r["new_pairs"]) == (4, 1, 0) and r["coarse_adds_up"] and r["fine_adds_up"]
    assert (r["corrected_small_margin"], r["corrected_large_margin"], r["corrected_near_boundary"]) == (0, 4, 4)
    assert (r["persistent_small_margin"], r["persistent_large_margin"], r["persistent_near_boundary"]) == (0, 0, 1)


def test_score_observables(spark, two):
    (r,) = run(spark, "score_observables", two, model="coarse")
    assert (r["g10_11"], r["g9_12"], r["w1"], r["w2"], r["w5"]) == (0.5, 2.0, 1, 1, 2)
    assert r["relative_g10_11"] == pytest.approx(0.5 / 12) and r["relative_g9_12"] == pytest.approx(2 / 12)


def test_residuals(spark, two):
    (r,) = run(spark, "residual_regions", two, model="coarse", region="top5")
    assert (r["n"], r["mean_residual"], r["mae"], r["sd"], r["variance"], r["abs_p50"], r["abs_p90"], r["abs_p95"]) == (5, 1.7, 1.7, 3.4, 11.56, 0.0, 5.1, 6.8)


def test_random_pairs_are_different_pairs(spark, two):
    """The bijection gives 512 different pairs of 128 places, and other ones to other queries."""
    n = 128
    rows = [(q, k, k, float(k), "m", float(k)) for q in range(4) for k in range(n)]
    scored = spark.createDataFrame(rows, "query_id long, pos long, base_id long, exact double, model string, score double")
    text = RELATIONS["random_pairs"].body(SPARK)
    drawn = over(spark, text[: text.index("SELECT a.query_id, a.model")] + "SELECT query_id, i, j FROM p", {"scored": scored}).collect()
    by = {}
    for r in drawn:
        assert 0 <= r["i"] < r["j"] < n
        by.setdefault(r["query_id"], set()).add((r["i"], r["j"]))
    assert [len(v) for v in by.values()] == [512] * 4 and len(set.union(*by.values())) > 1200
    got = over(spark, text, {"scored": scored}).collect()
    assert all((r["inverted"], r["ties"], r["pairs"]) == (0, 0, 512) for r in got) and len(got) == 4


FIVE = {"s0": COARSE, "s1": FINE, "s2": EXACT, "s3": EXACT, "s4": EXACT}


def test_loss_attribution(spark):
    made = pools(spark, FIVE, sfx="5")
    got = {(r["model"], r["pair_class"]): r["loss"] for r in run(spark, "loss_attribution", made)}
    assert got == {("s0", "minority"): 0.05, ("s0", "one-off"): 0.15, ("s1", "minority"): 0.1}
    made = pools(spark, FIVE, truth=[*range(9), 10], sfx="5")
    rows = run(spark, "loss_attribution", made, model="s0")
    assert {r["pair_class"]: r["loss"] for r in rows} == {"one-off": 0.1, "intruder credit": -0.1} and all(r["adds_up"] for r in rows)


def test_a_loss_by_ties_is_unassigned(spark):
    """The tenth item scores as the eleventh and comes later in the pool, so no strict inversion explains its loss."""
    tied = [11.0 if k in (9, 10) else d for k, d in enumerate(EXACT)]
    made = pools(spark, {f"s{k}": tied for k in range(5)}, sfx="5")
    swapped = made["ranked5"].selectExpr("query_id", "model", "pos", "base_id", "exact", "score", "er", "CASE er WHEN 10 THEN 11L WHEN 11 THEN 10L ELSE sr END AS sr", "in_gt")
    made |= {"ranked5": swapped}
    made |= {n: over(spark, RELATIONS[n].body(SPARK), made) for n in ("perq5", "inversions5")}
    rows = run(spark, "loss_attribution", made)
    assert {(r["pair_class"], r["loss"], r["adds_up"]) for r in rows} == {("unassigned", 0.1, True)} and len(rows) == 5


def perq(spark, losses, columns="query_id long, model string, loss_hits long"):
    return spark.createDataFrame(losses, columns)


def test_factorial(spark):
    rows = [(0, f"r{r}{i}", (i + 1 if r == 0 else 0)) for r in range(5) for i in range(3)]
    (r,) = core.run(spark, "factorial_variance", perq15=perq(spark, rows)).collect()
    want = {"mean_loss": 0.4, "within": 2 / 15, "rotation": 0.64, "init": 2 / 75, "interaction": 8 / 75, "total": 58 / 75, "within_sample": 0.2, "rotation_sample": 0.8, "signed_contrast": 0.8 - 0.2 / 3}
    assert {k: r[k] for k in want} == pytest.approx(want, abs=1e-8) and r["adds_up"] and r["nested_adds_up"]
    assert (r["harmful_rotations"], r["harmful_models"], r["category"]) == (1, 3, "occasionally vulnerable")


@pytest.mark.parametrize(
    "a,b,want",
    [([3, 2, 2, 0], [0, 2, 2, 3], (1, 0.0, 0.0, 0.0, 3, 3, 1, 1)), ([2, 2, 0, 0], [2, 0, 0, 2], (1, 1.0, 0.25, round(1 / 3, 9), 2, 2, 2, 2)), ([5, 4, 1, 1, 0, 0, 0, 0], [5, 0, 1, 1, 1, 0, 0, 0], (2, 0.5, 0.5, 0.2, 4, 1, 1, 3))],
)
def test_severity(spark, a, b, want):
    losses = [(q, m, x) for m, xs in (("coarse", a), ("fine", b)) for q, x in enumerate(xs)]
    severity = RELATIONS["severity"].build(spark, None, lambda name: perq(spark, losses))
    (r,) = core.run(spark, "severity_sets", severity=severity).collect()
    assert tuple(r[c] for c in ("size", "overlap", "expected_overlap", "tie_inclusive_jaccard", "cutoff_a", "cutoff_b", "cutoff_ties_a", "cutoff_ties_b")) == want


def test_closure(spark):
    nulls = [(0, m, c, k, x, 0) for m in ("coarse", "fine") for k in range(2) for c, x in (("N0", 4 + 2 * k), ("N1", 3))]
    nulls = spark.createDataFrame(nulls, "query_id long, model string, condition string, draw long, loss_hits long, displaced long")
    seen = perq(spark, [(0, "coarse", 2), (0, "fine", 5)])
    by = {(r["model"], r["draw"]): r["closure"] for r in core.run(spark, "draw_closure", nulls=nulls, perq=seen).collect() if r["condition"] == "N1"}
    assert by == {("coarse", 0): 0.5, ("coarse", 1): 0.75, ("fine", 0): None, ("fine", 1): 3.0}  # 4 - 5 isn't positive
    got = {r["model"]: r for r in core.run(spark, "gap_closure", nulls=nulls, perq=seen).collect() if r["condition"] == "N1"}
    assert (got["coarse"]["closure"], got["coarse"]["mean_closure"], got["coarse"]["closed_draws"]) == (round(2 / 3, 9), 0.625, 2)
    assert (got["fine"]["closure"], got["fine"]["closed_draws"], got["fine"]["mean_closure"]) == (None, 1, 3.0)
    models = {r["draw"]: r for r in core.run(spark, "null_models", nulls=nulls).collect() if r["condition"] == "N0"}
    assert (models[1]["mean"], models[1]["sd_models"], models[1]["models"]) == (6.0, 0.0, 2)


def test_replacement_pairs_against_draws(spark, two):
    """Item 9 went for item 10: errors 2.5 and 0, margin 1; draws give it 0, 1, 2 and 3 more."""
    rows = [(0, k, i, float(k) if i == 9 else 0.0) for k in range(4) for i in range(24)]
    shuffled = spark.createDataFrame(rows, "query_id long, draw long, base_id long, e double")
    made = pools(spark, {"coarse": FINE})
    (r,) = core.run(spark, "replacement_null", shuffled=shuffled, ranked=made["ranked"]).collect()
    assert (r["displaced"], r["intruder"], r["margin"], r["observed"], r["violation"]) == (9, 10, 1.0, 1.5, 0.5)
    assert (r["null_mean"], r["null_median"], r["null_inverted"]) == (1.5, 1.5, 0.5) and r["null_p95"] == pytest.approx(2.85) and r["null_sd"] == pytest.approx(1.290994449)


def test_candidate_diagnostics(spark, two):
    """Refining the best 16 brings the fifth and the tenth item back, and takes items 10 and 11 out."""
    policies = spark.createDataFrame([(0, 0.1, "gap", 0, 8, 10, 10, 1)], "query_id long, f double, policy string, rep long, native_hits long, refined_hits long, oracle_hits long, chosen long")
    got = {r["depth"]: r for r in core.run(spark, "candidate_diagnostics", ranked=two["ranked"], policies=policies).collect()}
    r = got[16]
    assert (r["members_added"], r["wrong_removed"], r["members_beyond"], r["new_results"]) == (2.0, 2.0, 0.0, 2)
    assert (r["new_rank_median"], r["rescued_rank_median"]) == (7.5, 7.5) and r["new_rank_p95"] == pytest.approx(9.75) and set(got) == {16, 32, 64}


def test_overhead_against_the_native_policy(spark):
    rows = [(p, w, 0, k, us * (1 if k else 2)) for p, us in (("a", 100.0), ("b", 110.0)) for w in (1, 2) for k in range(100)]
    latency = spark.createDataFrame(rows, "policy string, workers long, rep long, query_id long, us double")
    got = core.run(spark, "relative_overhead", latency=latency).collect()
    assert {(r["policy"], r["native"], r["workers"], r["mean_overhead"], r["p95_overhead"], r["p99_ratio"], r["throughput_penalty"]) for r in got} == {("b", "a", w, 0.1, 0.1, 1.1, round(1 - 100 / 110, 6)) for w in (1, 2)}
    assert {(r["speedup"], r["efficiency"]) for r in core.run(spark, "scaling", latency=latency).collect() if r["workers"] == 2} == {(2.0, 1.0)}


def test_scaling_has_overhead_and_tail(spark):
    """Two workers take 110 instead of 100 on average, and their slowest query 200 instead of 100."""
    rows = [("a", w, 0, k, 100.0 if w == 1 else 200.0 if k == 9 else 100.0) for w in (1, 2) for k in range(10)]
    latency = spark.createDataFrame(rows, "policy string, workers long, rep long, query_id long, us double")
    got = {r["workers"]: r for r in core.run(spark, "scaling", latency=latency).collect()}
    assert (got[2]["overhead"], got[2]["p99_ratio"]) == (0.1, 1.91) and (got[1]["overhead"], got[1]["p99_ratio"]) == (0.0, 1.0)


def test_service_gates(spark):
    us = {"a native": 100.0, "b bounded": 104.0, "c full": 110.0, "d bounded all": 106.0, "e full all": 120.0}
    latency = spark.createDataFrame([(p, 1, 0, 0, x) for p, x in us.items()], "policy string, workers long, rep long, query_id long, us double")
    refined = spark.createDataFrame([(q, 16, 5, 9 if q == 0 else 6) for q in range(4)], "query_id long, l long, native_hits long, refined_hits long")
    gaps = spark.createDataFrame([(q, float(q)) for q in range(4)], "query_id long, gap double")
    (r,) = core.run(spark, "service_gates", latency=latency, refined=refined, gaps=gaps).collect()
    assert (r["overhead_reduction"], r["overhead_gate"], r["meaningful"]) == (0.6, True, True) and r["latency_saving"] == pytest.approx(1 - 106 / 120, abs=1e-6)
    assert r["gain_retained"] == pytest.approx(4 / 7) and r["gap_saving"] == pytest.approx(1 - (0.25 * 106 + 0.75 * 104) / 106, abs=1e-6) and not r["selective_gate"]


def test_normalized(spark):
    rows = [(0, [3.0] + [0.0] * 62 + [4.0], 0), (1, [0.0] * 64, 0), (2, [float("nan")] + [1.0] * 63, 0), (3, [float("inf")] + [1.0] * 63, 0), (4, [1.0] + [0.0] * 62 + [3.0], 0)]
    got = {r["vec_id"]: r for r in core.run(spark, "normalized", vectors=spark.createDataFrame(rows, "vec_id long, e array<double>, label long")).collect()}
    assert [got[k]["stored"] for k in range(5)] == [True, False, False, False, True] and (got[0]["norm"], got[1]["norm"], got[3]["first"]) == (5.0, None, None)
    assert got[0]["first"] == round(float.fromhex("0x1.333334p-1"), 9)  # 0.6 as a FLOAT


def test_all_starts(spark):
    rows = [(0, f"g{i}{j}", 1, 2) for i, j in [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0)]]
    (r,) = core.run(spark, "grid_inversion_union", inversions9=spark.createDataFrame(rows, "query_id long, model string, inside_id long, outside_id long")).collect()
    assert (r["models"], r["majorities"], r["all_starts"], r["pairs"]) == (6, 2, 1, 1)
