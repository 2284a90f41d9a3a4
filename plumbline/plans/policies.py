"""Plans on refinement under a budget, latencies and Pareto frontiers."""

from __future__ import annotations

from ..functions.skyline import skyline
from .core import over, plan
from .relations import K


@plan("M1", "gaps", "perq")
def score_gaps(d):
    return "SELECT g.query_id, round(gap, 9) AS gap, round(gap / greatest(abs(s10), 1e-12), 9) AS relative_gap FROM pl_gaps g JOIN pl_perq p ON g.query_id = p.query_id AND p.model = 'coarse'"


@plan("M2 T6", "refined")
def refined_hits(d):
    return "SELECT query_id, l AS depth, native_hits, refined_hits, refined_hits - native_hits AS gain FROM pl_refined"


@plan("M3 M4 M5", "policies")
def selected_queries(d):
    return "SELECT query_id, f, policy, rep, CAST(chosen AS BIGINT) AS chosen FROM pl_policies"


@plan("M5 M6", "policies")
def policy_value(d):
    """Value of each policy at each budget, against the mean and the middle 95 % of random orders."""
    quantile = lambda p: f"percentile_cont({p}) WITHIN GROUP (ORDER BY recall)"
    ratio = lambda a, b: f"CASE WHEN {b} > 1e-12 THEN round(({a}) / ({b}), 9) END"
    return f"""WITH v AS (SELECT f, policy, rep, sum(CASE WHEN chosen = 1 THEN refined_hits ELSE native_hits END) / (count(*) * {K}.0E0) AS recall, sum(CASE WHEN chosen = 1 THEN refined_hits - native_hits ELSE 0 END) / (count(*) * {K}.0E0) AS gain,
        16.0E0 * sum(chosen) / count(*) AS evals, sum(oracle_hits - native_hits) / (count(*) * {K}.0E0) AS missing FROM pl_policies GROUP BY f, policy, rep),
      r AS (SELECT f, round(avg(recall), 12) AS mean, {quantile(0.025)} AS p025, {quantile(0.975)} AS p975 FROM v WHERE policy = 'random' GROUP BY f), o AS (SELECT f, recall AS best FROM v WHERE policy = 'oracle'),
      a AS (SELECT f, policy, round(avg(recall), 12) AS recall, round(avg(gain), 12) AS gain, avg(evals) AS evals, max(missing) AS missing FROM v GROUP BY f, policy)
      SELECT a.f, a.policy, round(recall, 9) AS recall, round(gain, 9) AS gain, round(evals, 9) AS evals, {ratio('gain', 'missing')} AS recovery, {ratio('gain', 'evals')} AS gain_per_eval, round(mean, 9) AS random_mean, round(p025, 9) AS random_p025, round(p975, 9) AS random_p975,
        {ratio('recall - mean', 'best - mean')} AS efficiency, recall > p975 + 1e-12 AS exceeds_random FROM a JOIN r ON a.f = r.f JOIN o ON a.f = o.f"""


@plan("M7", "gaps", "refined")
def frozen_threshold(d):
    """A threshold from half of the queries, applied to the other half."""
    return f"""WITH t AS (SELECT percentile_cont(0.25) WITHIN GROUP (ORDER BY gap) AS tau FROM pl_gaps WHERE floor(query_id / 20) % 2 = 0)
      SELECT round(max(tau), 9) AS tau, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN gap <= tau THEN 1 ELSE 0 END) AS BIGINT) AS refined, round(sum(CASE WHEN gap <= tau THEN refined_hits ELSE native_hits END) / (count(*) * {K}.0E0), 9) AS recall
      FROM pl_gaps g CROSS JOIN t JOIN pl_refined r ON g.query_id = r.query_id AND l = 16 WHERE floor(g.query_id / 20) % 2 = 1"""


@plan("M8", "ranked", "gaps")
def refinement_modes(d):
    """Six modes of service. What is retained: nothing, the whole pool, or the best 16; what is refined: none, all, or by the gap.

    A full pool and a bounded one are retained in their own ways, so that their equality is a test.
    """
    top = f"CAST(sum(CASE WHEN sr <= {K} THEN in_gt ELSE 0 END) AS BIGINT)"
    fine = lambda rows: f"SELECT query_id, CAST(sum(CASE WHEN rr <= {K} THEN in_gt ELSE 0 END) AS BIGINT) AS hits FROM (SELECT query_id, in_gt, row_number() OVER (PARTITION BY query_id ORDER BY exact, pos) AS rr FROM ({rows}) AS s_) AS t_ GROUP BY query_id"
    whole = "SELECT f.* FROM p f JOIN (SELECT query_id, max(score) AS worst, max(sr) AS last FROM p WHERE sr <= 16 GROUP BY query_id) c ON f.query_id = c.query_id WHERE f.score < c.worst OR (f.score = c.worst AND f.sr <= c.last)"
    return f"""WITH p AS (SELECT query_id, pos, exact, score, sr, in_gt FROM pl_ranked WHERE model = 'coarse'), b AS (SELECT * FROM p WHERE sr <= 16),
      t AS (SELECT percentile_cont(0.25) WITHIN GROUP (ORDER BY gap) AS tau FROM pl_gaps), n AS (SELECT query_id, {top} AS hits, CAST(count(*) AS BIGINT) AS pool FROM p GROUP BY query_id),
      k AS (SELECT query_id, {top} AS hits, CAST(count(*) AS BIGINT) AS kept FROM b GROUP BY query_id), fa AS ({fine(whole)}), ba AS ({fine('SELECT * FROM b')}),
      x AS (SELECT n.query_id, n.hits AS native, n.pool, k.hits AS bounded, k.kept, fa.hits AS full_all, ba.hits AS bounded_all, g.gap <= t.tau AS near FROM n JOIN k ON n.query_id = k.query_id JOIN fa ON n.query_id = fa.query_id JOIN ba ON n.query_id = ba.query_id JOIN pl_gaps g ON n.query_id = g.query_id CROSS JOIN t),
      m AS (SELECT 'native' AS mode, native AS hits, 0 AS retained, 0 AS evals, native AS same FROM x UNION ALL SELECT 'full', native, pool, 0, bounded FROM x UNION ALL SELECT 'bounded', bounded, kept, 0, native FROM x
        UNION ALL SELECT 'full all16', full_all, pool, 16, bounded_all FROM x UNION ALL SELECT 'bounded all16', bounded_all, kept, 16, full_all FROM x
        UNION ALL SELECT 'gap bounded', CASE WHEN near THEN bounded_all ELSE bounded END, kept, CASE WHEN near THEN 16 ELSE 0 END, CASE WHEN near THEN full_all ELSE native END FROM x)
      SELECT mode, round(sum(hits) / (count(*) * {K}.0E0), 9) AS recall, round(avg(retained), 9) AS retained, round(avg(evals), 9) AS evals, CAST(sum(CASE WHEN hits = same THEN 0 ELSE 1 END) AS BIGINT) AS differing FROM m GROUP BY mode"""


@plan("M12", "latency", "refined", "gaps")
def service_gates(d):
    """Gates on latency and recall. Event types stand in for the modes' traces, in order of their names; the gap policy takes the refined mode's time for the queries it refines, and the bounded one's for the others."""
    ratio = lambda a, b: f"CASE WHEN {b} > 1e-9 THEN ({a}) / ({b}) END"
    return f"""WITH t AS (SELECT percentile_cont(0.25) WITHIN GROUP (ORDER BY gap) AS tau FROM pl_gaps),
      h AS (SELECT avg(native_hits) / {K}.0E0 AS native, avg(refined_hits) / {K}.0E0 AS all16, avg(CASE WHEN gap <= tau THEN refined_hits ELSE native_hits END) / {K}.0E0 AS gap, avg(CASE WHEN gap <= tau THEN 1.0E0 ELSE 0.0E0 END) AS refined FROM pl_refined r JOIN pl_gaps g ON r.query_id = g.query_id CROSS JOIN t WHERE l = 16),
      o AS (SELECT policy, avg(us) AS us, row_number() OVER (ORDER BY policy) AS r FROM pl_latency GROUP BY policy),
      m AS (SELECT max(CASE WHEN r = 1 THEN us END) AS native, max(CASE WHEN r = 2 THEN us END) AS bounded, max(CASE WHEN r = 3 THEN us END) AS full_, max(CASE WHEN r = 4 THEN us END) AS bounded_all, max(CASE WHEN r = 5 THEN us END) AS full_all FROM o),
      g AS (SELECT m.*, h.native AS native_recall, h.all16 AS all_recall, h.gap AS gap_recall, 1 - refined AS eval_saving, {ratio('m.full_ - m.native - (m.bounded - m.native)', 'm.full_ - m.native')} AS overhead_reduction, 1 - m.bounded_all / coalesce(m.full_all, m.full_) AS latency_saving, 1 - (refined * m.bounded_all + (1 - refined) * m.bounded) / m.bounded_all AS gap_saving, CASE WHEN h.all16 - h.native > 1e-12 THEN (h.gap - h.native) / (h.all16 - h.native) END AS gain_retained FROM m CROSS JOIN h)
      SELECT 'event types' AS stand_ins, round(eval_saving, 9) AS eval_saving, round(gap_saving, 6) AS gap_saving, round(latency_saving, 6) AS latency_saving, round(gain_retained, 9) AS gain_retained, round(overhead_reduction, 6) AS overhead_reduction, coalesce(overhead_reduction >= 0.5E0, false) AS overhead_gate, latency_saving >= 0.1E0 AS latency_gate,
        gap_saving >= 0.1E0 AND coalesce(gain_retained >= 0.6E0, false) AS selective_gate, coalesce(overhead_reduction >= 0.5E0, false) OR latency_saving >= 0.1E0 AS meaningful FROM g"""


@plan("M9", "policies")
def refinement_outcomes(d):
    return """SELECT f, chosen, outcome, CAST(count(*) AS BIGINT) AS n FROM (SELECT f, CAST(chosen AS BIGINT) AS chosen, CASE WHEN refined_hits > native_hits THEN 'useful' WHEN refined_hits = native_hits THEN 'neutral' ELSE 'harmful' END AS outcome FROM pl_policies WHERE policy = 'gap') AS x_ GROUP BY f, chosen, outcome"""


@plan("M11", "ranked")
def candidate_coverage(d):
    """Members of the exact top within each depth of the score order."""
    deep = ", ".join(f"CAST(sum(CASE WHEN er <= {K} AND sr <= {l} THEN 1 ELSE 0 END) AS BIGINT) AS within_{l}" for l in (10, 16, 32, 64))
    return f"SELECT query_id, model, {deep}, CAST(sum(CASE WHEN er <= {K} AND sr > 16 THEN 1 ELSE 0 END) AS BIGINT) AS missed_by_16, CAST(sum(CASE WHEN er > {K} AND sr <= {K} THEN 1 ELSE 0 END) AS BIGINT) AS wrong_inside FROM pl_ranked GROUP BY query_id, model"


@plan("M10", "ranked", "policies")
def candidate_diagnostics(d):
    """What refining the best 16, 32, 64 of the queries that the gap chooses does to their results: true members added, wrong ones removed, members beyond the depth, and the exact ranks of what comes in."""
    q = lambda x, p: f"round(percentile_cont({p}) WITHIN GROUP (ORDER BY {x}), 9)"
    return f"""WITH s AS (SELECT query_id, f FROM pl_policies WHERE policy = 'gap' AND chosen = 1), x AS (
        SELECT s.query_id, f, l, er, sr, CASE WHEN sr <= l THEN row_number() OVER (PARTITION BY s.query_id, f, l, sr <= l ORDER BY exact, pos) END AS rr FROM s JOIN pl_ranked r ON s.query_id = r.query_id AND r.model = 'coarse' CROSS JOIN (SELECT 16 AS l UNION ALL SELECT 32 UNION ALL SELECT 64) AS l_),
      m AS (SELECT *, coalesce(rr <= {K}, false) AS refined, sr <= {K} AS native, er <= {K} AS member FROM x),
      g AS (SELECT query_id, f, l, sum(CASE WHEN refined AND NOT native AND member THEN 1 ELSE 0 END) AS added, sum(CASE WHEN native AND NOT refined AND NOT member THEN 1 ELSE 0 END) AS removed, sum(CASE WHEN member AND sr > l THEN 1 ELSE 0 END) AS beyond FROM m GROUP BY query_id, f, l),
      c AS (SELECT f, l, count(*) AS queries, avg(added) AS added, avg(removed) AS removed, avg(CASE WHEN beyond > 0 THEN 1.0E0 ELSE 0.0E0 END) AS some_beyond, avg(beyond) AS beyond FROM g GROUP BY f, l),
      n AS (SELECT f, l, count(*) AS n, {q('CAST(er AS DOUBLE)', 0.5)} AS median, {q('CAST(er AS DOUBLE)', 0.95)} AS p95, {q('CASE WHEN member THEN CAST(er AS DOUBLE) END', 0.5)} AS member_median, {q('CASE WHEN member THEN CAST(er AS DOUBLE) END', 0.95)} AS member_p95 FROM m WHERE refined AND NOT native GROUP BY f, l)
      SELECT c.f, CAST(c.l AS BIGINT) AS depth, CAST(queries AS BIGINT) AS queries, round(added, 9) AS members_added, round(removed, 9) AS wrong_removed, round(some_beyond, 9) AS queries_with_members_beyond, round(beyond, 9) AS members_beyond, CAST(coalesce(n.n, 0) AS BIGINT) AS new_results,
        median AS new_rank_median, p95 AS new_rank_p95, member_median AS rescued_rank_median, member_p95 AS rescued_rank_p95 FROM c LEFT JOIN n ON c.f = n.f AND c.l = n.l"""


@plan("M13", "perq")
def compression_transition(d):
    return f"SELECT c.query_id, round((f.score_hits - c.score_hits) / {K}.0E0, 9) AS recall_change, round(f.mae - c.mae, 9) AS error_change FROM pl_perq c JOIN pl_perq f ON c.query_id = f.query_id AND c.model = 'coarse' AND f.model = 'fine'"


@plan("Q1", "latency")
def latency_statistics(d):
    q = lambda p: f"round(percentile_cont({p}) WITHIN GROUP (ORDER BY us), 9)"
    return f"SELECT policy, workers, CAST(count(*) AS BIGINT) AS n, round(avg(us), 6) AS mean, {q(0.5)} AS median, {q(0.9)} AS p90, {q(0.95)} AS p95, {q(0.99)} AS p99, round(1e6 / avg(us), 6) AS qps FROM pl_latency GROUP BY policy, workers"


@plan("Q2", "latency")
def repetition_summary(d):
    return "SELECT policy, workers, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, round(min(m), 6) AS least, round(max(m), 6) AS most FROM (SELECT policy, workers, rep, avg(us) AS m FROM pl_latency GROUP BY policy, workers, rep) AS x_ GROUP BY policy, workers"


@plan("Q3", "latency")
def scaling(d):
    return """WITH s AS (SELECT policy, workers, workers * 1e6 / avg(us) AS qps, avg(us) AS m, percentile_cont(0.99) WITHIN GROUP (ORDER BY us) AS p99 FROM pl_latency GROUP BY policy, workers)
      SELECT s.policy, s.workers, round(s.qps / o.qps, 6) AS speedup, round(s.qps / o.qps / s.workers, 6) AS efficiency, round(s.m / o.m - 1, 6) AS overhead, round(s.p99 / o.p99, 6) AS p99_ratio FROM s JOIN s o ON s.policy = o.policy AND o.workers = 1"""


@plan("Q4", "latency")
def relative_overhead(d):
    """Policies against the first by name (which stands in for the native one) at as many workers: throughput lost, latency added, ratio of the 99th percentiles."""
    over = ", ".join(f"round(a.{x} / n.{x} - 1, 6) AS {x}_overhead" for x in ("mean", "p95", "p99"))
    return f"""WITH s AS (SELECT policy, workers, workers * 1e6 / avg(us) AS qps, avg(us) AS mean, percentile_cont(0.95) WITHIN GROUP (ORDER BY us) AS p95, percentile_cont(0.99) WITHIN GROUP (ORDER BY us) AS p99 FROM pl_latency GROUP BY policy, workers), f AS (SELECT min(policy) AS native FROM s)
      SELECT a.policy, f.native, a.workers, round(1 - a.qps / n.qps, 6) AS throughput_penalty, {over}, round(a.p99 / n.p99, 6) AS p99_ratio FROM s a CROSS JOIN f JOIN s n ON n.policy = f.native AND n.workers = a.workers WHERE a.policy <> f.native"""


@plan("Q5", "components")
def component_shares(d):
    """Shares of the measured parts of a query's time, and how far their sum is from the whole."""
    parts = ("search", "gap", "refine", "final")
    sums = ", ".join(f"sum({p}_us) AS {p}_us" for p in parts)
    rows = " UNION ALL ".join(f"SELECT policy, '{p}' AS part, {p}_us AS us, total_us, {' + '.join(f'{x}_us' for x in parts)} AS whole FROM s" for p in parts)
    return f"""WITH s AS (SELECT policy, {sums}, sum(total_us) AS total_us FROM pl_components GROUP BY policy)
      SELECT policy, part, round(us / total_us, 9) AS share, round(1 - whole / total_us, 9) AS unaccounted, abs(1 - whole / total_us) <= 0.05E0 AS adds_up FROM ({rows}) AS x_"""


@plan("Q6", "latency")
def worker_imbalance(d):
    """Busiest worker against the mean, the share of time workers are busy, and what clocks (odd repetitions) cost."""
    return """WITH w AS (SELECT policy, max(busy) / avg(busy) AS imbalance, sum(busy) / (count(*) * max(busy)) AS utilization FROM (SELECT policy, workers, sum(us) AS busy FROM pl_latency GROUP BY policy, workers) AS x_ GROUP BY policy),
      c AS (SELECT policy, avg(CASE WHEN rep = 1 THEN us END) / avg(CASE WHEN rep <> 1 THEN us END) - 1 AS clocks FROM pl_latency GROUP BY policy)
      SELECT w.policy, round(imbalance, 6) AS imbalance, round(utilization, 6) AS utilization, round(clocks, 6) AS clock_overhead FROM w JOIN c ON w.policy = c.policy"""


_MODELS = f"""SELECT model, sum(score_hits) / (count(*) * {K}.0E0) AS recall, round(-avg(mae), 9) AS cheap FROM (SELECT model, score_hits, mae FROM pl_perq15 UNION ALL SELECT model, score_hits, mae FROM pl_perq9 UNION ALL SELECT model, score_hits, mae FROM pl_perq5) AS u_ GROUP BY model"""


def _pareto_frontier(rel):
    return skyline(over(rel["perq5"].sparkSession, _MODELS, rel), ["recall"], ["cheap"]).selectExpr("model", "round(recall, 9) AS recall", "round(cheap, 9) AS negative_error")


@plan("Q7 C9", "perq15", "perq9", "perq5", build=_pareto_frontier)
def pareto_frontier(d):
    """Models by recall and error; those that no other dominates."""
    return f"""WITH a AS ({_MODELS})
      SELECT model, round(recall, 9) AS recall, round(cheap, 9) AS negative_error FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.recall >= a.recall AND b.cheap <= a.cheap AND (b.recall > a.recall OR b.cheap < a.cheap))"""
