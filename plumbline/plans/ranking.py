"""Plans on the ranking of fixed pools: rows a query, inversions, transitions, summaries, windows."""

from __future__ import annotations

from ..functions.sketches import UNITS
from .core import plan
from .relations import K


@plan("H1 H2 H3", "perq")
def ranking_rows(d):
    return f"""SELECT query_id, model, round(d1, 9) AS d1, round(d10, 9) AS d10, round(d11 - d10, 9) AS margin, CASE WHEN d10 > 1e-12 THEN round((d11 - d10) / d10, 9) END AS relative_margin,
      round(d12 - d9, 9) AS gap_r2, round(d15 - d6, 9) AS gap_r5, agreement, exact_hits / {K}.0E0 AS oracle_recall, score_hits / {K}.0E0 AS recall, loss_hits, class FROM pl_perq"""


@plan("H4 H5 H6 H11", "ranked", "perq", "metrics")
def candidate_errors(d):
    """Errors of a pool, at the boundary, and the pairs across it that are nearly as far (by the tenth distance)."""
    e = "r.score - r.exact"
    near = lambda f: f"CAST(sum(CASE WHEN (b.exact - a.exact) / greatest(q.d10, 1e-12) <= {f} THEN 1 ELSE 0 END) AS BIGINT)"
    return f"""SELECT x.query_id, x.model, round(m.mae, 9) AS mae, median_error, p95_error, round(m.window_mae, 9) AS window_mae, round(m.window_max, 9) AS window_max, boundary_advantage, overtaken,
      CASE WHEN margin > 0 THEN round(m.window_mae / margin, 9) END AS error_per_margin, round(m.relative_mae, 9) AS relative_mae, m.omitted, within_1, within_5, within_10, cross_pairs FROM (
      SELECT r.query_id, r.model, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY abs({e})), 9) AS median_error, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY abs({e})), 9) AS p95_error, max(p.d11 - p.d10) AS margin,
        round(max(CASE WHEN er = {K} THEN {e} END) - max(CASE WHEN er = {K + 1} THEN {e} END), 9) AS boundary_advantage, max(CASE WHEN er = {K} THEN r.score END) > max(CASE WHEN er = {K + 1} THEN r.score END) AS overtaken
      FROM pl_ranked r JOIN pl_perq p ON r.query_id = p.query_id AND r.model = p.model GROUP BY r.query_id, r.model) x
      JOIN pl_metrics m ON x.query_id = m.query_id AND x.model = m.model
      JOIN (SELECT a.query_id, a.model, {near('0.01E0')} AS within_1, {near('0.05E0')} AS within_5, {near('0.1E0')} AS within_10, CAST(count(*) AS BIGINT) AS cross_pairs FROM (SELECT * FROM pl_ranked WHERE er <= {K}) a JOIN (SELECT * FROM pl_ranked WHERE er > {K}) b
        ON a.query_id = b.query_id AND a.model = b.model JOIN pl_perq q ON a.query_id = q.query_id AND a.model = q.model GROUP BY a.query_id, a.model) c ON x.query_id = c.query_id AND x.model = c.model"""


@plan("H7 C3 T8", "inversions", "ranked", "metrics")
def boundary_inversions(d):
    return f"""SELECT p.query_id, p.model, p.inversions, round(p.fraction, 9) AS fraction, CAST(coalesce(i.items, 0) AS BIGINT) AS overtaken_items, CAST(coalesce(i.overtakers, 0) AS BIGINT) AS max_overtakers, round(p.max_violation, 9) AS max_violation, CAST(coalesce(t.ties, 0) AS BIGINT) AS exact_ties
      FROM pl_metrics p LEFT JOIN (SELECT a.query_id, a.model, count(*) AS ties FROM (SELECT * FROM pl_ranked WHERE er <= {K}) a JOIN (SELECT * FROM pl_ranked WHERE er > {K}) b ON a.query_id = b.query_id AND a.model = b.model AND a.exact = b.exact GROUP BY a.query_id, a.model) t ON p.query_id = t.query_id AND p.model = t.model
      LEFT JOIN (SELECT query_id, model, count(*) AS items, max(n) AS overtakers FROM (SELECT query_id, model, inside_id, count(*) AS n FROM pl_inversions GROUP BY query_id, model, inside_id) AS o_ GROUP BY query_id, model) i ON p.query_id = i.query_id AND p.model = i.model"""


@plan("H8", "ranked")
def replacement_pairs(d):
    """Displaced members of the exact top against the intruders that took their places."""
    return f"""SELECT a.query_id, a.model, a.base_id AS displaced, b.base_id AS intruder, a.er AS displaced_rank, b.er AS intruder_rank, round(b.exact - a.exact, 9) AS margin, round(a.score - b.score, 9) AS violation, a.in_gt AS displaced_gt, b.in_gt AS intruder_gt
      FROM (SELECT * FROM pl_ranked WHERE er <= {K} AND sr > {K}) a JOIN (SELECT * FROM pl_ranked WHERE er > {K} AND sr <= {K}) b ON a.query_id = b.query_id AND a.model = b.model"""


@plan("H9", "random_pairs")
def random_pair_inversions(d):
    return "SELECT query_id, model, inverted, ties, pairs FROM pl_random_pairs"


@plan("H10", "inversions", "metrics")
def intruder_overtakes(d):
    """Selected intruders that overtake members of the exact top: in all, and the most over one member."""
    return f"""SELECT m.query_id, m.model, CAST(coalesce(overtakes, 0) AS BIGINT) AS overtakes, CAST(coalesce(most, 0) AS BIGINT) AS most_over_one FROM pl_metrics m LEFT JOIN (
      SELECT query_id, model, sum(n) AS overtakes, max(n) AS most FROM (SELECT query_id, model, inside_id, count(*) AS n FROM pl_inversions WHERE outside_score_rank <= {K} GROUP BY query_id, model, inside_id) AS x_ GROUP BY query_id, model) o ON m.query_id = o.query_id AND m.model = o.model"""


@plan("H12 H14", "perq", "metrics")
def precision_transition(d):
    """From the coarse to the fine model: seven flags, which overlap, and differences of eight measures and of the loss."""
    a, b = "c.loss_hits", "f.loss_hits"
    flags = {"stable_both": f"{a} = 0 AND {b} = 0", "rescued_improved": f"{a} > {b}", "persistent_harmful": f"{a} > 0 AND {b} > 0", "regressed": f"{b} > {a}", "fully_rescued": f"{a} > 0 AND {b} = 0", "partially_improved_persistent": f"{a} > {b} AND {b} > 0", "unchanged_harmful": f"{a} = {b} AND {a} > 0"}
    measures = ("inversions", "fraction", "mae", "relative_mae", "random_rate", "window_mae", "max_violation", "displaced")
    return f"""SELECT c.query_id, {a} AS coarse_loss, {b} AS fine_loss, {a} - {b} AS delta_loss, {', '.join(f'{x} AS {n}' for n, x in flags.items())}, {', '.join(f'round(x.{m} - y.{m}, 9) AS delta_{m}' for m in measures)}
      FROM (SELECT * FROM pl_perq WHERE model = 'coarse') c JOIN (SELECT * FROM pl_perq WHERE model = 'fine') f ON c.query_id = f.query_id
      JOIN (SELECT * FROM pl_metrics WHERE model = 'coarse') x ON c.query_id = x.query_id JOIN (SELECT * FROM pl_metrics WHERE model = 'fine') y ON c.query_id = y.query_id"""


@plan("H13", "inversions", "perq", "metrics")
def inversion_transition(d):
    """Pairs inverted under the coarse model, the fine one, or both (a full outer join), by their margin as a share of the tenth distance and their ranks; the counts of each model's inversions must add up."""
    n = lambda x: f"CAST(sum(CASE WHEN {x} THEN 1 ELSE 0 END) AS BIGINT)"
    states = ", ".join(f"{n(f'state = {chr(39)}{s}{chr(39)} AND {x}')} AS {s}_{c}" for s in ("corrected", "persistent", "new") for c, x in {"pairs": "true", "small_margin": "rel <= 0.05E0", "large_margin": "rel > 0.1E0", "near_boundary": "inside_rank >= 5 AND outside_rank <= 20"}.items())
    return f"""SELECT t.*, corrected_pairs + persistent_pairs = c.inversions AS coarse_adds_up, new_pairs + persistent_pairs = f.inversions AS fine_adds_up FROM (SELECT query_id, {states} FROM (
      SELECT x_.*, margin / greatest(d10, 1e-12) AS rel FROM (
        SELECT coalesce(c.query_id, f.query_id) AS query_id, coalesce(c.margin, f.margin) AS margin, coalesce(c.inside_rank, f.inside_rank) AS inside_rank, coalesce(c.outside_rank, f.outside_rank) AS outside_rank,
          CASE WHEN f.query_id IS NULL THEN 'corrected' WHEN c.query_id IS NULL THEN 'new' ELSE 'persistent' END AS state
        FROM (SELECT * FROM pl_inversions WHERE model = 'coarse') c FULL OUTER JOIN (SELECT * FROM pl_inversions WHERE model = 'fine') f ON c.query_id = f.query_id AND c.inside_id = f.inside_id AND c.outside_id = f.outside_id) AS x_
      JOIN (SELECT query_id AS q, d10 FROM pl_perq WHERE model = 'coarse') p ON x_.query_id = p.q) AS y_ GROUP BY query_id) t
      JOIN (SELECT * FROM pl_metrics WHERE model = 'coarse') c ON t.query_id = c.query_id JOIN (SELECT * FROM pl_metrics WHERE model = 'fine') f ON t.query_id = f.query_id"""


@plan("H15", "perq15")
def evaluated_models(d):
    """All score rows of many models in one pass: hits, loss, class and errors by query and model."""
    return "SELECT query_id, model, exact_hits, score_hits, loss_hits, agreement, class, round(mae, 9) AS mae, round(bias, 9) AS bias, round(s12 - s9, 9) AS gap FROM pl_perq15"


@plan("H17", "ranked")
def residual_regions(d):
    """Residuals by exact rank, by region of ranks and by quartile of the exact distance in a pool."""
    region = f"CASE WHEN er <= 5 THEN 'top5' WHEN er <= {K} THEN 'top10' WHEN er <= 20 THEN 'boundary' WHEN er <= 64 THEN 'middle' ELSE 'tail' END"
    text = "STRING" if d.spark else "VARCHAR"
    q = lambda p: f"round(percentile_cont({p}) WITHIN GROUP (ORDER BY abs(e)), 9)"
    return f"""SELECT model, kind, region, CAST(count(*) AS BIGINT) AS n, round(avg(e), 9) AS mean_residual, round(avg(abs(e)), 9) AS mae, round(stddev_pop(e), 9) AS sd, round(var_pop(e), 9) AS variance, {q(0.5)} AS abs_p50, {q(0.9)} AS abs_p90, {q(0.95)} AS abs_p95 FROM (
      SELECT model, score - exact AS e, 'region' AS kind, {region} AS region FROM pl_ranked UNION ALL SELECT model, score - exact, 'rank', CAST(er AS {text}) FROM pl_ranked
      UNION ALL SELECT model, score - exact, 'distance', concat('q', CAST(ntile(4) OVER (PARTITION BY query_id, model ORDER BY er) AS {text})) FROM pl_ranked) AS x_ GROUP BY model, kind, region"""


@plan("H16", "perq", "ranked")
def score_observables(d):
    """Gaps between scores about the tenth, as they are and by its size, and candidates within 1, 2, 5 % of it on either side."""
    scale = "greatest(abs(s10), 1e-12)"
    near = lambda f: f"CAST(sum(CASE WHEN abs(r.score - q.s10) <= {f} * greatest(abs(q.s10), 1e-12) THEN 1 ELSE 0 END) AS BIGINT)"
    return f"""SELECT p.query_id, p.model, round(s11 - s10, 9) AS g10_11, round(s12 - s9, 9) AS g9_12, round((s11 - s10) / {scale}, 9) AS relative_g10_11, round((s12 - s9) / {scale}, 9) AS relative_g9_12, w1, w2, w5 FROM pl_perq p JOIN (
      SELECT r.query_id, r.model, {near('0.01E0')} AS w1, {near('0.02E0')} AS w2, {near('0.05E0')} AS w5
      FROM pl_ranked r JOIN pl_perq q ON r.query_id = q.query_id AND r.model = q.model GROUP BY r.query_id, r.model) w ON p.query_id = w.query_id AND p.model = w.model WHERE p.n >= 12"""


@plan("H18", "ranked")
def pooled_moments(d):
    """Candidate-weighted mean and variance from group moments."""
    return """SELECT model, CAST(sum(n) AS BIGINT) AS n, round(sum(n * m) / sum(n), 9) AS mean, round(sum(n * (v + m * m)) / sum(n) - power(sum(n * m) / sum(n), 2), 9) AS variance FROM (
      SELECT model, query_id, count(*) AS n, avg(score - exact) AS m, var_pop(score - exact) AS v FROM pl_ranked GROUP BY model, query_id) AS x_ GROUP BY model"""


@plan("I1 I10 T12", "perq")
def group_statistics(d):
    q = lambda p: f"round(percentile_cont({p}) WITHIN GROUP (ORDER BY mae), 9)"
    return f"""SELECT model, class, CAST(count(*) AS BIGINT) AS n, round(avg(mae), 9) AS mean, {q(0.5)} AS median, {q(0.25)} AS q1, {q(0.75)} AS q3, {q(0.9)} AS p90, {q(0.95)} AS p95, {q(0.99)} AS p99, round(percentile_disc(0.9) WITHIN GROUP (ORDER BY mae), 9) AS nearest_p90,
      round(min(mae), 9) AS least, round(max(mae), 9) AS most FROM pl_perq GROUP BY model, class"""


@plan("I3 J3", "loss_down")
def loss_concentration(d):
    """The least share of queries with a loss that hold 50, 80, 90 % of it."""
    return """SELECT target, CAST(min(r_) AS BIGINT) AS queries, round(min(r_) / CAST(max(n_) AS DOUBLE), 9) AS share FROM pl_loss_down CROSS JOIN (SELECT 0.5E0 AS target UNION ALL SELECT 0.8E0 UNION ALL SELECT 0.9E0) AS t_ WHERE upto_ / CAST(sum_ AS DOUBLE) >= target - 1e-12 GROUP BY target"""


@plan("I4 I5 I12", "perq5")
def replicate_summary(d):
    return """SELECT CAST(count(*) AS BIGINT) AS replicates, round(avg(x), 9) AS mean, round(stddev_samp(x), 9) AS sd, round(min(x), 9) AS least, round(max(x), 9) AS most, CASE WHEN abs(avg(x)) > 1e-12 THEN round(stddev_samp(x) / abs(avg(x)), 9) END AS cv, round(stddev_samp(x) / sqrt(count(*)), 9) AS se
      FROM (SELECT model, avg(loss_hits) AS x FROM pl_perq5 GROUP BY model) AS m_"""


@plan("I6", "scored")
def quality_summary(d):
    return "SELECT model, CAST(count(*) AS BIGINT) AS n, round(avg(abs(score - exact)), 9) AS mae, round(sqrt(avg((score - exact) * (score - exact))), 9) AS rmse, round(avg(score - exact), 9) AS bias, round(corr(score, exact), 9) AS pearson FROM pl_scored GROUP BY model"


@plan("I7", "perq")
def class_share(d):
    return """SELECT model, class, n, round(n / CAST(sum(n) OVER (PARTITION BY model) AS DOUBLE), 9) AS share, loss, CASE WHEN sum(loss) OVER (PARTITION BY model) <> 0 THEN round(loss / CAST(sum(loss) OVER (PARTITION BY model) AS DOUBLE), 9) END AS loss_share
      FROM (SELECT model, class, CAST(count(*) AS BIGINT) AS n, CAST(sum(loss_hits) AS BIGINT) AS loss FROM pl_perq GROUP BY model, class) AS x_"""


@plan("I8", "loss")
def loss_histogram(d):
    return f"SELECT h.hits, CAST(count(l.query_id) AS BIGINT) AS n FROM {d.series(-2, K, 'hits')} h LEFT JOIN pl_loss l ON l.loss = h.hits GROUP BY h.hits"


@plan("I9 I16", "perq")
def class_cube(d):
    """Counts by the two models' classes with all marginals."""
    return """SELECT coalesce(coarse, 'all') AS coarse, coalesce(fine, 'all') AS fine, CAST(count(*) AS BIGINT) AS n FROM (
      SELECT c.class AS coarse, f.class AS fine FROM (SELECT * FROM pl_perq WHERE model = 'coarse') c JOIN (SELECT * FROM pl_perq WHERE model = 'fine') f ON c.query_id = f.query_id) AS x_ GROUP BY CUBE (coarse, fine)"""


@plan("I9", "perq9")
def harmful_grid(d):
    """Queries by the number of harmful models and of subsets in which most are, with the cells that are empty."""
    return f"""WITH s AS (SELECT query_id, substring(model, 2, 1) AS subset, sum(CASE WHEN loss_hits > 0 THEN 1 ELSE 0 END) AS harmful FROM pl_perq9 GROUP BY query_id, substring(model, 2, 1)),
      q AS (SELECT query_id, sum(harmful) AS models, sum(CASE WHEN harmful >= 2 THEN 1 ELSE 0 END) AS subsets FROM s GROUP BY query_id)
      SELECT g.models, g.subsets, CAST(count(q.query_id) AS BIGINT) AS n FROM (SELECT models, subsets FROM {d.series(0, 9, 'models')} AS m_ CROSS JOIN {d.series(0, 3, 'subsets')} AS u_) AS g LEFT JOIN q ON g.models = q.models AND g.subsets = q.subsets GROUP BY g.models, g.subsets"""


@plan("I11 J2 T15", "by_loss", "by_margin", "by_mae")
def rank_correlation(d):
    """Pearson and Spearman (average ranks) of loss with margin and error."""
    rank = lambda t: f"({t}.first_ + {t}.last_) / 2.0E0"
    return f"""SELECT round(corr(CAST(a.loss AS DOUBLE), a.margin), 9) AS pearson_margin, round(corr({rank('a')}, {rank('b')}), 9) AS spearman_margin, round(corr(CAST(a.loss AS DOUBLE), a.mae), 9) AS pearson_error, round(corr({rank('a')}, {rank('c')}), 9) AS spearman_error
      FROM pl_by_loss a JOIN pl_by_margin b ON a.query_id = b.query_id JOIN pl_by_mae c ON a.query_id = c.query_id"""


@plan("I13", "loss")
def low_quartile(d):
    return """SELECT round(max(q), 9) AS cut, round(avg(CASE WHEN margin <= q THEN CAST(loss AS DOUBLE) END), 9) AS low_mean, round(avg(CASE WHEN margin > q THEN CAST(loss AS DOUBLE) END), 9) AS rest_mean
      FROM pl_loss CROSS JOIN (SELECT percentile_cont(0.25) WITHIN GROUP (ORDER BY margin) AS q FROM pl_loss) AS q_"""


@plan("I15", "scored")
def distinct_counts(d):
    return "SELECT model, CAST(count(DISTINCT base_id) AS BIGINT) AS candidates, CAST(count(DISTINCT query_id) AS BIGINT) AS queries, CAST(count(DISTINCT round(score, 6)) AS BIGINT) AS scores FROM pl_scored GROUP BY model"


@plan("J1 J4", "ranked")
def adjacent_gaps(d):
    return f"""SELECT query_id, model, CAST(sum(CASE WHEN exact = nxt AND er < {K} THEN 1 ELSE 0 END) AS BIGINT) AS ties_inside, CAST(sum(CASE WHEN exact = nxt AND er = {K} THEN 1 ELSE 0 END) AS BIGINT) AS ties_at_boundary, round(avg(nxt - exact), 9) AS mean_gap
      FROM (SELECT *, lead(exact) OVER (PARTITION BY query_id, model ORDER BY er) AS nxt FROM pl_ranked) AS x_ WHERE er <= 20 GROUP BY query_id, model"""


@plan("J3", "by_margin")
def margin_ecdf(d):
    return "SELECT query_id, round(last_ / CAST(n_ AS DOUBLE), 9) AS share, CAST(upto_ AS BIGINT) AS upto FROM pl_by_margin"


@plan("J5 T13", "loss")
def margin_bins(d):
    """Bins by interior quantile edges; tied values stay together."""
    edge = lambda p: f"(SELECT percentile_cont({p}) WITHIN GROUP (ORDER BY margin) FROM pl_loss)"
    return f"""SELECT CASE WHEN margin IS NULL THEN 'zero_margin' ELSE concat('bin', CAST(bin AS {'STRING' if d.spark else 'VARCHAR'})) END AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(loss AS DOUBLE)), 9) AS mean_loss, round(stddev_samp(CAST(loss AS DOUBLE)) / sqrt(count(*)), 9) AS se
      FROM (SELECT loss, margin, CASE WHEN margin >= q1 THEN 1 ELSE 0 END + CASE WHEN margin >= q2 AND q2 > q1 THEN 1 ELSE 0 END + CASE WHEN margin >= q3 AND q3 > q2 THEN 1 ELSE 0 END AS bin
        FROM pl_loss CROSS JOIN (SELECT {edge(0.25)} AS q1, {edge(0.5)} AS q2, {edge(0.75)} AS q3) AS e_) AS x_ GROUP BY 1"""


@plan("J6 T14", "by_margin")
def equal_count_groups(d):
    """Five groups of equal count by margin; the first ones are larger by one where that can't be."""
    small, extra = "floor(n_ / 5)", "n_ % 5"
    group = f"CASE WHEN r_ <= ({extra}) * ({small} + 1) THEN ceil(r_ / ({small} + 1)) ELSE {extra} + ceil((r_ - ({extra}) * ({small} + 1)) / greatest({small}, 1)) END"
    return f"SELECT CAST(g AS BIGINT) AS quintile, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(loss AS DOUBLE)), 9) AS mean_loss, round(max(margin), 9) AS upper FROM (SELECT loss, margin, {group} AS g FROM pl_by_margin) AS x_ GROUP BY g"


@plan("J7", "loss")
def threshold_sweep(d):
    """Losses on either side of nine deciles of the margin, which one pass finds."""
    cuts = ", ".join(f"percentile_cont({k / 10}) WITHIN GROUP (ORDER BY margin) AS c{k}" for k in range(1, 10))
    picked = " ".join(f"WHEN {k} THEN c{k}" for k in range(1, 10))
    return f"""SELECT q, direction, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(loss AS DOUBLE)), 9) AS mean_loss FROM (SELECT k / 10.0E0 AS q, CASE k {picked} END AS cut FROM (SELECT {cuts} FROM pl_loss) AS e_ CROSS JOIN {d.series(1, 9, 'k')} AS k_) AS c_
      CROSS JOIN (SELECT 'le' AS direction UNION ALL SELECT 'ge') AS d_ JOIN pl_loss l ON (direction = 'le' AND margin <= cut) OR (direction = 'ge' AND margin >= cut) GROUP BY q, direction"""


@plan("I1 I16", "error_sketch")
def sketched_statistics(d):
    """Quantiles of errors by model and class and all marginals, from one pass's sketches; a quantile is at most a sixty-fourth below."""
    q = lambda p: f"min(CASE WHEN upto >= ceil({p} * total) THEN step END) / {UNITS}.0E0 AS p{round(100 * p)}"
    return f"""WITH u AS (SELECT coalesce(model, 'all') AS model, coalesce(class, 'all') AS class, step, sum(n) AS n FROM pl_error_sketch GROUP BY GROUPING SETS ((model, class, step), (model, step), (class, step), (step))),
      r AS (SELECT *, sum(n) OVER (PARTITION BY model, class ORDER BY step) AS upto, sum(n) OVER (PARTITION BY model, class) AS total FROM u)
      SELECT model, class, CAST(max(total) AS BIGINT) AS n, {', '.join(q(p) for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99))} FROM r GROUP BY model, class"""


@plan("B11", "perq")
def scopes(d):
    """One pass over overlapping scopes: all, whole oracle, no tie, four shards."""
    return f"""SELECT model, scope, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(loss_hits AS DOUBLE)), 9) AS mean_loss FROM (
      SELECT model, loss_hits, 'all' AS scope FROM pl_perq UNION ALL SELECT model, loss_hits, 'oracle1' FROM pl_perq WHERE exact_hits = {K} UNION ALL SELECT model, loss_hits, 'no_tie' FROM pl_perq WHERE d10 < d11
      UNION ALL SELECT model, loss_hits, concat('shard', CAST(query_id / 10 % 4 AS INT)) FROM pl_perq) AS x_ GROUP BY model, scope""".replace("query_id / 10 % 4", "floor(query_id / 20) % 4")


@plan("E12", "perq")
def feature_ranking(d):
    """Features by the least size of their correlation with the loss over both models, if its sign is the same."""
    feats = {"margin": "d11 - d10", "d1": "d1", "mae": "mae", "gap": "s12 - s9"}
    rows = " UNION ALL ".join(f"SELECT '{n}' AS feature, model, corr(CAST(loss_hits AS DOUBLE), {e}) AS rho FROM pl_perq GROUP BY model" for n, e in feats.items())
    return f"SELECT feature, round(min(abs(rho)), 9) AS least, CAST(row_number() OVER (ORDER BY -round(min(abs(rho)), 9), feature) AS BIGINT) AS rank FROM ({rows}) AS x_ GROUP BY feature HAVING min(rho) * max(rho) > 0"


@plan("N1 N2 N3", "ranked")
def set_operations(d):
    a, b = f"SELECT query_id, base_id FROM pl_ranked WHERE model = 'coarse' AND sr <= {K}", f"SELECT query_id, base_id FROM pl_ranked WHERE model = 'fine' AND sr <= {K}"
    return f"""SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'intersect' AS kind, query_id, base_id FROM ({a} INTERSECT {b}) AS i_ UNION ALL SELECT 'union', query_id, base_id FROM ({a} UNION {b}) AS u_
      UNION ALL SELECT 'except', query_id, base_id FROM ({a} EXCEPT {b}) AS e_ UNION ALL SELECT 'reverse except', query_id, base_id FROM ({b} EXCEPT {a}) AS r_) AS x_ GROUP BY kind"""


@plan("I14", "perq")
def conditional_overlap(d):
    """Harmful under the fine model given harmful under the coarse one, and their Jaccard."""
    return """SELECT CAST(sum(c) AS BIGINT) AS coarse, CAST(sum(f) AS BIGINT) AS fine, CAST(sum(c * f) AS BIGINT) AS both, CASE WHEN sum(c) > 0 THEN round(sum(c * f) / CAST(sum(c) AS DOUBLE), 9) END AS fine_given_coarse,
      CASE WHEN sum(greatest(c, f)) > 0 THEN round(sum(c * f) / CAST(sum(greatest(c, f)) AS DOUBLE), 9) END AS jaccard
      FROM (SELECT query_id, max(CASE WHEN model = 'coarse' AND loss_hits > 0 THEN 1 ELSE 0 END) AS c, max(CASE WHEN model = 'fine' AND loss_hits > 0 THEN 1 ELSE 0 END) AS f FROM pl_perq GROUP BY query_id) AS x_"""


@plan("K14", "base")
def sample_overlap(d):
    """Three hashed training subsets of a third each: overlaps against n * m / N."""
    half = f"SELECT s, base_id, row_number() OVER (PARTITION BY s ORDER BY {d.hash_order('s', 'base_id')}, base_id) AS r, count(*) OVER (PARTITION BY s) AS n FROM pl_base CROSS JOIN {d.series(0, 2, 's')} AS s_"
    return f"""WITH m AS (SELECT s, base_id, n FROM ({half}) AS h_ WHERE r <= floor(n / 3)), z AS (SELECT s, count(*) AS size, max(n) AS n FROM m GROUP BY s),
      x AS (SELECT a.s AS first, b.s AS second, count(*) AS shared FROM m a JOIN m b ON a.base_id = b.base_id WHERE a.s < b.s GROUP BY a.s, b.s)
      SELECT first, second, CAST(shared AS BIGINT) AS shared, round(shared / CAST(p.size + q.size - shared AS DOUBLE), 9) AS jaccard, round(p.size * q.size / CAST(p.n AS DOUBLE), 9) AS expected FROM x JOIN z p ON x.first = p.s JOIN z q ON x.second = q.s"""
