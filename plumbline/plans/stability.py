"""Plans on several models: stability, variance components, permutation nulls."""

from __future__ import annotations

from .core import SPARK, over, plan
from .relations import DRAWS, K


@plan("K1", "perq5")
def harmful_frequency(d):
    return """SELECT query_id, harmful, CASE WHEN harmful = 0 THEN 'never' WHEN harmful <= 2 THEN 'minority' WHEN harmful <= 4 THEN 'majority' ELSE 'always' END AS category, round(mean_loss, 9) AS mean_loss, round(sd_loss, 9) AS sd_loss
      FROM (SELECT query_id, CAST(sum(CASE WHEN loss_hits > 0 THEN 1 ELSE 0 END) AS BIGINT) AS harmful, avg(CAST(loss_hits AS DOUBLE)) AS mean_loss, stddev_samp(CAST(loss_hits AS DOUBLE)) AS sd_loss FROM pl_perq5 GROUP BY query_id) AS x_"""


@plan("K2", "inversions5")
def inversion_union(d):
    return f"""SELECT query_id, inside_id, outside_id, n AS models, mask, CASE n WHEN 1 THEN 'one-off' WHEN 2 THEN 'minority' WHEN 5 THEN 'persistent' ELSE 'majority' END AS class FROM (
      SELECT query_id, inside_id, outside_id, CAST(count(*) AS BIGINT) AS n, {d.names('model', 'model')} AS mask FROM pl_inversions5 GROUP BY query_id, inside_id, outside_id) AS x_"""


@plan("K3", "ranked5", "inversions5", "perq5")
def loss_attribution(d):
    """A lost member of the truth is shared among the chosen intruders that overtake it in this model, by how often their pair recurs; what none overtakes stays unassigned, and intruders that are true themselves are credited. The parts are the loss."""
    return f"""WITH f AS (SELECT query_id, inside_id, outside_id, count(*) AS freq FROM pl_inversions5 GROUP BY query_id, inside_id, outside_id),
      p AS (SELECT l.query_id, l.model, l.base_id, f.freq, count(i.outside_id) OVER (PARTITION BY l.query_id, l.model, l.base_id) AS n FROM (SELECT query_id, model, base_id FROM pl_ranked5 WHERE er <= {K} AND sr > {K} AND in_gt = 1) l
        LEFT JOIN (SELECT * FROM pl_inversions5 WHERE outside_score_rank <= {K}) i ON l.query_id = i.query_id AND l.model = i.model AND l.base_id = i.inside_id LEFT JOIN f ON i.query_id = f.query_id AND i.inside_id = f.inside_id AND i.outside_id = f.outside_id),
      c AS (SELECT query_id, model, CASE WHEN n = 0 THEN 'unassigned' WHEN freq = 1 THEN 'one-off' WHEN freq = 2 THEN 'minority' WHEN freq = 5 THEN 'persistent' ELSE 'majority' END AS pair_class, 1.0E0 / {K} / greatest(n, 1) AS x FROM p
        UNION ALL SELECT query_id, model, 'intruder credit', -1.0E0 / {K} FROM pl_ranked5 WHERE er > {K} AND sr <= {K} AND in_gt = 1),
      s AS (SELECT query_id, model, pair_class, sum(x) AS loss FROM c GROUP BY query_id, model, pair_class)
      SELECT s.query_id, s.model, pair_class, round(s.loss, 9) AS loss, abs(sum(s.loss) OVER (PARTITION BY s.query_id, s.model) - q.loss_hits / {K}.0E0) <= 1e-10 AS adds_up FROM s JOIN pl_perq5 q ON s.query_id = q.query_id AND s.model = q.model"""


@plan("K4 C8 K12", "harm", "by_inversions", "inversions5")
def model_pairs(d):
    """Pairs of models: harmful queries shared, expected and by Jaccard; correlation of losses and of inversion counts by average ranks; inversions shared."""
    share = lambda a, b: f"CASE WHEN sum(CASE WHEN {a} OR {b} THEN 1 ELSE 0 END) > 0 THEN round(sum(CASE WHEN {a} AND {b} THEN 1 ELSE 0 END) / CAST(sum(CASE WHEN {a} OR {b} THEN 1 ELSE 0 END) AS DOUBLE), 9) END"
    rank = lambda t: f"({t}.first_ + {t}.last_) / 2.0E0"
    return f"""WITH r AS (SELECT h.query_id, h.model, h.loss_hits, i.inversions, {rank('h')} AS rl, {rank('i')} AS ri FROM pl_harm h JOIN pl_by_inversions i ON h.query_id = i.query_id AND h.model = i.model), n AS (SELECT model, sum(inversions) AS n FROM r GROUP BY model),
      s AS (SELECT a.model AS first, b.model AS second, count(*) AS shared FROM pl_inversions5 a JOIN pl_inversions5 b ON a.query_id = b.query_id AND a.inside_id = b.inside_id AND a.outside_id = b.outside_id WHERE a.model < b.model GROUP BY a.model, b.model),
      x AS (SELECT a.model AS first, b.model AS second, CAST(sum(CASE WHEN a.loss_hits > 0 AND b.loss_hits > 0 THEN 1 ELSE 0 END) AS BIGINT) AS both, {share('a.loss_hits > 0', 'b.loss_hits > 0')} AS jaccard,
        round(avg(CASE WHEN a.loss_hits > 0 THEN 1.0E0 ELSE 0.0E0 END) * avg(CASE WHEN b.loss_hits > 0 THEN 1.0E0 ELSE 0.0E0 END) * count(*), 9) AS expected_both,
        round(corr(CAST(a.loss_hits AS DOUBLE), CAST(b.loss_hits AS DOUBLE)), 9) AS correlation, round(corr(a.rl, b.rl), 9) AS spearman_loss, round(corr(a.ri, b.ri), 9) AS spearman_inversions
        FROM r a JOIN r b ON a.query_id = b.query_id AND a.model < b.model GROUP BY a.model, b.model)
      SELECT x.*, CASE WHEN p.n + q.n > 0 THEN round(coalesce(shared, 0) / CAST(p.n + q.n - coalesce(shared, 0) AS DOUBLE), 9) END AS inversion_jaccard FROM x JOIN n p ON x.first = p.model JOIN n q ON x.second = q.model LEFT JOIN s ON x.first = s.first AND x.second = s.second"""


@plan("K15", "inversions5")
def pair_coinversion(d):
    return """WITH n AS (SELECT model, count(*) AS n FROM pl_inversions5 GROUP BY model), x AS (SELECT a.model AS first, b.model AS second, CAST(count(*) AS BIGINT) AS shared FROM pl_inversions5 a JOIN pl_inversions5 b
      ON a.query_id = b.query_id AND a.inside_id = b.inside_id AND a.outside_id = b.outside_id WHERE a.model < b.model GROUP BY a.model, b.model)
      SELECT first, second, shared, CAST(p.n + q.n - shared AS BIGINT) AS either, round(shared / CAST(p.n + q.n - shared AS DOUBLE), 9) AS jaccard FROM x JOIN n p ON x.first = p.model JOIN n q ON x.second = q.model"""


@plan("K5", "perq9")
def variance_components(d):
    """Within and between training subsets; within + between = total."""
    return """SELECT query_id, round(avg(v), 9) AS within, round(var_pop(m), 9) AS between, round(max(t), 9) AS total, abs(avg(v) + var_pop(m) - max(t)) <= 1e-9 AS adds_up, round(avg(vs), 9) AS within_sample, round(var_samp(m), 9) AS between_sample, round(var_samp(m) - avg(vs) / 3, 9) AS signed_contrast FROM (
      SELECT query_id, substring(model, 2, 1) AS subset, avg(CAST(loss_hits AS DOUBLE)) AS m, var_pop(CAST(loss_hits AS DOUBLE)) AS v, var_samp(CAST(loss_hits AS DOUBLE)) AS vs, max(t) AS t FROM (
        SELECT *, var_pop(CAST(loss_hits AS DOUBLE)) OVER (PARTITION BY query_id) AS t FROM pl_perq9) AS y_ GROUP BY query_id, substring(model, 2, 1)) AS x_ GROUP BY query_id"""


@plan("K6", "perq9")
def subset_majority(d):
    return """SELECT query_id, harmful, CASE WHEN harmful = 0 THEN 'never' WHEN harmful <= 2 THEN 'rare' WHEN harmful <= 5 THEN 'some' WHEN harmful <= 8 THEN 'most' ELSE 'always' END AS category, majorities, majorities = 3 AS persistent FROM (
      SELECT query_id, CAST(sum(h) AS BIGINT) AS harmful, CAST(sum(CASE WHEN h >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS majorities FROM (
        SELECT query_id, substring(model, 2, 1) AS subset, sum(CASE WHEN loss_hits > 0 THEN 1 ELSE 0 END) AS h FROM pl_perq9 GROUP BY query_id, substring(model, 2, 1)) AS y_ GROUP BY query_id) AS x_"""


@plan("K7", "inversions9")
def grid_inversion_union(d):
    """Inverted pairs by the number of models, of subsets in which most starts invert them, and in which all do."""
    return """SELECT query_id, CAST(n AS BIGINT) AS models, CAST(majorities AS BIGINT) AS majorities, CAST(all_starts AS BIGINT) AS all_starts, CAST(count(*) AS BIGINT) AS pairs FROM (
      SELECT query_id, inside_id, outside_id, sum(h) AS n, sum(CASE WHEN h >= 2 THEN 1 ELSE 0 END) AS majorities, sum(CASE WHEN h = 3 THEN 1 ELSE 0 END) AS all_starts FROM (
      SELECT query_id, inside_id, outside_id, substring(model, 2, 1) AS subset, count(*) AS h FROM pl_inversions9 GROUP BY query_id, inside_id, outside_id, substring(model, 2, 1)) AS y_ GROUP BY query_id, inside_id, outside_id) AS x_ GROUP BY query_id, n, majorities, all_starts"""


@plan("K8", "perq15")
def factorial_variance(d):
    """Five rotations by three starts: within + between = total, and between + start + interaction = total; sample forms; in how many rotations most starts lose."""
    return """WITH x AS (SELECT query_id, substring(model, 2, 1) AS r, substring(model, 3, 1) AS i, CAST(loss_hits AS DOUBLE) AS y FROM pl_perq15),
      m AS (SELECT *, avg(y) OVER (PARTITION BY query_id) AS g, avg(y) OVER (PARTITION BY query_id, r) AS mr, avg(y) OVER (PARTITION BY query_id, i) AS mi FROM x),
      t AS (SELECT query_id, avg((mr - g) * (mr - g)) AS b, avg((mi - g) * (mi - g)) AS s, avg((y - mr - mi + g) * (y - mr - mi + g)) AS z, avg((y - g) * (y - g)) AS t, avg(y) AS mean FROM m GROUP BY query_id),
      w AS (SELECT query_id, avg(v) AS w, avg(vs) AS ws, var_samp(mean) AS bs, CAST(sum(CASE WHEN h >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS rotations, CAST(sum(h) AS BIGINT) AS models FROM (
        SELECT query_id, r, var_pop(y) AS v, var_samp(y) AS vs, avg(y) AS mean, sum(CASE WHEN y > 0 THEN 1 ELSE 0 END) AS h FROM x GROUP BY query_id, r) AS y_ GROUP BY query_id)
      SELECT t.query_id, round(mean, 9) AS mean_loss, round(w, 9) AS within, round(b, 9) AS rotation, round(s, 9) AS init, round(z, 9) AS interaction, round(t, 9) AS total, abs(w + b - t) <= 1e-9 AS nested_adds_up, abs(b + s + z - t) <= 1e-9 AS adds_up,
        round(ws, 9) AS within_sample, round(bs, 9) AS rotation_sample, round(bs - ws / 3, 9) AS signed_contrast, rotations AS harmful_rotations, models AS harmful_models,
        CASE WHEN rotations = 0 THEN 'rotation-robust' WHEN rotations <= 2 THEN 'occasionally vulnerable' WHEN rotations <= 4 THEN 'usually vulnerable' ELSE 'rotation-persistent' END AS category FROM t JOIN w ON t.query_id = w.query_id"""


@plan("K9", "inversions15")
def rotation_inversion_union(d):
    return """SELECT rotations, CAST(count(*) AS BIGINT) AS pairs, round(avg(models), 9) AS mean_models FROM (SELECT query_id, inside_id, outside_id, CAST(count(DISTINCT substring(model, 2, 1)) AS BIGINT) AS rotations, CAST(count(*) AS DOUBLE) AS models FROM pl_inversions15 GROUP BY query_id, inside_id, outside_id) AS x_ GROUP BY rotations"""


@plan("K10", "perq15")
def pair_relations(d):
    return """SELECT relation, CAST(count(*) AS BIGINT) AS pairs, round(avg(j), 9) AS mean_jaccard, round(min(j), 9) AS least, round(max(j), 9) AS most FROM (
      SELECT CASE WHEN substring(a.model, 2, 1) = substring(b.model, 2, 1) THEN 'within rotation' WHEN substring(a.model, 3, 1) = substring(b.model, 3, 1) THEN 'same start' ELSE 'between' END AS relation,
        sum(CASE WHEN a.loss_hits > 0 AND b.loss_hits > 0 THEN 1 ELSE 0 END) / CAST(greatest(sum(CASE WHEN a.loss_hits > 0 OR b.loss_hits > 0 THEN 1 ELSE 0 END), 1) AS DOUBLE) AS j
      FROM pl_perq15 a JOIN pl_perq15 b ON a.query_id = b.query_id AND a.model < b.model GROUP BY a.model, b.model) AS x_ GROUP BY relation"""


@plan("K11", "perq15")
def variance_accounting(d):
    """Over queries and models: joint = between queries + mean within. The joint variance is of sums, so no row sees all others."""
    return """WITH q AS (SELECT query_id, avg(y) AS m, var_pop(y) AS v FROM (SELECT query_id, CAST(loss_hits AS DOUBLE) AS y FROM pl_perq15) AS y_ GROUP BY query_id), j AS (SELECT var_pop(CAST(loss_hits AS DOUBLE)) AS j FROM pl_perq15)
      SELECT round(max(j), 9) AS joint, round(var_pop(m), 9) AS between_queries, round(avg(v), 9) AS model_variance, abs(max(j) - var_pop(m) - avg(v)) <= 1e-9 AS adds_up FROM q CROSS JOIN j"""


@plan("K13", "geometry_x", "geometry_y")
def geometry_correlations(d):
    rank = lambda t: f"({t}.first_ + {t}.last_) / 2.0E0"
    return f"""SELECT a.feature, CAST(count(*) AS BIGINT) AS n, round(corr(a.x, a.y), 9) AS pearson, round(corr({rank('a')}, {rank('b')}), 9) AS spearman FROM pl_geometry_x a JOIN pl_geometry_y b ON a.feature = b.feature AND a.query_id = b.query_id GROUP BY a.feature"""


@plan("K13 T13", "geometry")
def geometry_bins(d):
    """Mean losses by quintile of a feature; edges that coincide are one, and equal values stay together."""
    edges = ", ".join(f"percentile_cont({k / 5}) WITHIN GROUP (ORDER BY x) AS q{k}" for k in range(1, 5))
    place = " + ".join(f"CASE WHEN x >= q{k}{f' AND q{k} > q{k - 1}' if k > 1 else ''} AND q{k} > q0 AND q{k} < q5 THEN 1 ELSE 0 END" for k in range(1, 5))
    return f"""SELECT feature, CAST(bin AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n, round(min(x), 9) AS least, round(max(x), 9) AS most, round(avg(y), 9) AS mean_loss, round(stddev_samp(y) / sqrt(count(*)), 9) AS se FROM (
      SELECT g.feature, x, y, {place} AS bin FROM pl_geometry g JOIN (SELECT feature, min(x) AS q0, max(x) AS q5, {edges} FROM pl_geometry GROUP BY feature) e ON g.feature = e.feature) AS b_ GROUP BY feature, bin"""


@plan("K13", "geometry_x", "geometry_y", "harm")
def geometry_realized(d):
    """How a feature ranks the mean loss of five models, and how it ranks what each of them loses."""
    rank = lambda t: f"({t}.first_ + {t}.last_) / 2.0E0"
    return f"""SELECT a.feature, h.model, round(max(m.rho), 9) AS mean_spearman, round(corr({rank('a')}, {rank('h')}), 9) AS realized_spearman FROM pl_geometry_x a JOIN pl_harm h ON a.query_id = h.query_id
      JOIN (SELECT a.feature, corr({rank('a')}, {rank('b')}) AS rho FROM pl_geometry_x a JOIN pl_geometry_y b ON a.feature = b.feature AND a.query_id = b.query_id GROUP BY a.feature) m ON a.feature = m.feature GROUP BY a.feature, h.model"""


@plan("L1 L2", "nulls")
def null_draws(d):
    return "SELECT query_id, model, condition, draw, loss_hits, displaced FROM pl_nulls"


@plan("L4", "nulls", "loss")
def null_summary(d):
    q = lambda p: f"round(percentile_cont({p}) WITHIN GROUP (ORDER BY CAST(loss_hits AS DOUBLE)), 9)"
    return f"""SELECT n.query_id, condition, round(avg(CAST(loss_hits AS DOUBLE)), 9) AS mean, round(stddev_samp(CAST(loss_hits AS DOUBLE)), 9) AS sd, {q(0.5)} AS median, {q(0.05)} AS p05, {q(0.95)} AS p95, round(max(loss) - avg(CAST(loss_hits AS DOUBLE)), 9) AS excess
      FROM pl_nulls n JOIN pl_loss l ON n.query_id = l.query_id WHERE model = 'coarse' GROUP BY n.query_id, condition"""


@plan("L5", "nulls", "loss")
def empirical_rank(d):
    return f"""SELECT n.query_id, condition, CAST(sum(CASE WHEN loss_hits < loss THEN 1 ELSE 0 END) AS BIGINT) AS below, CAST(sum(CASE WHEN loss_hits = loss THEN 1 ELSE 0 END) AS BIGINT) AS equal, CAST(sum(CASE WHEN loss_hits > loss THEN 1 ELSE 0 END) AS BIGINT) AS above,
      sum(CASE WHEN loss_hits < loss THEN 1 ELSE 0 END) / {DRAWS}.0E0 AS lower, sum(CASE WHEN loss_hits <= loss THEN 1 ELSE 0 END) / {DRAWS}.0E0 AS upper, (sum(CASE WHEN loss_hits < loss THEN 1 ELSE 0 END) + sum(CASE WHEN loss_hits <= loss THEN 1 ELSE 0 END)) / {2 * DRAWS}.0E0 AS middle
      FROM pl_nulls n JOIN pl_loss l ON n.query_id = l.query_id WHERE model = 'coarse' GROUP BY n.query_id, condition"""


def _closure(n0: str, nj: str, observed: str) -> str:
    """The share of the gap to the unconditioned null that a condition closes; absent unless that gap is positive."""
    return f"CASE WHEN {n0} - {observed} > 1e-6 THEN ({n0} - {nj}) / ({n0} - {observed}) END"


@plan("L6", "nulls", "perq")
def gap_closure(d):
    """By condition and model: the closure of the means, and of every draw."""
    return f"""WITH m AS (SELECT model, condition, draw, avg(CAST(loss_hits AS DOUBLE)) AS x FROM pl_nulls GROUP BY model, condition, draw), o AS (SELECT model, avg(CAST(loss_hits AS DOUBLE)) AS obs FROM pl_perq GROUP BY model),
      c AS (SELECT a.model, a.condition, a.x, z.x AS n0, obs, {_closure('z.x', 'a.x', 'obs')} AS closure FROM m a JOIN m z ON a.model = z.model AND a.draw = z.draw AND z.condition = 'N0' JOIN o ON a.model = o.model)
      SELECT model, condition, CAST(count(*) AS BIGINT) AS draws, round(avg(x), 9) AS mean, round(min(x), 9) AS least, round(max(x), 9) AS most, round({_closure('avg(n0)', 'avg(x)', 'max(obs)')}, 9) + 0.0E0 AS closure,
        CAST(count(closure) AS BIGINT) AS closed_draws, round(avg(closure), 9) + 0.0E0 AS mean_closure, round(stddev_samp(closure), 9) AS sd_closure FROM c GROUP BY model, condition"""


@plan("L6", "nulls", "perq")
def draw_closure(d):
    """The closure of each draw."""
    return f"""WITH m AS (SELECT model, condition, draw, avg(CAST(loss_hits AS DOUBLE)) AS x FROM pl_nulls GROUP BY model, condition, draw), o AS (SELECT model, avg(CAST(loss_hits AS DOUBLE)) AS obs FROM pl_perq GROUP BY model)
      SELECT a.model, a.condition, a.draw, round(a.x, 9) AS mean, round({_closure('z.x', 'a.x', 'obs')}, 9) + 0.0E0 AS closure FROM m a JOIN m z ON a.model = z.model AND a.draw = z.draw AND z.condition = 'N0' JOIN o ON a.model = o.model"""


@plan("L8", "nulls")
def null_models(d):
    """The mean over models of each draw, and how models differ about it."""
    return """SELECT condition, draw, round(avg(x), 9) AS mean, round(min(x), 9) AS least_model, round(max(x), 9) AS most_model, round(stddev_samp(x), 9) AS sd_models, CAST(count(*) AS BIGINT) AS models FROM (
      SELECT model, condition, draw, avg(CAST(loss_hits AS DOUBLE)) AS x FROM pl_nulls GROUP BY model, condition, draw) AS m_ GROUP BY condition, draw"""


def _replacement_null(rel):
    """The text as it is; draws are many small rows, whose files are so small that Spark would send them to the driver to broadcast them."""
    return over(rel["ranked"].sparkSession, replacement_null(SPARK), rel | {"shuffled": rel["shuffled"].hint("merge")})


@plan("L7", "shuffled", "ranked", build=_replacement_null)
def replacement_null(d):
    """Displaced members against the intruders that took their places: the difference of their errors, and what draws give the same pair. A pair counts as inverted where the difference is over a positive margin."""
    q = lambda p: f"round(percentile_cont({p}) WITHIN GROUP (ORDER BY diff), 9)"
    return f"""WITH p AS (SELECT a.query_id, a.base_id AS displaced, b.base_id AS intruder, b.exact - a.exact AS margin, (a.score - a.exact) - (b.score - b.exact) AS observed
        FROM (SELECT * FROM pl_ranked WHERE model = 'coarse' AND er <= {K} AND sr > {K}) a JOIN (SELECT * FROM pl_ranked WHERE model = 'coarse' AND er > {K} AND sr <= {K}) b ON a.query_id = b.query_id)
      SELECT query_id, displaced, intruder, round(max(margin), 9) AS margin, round(max(observed), 9) AS observed, round(max(observed) - max(margin), 9) AS violation, round(avg(diff), 9) AS null_mean, round(stddev_samp(diff), 9) AS null_sd, {q(0.5)} AS null_median, {q(0.05)} AS null_p05, {q(0.95)} AS null_p95,
        round(avg(CASE WHEN margin > 0 AND diff > margin THEN 1.0E0 ELSE 0.0E0 END), 9) AS null_inverted FROM (
      SELECT p.*, x.e - y.e AS diff FROM p JOIN pl_shuffled x ON p.query_id = x.query_id AND p.displaced = x.base_id JOIN pl_shuffled y ON x.query_id = y.query_id AND x.draw = y.draw AND p.intruder = y.base_id) AS d_ GROUP BY query_id, displaced, intruder"""


def _replacement_counts(rel):
    """Draws are averaged before the join: their files are so small that Spark would broadcast their rows."""
    draws = "SELECT model, condition, avg(CAST(displaced AS DOUBLE)) AS displaced FROM pl_nulls GROUP BY model, condition"
    return over(rel["nulls"].sparkSession, replacement_counts(SPARK).replace("FROM pl_nulls n", f"FROM ({draws}) n"), rel)


@plan("L7", "nulls", "ranked", build=_replacement_counts)
def replacement_counts(d):
    """Members displaced by draws, against those displaced by the model."""
    return f"""SELECT n.model, n.condition, round(avg(CAST(n.displaced AS DOUBLE)), 9) AS shuffled, round(max(o.observed), 9) AS observed FROM pl_nulls n JOIN (
      SELECT model, avg(x) AS observed FROM (SELECT query_id, model, CAST(sum(CASE WHEN er <= {K} AND sr > {K} THEN 1 ELSE 0 END) AS DOUBLE) AS x FROM pl_ranked GROUP BY query_id, model) AS y_ GROUP BY model) o ON n.model = o.model GROUP BY n.model, n.condition"""
