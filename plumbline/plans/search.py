"""Plans on vectors, distances, quantizers, pools, recall and decomposition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranks import placed
from ..functions.skyline import skyline
from ..functions.storage import materialize
from ..operators import balls, knn
from .core import SPARK, over, plan
from .relations import CODES, DIMS, K, PARTS, POOL, SWEEP, WALK

W = DIMS // PARTS


@plan("E1 D1 C4 E7", "gt")
def exact_knn(d):
    return f"SELECT query_id, CAST(rk AS BIGINT) AS rank, base_id, round(d, 9) AS dist FROM pl_gt WHERE rk <= {K}"


def _pruned_knn(rel):
    found, _ = balls.pruned_top_k(rel["queries"], rel["base"], K, same=True)
    return found.select("query_id", F.col("rk").cast("long").alias("rank"), "base_id", F.round("d", 9).alias("dist"))


@plan("E1 C4", "queries", "base", build=_pruned_knn)
def pruned_knn(d):
    """The same by balls and the triangle inequality: a query goes only to blocks that can hold one of its neighbours."""
    return f"SELECT query_id, CAST(r AS BIGINT) AS rank, base_id, round(dist, 9) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, base_id) AS r FROM (SELECT query_id, base_id, {d.l2('qe', 'be')} AS dist FROM pl_queries JOIN pl_base ON query_id <> base_id) AS p_) AS x_ WHERE r <= {K}"


@plan("A2 J8", "gt")
def first_neighbors(d):
    return f"SELECT query_id, {d.names('base_id', 'rk')} AS ids FROM pl_gt WHERE rk <= 5 GROUP BY query_id"


def _range_neighbors(rel):
    """Every tenth distance against the whole base; the SQL sees the first 11 rows of a query only."""
    bound = rel["gt"].filter(F.col("rk") == K).select(F.col("query_id").alias("id"), F.col("d").alias("bound"))
    asked = rel["queries"].select(F.col("query_id").alias("id"), F.col("qe").alias("vector")).join(bound, "id")
    found = knn.count_within(asked, rel["base"].select(F.col("base_id").alias("id"), F.col("be").alias("vector")), same=True)
    return found.select("query_id", F.round("bound", 9).alias("d10"), "closer", "tied")


@plan("E13", "gt", "queries", "base", build=_range_neighbors)
def range_neighbors(d):
    return f"""SELECT g.query_id, round(g.d, 9) AS d10, CAST(sum(CASE WHEN p.d < g.d THEN 1 ELSE 0 END) AS BIGINT) AS closer, CAST(sum(CASE WHEN p.d = g.d THEN 1 ELSE 0 END) AS BIGINT) AS tied
      FROM (SELECT query_id, d FROM pl_gt WHERE rk = {K}) g JOIN pl_gt p ON g.query_id = p.query_id WHERE p.d <= g.d GROUP BY g.query_id, g.d"""


@plan("D2", "gt", "queries", "base")
def cosine_identity(d):
    return f"""SELECT query_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN abs(dist - (2 - 2 * c)) <= 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS equal FROM (
      SELECT g.query_id, g.d AS dist, {d.dot('qe', 'be')} / (sqrt({d.dot('qe', 'qe')}) * sqrt({d.dot('be', 'be')})) AS c
      FROM pl_gt g JOIN pl_queries q ON g.query_id = q.query_id JOIN pl_base b ON g.base_id = b.base_id) AS x_ GROUP BY query_id"""


@plan("B6 A4", "vectors")
def normalized(d):
    """Vectors divided by their norm once and stored as FLOAT; zero vectors and those with a component that isn't finite are rejected."""
    n = f"sqrt({d.dot('e', 'e')})"
    unit = lambda k: f"CASE WHEN fit THEN round(CAST(CAST({d.at('e', k)} / n AS FLOAT) AS DOUBLE), 9) END"
    return f"SELECT vec_id, fit AS stored, CASE WHEN fit THEN round(n, 9) END AS norm, {unit(1)} AS first, {unit(DIMS)} AS last FROM (SELECT vec_id, e, n, n > 0 AND n < CAST('Infinity' AS DOUBLE) AS fit FROM (SELECT vec_id, e, {n} AS n FROM pl_vectors) AS y_) AS x_"


def _role_split(rel):
    """A seeded order of all vectors, by ranges of hashes."""
    keyed = rel["vectors"].select("vec_id", F.md5(F.concat_ws(":", F.lit("42"), F.col("vec_id").cast("string"))).alias("key"))
    role = F.when(F.col("r_") <= F.floor(0.1 * F.col("n_")), "query").when(F.col("r_") <= F.floor(0.3 * F.col("n_")), "training").when(F.col("r_") <= F.floor(0.9 * F.col("n_")), "base").otherwise("held out")
    return placed(keyed, ["key"], ["vec_id"]).select("vec_id", role.alias("role"), F.when(F.col("vec_id") % 8 == 0, 1).otherwise(0).alias("strided"))


@plan("B7 B9 B10", "vectors", build=_role_split)
def role_split(d):
    return f"""SELECT vec_id, CASE WHEN r <= floor(0.1E0 * n) THEN 'query' WHEN r <= floor(0.3E0 * n) THEN 'training' WHEN r <= floor(0.9E0 * n) THEN 'base' ELSE 'held out' END AS role,
      CASE WHEN vec_id % 8 = 0 THEN 1 ELSE 0 END AS strided FROM (
      SELECT vec_id, row_number() OVER (ORDER BY {d.hash_order("'42'", 'vec_id')}, vec_id) AS r, count(*) OVER () AS n FROM pl_vectors) AS x_"""


@plan("B8 C6 N4", "vectors")
def content_dedup_split(d):
    key = d.sha256(f"array_join({d.each('e', 'v', 'CAST(round(v, 2) AS DECIMAL(10, 2))')}, ',')" if d.spark else "array_to_string(list_transform(e, lambda v: CAST(round(v, 2) AS DECIMAL(10, 2))), ',')")
    return f"""SELECT l.vec_id, CASE WHEN b.k IS NOT NULL THEN 'in base' WHEN q.k IS NOT NULL THEN 'in queries' WHEN l.r > 1 THEN 'repeated' ELSE 'kept' END AS reason
      FROM (SELECT vec_id, {key} AS k, row_number() OVER (PARTITION BY {key} ORDER BY vec_id) AS r FROM pl_vectors WHERE vec_id % 10 < 5) l
      LEFT JOIN (SELECT DISTINCT {key} AS k FROM pl_vectors WHERE vec_id % 10 > 7) b ON l.k = b.k LEFT JOIN (SELECT DISTINCT {key} AS k FROM pl_vectors WHERE vec_id % 10 BETWEEN 5 AND 7) q ON l.k = q.k"""


@plan("B2 B3 B4 C7", "queries", "base")
def shifted_queries(d):
    """Queries moved along a direction (the first base vector) or scaled."""
    moved = d.zip2("qe", "u", f"x + s * {DIMS**0.5!r} * y")
    scaled = d.each("qe", "v", "v * s")
    return f"""SELECT query_id, family, s AS severity, round(sqrt({d.dot('v', 'v')}), 9) AS norm, round({d.dot('v', 'u')}, 9) AS along FROM (
      SELECT query_id, u, family, s, CASE WHEN family = 'mean' THEN {moved} ELSE {scaled} END AS v FROM pl_queries CROSS JOIN (
        SELECT {d.each('be', 'v', f"v / n")} AS u FROM (SELECT be, sqrt({d.dot('be', 'be')}) AS n FROM pl_base ORDER BY base_id LIMIT 1) AS f_) AS u_
      CROSS JOIN (SELECT 'mean' AS family, 0.25E0 AS s UNION ALL SELECT 'mean', 0.5E0 UNION ALL SELECT 'radial', 0.5E0 UNION ALL SELECT 'radial', 2.0E0) AS c_) AS x_"""


@plan("B5", "queries", "base")
def mixtures(d):
    """sqrt(1 - rho) of a query and sqrt(rho * d) of its label's first base vector."""
    body = d.zip2("qe", "be", f"sqrt(1 - rho) * x + sqrt(rho * {DIMS}) * y")
    return f"""SELECT query_id, rho, round(sqrt({d.dot('v', 'v')}), 9) AS norm, round({d.at('v', 1)}, 9) AS first FROM (
      SELECT query_id, rho, {body} AS v FROM pl_queries q JOIN (SELECT b_label, min_by(be, base_id) AS be FROM pl_base GROUP BY b_label) AS c_
      ON q.q_label = c_.b_label CROSS JOIN (SELECT 0.0E0 AS rho UNION ALL SELECT 0.3E0 UNION ALL SELECT 0.9E0) AS h_) AS x_"""


@plan("B12 B14", "queries", "base", "gt")
def shift_descriptors(d):
    comp = "posexplode(be) AS (j, x)" if d.spark else "unnest(range(len(be))) AS j, unnest(be) AS x"
    qcomp = "posexplode(qe) AS (j, x)" if d.spark else "unnest(range(len(qe))) AS j, unnest(qe) AS x"
    return f"""WITH m AS (SELECT j, avg(x) AS m FROM (SELECT {comp} FROM pl_base) AS b_ GROUP BY j),
      c AS (SELECT query_id, sqrt(sum((x - m) * (x - m))) AS centroid_distance, sqrt(sum(x * x)) AS norm FROM (SELECT query_id, {qcomp} FROM pl_queries) AS q_ JOIN m ON q_.j = m.j GROUP BY query_id),
      g AS (SELECT query_id, max(CASE WHEN rk = 1 THEN d END) AS d1, max(CASE WHEN rk = 2 THEN d END) AS d2, max(CASE WHEN rk = 10 THEN d END) AS d10, max(CASE WHEN rk = 11 THEN d END) AS d11 FROM pl_gt GROUP BY query_id)
      SELECT c.query_id, round(norm, 9) AS norm, round(norm / {DIMS**0.5!r}, 9) AS norm_per_dim, round(centroid_distance, 9) AS centroid_distance, round(d2 - d1, 9) AS nn_margin,
        CASE WHEN d1 > 1e-12 THEN round((d2 - d1) / d1, 9) END AS normalized_margin, CASE WHEN d10 > 1e-12 THEN round(d1 / d10, 9) END AS first_to_tenth,
        CASE WHEN d1 > 1e-12 THEN round((d10 - d1) / d1, 9) END AS concentration10, round((d11 - d1) / greatest(d1, 1e-12), 9) AS concentration11
      FROM c JOIN g ON c.query_id = g.query_id"""


@plan("B13", "queries", "base", "gt")
def cluster_descriptors(d):
    comp = "posexplode(be) AS (j, x)" if d.spark else "unnest(range(len(be))) AS j, unnest(be) AS x"
    qcomp = "posexplode(qe) AS (j, x)" if d.spark else "unnest(range(len(qe))) AS j, unnest(qe) AS x"
    return f"""WITH m AS (SELECT b_label, j, avg(x) AS m FROM (SELECT b_label, {comp} FROM pl_base) AS b_ GROUP BY b_label, j),
      c AS (SELECT query_id, q_label, b_label, sum((x - m) * (x - m)) AS cd FROM (SELECT query_id, q_label, {qcomp} FROM pl_queries) AS q_ JOIN m ON q_.j = m.j GROUP BY query_id, q_label, b_label),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cd, 12), b_label) AS r FROM c),
      k AS (SELECT query_id, max(CASE WHEN b_label = q_label THEN sqrt(cd) END) AS own, max(CASE WHEN r = 1 THEN sqrt(cd) END) AS first, max(CASE WHEN r = 2 THEN sqrt(cd) END) AS second FROM r GROUP BY query_id),
      l AS (SELECT query_id, CAST(count(DISTINCT b_label) AS BIGINT) AS labels FROM pl_gt g JOIN pl_base b ON g.base_id = b.base_id WHERE rk <= {K} GROUP BY query_id)
      SELECT k.query_id, round(own, 9) AS own_center, round(first, 9) AS nearest_center, round(second, 9) AS second_center, round(second - first, 9) AS center_margin,
        CASE WHEN first > 1e-12 THEN round((second - first) / first, 9) END AS normalized_center_margin, labels, labels > 1 AS spans_several
      FROM k JOIN l ON k.query_id = l.query_id"""


@plan("D4", "codes")
def pq_codes(d):
    return "SELECT base_id, CAST(m AS BIGINT) AS m, CAST(c AS BIGINT) AS c FROM pl_codes"


@plan("D5", "codes", "codebook", "base")
def pq_reconstruction(d):
    return f"""SELECT base_id, round({d.ordered_sum('dist', 'm')}, 9) AS squared_error FROM (
      SELECT c.base_id, c.m, {d.l2(f"slice(be, CAST(c.m * {W} + 1 AS INT), {W})" if d.spark else f"be[c.m * {W} + 1 : c.m * {W} + {W}]", 'centroid')} AS dist
      FROM pl_codes c JOIN pl_codebook k ON c.m = k.m AND c.c = k.c JOIN pl_base b ON c.base_id = b.base_id) AS x_ GROUP BY base_id"""


@plan("D6 E2", "pool")
def pq_top_k(d):
    return f"SELECT query_id, pos + 1 AS rank, base_id, round(adc, 9) AS adc FROM pl_pool WHERE pos < {K}"


@plan("D7", "pool", "codes", "codebook", "queries")
def adc_check(d):
    """Asymmetric distances against distances to decoded vectors."""
    part = f"slice(qe, CAST(c.m * {W} + 1 AS INT), {W})" if d.spark else f"qe[c.m * {W} + 1 : c.m * {W} + {W}]"
    return f"""SELECT query_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN abs(adc - dec) > 2e-5 THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM (
      SELECT p.query_id, p.base_id, p.adc, sum({d.l2(part, 'centroid')}) AS dec FROM pl_pool p JOIN pl_queries q ON p.query_id = q.query_id
      JOIN pl_codes c ON p.base_id = c.base_id JOIN pl_codebook k ON c.m = k.m AND c.c = k.c GROUP BY p.query_id, p.base_id, p.adc) AS x_ GROUP BY query_id"""


@plan("D8 Q8", "base")
def pq_accounting(d):
    return f"""SELECT parts, bits, CAST(floor((parts * bits + 7) / 8) AS BIGINT) AS code_bytes, round(4.0E0 * {DIMS} / floor((parts * bits + 7) / 8), 9) AS compression,
      CAST(n * floor((parts * bits + 7) / 8) AS BIGINT) AS payload, CAST(4 * {DIMS} * power(2, bits) AS BIGINT) AS codebook_bytes, CAST(4 * parts * power(2, bits) AS BIGINT) AS table_bytes
      FROM (SELECT CAST(count(*) AS BIGINT) AS n FROM pl_base) AS n_ CROSS JOIN (SELECT CAST(8 AS BIGINT) AS parts UNION ALL SELECT CAST(16 AS BIGINT) UNION ALL SELECT CAST(32 AS BIGINT)) AS p_
      CROSS JOIN (SELECT CAST(4 AS BIGINT) AS bits UNION ALL SELECT CAST(8 AS BIGINT)) AS b_"""


@plan("D9", "scored")
def distance_errors(d):
    return """SELECT query_id, base_id, model, round(abs(score - exact), 9) AS abs_error, CASE WHEN exact > 1e-12 THEN round(abs(score - exact) / exact, 9) END AS rel_error
      FROM pl_scored WHERE pos % 8 = 0"""


@plan("D10", "scored")
def order_pairs(d):
    return f"""SELECT a.model, a.query_id, CAST(count(*) AS BIGINT) AS pairs, CAST(sum(CASE WHEN (a.exact < b.exact AND a.score > b.score) OR (a.exact > b.exact AND a.score < b.score) THEN 1 ELSE 0 END) AS BIGINT) AS inversions,
      CAST(sum(CASE WHEN a.score = b.score THEN 1 ELSE 0 END) AS BIGINT) AS score_ties
      FROM pl_scored a JOIN pl_scored b ON a.query_id = b.query_id AND a.model = b.model AND b.pos = (a.pos * 7 + 1) % {POOL} WHERE a.pos <> b.pos GROUP BY a.model, a.query_id"""


@plan("D11 D12", "queries", "base", "gt")
def rotation_gate(d):
    """A plane rotation by 3-4-5 of every pair of coordinates keeps distances."""
    half = DIMS // 2
    if d.spark:
        turn = lambda v: f"concat(zip_with(slice({v}, 1, {half}), slice({v}, {half + 1}, {half}), (x, y) -> 0.6D * x - 0.8D * y), zip_with(slice({v}, 1, {half}), slice({v}, {half + 1}, {half}), (x, y) -> 0.8D * x + 0.6D * y))"
    else:
        turn = lambda v: f"list_concat(list_transform(list_zip({v}[1:{half}], {v}[{half + 1}:{DIMS}]), lambda t: 0.6::DOUBLE * t[1] - 0.8::DOUBLE * t[2]), list_transform(list_zip({v}[1:{half}], {v}[{half + 1}:{DIMS}]), lambda t: 0.8::DOUBLE * t[1] + 0.6::DOUBLE * t[2]))"
    return f"""SELECT query_id, CAST(sum(CASE WHEN abs(turned - d) > 1e-9 + 1e-9 * abs(d) THEN 1 ELSE 0 END) AS BIGINT) AS far, CAST(sum(CASE WHEN before - turned > 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS reversals FROM (
      SELECT *, lag(turned) OVER (PARTITION BY query_id ORDER BY rk) AS before FROM (
        SELECT g.query_id, g.rk, g.d, {d.l2(turn('qe'), turn('be'))} AS turned FROM pl_gt g JOIN pl_queries q ON g.query_id = q.query_id JOIN pl_base b ON g.base_id = b.base_id) AS y_) AS x_ GROUP BY query_id"""


@plan("D13", "ranked5")
def score_ensemble(d):
    """The mean of five models' scores, ranked again, against the members' mean loss."""
    return f"""WITH e AS (SELECT query_id, base_id, pos, max(in_gt) AS in_gt, max(er) AS er, {d.ordered_sum('score', 'model')} / 5 AS score FROM pl_ranked5 GROUP BY query_id, base_id, pos),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, pos) AS sr FROM e),
      l AS (SELECT query_id, CAST(sum(CASE WHEN er <= {K} THEN in_gt ELSE 0 END) - sum(CASE WHEN sr <= {K} THEN in_gt ELSE 0 END) AS BIGINT) AS loss FROM r GROUP BY query_id),
      m AS (SELECT query_id, CAST(sum(CASE WHEN er <= {K} THEN in_gt ELSE 0 END) - sum(CASE WHEN sr <= {K} THEN in_gt ELSE 0 END) AS BIGINT) AS losses FROM pl_ranked5 GROUP BY query_id)
      SELECT l.query_id, loss, round(losses / 5.0E0, 9) AS member_mean, CASE WHEN losses > 0 THEN round(1 - loss / (losses / 5.0E0), 9) END AS recovered FROM l JOIN m ON l.query_id = m.query_id"""


@plan("E3 E4 G3", "ranked")
def exact_rerank(d):
    return f"SELECT query_id, er AS rank, base_id, pos, round(exact, 9) AS dist, in_gt FROM pl_ranked WHERE model = 'coarse' AND er <= {K}"


@plan("E5", "scored")
def bounded_retention(d):
    return f"SELECT query_id, model, {d.names('base_id', 'r')} AS kept, round(max(score), 9) AS worst FROM (SELECT *, row_number() OVER (PARTITION BY query_id, model ORDER BY score, pos) AS r FROM pl_scored) AS x_ WHERE r <= 16 GROUP BY query_id, model"


@plan("E8 K14 I14 T18", "severity")
def severity_sets(d):
    """The worst quarter by the losses of two models: how they overlap, what is expected where ties at the cut are broken independently, and the overlap with all ties let in."""
    weight = "CASE WHEN last_ <= k THEN 1.0E0 WHEN first_ <= k THEN (k - first_ + 1) / CAST(last_ - first_ + 1 AS DOUBLE) ELSE 0.0E0 END"
    side = lambda m: f"(SELECT query_id, loss_hits, r_ <= k AS chosen, {weight} AS w, first_ <= k AS let_in, first_ <= k AND last_ >= k AS at_cut, k FROM (SELECT *, ceil(0.25E0 * n_) AS k FROM pl_severity WHERE model = '{m}') AS s_)"
    n = lambda x: f"sum(CASE WHEN {x} THEN 1 ELSE 0 END)"
    return f"""SELECT CAST(max(a.k) AS BIGINT) AS size, round({n('a.chosen AND b.chosen')} / max(a.k), 9) AS overlap, round(sum(a.w * b.w) / max(a.k), 9) AS expected_overlap, round({n('a.let_in AND b.let_in')} / CAST({n('a.let_in OR b.let_in')} AS DOUBLE), 9) AS tie_inclusive_jaccard,
      CAST(max(CASE WHEN a.at_cut THEN a.loss_hits END) AS BIGINT) AS cutoff_a, CAST(max(CASE WHEN b.at_cut THEN b.loss_hits END) AS BIGINT) AS cutoff_b, CAST({n('a.at_cut')} AS BIGINT) AS cutoff_ties_a, CAST({n('b.at_cut')} AS BIGINT) AS cutoff_ties_b
      FROM {side('coarse')} a JOIN {side('fine')} b ON a.query_id = b.query_id"""


@plan("E9 E11", "pool", "gt")
def operating_points(d):
    """Recall by pool depth; the depth nearest each target, none used twice, and the least that reaches it."""
    near = lambda t, used: f"(SELECT min_by(ef, round(abs(recall - {t}E0), 12) + ef * 1e-15) FROM r{used})"
    return f"""WITH hits AS (SELECT p.query_id, p.pos FROM pl_pool p JOIN pl_gt g ON p.query_id = g.query_id AND p.base_id = g.base_id WHERE g.rk <= {K}),
      r AS (SELECT ef, count(h.pos) / ({K}.0E0 * (SELECT count(DISTINCT query_id) FROM pl_gt)) AS recall FROM (SELECT CAST(10 AS BIGINT) AS ef UNION ALL SELECT CAST(16 AS BIGINT) UNION ALL SELECT CAST(32 AS BIGINT) UNION ALL SELECT CAST(64 AS BIGINT) UNION ALL SELECT CAST(128 AS BIGINT)) AS e_
        LEFT JOIN hits h ON h.pos < e_.ef GROUP BY ef),
      a1 AS (SELECT {near(0.25, '')} AS ef), a2 AS (SELECT {near(0.5, ' WHERE ef NOT IN (SELECT ef FROM a1)')} AS ef), a3 AS (SELECT {near(0.75, ' WHERE ef NOT IN (SELECT ef FROM a1 UNION ALL SELECT ef FROM a2)')} AS ef)
      SELECT target, max(a.ef) AS nearest_ef, min(CASE WHEN recall >= target THEN r.ef END) AS least_ef, round(max(recall), 9) AS best_recall, max(recall) < 0.9E0 AS below_090
      FROM r CROSS JOIN (SELECT 0.25E0 AS target, ef FROM a1 UNION ALL SELECT 0.5E0, ef FROM a2 UNION ALL SELECT 0.75E0, ef FROM a3) AS a GROUP BY target"""


@plan("E10", "perq15")
def quantizer_selection(d):
    """Models within a window of recall and of recall lost, by how near the loss is to its target, then by name; the first is taken."""
    return f"""WITH m AS (SELECT model, sum(score_hits) / (count(*) * {K}.0E0) AS recall, sum(exact_hits - score_hits) / (count(*) * {K}.0E0) AS delta FROM pl_perq15 GROUP BY model),
      e AS (SELECT *, row_number() OVER (ORDER BY round(abs(delta - 0.05E0), 12), model) AS place FROM m WHERE recall >= 0.2E0 AND delta BETWEEN 0.005E0 AND 0.3E0)
      SELECT m.model, round(m.recall, 9) AS recall, round(m.delta, 9) AS delta, CAST(place AS BIGINT) AS place, coalesce(place = 1, false) AS selected FROM m LEFT JOIN e ON m.model = e.model"""


@plan("G1 G2 C1 C2 C5", "perq", "gt")
def paired_recall(d):
    return f"""SELECT c.query_id, c.score_hits / {K}.0E0 AS recall_coarse, f.score_hits / {K}.0E0 AS recall_fine, round((f.score_hits - c.score_hits) / {K}.0E0, 9) AS delta, c.pool_hits / {K}.0E0 AS coverage
      FROM (SELECT * FROM pl_perq WHERE model = 'coarse') c JOIN (SELECT * FROM pl_perq WHERE model = 'fine') f ON c.query_id = f.query_id"""


@plan("G4 G8 G6", "decomposed")
def decomposition(d):
    """Losses of two searches over one graph; each part is a difference of its own, so the identity can fail."""
    return """SELECT query_id, model, round(total_loss, 9) AS total_loss, round(discovery_loss, 9) AS discovery_loss, round(ranking_loss, 9) AS ranking_loss, round(control_delta, 9) AS control_delta,
      abs(total_loss - discovery_loss - ranking_loss + control_delta) <= 1e-12 AS identity, boundary_tie, explained, all16_hits, tie16 FROM pl_decomposed"""


@plan("G9 I2", "decomposed")
def decomposition_summary(d):
    """Ratios are of sums, and absent where nothing is lost."""
    share = lambda x: f"CASE WHEN sum(native_exact_hits - native_hits) > 0 THEN round(sum({x}) / CAST(sum(native_exact_hits - native_hits) AS DOUBLE), 9) END"
    return f"""SELECT model, round(avg(total_loss), 9) AS total, round(avg(discovery_loss), 9) AS discovery, round(avg(ranking_loss), 9) AS ranking,
      {share('oracle_hits - native_hits')} AS rerank_recovery, {share('all16_hits - native_hits')} AS recovery16, {share('native_exact_hits - oracle_hits')} AS discovery_share,
      round(avg(CASE WHEN ranking_loss > 0 THEN 1.0E0 ELSE 0.0E0 END), 9) AS positive, round(avg(CASE WHEN ranking_loss = 0 THEN 1.0E0 ELSE 0.0E0 END), 9) AS zero, round(avg(CASE WHEN ranking_loss < 0 THEN 1.0E0 ELSE 0.0E0 END), 9) AS negative
      FROM pl_decomposed GROUP BY model"""


@plan("F9", *[f"searched{'' if w == WALK[1] else w}" for w in SWEEP])
def search_sweep(d):
    """Recall, evaluations and what the exact order of all evaluated would give, by width and distance source."""
    rows = " UNION ALL ".join(f"SELECT CAST({w} AS BIGINT) AS width, * FROM pl_searched{'' if w == WALK[1] else w}" for w in SWEEP)
    return f"SELECT width, model, round(avg(native_hits) / {K}.0E0, 9) AS recall, round(avg(oracle_hits) / {K}.0E0, 9) AS oracle_recall, round(avg(evaluated), 9) AS evaluated FROM ({rows}) AS x_ GROUP BY width, model"


def _points() -> str:
    rows = " UNION ALL ".join(f"SELECT CAST({w} AS BIGINT) AS width, * FROM pl_searched{'' if w == WALK[1] else w}" for w in SWEEP)
    return f"SELECT width, model, avg(native_hits) / {K}.0E0 AS recall, avg(evaluated) AS evaluated, max(CASE model WHEN 'exact' THEN {32 * DIMS} WHEN 'fine' THEN {8 * PARTS} ELSE {4 * PARTS} END) AS bits FROM ({rows}) AS x_ GROUP BY width, model"


def _search_frontier(rel):
    points = over(next(iter(rel.values())).sparkSession, _points(), rel)
    best = skyline(points, ["recall"], ["evaluated", "bits"]).select(F.col("width").alias("w"), F.col("model").alias("m"), F.lit(True).alias("on"))
    joined = points.join(best, (F.col("width") == F.col("w")) & (F.col("model") == F.col("m")), "left")
    return joined.select("width", "model", F.round("recall", 9).alias("recall"), F.round("evaluated", 9).alias("evaluated"), F.col("bits").cast("long").alias("bits"), F.coalesce("on", F.lit(False)).alias("on_frontier"))


@plan("Q7 C9", *[f"searched{'' if w == WALK[1] else w}" for w in SWEEP], build=_search_frontier)
def search_frontier(d):
    """Widths and distance sources by recall and by what a search costs: evaluations, and bits of a stored vector; those that no other dominates."""
    better = "b.recall >= a.recall AND b.evaluated <= a.evaluated AND b.bits <= a.bits"
    return f"""WITH a AS ({_points()})
      SELECT width, model, round(recall, 9) AS recall, round(evaluated, 9) AS evaluated, CAST(bits AS BIGINT) AS bits, NOT EXISTS (SELECT 1 FROM a b WHERE {better} AND (b.recall > a.recall OR b.evaluated < a.evaluated OR b.bits < a.bits)) AS on_frontier FROM a"""


@plan("G5 N1 N2", "ranked")
def pool_overlap(d):
    """Top lists of the two models as sets: intersection, union, difference, Jaccard."""
    return f"""SELECT query_id, CAST(sum(CASE WHEN c = 1 AND f = 1 THEN 1 ELSE 0 END) AS BIGINT) AS both, CAST(sum(CASE WHEN c + f > 0 THEN 1 ELSE 0 END) AS BIGINT) AS either, CAST(sum(CASE WHEN c + f = 1 THEN 1 ELSE 0 END) AS BIGINT) AS one_only,
      round(sum(CASE WHEN c = 1 AND f = 1 THEN 1 ELSE 0 END) / CAST(sum(CASE WHEN c + f > 0 THEN 1 ELSE 0 END) AS DOUBLE), 9) AS jaccard FROM (
      SELECT query_id, base_id, max(CASE WHEN model = 'coarse' AND sr <= {K} THEN 1 ELSE 0 END) AS c, max(CASE WHEN model = 'fine' AND sr <= {K} THEN 1 ELSE 0 END) AS f FROM pl_ranked GROUP BY query_id, base_id) AS x_ GROUP BY query_id"""


@plan("G7 T4", "ranked")
def native_equals_rerank(d):
    """Ranking by (score, id) and by (score, position) keep the same scores."""
    return f"""SELECT query_id, model, CAST(sum(CASE WHEN a.score = b.score THEN 0 ELSE 1 END) AS BIGINT) AS differing FROM (
      SELECT query_id, model, score, row_number() OVER (PARTITION BY query_id, model ORDER BY score, base_id) AS r FROM pl_ranked) a JOIN (SELECT query_id AS q, model AS m, score, sr FROM pl_ranked) b
      ON a.query_id = b.q AND a.model = b.m AND a.r = b.sr WHERE r <= {K} GROUP BY query_id, model"""


@plan("G10", "ranked", "gt")
def tie_aware_recall(d):
    return f"""WITH c AS (SELECT query_id, d AS d10 FROM pl_gt WHERE rk = {K}), s AS (SELECT query_id, CAST(sum(CASE WHEN d < d10 THEN 1 ELSE 0 END) AS BIGINT) AS strict FROM (SELECT g.query_id, g.d, d10 FROM pl_gt g JOIN c ON g.query_id = c.query_id) AS y_ GROUP BY query_id)
      SELECT r.query_id, model, CAST(sum(CASE WHEN exact < d10 THEN 1 ELSE 0 END) + least({K} - max(strict), sum(CASE WHEN exact = d10 THEN 1 ELSE 0 END)) AS BIGINT) AS tie_aware_hits
      FROM pl_ranked r JOIN c ON r.query_id = c.query_id JOIN s ON r.query_id = s.query_id WHERE sr <= {K} GROUP BY r.query_id, model"""


@plan("G11", "decomposed")
def criterion_gates(d):
    """By model: the votes of four replicates (shards of queries) on evidence of a ranking (H1) and of a discovery loss (H2), and none of either."""
    return f"""WITH s AS (SELECT model, floor(query_id / 20) % 4 AS shard, count(*) AS n, avg(native_exact_hits) / {K}.0E0 AS recall, avg(ranking_loss) AS ranking, avg(discovery_loss) AS discovery,
        CASE WHEN sum(native_exact_hits - native_hits) > 0 THEN sum(oracle_hits - native_hits) / CAST(sum(native_exact_hits - native_hits) AS DOUBLE) END AS recovery FROM pl_decomposed GROUP BY model, floor(query_id / 20) % 4),
      v AS (SELECT *, recall >= 0.5E0 AS eligible, recall >= 0.5E0 AND ranking >= 0.02E0 AS h1, recall >= 0.5E0 AND discovery >= 0.02E0 AND coalesce(recovery, 1.0E0) <= 0.5E0 AS h2, recall >= 0.5E0 AND abs(discovery) <= 0.02E0 AND coalesce(recovery, 1.0E0) >= 0.9E0 AS none_ FROM s)
      SELECT model, sum(n) >= 20 AS enough, CAST(sum(CASE WHEN eligible THEN 1 ELSE 0 END) AS BIGINT) AS eligible, CAST(sum(CASE WHEN h1 THEN 1 ELSE 0 END) AS BIGINT) AS votes_ranking, CAST(sum(CASE WHEN h2 THEN 1 ELSE 0 END) AS BIGINT) AS votes_discovery,
        sum(CASE WHEN h1 THEN 1 ELSE 0 END) >= 3 AS ranking_replicated, sum(CASE WHEN h2 THEN 1 ELSE 0 END) >= 3 AS emerging, sum(CASE WHEN eligible THEN 1 ELSE 0 END) > 0 AND sum(CASE WHEN none_ THEN 1 ELSE 0 END) = sum(CASE WHEN eligible THEN 1 ELSE 0 END) AS no_evidence FROM v GROUP BY model"""


def _gt_disagreement(rel):
    """The second ground truth is a search of its own over the whole base; the SQL ranks the first one's rows again."""
    q, b = rel["queries"], rel["base"]
    second = knn.blocked_top_k(q.select(F.col("query_id").alias("id"), F.col("qe").alias("vector")), b.select(F.col("base_id").alias("id"), F.col("be").alias("vector")), K + 1, ("query_id", "base_id", "i"), knn.identity_distances)
    second = knn.others(second, K, "i")
    mark = lambda df, one, two: df.select("query_id", "base_id", one.cast("int").alias("one"), two.cast("int").alias("two"))
    both = mark(rel["gt"], F.col("rk") <= K, F.lit(False)).union(mark(second, F.lit(False), F.lit(True)))
    both = both.groupBy("query_id", "base_id").agg(F.max("one").alias("one"), F.max("two").alias("two"))
    spread = F.abs(F.expr(SPARK.l2("qe", "be")) - F.round(F.expr(f"{SPARK.dot('qe', 'qe')} + {SPARK.dot('be', 'be')} - 2 * {SPARK.dot('qe', 'be')}"), 9))
    rows = both.join(q, "query_id").join(b, "base_id").withColumn("spread", spread)
    only = lambda x, y: F.sum((F.col(x) > F.col(y)).cast("long"))
    return rows.groupBy("query_id").agg(only("one", "two").alias("missing"), only("two", "one").alias("extra"), (F.max("spread") <= 2e-5).alias("within"))


@plan("G12 C6", "gt", "queries", "base", build=_gt_disagreement)
def gt_disagreement(d):
    """Ground truth against one by the norm identity: missing, extra, spread."""
    return f"""WITH p AS (SELECT g.query_id, g.base_id, g.rk, g.d, round({d.dot('qe', 'qe')} + {d.dot('be', 'be')} - 2 * {d.dot('qe', 'be')}, 9) AS i FROM pl_gt g JOIN pl_queries q ON g.query_id = q.query_id JOIN pl_base b ON g.base_id = b.base_id),
      o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i, base_id) AS ri FROM p)
      SELECT query_id, CAST(sum(CASE WHEN rk <= {K} AND ri > {K} THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(sum(CASE WHEN rk > {K} AND ri <= {K} THEN 1 ELSE 0 END) AS BIGINT) AS extra, max(abs(d - i)) <= 2e-5 AS within FROM o GROUP BY query_id"""


@plan("G13 L3 N4", "pool", "scored", "ranked", "gt", "perq", "gaps", "refined")
def pool_audit(d):
    """Violations of what must hold, each found in another way than the relation was made; every count is 0."""
    again = "SELECT query_id, max(CASE WHEN c = 9 THEN score END) AS s9, max(CASE WHEN c = 12 THEN score END) AS s12 FROM (SELECT query_id, score, rank() OVER (PARTITION BY query_id ORDER BY score, base_id) AS c FROM pl_scored WHERE model = 'coarse') AS z_ GROUP BY query_id"
    return f"""SELECT 'pool repeats' AS check_name, CAST(count(*) AS BIGINT) AS violations FROM (SELECT query_id, base_id FROM pl_pool GROUP BY query_id, base_id HAVING count(*) > 1) AS a_
      UNION ALL SELECT 'pool size', CAST(count(*) AS BIGINT) FROM (SELECT query_id FROM pl_pool GROUP BY query_id HAVING count(*) <> {POOL}) AS b_
      UNION ALL SELECT 'order', CAST(count(*) AS BIGINT) FROM pl_pool a JOIN pl_pool b ON a.query_id = b.query_id AND b.pos = a.pos + 1 WHERE b.adc < a.adc
      UNION ALL SELECT 'rank bijection', CAST(count(*) AS BIGINT) FROM (SELECT query_id, model FROM pl_ranked GROUP BY query_id, model HAVING count(DISTINCT er) <> count(*) OR count(DISTINCT sr) <> count(*)) AS c_
      UNION ALL SELECT 'truth in pool ranks first', CAST(count(*) AS BIGINT) FROM (SELECT query_id, model, sum(in_gt) AS g, sum(CASE WHEN er <= {K} THEN in_gt ELSE 0 END) AS t FROM pl_ranked GROUP BY query_id, model) AS e_ WHERE g <> t
      UNION ALL SELECT 'gap', CAST(count(*) AS BIGINT) FROM ({again}) AS f_ JOIN pl_gaps g ON f_.query_id = g.query_id WHERE coalesce(f_.s12 - f_.s9, CAST('Infinity' AS DOUBLE)) <> g.gap
      UNION ALL SELECT 'decision', CAST(count(*) AS BIGINT) FROM ({again}) AS h_ JOIN pl_gaps g ON h_.query_id = g.query_id WHERE (coalesce(h_.s12 - h_.s9, CAST('Infinity' AS DOUBLE)) <= 0.02E0) <> (g.gap <= 0.02E0)
      UNION ALL SELECT 'top 16', CAST(count(*) AS BIGINT) FROM (SELECT a.query_id, count(b.base_id) AS closer, max(a.sr) AS sr FROM pl_ranked a LEFT JOIN pl_scored b ON a.query_id = b.query_id AND a.model = b.model AND (b.score < a.score OR (b.score = a.score AND b.pos < a.pos))
        WHERE a.sr <= 16 GROUP BY a.query_id, a.model, a.base_id) AS i_ WHERE closer + 1 <> sr
      UNION ALL SELECT 'oracle membership', CAST(count(*) AS BIGINT) FROM (SELECT p.query_id, p.model, max(p.exact_hits) AS kept, count(g.base_id) AS found FROM pl_perq p LEFT JOIN pl_scored s ON p.query_id = s.query_id AND p.model = s.model
        LEFT JOIN pl_gt g ON s.query_id = g.query_id AND s.base_id = g.base_id AND g.rk <= {K} GROUP BY p.query_id, p.model) AS j_ WHERE kept <> found
      UNION ALL SELECT 'refinement', CAST(count(*) AS BIGINT) FROM pl_refined r JOIN pl_perq p ON r.query_id = p.query_id AND p.model = 'coarse' WHERE r.native_hits <> p.score_hits OR r.refined_hits > p.exact_hits"""


@plan("F1", "edges")
def knn_graph(d):
    return "SELECT src, CAST(rk AS BIGINT) AS rank, dst FROM pl_edges"


@plan("F2", "edges")
def graph_fingerprint(d):
    """A hash of bucket hashes of node hashes: a bucket has the nodes of 4,096 ids in a row."""
    nodes = f"SELECT src, CAST(floor(src / 4096) AS BIGINT) AS bucket, count(*) AS n, {d.sha256(d.names('dst', 'rk'))} AS h FROM pl_edges GROUP BY src"
    buckets = f"SELECT bucket, sum(n) AS n, {d.sha256(d.names('h', 'src'))} AS h FROM ({nodes}) AS x_ GROUP BY bucket"
    return f"SELECT {d.sha256(d.names('h', 'bucket'))} AS fingerprint, CAST(sum(n) AS BIGINT) AS edges FROM ({buckets}) AS y_"


def _storage_swap(rel):
    """The edges are hashed before and after; a difference, or a search that met an unknown node, is an error."""
    spark = rel["edges"].sparkSession
    stamp = lambda: over(spark, graph_fingerprint(SPARK), {"edges": rel["edges"]}).first()["fingerprint"]
    before = stamp()
    found = over(spark, _SWAPPED, rel).withColumn("before", F.lit(before))
    kept = materialize(found)
    if stamp() != before:
        raise ValueError("the graph has changed while it was searched")
    return kept.select("before", "model", "queries", "evaluated", "unknown", F.lit(True).alias("unchanged"))


_SWAPPED = "SELECT w.model, CAST(count(DISTINCT w.query_id) AS BIGINT) AS queries, CAST(count(*) AS BIGINT) AS evaluated, CAST(sum(CASE WHEN n.src IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unknown FROM pl_walked w LEFT JOIN (SELECT DISTINCT src FROM pl_edges) n ON w.base_id = n.src GROUP BY w.model"


@plan("F3", "walked", "edges", build=_storage_swap)
def storage_swap(d):
    """One graph, its distance source swapped: vectors, and two models' codes. Its fingerprint stays."""
    return f"SELECT f.fingerprint AS before, s.*, true AS unchanged FROM ({_SWAPPED}) s CROSS JOIN ({graph_fingerprint(d)}) f"


@plan("F4 F6", "recorded")
def evaluation_record(d):
    """Every vector that a search of two levels evaluates, once a phase, with the step of its first evaluation."""
    return "SELECT query_id, model, phase, step, base_id, round(dist, 9) AS dist FROM pl_recorded"


@plan("F4 F5 F7", "recorded", "gt")
def phase_split(d):
    """Evaluations on the whole graph, and those on the upper level only; where the descent ended; and the truth that the beam's results and evaluations hold."""
    n = lambda x: f"CAST(sum(CASE WHEN {x} THEN 1 ELSE 0 END) AS BIGINT)"
    return f"""SELECT query_id, model, {n("phase = 'upper'")} AS upper, {n("phase = 'upper' AND below = 0")} AS upper_only, {n("phase = 'level0'")} AS level0, max(CASE WHEN phase = 'level0' AND step = 0 THEN base_id END) AS entry, max(CASE WHEN phase = 'upper' THEN step END) AS moves, max(CASE WHEN phase = 'level0' THEN step END) AS rounds,
      {n(f"phase = 'level0' AND place <= {K} AND true_")} AS native_hits, {n("phase = 'level0' AND true_")} AS pool_hits FROM (
      SELECT r.*, g.base_id IS NOT NULL AS true_, sum(CASE WHEN phase = 'level0' THEN 1 ELSE 0 END) OVER (PARTITION BY r.query_id, model, r.base_id) AS below, row_number() OVER (PARTITION BY r.query_id, model, phase ORDER BY dist, r.base_id) AS place
      FROM pl_recorded r LEFT JOIN (SELECT query_id, base_id FROM pl_gt WHERE rk <= {K}) g ON r.query_id = g.query_id AND r.base_id = g.base_id) AS x_ GROUP BY query_id, model"""


@plan("F8", "pool", "edges", "gt")
def graph_expansion(d):
    """Coverage of the truth by the first 8 candidates and one or two hops from them."""
    return f"""WITH h0 AS (SELECT query_id, base_id FROM pl_pool WHERE pos < 8), h1 AS (SELECT query_id, base_id FROM h0 UNION SELECT query_id, dst FROM h0 JOIN pl_edges e ON h0.base_id = e.src WHERE rk <= 4),
      h2 AS (SELECT query_id, base_id FROM h1 UNION SELECT query_id, dst FROM h1 JOIN pl_edges e ON h1.base_id = e.src WHERE rk <= 4), u AS (SELECT 0 AS hops, * FROM h0 UNION ALL SELECT 1, * FROM h1 UNION ALL SELECT 2, * FROM h2)
      SELECT u.query_id, CAST(hops AS BIGINT) AS hops, CAST(count(*) AS BIGINT) AS reached, CAST(count(g.base_id) AS BIGINT) AS found FROM u LEFT JOIN (SELECT query_id, base_id FROM pl_gt WHERE rk <= {K}) g ON u.query_id = g.query_id AND u.base_id = g.base_id GROUP BY u.query_id, hops"""
