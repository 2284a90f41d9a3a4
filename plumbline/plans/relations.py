"""The relations that plans share."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sketches
from ..functions.ranks import placed
from ..functions.storage import materialize
from ..operators import graph, knn, permutations, quantizers
from .core import relation

K, POOL, PARTS, CODES, DIMS = 10, 128, 8, 16, 64
#: Rounds of k-means, of one codebook and of families; most rounds of a walk over the neighbour graph, its width, edges a node and entries.
ROUNDS, FAMILY_ROUNDS, WALK = 25, 5, (12, 32, 8, 8)
#: Widths of the sweep, that of ``WALK`` among them.
SWEEP = (8, 32, 96)
#: Distance sources of one graph: vectors, the codebook's codes, and those of a model with more sub-spaces.
SOURCES = ("exact", "coarse", "fine")
#: Families of trained quantizers. The pool's own codebook is the model ``coarse``.
MODELS = {
    "": [quantizers.Model("fine", 2 * PARTS)],
    "5": [quantizers.Model(f"s{i}", PARTS, seed=i) for i in range(5)],
    "9": [quantizers.Model(f"g{i}{j}", PARTS, seed=j, subset=i) for i in range(3) for j in range(3)],
    "15": [quantizers.Model(f"r{i}{j}", PARTS, seed=j, turn=i + 1) for i in range(5) for j in range(3)],
}


def _vectors(spark, sf_dir, rel):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").cast("long").alias("label")).filter("e IS NOT NULL")


@relation("vectors", build=_vectors)
def vectors(d):
    return "SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(label AS BIGINT) AS label FROM embeddings WHERE embedding IS NOT NULL"


@relation("queries", "vectors")
def queries(d):
    """The stated query set; it is searched for in all rows but its own."""
    return "SELECT vec_id AS query_id, e AS qe, label AS q_label FROM pl_vectors WHERE vec_id % 20 = 0"


@relation("base", "vectors")
def base(d):
    return "SELECT vec_id AS base_id, e AS be, label AS b_label FROM pl_vectors"


@relation("gt", "queries", "base", build=lambda spark, sf_dir, rel: knn.exact_top_k(rel("queries"), rel("base"), K + 1, same=True), keep=True)
def gt(d):
    return f"""SELECT query_id, base_id, d, rk FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, base_id) AS rk
      FROM (SELECT query_id, base_id, {d.l2('qe', 'be')} AS d FROM pl_queries JOIN pl_base ON query_id <> base_id)) WHERE rk <= {K + 1}"""


@relation("subs", "base", build=lambda spark, sf_dir, rel: quantizers.sub_vectors(rel("base"), PARTS, DIMS))
def subs(d):
    w = DIMS // PARTS
    return f"SELECT base_id, m, be[m * {w} + 1 : m * {w} + {w}] AS s FROM pl_base, (SELECT unnest(range({PARTS})) AS m)"


@relation("codebook", "base", build=lambda spark, sf_dir, rel: materialize(quantizers.train_codebook(rel("base"), PARTS, CODES, DIMS, ROUNDS)), keep=True)
def codebook(d):
    """K-means by subspace, its rounds written out."""
    w, steps = DIMS // PARTS, []
    for k in range(ROUNDS):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT m, s, c FROM (SELECT x.m, s, c, row_number() OVER (PARTITION BY base_id, x.m ORDER BY {d.l2('s', 'centroid')}, c) AS q FROM t_ x JOIN k{k} ON x.m = k{k}.m) WHERE q = 1)""")
        steps.append(f"""k{k + 1} AS MATERIALIZED (SELECT o.m, o.c, coalesce(n.mean, o.centroid) AS centroid FROM k{k} o LEFT JOIN (SELECT m, c, list(x ORDER BY j) AS mean FROM (
          SELECT m, c, j, round(avg(x), 4) AS x FROM (SELECT m, c, unnest(range({w})) AS j, unnest(s) AS x FROM a{k}) GROUP BY m, c, j) GROUP BY m, c) n ON o.m = n.m AND o.c = n.c)""")
    return f"""WITH o_ AS MATERIALIZED (SELECT base_id, be, row_number() OVER (ORDER BY {d.hash_order("'11'", 'base_id')}, base_id) - 1 AS r FROM pl_base),
      t_ AS MATERIALIZED (SELECT base_id, r, m, be[m * {w} + 1 : m * {w} + {w}] AS s FROM o_, (SELECT unnest(range({PARTS})) AS m) WHERE r < {CODES * quantizers.PER_CODE}),
      k0 AS MATERIALIZED (SELECT m, r AS c, s AS centroid FROM t_ WHERE r < {CODES}), {', '.join(steps)} SELECT m, c, centroid FROM k{ROUNDS}"""


@relation("codes", "subs", "codebook", build=lambda spark, sf_dir, rel: quantizers.encode(rel("subs"), rel("codebook")), keep=True)
def codes(d):
    return f"""SELECT base_id, m, c FROM (SELECT *, row_number() OVER (PARTITION BY base_id, m ORDER BY dist, c) AS r
      FROM (SELECT base_id, s.m, c, {d.l2('s.s', 'k.centroid')} AS dist FROM pl_subs s JOIN pl_codebook k ON s.m = k.m)) WHERE r = 1"""


@relation("pool", "queries", "codes", "codebook", build=lambda spark, sf_dir, rel: knn.others(quantizers.adc_top_k(rel("queries"), rel("codes"), rel("codebook"), POOL + 1), POOL, "adc").select("query_id", (F.col("rk") - 1).cast("long").alias("pos"), "base_id", "adc"), keep=True)
def pool(d):
    w = DIMS // PARTS
    return f"""SELECT query_id, r - 1 AS pos, base_id, adc FROM (
      SELECT query_id, base_id, adc, row_number() OVER (PARTITION BY query_id ORDER BY adc, base_id) AS r FROM (
        SELECT query_id, base_id, sum(dist ORDER BY c.m) AS adc FROM pl_codes c JOIN (
          SELECT query_id, k.m, k.c, {d.l2(f'qe[k.m * {w} + 1 : k.m * {w} + {w}]', 'k.centroid')} AS dist FROM pl_queries CROSS JOIN pl_codebook k) l
        ON c.m = l.m AND c.c = l.c WHERE query_id <> base_id GROUP BY query_id, base_id)) WHERE r <= {POOL}"""


def _turned(v: str, turn: int) -> str:
    """A rotated list, for DuckDB."""
    if not turn:
        return v
    signs = quantizers.turn_signs(DIMS, turn)
    return f"list_transform(range({DIMS}), lambda i: list_sum(list_transform(range({DIMS}), lambda j: CASE WHEN (bit_count(i & j) + ({signs})[j + 1]) % 2 = 0 THEN {v}[j + 1] ELSE -{v}[j + 1] END)) / {DIMS**0.5!r}::DOUBLE)"


def _by_codes() -> str:
    """The sum of a lookup table's entries for a vector's codes, for DuckDB."""
    return f"list_sum(list_transform(codes, lambda c, m: lut[(m - 1) * {CODES} + c + 1]))"


def _family(sfx: str) -> None:
    models = MODELS[sfx]
    turns = sorted({m.turn for m in models})
    listed = ", ".join(f"('{m.name}', {m.parts}, {m.seed}, {'NULL' if m.subset is None else m.subset}, {m.turn})" for m in models)
    names = f"(VALUES {listed}) AS m_(model, parts, seed, subset, turn)"

    @relation(f"turned{sfx}", "base")
    def turned(d):
        return " UNION ALL ".join(f"SELECT {t} AS turn, base_id, {_turned('be', t)} AS x FROM pl_base" for t in turns)

    @relation(f"books{sfx}", "base", f"turned{sfx}", build=lambda spark, sf_dir, rel: materialize(quantizers.train_models(rel("base"), models, CODES, DIMS, FAMILY_ROUNDS)), keep=True)
    def books(d):
        """Codebooks of all models, the rounds of k-means written out."""
        steps = []
        for k in range(FAMILY_ROUNDS):
            steps.append(f"a{k} AS MATERIALIZED (SELECT x.model, x.m, any_value(s) AS s, arg_min(k{k}.c, ({d.l2('s', 'centroid')}, k{k}.c)) AS c FROM s_ x JOIN k{k} ON x.model = k{k}.model AND x.m = k{k}.m GROUP BY x.model, x.m, base_id)")
            steps.append(f"""k{k + 1} AS MATERIALIZED (SELECT o.model, o.m, o.c, coalesce(n.mean, o.centroid) AS centroid FROM k{k} o LEFT JOIN (SELECT model, m, c, list(x ORDER BY j) AS mean FROM (
              SELECT model, m, c, j, round(avg(x), 4) AS x FROM (SELECT model, m, c, unnest(range(len(s))) AS j, unnest(s) AS x FROM a{k}) GROUP BY model, m, c, j) GROUP BY model, m, c) n ON o.model = n.model AND o.m = n.m AND o.c = n.c)""")
        return f"""WITH t_ AS MATERIALIZED (SELECT model, parts, base_id, x, row_number() OVER (PARTITION BY model ORDER BY {d.hash_order('seed', 'base_id')}, base_id) - 1 AS c
            FROM {names} JOIN pl_turned{sfx} USING (turn) CROSS JOIN (SELECT count(*) AS n FROM pl_base) AS n_
            WHERE ('0x' || left({d.hash_order("'11'", 'base_id')}, 8))::BIGINT < least(1, {CODES * quantizers.PER_CODE}::DOUBLE / n) * 4294967296.0 AND (subset IS NULL OR {d.hash_order("'subset'", 'subset', 'base_id')} < '{quantizers.THIRD}')),
          s_ AS MATERIALIZED (SELECT model, base_id, m, c, x[m * ({DIMS} // parts) + 1 : (m + 1) * ({DIMS} // parts)] AS s FROM (SELECT *, unnest(range(parts)) AS m FROM t_)),
          k0 AS MATERIALIZED (SELECT model, m, c, s AS centroid FROM s_ WHERE c < {CODES}), {', '.join(steps)} SELECT model, m, c, centroid FROM k{FAMILY_ROUNDS}"""

    @relation(f"coded{sfx}", "base", f"turned{sfx}", f"books{sfx}", build=lambda spark, sf_dir, rel: quantizers.encode_models(rel("base"), models, quantizers.books_of(rel(f"books{sfx}"))), keep=True)
    def coded(d):
        return f"""SELECT base_id, model, list(c ORDER BY m) AS codes FROM (SELECT base_id, k.model, k.m, arg_min(c, ({d.l2(f'x[k.m * ({DIMS} // parts) + 1 : (k.m + 1) * ({DIMS} // parts)]', 'centroid')}, c)) AS c
          FROM {names} JOIN pl_turned{sfx} USING (turn) JOIN pl_books{sfx} k ON m_.model = k.model GROUP BY base_id, k.model, k.m) GROUP BY base_id, model"""

    @relation(f"luts{sfx}", "queries", f"books{sfx}")
    def luts(d):
        rows = " UNION ALL ".join(f"SELECT {t} AS turn, query_id, {_turned('qe', t)} AS x FROM pl_queries" for t in turns)
        return f"""SELECT query_id, model, list(dist ORDER BY m, c) AS lut FROM (SELECT query_id, k.model, m, c, {d.l2(f'x[m * ({DIMS} // parts) + 1 : (m + 1) * ({DIMS} // parts)]', 'centroid')} AS dist
          FROM {names} JOIN ({rows}) AS q_ USING (turn) JOIN pl_books{sfx} k ON m_.model = k.model) GROUP BY query_id, model"""

    def _scored(spark, sf_dir, rel):
        return quantizers.score_pool(rel("pool"), rel("queries"), rel("base"), rel(f"coded{sfx}"), models, quantizers.books_of(rel(f"books{sfx}")), None if sfx else "coarse")

    @relation(f"scored{sfx}", "pool", "queries", "base", f"coded{sfx}", f"luts{sfx}", build=_scored, keep=True)
    def scored(d):
        pooled = "" if sfx else f"UNION ALL SELECT p.query_id, p.pos, p.base_id, {d.l2('qe', 'be')} AS exact, 'coarse' AS model, adc AS score FROM pl_pool p JOIN pl_queries q ON p.query_id = q.query_id JOIN pl_base b ON p.base_id = b.base_id"
        return f"""SELECT p.query_id, p.pos, p.base_id, {d.l2('qe', 'be')} AS exact, c.model, {_by_codes()} AS score
          FROM pl_pool p JOIN pl_queries q ON p.query_id = q.query_id JOIN pl_base b ON p.base_id = b.base_id JOIN pl_coded{sfx} c ON p.base_id = c.base_id JOIN pl_luts{sfx} l ON p.query_id = l.query_id AND l.model = c.model {pooled}"""

    @relation(f"ranked{sfx}", f"scored{sfx}", "gt", keep=True)
    def ranked(d):
        w = "PARTITION BY s.query_id, s.model ORDER BY"
        return f"""SELECT s.query_id, s.model, s.pos, s.base_id, s.exact, s.score,
          CAST(row_number() OVER ({w} s.exact, s.pos) AS BIGINT) AS er, CAST(row_number() OVER ({w} s.score, s.pos) AS BIGINT) AS sr,
          CAST(CASE WHEN g.base_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS in_gt
          FROM pl_scored{sfx} s LEFT JOIN (SELECT query_id, base_id FROM pl_gt WHERE rk <= {K}) g ON s.query_id = g.query_id AND s.base_id = g.base_id"""

    @relation(f"perq{sfx}", f"ranked{sfx}", keep=True)
    def perq(d):
        pick = lambda col, key, r: f"max(CASE WHEN {key} = {r} THEN {col} END)"
        return f"""SELECT *, exact_hits - score_hits AS loss_hits,
          CASE WHEN agreement = {K} THEN 'Stable' WHEN exact_hits > score_hits THEN 'Harmful' WHEN exact_hits = score_hits THEN 'Benign' ELSE 'Lucky' END AS class
          FROM (SELECT query_id, model, {pick('exact', 'er', 1)} AS d1, {pick('exact', 'er', 10)} AS d10, {pick('exact', 'er', 11)} AS d11, {pick('exact', 'er', 20)} AS d20,
            {pick('exact', 'er', 9)} AS d9, {pick('exact', 'er', 12)} AS d12, {pick('exact', 'er', 6)} AS d6, {pick('exact', 'er', 15)} AS d15,
            {pick('score', 'sr', 9)} AS s9, {pick('score', 'sr', 10)} AS s10, {pick('score', 'sr', 11)} AS s11, {pick('score', 'sr', 12)} AS s12,
            CAST(sum(CASE WHEN er <= {K} AND sr <= {K} THEN 1 ELSE 0 END) AS BIGINT) AS agreement,
            CAST(sum(CASE WHEN er <= {K} THEN in_gt ELSE 0 END) AS BIGINT) AS exact_hits,
            CAST(sum(CASE WHEN sr <= {K} THEN in_gt ELSE 0 END) AS BIGINT) AS score_hits,
            CAST(sum(in_gt) AS BIGINT) AS pool_hits, avg(abs(score - exact)) AS mae, avg(score - exact) AS bias,
            CAST(count(*) AS BIGINT) AS n FROM pl_ranked{sfx} GROUP BY query_id, model) AS p_"""

    @relation(f"inversions{sfx}", f"ranked{sfx}", keep=True)
    def inversions(d):
        return f"""SELECT a.query_id, a.model, a.base_id AS inside_id, b.base_id AS outside_id, a.er AS inside_rank, b.er AS outside_rank,
          b.exact - a.exact AS margin, a.score - b.score AS violation, a.in_gt AS inside_gt, b.in_gt AS outside_gt, a.sr AS inside_score_rank, b.sr AS outside_score_rank
          FROM (SELECT * FROM pl_ranked{sfx} WHERE er <= {K}) a JOIN (SELECT * FROM pl_ranked{sfx} WHERE er > {K}) b
          ON a.query_id = b.query_id AND a.model = b.model WHERE a.exact < b.exact AND a.score > b.score"""


for _sfx in MODELS:
    _family(_sfx)


@relation("stored", "codes", "coded", build=lambda spark, sf_dir, rel: _stored(rel), keep=True)
def stored(d):
    """The codes of both models of a walk."""
    return "SELECT base_id, 'coarse' AS model, list(c ORDER BY m) AS codes FROM pl_codes GROUP BY base_id UNION ALL SELECT base_id, model, codes FROM pl_coded"


def _stored(rel):
    listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col("m").cast("long").alias("m"), F.col("c").cast("long").alias("c")))), lambda e: e["c"])
    return rel("codes").groupBy("base_id").agg(listed.alias("codes")).select("base_id", F.lit("coarse").alias("model"), "codes").unionByName(rel("coded"))


@relation("tables", "queries", "codebook", "luts", build=lambda spark, sf_dir, rel: _tables(rel), keep=True)
def tables(d):
    """Every query's distances to the centroids of both models."""
    w = DIMS // PARTS
    return f"SELECT query_id, 'coarse' AS model, list(dist ORDER BY m, c) AS lut FROM (SELECT query_id, m, c, {d.l2(f'qe[m * {w} + 1 : m * {w} + {w}]', 'centroid')} AS dist FROM pl_queries CROSS JOIN pl_codebook) GROUP BY query_id UNION ALL SELECT * FROM pl_luts"


def _tables(rel):
    models = [quantizers.Model("coarse", PARTS), *MODELS[""]]
    books = quantizers.books_of(rel("codebook").withColumn("model", F.lit("coarse")).unionByName(rel("books")))
    return quantizers.lookup_tables(rel("queries"), models, books)


def _searches(sfx: str, rounds: int, width: int, degree: int, entries: int) -> None:
    @relation(f"walked{sfx}", "queries", "base", "edges", "stored", "tables", build=lambda spark, sf_dir, rel: graph.walk(rel("queries"), rel("base"), rel("edges"), rel("stored"), rel("tables"), list(SOURCES), rounds, width, degree, entries), keep=True)
    def walked(d):
        """What searches of one graph evaluate, by exact distances and by codes. Rounds after a search's end add nothing."""
        names = ", ".join(f"('{m}')" for m in SOURCES)
        scored = lambda rows: f"""SELECT x.query_id, x.model, x.base_id, {d.l2('qe', 'be')} AS exact, CASE WHEN x.model = 'exact' THEN {d.l2('qe', 'be')} ELSE {_by_codes()} END AS dist
          FROM ({rows}) x JOIN pl_queries q ON x.query_id = q.query_id JOIN pl_base b ON x.base_id = b.base_id LEFT JOIN pl_stored s ON x.base_id = s.base_id AND x.model = s.model LEFT JOIN pl_tables l ON x.query_id = l.query_id AND x.model = l.model WHERE x.query_id <> x.base_id"""  # noqa: E731
        first = f"SELECT base_id FROM pl_base ORDER BY {d.hash_order(chr(39) + '13' + chr(39), 'base_id')}, base_id LIMIT {entries}"
        steps = [f"v0 AS MATERIALIZED ({scored(f'SELECT query_id, model, base_id FROM pl_queries CROSS JOIN (VALUES {names}) AS s(model) CROSS JOIN ({first})')})"]
        for k in range(rounds):
            beam = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, model ORDER BY dist, base_id) AS r FROM v{k}) WHERE r <= {width}"
            new = f"SELECT DISTINCT m.query_id, m.model, e.dst AS base_id FROM ({beam}) m JOIN pl_edges e ON m.base_id = e.src WHERE e.rk <= {degree} AND NOT EXISTS (SELECT 1 FROM v{k} o WHERE o.query_id = m.query_id AND o.model = m.model AND o.base_id = e.dst)"
            steps.append(f"v{k + 1} AS MATERIALIZED (SELECT * FROM v{k} UNION ALL {scored(new)})")
        return f"WITH {', '.join(steps)} SELECT query_id, model, base_id, exact, dist FROM v{rounds}"


    @relation(f"searched{sfx}", f"walked{sfx}", "gt", keep=True)
    def searched(d):
        """For each distance source: hits of its own order, of the exact order of all it evaluated, and of its best 16 in exact order."""
        order = lambda by: f"row_number() OVER (PARTITION BY w.query_id, model ORDER BY {by}, w.base_id)"
        return f"""SELECT query_id, model, CAST(sum(CASE WHEN nr <= {K} THEN in_gt ELSE 0 END) AS BIGINT) AS native_hits, CAST(sum(CASE WHEN er <= {K} THEN in_gt ELSE 0 END) AS BIGINT) AS oracle_hits,
          CAST(sum(CASE WHEN rr <= {K} AND nr <= 16 THEN in_gt ELSE 0 END) AS BIGINT) AS all16_hits, CAST(sum(in_gt) AS BIGINT) AS pool_hits, CAST(count(*) AS BIGINT) AS evaluated,
          max(CASE WHEN er = {K} THEN exact END) = max(CASE WHEN er = {K + 1} THEN exact END) AS oracle_tie, max(CASE WHEN nr = 16 THEN dist END) = max(CASE WHEN nr = 17 THEN dist END) AS tie16
          FROM (SELECT *, row_number() OVER (PARTITION BY query_id, model, nr <= 16 ORDER BY exact, base_id) AS rr FROM (
            SELECT w.query_id, model, w.base_id, exact, dist, {order('dist')} AS nr, {order('exact')} AS er, CASE WHEN g.base_id IS NULL THEN 0 ELSE 1 END AS in_gt
            FROM pl_walked{sfx} w LEFT JOIN (SELECT query_id, base_id FROM pl_gt WHERE rk <= {K}) g ON w.query_id = g.query_id AND w.base_id = g.base_id) AS a_) AS b_ GROUP BY query_id, model"""


for _width in SWEEP:
    _searches("" if _width == WALK[1] else str(_width), WALK[0], _width, *WALK[2:])


#: Moves on the upper level, at most, and its links a node.
MOVES, LINKS = 8, 8


@relation("upper", "base", build=lambda spark, sf_dir, rel: graph.upper_level(rel("base"), LINKS), keep=True)
def upper(d):
    nodes = f"(SELECT base_id, be FROM pl_base WHERE starts_with({d.hash_order(chr(39) + '5' + chr(39), 'base_id')}, '0'))"
    return f"SELECT src, dst, rk FROM (SELECT a.base_id AS src, b.base_id AS dst, row_number() OVER (PARTITION BY a.base_id ORDER BY {d.l2('a.be', 'b.be')}, b.base_id) AS rk FROM {nodes} a JOIN {nodes} b ON a.base_id <> b.base_id) WHERE rk <= {LINKS}"


@relation("recorded", "queries", "base", "edges", "upper", "stored", "tables", build=lambda spark, sf_dir, rel: graph.level_search(rel("queries"), rel("base"), rel("edges"), rel("upper"), rel("stored"), rel("tables"), list(SOURCES), MOVES, *WALK[:3]), keep=True)
def recorded(d):
    """What searches of two levels evaluate, with the step of each vector's first evaluation in a phase."""
    names = ", ".join(f"('{m}')" for m in SOURCES)
    limit, width, degree, _ = WALK
    dist = f"CASE WHEN x.model = 'exact' THEN {d.l2('qe', 'be')} ELSE {_by_codes()} END"
    scored = lambda rows: f"""SELECT x.query_id, x.model, x.base_id, {dist} AS dist FROM ({rows}) x JOIN pl_queries q ON x.query_id = q.query_id JOIN pl_base b ON x.base_id = b.base_id
      LEFT JOIN pl_stored s ON x.base_id = s.base_id AND x.model = s.model LEFT JOIN pl_tables l ON x.query_id = l.query_id AND x.model = l.model WHERE x.query_id <> x.base_id"""  # noqa: E731
    first = f"SELECT base_id, row_number() OVER (ORDER BY {d.hash_order(chr(39) + '5' + chr(39), 'base_id')}, base_id) AS k FROM pl_base"
    steps = [f"o0 AS MATERIALIZED ({scored(f'SELECT query_id, model, arg_min(base_id, k) AS base_id FROM pl_queries CROSS JOIN (VALUES {names}) AS s_(model) CROSS JOIN (SELECT * FROM ({first}) WHERE k <= 2) AS f_ WHERE query_id <> base_id GROUP BY query_id, model')})", "u0 AS (SELECT *, 0 AS step FROM o0)"]
    for k in range(MOVES):
        steps.append(f"u{k + 1} AS MATERIALIZED (SELECT *, {k + 1} AS step FROM ({scored(f'SELECT o.query_id, o.model, e.dst AS base_id FROM o{k} o JOIN pl_upper e ON o.base_id = e.src')}))")
        steps.append(f"""o{k + 1} AS MATERIALIZED (SELECT o.query_id, o.model, CASE WHEN n.dist < o.dist THEN n.base_id ELSE o.base_id END AS base_id, CASE WHEN n.dist < o.dist THEN n.dist ELSE o.dist END AS dist
          FROM o{k} o LEFT JOIN (SELECT query_id, model, min(dist) AS dist, arg_min(base_id, (dist, base_id)) AS base_id FROM u{k + 1} GROUP BY query_id, model) n ON o.query_id = n.query_id AND o.model = n.model)""")
    steps.append(f"v0 AS MATERIALIZED (SELECT *, 0 AS step FROM ({scored(f'SELECT query_id, model, base_id FROM o{MOVES}')}))")
    for k in range(limit):
        beam = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, model ORDER BY dist, base_id) AS r FROM v{k}) WHERE r <= {width}"
        new = f"SELECT DISTINCT m.query_id, m.model, e.dst AS base_id FROM ({beam}) m JOIN pl_edges e ON m.base_id = e.src WHERE e.rk <= {degree} AND NOT EXISTS (SELECT 1 FROM v{k} o WHERE o.query_id = m.query_id AND o.model = m.model AND o.base_id = e.dst)"
        steps.append(f"v{k + 1} AS MATERIALIZED (SELECT * FROM v{k} UNION ALL SELECT *, {k + 1} AS step FROM ({scored(new)}))")
    uppers = " UNION ALL ".join(f"SELECT * FROM u{k}" for k in range(MOVES + 1))
    once = lambda rows, phase: f"SELECT query_id, model, '{phase}' AS phase, CAST(min(step) AS BIGINT) AS step, base_id, min(dist) AS dist FROM ({rows}) GROUP BY query_id, model, base_id"
    return f"WITH {', '.join(steps)} {once(uppers, 'upper')} UNION ALL {once(f'SELECT * FROM v{limit}', 'level0')}"


@relation("decomposed", "searched")
def decomposed(d):
    """The losses of a search over rounded vectors against the exact search of the same graph."""
    return f"""SELECT p.query_id, p.model, e.native_hits AS native_exact_hits, e.oracle_hits AS oracle_exact_hits, p.native_hits, p.oracle_hits, p.all16_hits, p.pool_hits,
      (e.native_hits - p.native_hits) / {K}.0E0 AS total_loss, (e.oracle_hits - p.oracle_hits) / {K}.0E0 AS discovery_loss, (p.oracle_hits - p.native_hits) / {K}.0E0 AS ranking_loss, (e.oracle_hits - e.native_hits) / {K}.0E0 AS control_delta,
      p.oracle_tie AS boundary_tie, p.tie16, p.oracle_hits = p.pool_hits OR p.oracle_tie AS explained FROM pl_searched p JOIN pl_searched e ON p.query_id = e.query_id AND e.model = 'exact' WHERE p.model <> 'exact'"""


@relation("error_sketch", "perq", build=lambda spark, sf_dir, rel: sketches.sketch(rel("perq"), "mae", ["model", "class"]), keep=True)
def error_sketch(d):
    """Errors of the finest groups as counts by step of their leading bits."""
    cut = f"greatest(length(bin(v)) - {sketches.BITS}, 0)"
    return f"SELECT model, class, (v >> {cut}) << {cut} AS step, count(*) AS n FROM (SELECT model, class, CAST(floor(mae * {sketches.UNITS}) AS BIGINT) AS v FROM pl_perq) GROUP BY ALL"


@relation("loss", "perq")
def loss(d):
    """The coarse model's loss a query, in hits."""
    return "SELECT query_id, loss_hits AS loss, d11 - d10 AS margin, mae, class FROM pl_perq WHERE model = 'coarse'"


def _placed(name: str, source: str, key: str, ties: tuple[str, ...] = ("query_id",), group: tuple[str, ...] = (), weight: str | None = None, where: str = "true") -> None:
    """Rows of ``source`` with ``key_`` and their places: in Spark by ranges, in DuckDB by windows over all."""

    def build(spark, sf_dir, rel):
        return placed(rel(source).filter(where).withColumn("key_", F.expr(key)), ["key_"], ties, group, weight)

    @relation(name, source, build=build, keep=True)
    def body(d):
        part = f"PARTITION BY {', '.join(group)}" if group else ""
        order = f"{part} ORDER BY key_ NULLS LAST"
        sums = f", sum({weight}) OVER ({order}, {', '.join(ties)} ROWS UNBOUNDED PRECEDING) AS upto_, sum({weight}) OVER ({part}) AS sum_" if weight else ""
        return f"""SELECT *, row_number() OVER ({order}, {', '.join(ties)}) AS r_, rank() OVER ({order}) AS first_, rank() OVER ({order}) + count(*) OVER (PARTITION BY {', '.join([*group, 'key_'])}) - 1 AS last_, count(*) OVER ({part}) AS n_{sums}
          FROM (SELECT *, {key} AS key_ FROM pl_{source} WHERE {where}) AS s_"""


_placed("loss_down", "loss", "-loss", weight="loss", where="loss > 0")
_placed("by_loss", "loss", "loss")
_placed("by_margin", "loss", "round(margin, 12)", weight="loss")
_placed("by_mae", "loss", "round(mae, 12)")
_placed("severity", "perq", "-loss_hits", group=("model",))


@relation("geometry", "perq5")
def geometry(d):
    """Features of a query's exact distances, and its mean loss under five models; a row a feature."""
    rows = " UNION ALL ".join(f"SELECT query_id, '{n}' AS feature, round({e}, 12) AS x, y FROM q" for n, e in {"margin": "margin", "d1": "d1", "spread": "spread"}.items())
    return f"WITH q AS (SELECT query_id, round(avg(CAST(loss_hits AS DOUBLE)), 12) AS y, max(d11 - d10) AS margin, max(d1) AS d1, max(d20 - d1) AS spread FROM pl_perq5 GROUP BY query_id) {rows}"


_placed("geometry_x", "geometry", "x", group=("feature",))
_placed("geometry_y", "geometry", "y", group=("feature",))
_placed("harm", "perq5", "loss_hits", group=("model",))


@relation("inversion_counts", "perq5", "inversions5")
def inversion_counts(d):
    return "SELECT p.query_id, p.model, p.loss_hits, coalesce(i.n, 0) AS inversions FROM pl_perq5 p LEFT JOIN (SELECT query_id, model, CAST(count(*) AS BIGINT) AS n FROM pl_inversions5 GROUP BY query_id, model) i ON p.query_id = i.query_id AND p.model = i.model"


_placed("by_inversions", "inversion_counts", "inversions", group=("model",))


@relation("random_pairs", "scored", keep=True)
def random_pairs(d):
    """512 different pairs of pool places a query: the k-th is a bijection of k keyed by the query, so none is drawn, sorted or looked up."""
    pairs = POOL * (POOL - 1) // 2
    odd = [p for p in range(2, pairs) if pairs % p == 0 and all(p % q for q in range(2, p))]  # factors that the step must not have
    step = f"(2 * {d.hash_int(chr(39) + '9' + chr(39), 'query_id')} + 1)"
    fit = " + ".join(f"CASE WHEN {step} % {p} = 0 THEN 2 ELSE 0 END" for p in odd if p > 2) or "0"
    at = f"CAST(floor((1 + sqrt(1 + 8E0 * t)) / 2) AS BIGINT)"  # noqa: F541
    return f"""WITH q AS (SELECT query_id, {step} + {fit} AS a, {d.hash_int(chr(39) + '10' + chr(39), 'query_id')} AS b FROM (SELECT query_id FROM pl_scored GROUP BY query_id) AS q_),
      t AS (SELECT query_id, (a % {pairs} * k + b) % {pairs} AS t FROM q CROSS JOIN {d.series(0, 511, 'k')} AS k_), p AS (SELECT query_id, {at} AS j, t - {at} * ({at} - 1) / 2 AS i FROM t)
      SELECT a.query_id, a.model, CAST(sum(CASE WHEN (a.exact - b.exact) * (a.score - b.score) < 0 THEN 1 ELSE 0 END) AS BIGINT) AS inverted, CAST(sum(CASE WHEN a.exact = b.exact OR a.score = b.score THEN 1 ELSE 0 END) AS BIGINT) AS ties, CAST(count(*) AS BIGINT) AS pairs
      FROM p JOIN pl_scored a ON p.query_id = a.query_id AND p.i = a.pos JOIN pl_scored b ON a.query_id = b.query_id AND a.model = b.model AND p.j = b.pos GROUP BY a.query_id, a.model"""


@relation("metrics", "ranked", "inversions", "random_pairs", keep=True)
def metrics(d):
    """Errors and inversions of a query under a model. The largest violation is over all pairs across the boundary, so it can be negative."""
    e = "abs(score - exact)"
    window = f"er BETWEEN {K - 5} AND {K + 5}"
    return f"""SELECT m.*, coalesce(i.inversions, 0) AS inversions, coalesce(i.inversions, 0) / ({K}.0E0 * (n - {K})) AS fraction, r.inverted / CAST(r.pairs AS DOUBLE) AS random_rate FROM (
      SELECT query_id, model, count(*) AS n, avg({e}) AS mae, avg(CASE WHEN exact > 1e-12 THEN {e} / exact END) AS relative_mae, CAST(sum(CASE WHEN exact > 1e-12 THEN 0 ELSE 1 END) AS BIGINT) AS omitted,
        avg(CASE WHEN {window} THEN {e} END) AS window_mae, max(CASE WHEN {window} THEN {e} END) AS window_max, max(CASE WHEN er <= {K} THEN score END) - min(CASE WHEN er > {K} THEN score END) AS max_violation,
        CAST(sum(CASE WHEN er <= {K} AND sr > {K} THEN 1 ELSE 0 END) AS BIGINT) AS displaced FROM pl_ranked GROUP BY query_id, model) AS m
      LEFT JOIN (SELECT query_id, model, CAST(count(*) AS BIGINT) AS inversions FROM pl_inversions GROUP BY query_id, model) i ON m.query_id = i.query_id AND m.model = i.model
      LEFT JOIN pl_random_pairs r ON m.query_id = r.query_id AND m.model = r.model"""


@relation("gaps", "perq")
def gaps(d):
    return "SELECT query_id, CASE WHEN n < 12 THEN CAST('Infinity' AS DOUBLE) ELSE s12 - s9 END AS gap FROM pl_perq WHERE model = 'coarse'"


@relation("refined", "ranked")
def refined(d):
    """Hits without refinement and with the exact order of the best 16, 32, 64 by score."""
    by = "PARTITION BY query_id, l ORDER BY exact, pos"
    return f"""SELECT query_id, l, CAST(sum(CASE WHEN sr <= {K} THEN in_gt ELSE 0 END) AS BIGINT) AS native_hits, CAST(sum(CASE WHEN rr <= {K} THEN in_gt ELSE 0 END) AS BIGINT) AS refined_hits
      FROM (SELECT r.query_id, l, sr, in_gt, row_number() OVER ({by}) AS rr FROM (SELECT * FROM pl_ranked WHERE model = 'coarse') r
        JOIN (SELECT CAST(16 AS BIGINT) AS l UNION ALL SELECT CAST(32 AS BIGINT) UNION ALL SELECT CAST(64 AS BIGINT)) AS t_ ON r.sr <= l) AS x_ GROUP BY query_id, l"""


@relation("policies", "refined", "gaps", "perq")
def policies(d):
    """Which queries each policy refines at a budget of a tenth, a quarter, a half; random orders are drawn a hundred times."""
    order = lambda expr: f"row_number() OVER (PARTITION BY f, rep, policy ORDER BY {expr})"
    return f"""SELECT query_id, f, policy, rep, native_hits, refined_hits, oracle_hits, CASE WHEN r <= floor(f * n) THEN 1 ELSE 0 END AS chosen FROM (
      SELECT b.*, p.policy, CASE policy WHEN 'gap' THEN {order('gap, query_id')} WHEN 'oracle' THEN {order('native_hits - refined_hits, query_id')} WHEN 'full loss' THEN {order('native_hits - oracle_hits, query_id')}
        ELSE {order(d.hash_order('rep', 'query_id'))} END AS r FROM (
        SELECT r.query_id, r.native_hits, r.refined_hits, q.exact_hits AS oracle_hits, gap, f, rep, count(*) OVER (PARTITION BY f, rep) AS n FROM pl_refined r JOIN pl_gaps g ON r.query_id = g.query_id JOIN pl_perq q ON r.query_id = q.query_id AND q.model = 'coarse'
        CROSS JOIN (SELECT 0.1E0 AS f UNION ALL SELECT 0.25E0 UNION ALL SELECT 0.5E0) AS f_ CROSS JOIN {d.series(0, REPLICATES - 1, 'rep')} AS r_ WHERE l = 16) b
      CROSS JOIN (SELECT 'gap' AS policy UNION ALL SELECT 'oracle' UNION ALL SELECT 'full loss' UNION ALL SELECT 'random') AS p) AS q_ WHERE policy = 'random' OR rep = 0"""


#: Random orders of queries.
REPLICATES = 100
#: Edges between exact ranks for residual permutations: none, 10, three, five, seven.
EDGES = {"N0": (), "N1": (10,), "N2": (5, 10, 20), "N3": (5, 10, 15, 20, 40), "N4": (5, 8, 10, 12, 15, 20, 40)}
DRAWS = 50


@relation("nulls", "ranked", build=lambda spark, sf_dir, rel: permutations.counted(rel("ranked"), K, {**EDGES, "N_distance": None}, DRAWS), keep=True)
def nulls(d):
    """Hits lost when residuals are permuted within bins of exact rank, by hash order."""
    rows = "(SELECT *, count(*) OVER (PARTITION BY query_id, model) AS of_ FROM pl_ranked)"
    cuts = {n: " + ".join(f"CASE WHEN er > {e} THEN 1 ELSE 0 END" for e in edges) or "0" for n, edges in EDGES.items()}
    # four bins of equal count, the first ones larger by one where that can't be
    small, extra = "floor(of_ / 4)", "of_ % 4"
    cuts["N_distance"] = f"CASE WHEN er <= ({extra}) * ({small} + 1) THEN floor((er - 1) / ({small} + 1)) ELSE {extra} + floor((er - 1 - ({extra}) * ({small} + 1)) / greatest({small}, 1)) END"
    bins = " UNION ALL ".join(f"SELECT *, '{n}' AS condition, CAST({cut} AS BIGINT) AS bin FROM {rows} AS c{n}" for n, cut in cuts.items())
    part = "PARTITION BY query_id, model, condition, draw, bin ORDER BY"
    return f"""WITH b AS ({bins}), x AS (SELECT b.*, draw FROM b CROSS JOIN {d.series(0, DRAWS - 1, 'draw')} AS d_),
      k AS (SELECT *, row_number() OVER ({part} er) AS place, row_number() OVER ({part} {d.hash_order("'7'", 'draw', 'query_id', 'base_id')}) AS drawn FROM x),
      p AS (SELECT a.query_id, a.model, a.condition, a.draw, a.pos, a.er, a.in_gt, a.exact, a.exact + (r.score - r.exact) AS score FROM k a JOIN k r
        ON a.query_id = r.query_id AND a.model = r.model AND a.condition = r.condition AND a.draw = r.draw AND a.bin = r.bin AND a.place = r.drawn),
      s AS (SELECT *, row_number() OVER (PARTITION BY query_id, model, condition, draw ORDER BY score, pos) AS sr FROM p)
      SELECT query_id, model, condition, draw, CAST(sum(CASE WHEN er <= {K} THEN in_gt ELSE 0 END) - sum(CASE WHEN sr <= {K} THEN in_gt ELSE 0 END) AS BIGINT) AS loss_hits,
        CAST(sum(CASE WHEN er <= {K} AND sr > {K} THEN 1 ELSE 0 END) AS BIGINT) AS displaced FROM s GROUP BY query_id, model, condition, draw"""


@relation("shuffled", "ranked", build=lambda spark, sf_dir, rel: permutations.moved(rel("ranked").filter("model = 'coarse'"), K, DRAWS), keep=True)
def shuffled(d):
    """The residuals that the unconditioned draws give the coarse model's candidates; Spark writes those of displaced members and intruders, which are all that are asked for."""
    return f"""WITH k AS (SELECT r.query_id, base_id, er, score - exact AS e, draw, row_number() OVER (PARTITION BY query_id, draw ORDER BY {d.hash_order("'7'", 'draw', 'query_id', 'base_id')}) AS drawn
        FROM pl_ranked r CROSS JOIN {d.series(0, DRAWS - 1, 'draw')} AS d_ WHERE model = 'coarse')
      SELECT a.query_id, a.draw, a.base_id, r.e FROM k a JOIN k r ON a.query_id = r.query_id AND a.draw = r.draw AND a.er = r.drawn"""


@relation("edges", "base", build=lambda spark, sf_dir, rel: _knn_graph(rel), keep=True)
def edges(d):
    return f"""SELECT src, dst, rk FROM (SELECT a.base_id AS src, b.base_id AS dst, row_number() OVER (PARTITION BY a.base_id ORDER BY {d.l2('a.be', 'b.be')}, b.base_id) AS rk
      FROM pl_base a JOIN pl_base b ON a.base_id <> b.base_id) WHERE rk <= 16"""


def _knn_graph(rel):
    from ..operators.graph import knn_graph

    return knn_graph(rel("base"), 16)


@relation("latency")
def latency(d):
    return "SELECT CAST(event_type AS STRING) AS policy, CAST(1 + user_id % 4 AS BIGINT) AS workers, CAST(event_id % 3 AS BIGINT) AS rep, CAST(event_id AS BIGINT) AS query_id, CAST(value AS DOUBLE) AS us FROM events WHERE value > 0"


def _latency(spark, sf_dir, rel):
    """A stand-in for latency traces: the positive values of the events table."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("value > 0")
    return e.select(
        F.col("event_type").cast("string").alias("policy"), (1 + F.col("user_id") % 4).cast("long").alias("workers"), (F.col("event_id") % 3).cast("long").alias("rep"), F.col("event_id").cast("long").alias("query_id"), F.col("value").cast("double").alias("us")
    )


@relation("components", "latency")
def components(d):
    """A stand-in for component clocks: parts of an event's value by digits of its own id and value; the last part is measured to whole units only."""
    return """SELECT policy, query_id, us AS total_us, us * (0.5E0 + (query_id % 31) / 100.0E0) AS search_us, us * (query_id % 7) / 100.0E0 AS gap_us, us * (query_id % 11) / 100.0E0 AS refine_us,
      floor(us * (0.5E0 - (query_id % 31) / 100.0E0 - (query_id % 7) / 100.0E0 - (query_id % 11) / 100.0E0)) AS final_us FROM pl_latency"""


from .core import RELATIONS  # noqa: E402

RELATIONS["latency"].build = _latency
