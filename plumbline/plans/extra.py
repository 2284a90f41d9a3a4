"""Queries that SQL can't check: graph search, folds, random draws, files, streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.storage import shared_dir
from ..operators import descent, graph, knn, quantizers
from ..sources import arrow_ipc, records, xvecs
from ..streaming import refinement
from .core import get


def beam_search(spark, sf_dir):
    """Every evaluation of a beam over the neighbour graph, exact distances."""
    return graph.beam_search(get(spark, sf_dir, "queries"), get(spark, sf_dir, "base"), get(spark, sf_dir, "edges"), 32, 10, same=True)


def beam_search_quantized(spark, sf_dir):
    """The same graph over rounded vectors."""
    return graph.beam_search(get(spark, sf_dir, "queries"), get(spark, sf_dir, "base"), get(spark, sf_dir, "edges"), 64, 10, step=1 / 16, same=True)


def sharded_beam_search(spark, sf_dir):
    """Shards with graphs of their own, results merged."""
    return graph.sharded_beam_search(get(spark, sf_dir, "queries"), get(spark, sf_dir, "base"), 16, 64, 10, shard=256, same=True)


def native_heap(spark, sf_dir):
    """Results of the order-dependent heap."""
    return graph.native_top_k(get(spark, sf_dir, "scored"), 10)


def pq_lloyd(spark, sf_dir):
    """D3: the trained codebook, one row a coordinate."""
    return get(spark, sf_dir, "codebook").select(F.col("m").cast("long").alias("m"), F.col("c").cast("long").alias("c"), F.posexplode("centroid").alias("j", "x")).select("m", "c", F.col("j").cast("long").alias("j"), F.round("x", 9).alias("x"))


def gaussian_matrix(spark, sf_dir):
    """B1: seeded normal vectors for as many ids as there are vectors."""
    ids = get(spark, sf_dir, "vectors").select("vec_id")
    return ids.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.sqrt(-2 * F.log((F.pmod(F.xxhash64("vec_id", j, F.lit(1)), F.lit(1 << 40)) + 1) / float(1 << 40))) * F.cos(2 * np.pi * F.pmod(F.xxhash64("vec_id", j, F.lit(2)), F.lit(1 << 40)) / float(1 << 40))).alias("e"))


def seeded_permutations(spark, sf_dir):
    """L1: residual permutations by NumPy's seeded generator, a group a query."""

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        exact, residual, gt, q = rows["exact"].to_numpy(), (rows["score"] - rows["exact"]).to_numpy(), rows["in_gt"].to_numpy(), int(rows["query_id"].iloc[0])
        top = gt[np.argsort(exact, kind="stable")[:10]].sum()
        out = []
        for k in range(50):
            score = exact + residual[np.random.Generator(np.random.PCG64(np.random.SeedSequence([7, q, k]))).permutation(len(rows))]
            out.append((q, k, int(top - gt[np.argsort(score, kind="stable")[:10]].sum())))
        return pd.DataFrame(out, columns=["query_id", "draw", "loss_hits"])

    return get(spark, sf_dir, "ranked").filter("model = 'coarse'").groupBy("query_id").applyInPandas(draw, "query_id long, draw long, loss_hits long")


def orthogonal_rotation(spark, sf_dir):
    """A random rotation of queries and base keeps every query's neighbours."""
    turn = quantizers.rotation(64, 3)
    q, b = (quantizers.rotate(get(spark, sf_dir, n), c, turn) for n, c in (("queries", "qe"), ("base", "be")))
    return knn.exact_top_k(q, b, 10, same=True).select("query_id", F.col("rk").cast("long").alias("rank"), "base_id", F.round("d", 6).alias("dist"))


def index_round_trip(spark, sf_dir):
    """Codebook, codes and graph written as tables and read back."""
    folder = shared_dir(spark)
    quantizers.save_index(folder, codebook=get(spark, sf_dir, "codebook"), codes=get(spark, sf_dir, "codes"), edges=get(spark, sf_dir, "edges"))
    tables = quantizers.load_index(spark, folder, "codes", "edges")
    return tables["edges"].join(tables["codes"].filter("m = 0"), F.col("src") == F.col("base_id")).select("src", "dst", F.col("rk").cast("long").alias("rank"), F.col("c").cast("long").alias("code"))


def xvec_round_trip(spark, sf_dir):
    """A1 A3: vectors written to vector files by tasks and read back by ranges."""
    folder = shared_dir(spark)
    rows = get(spark, sf_dir, "vectors").select("vec_id", F.col("e").cast("array<float>").alias("e"))
    xvecs.write_xvecs(rows, "vec_id", "e", folder)
    return xvecs.read_xvecs(spark, folder).select("vec_id", F.size("embedding").cast("long").alias("dim"), F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def raw_round_trip(spark, sf_dir):
    """Arrays of six element types, written by tasks, their sizes checked when read."""
    v, out = get(spark, sf_dir, "vectors"), None
    value = {"f32": F.element_at("e", 1), "f64": F.element_at("e", 1), "i32": F.col("label").cast("double"), "i64": F.col("vec_id").cast("double"), "u8": F.col("label").cast("double"), "u32": F.col("vec_id").cast("double")}
    for kind, x in value.items():
        folder = shared_dir(spark)
        n = xvecs.write_raw(v.select("vec_id", F.array(x).alias("row")), "vec_id", "row", folder, kind)
        part = xvecs.read_raw(spark, folder, kind, rows=n).select(F.lit(kind).alias("kind"), "pos", F.round(F.col("row")[0].cast("double"), 6).alias("value"))
        out = part if out is None else out.union(part)
    return out


def packed_round_trip(spark, sf_dir):
    """Candidate records packed in files, and read by an index of offsets and counts."""
    folder = shared_dir(spark)
    index = records.pack_candidates(get(spark, sf_dir, "scored").filter("model = 'coarse'"), folder)
    return records.scan_candidates(index, folder).select("query_id", "pos", "base_id", F.round("exact", 6).alias("exact"), F.round("score", 6).alias("score"))


def table_sink(spark, sf_dir):
    """A10: two tables of different columns as one CSV over the union of their columns."""
    path = shared_dir(spark)
    one = get(spark, sf_dir, "perq").select("query_id", "model", "loss_hits")
    two = get(spark, sf_dir, "gaps").select("query_id", F.round("gap", 9).alias("gap"))
    records.write_tables([one, two], path)
    return spark.read.option("header", True).schema("query_id long, model string, loss_hits long, gap double").csv(path)


def settings(spark, sf_dir):
    """A configuration read strictly."""
    path = shared_dir(spark)
    spark.createDataFrame([("# depths", 0), ("ef = 16,32  # two", 1), ("pairs=a:1,b:2", 2), ("", 3)], "value string, k int").coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    found = records.read_config(spark, path, {"ef", "pairs"})
    return spark.createDataFrame([(k, v, len(records.list_value(v))) for k, v in found.items()], "key string, value string, items long")


def descent_graph(spark, sf_dir):
    """a graph by descent, without all pairs."""
    edges, _ = descent.build(get(spark, sf_dir, "base"), 16)
    return edges.select("src", F.col("rk").cast("long").alias("rank"), "dst")


def arrow_round_trip(spark, sf_dir):
    """A4: vectors written as Arrow streams by tasks, and read by ranges of record batches."""
    folder = shared_dir(spark)
    rows = get(spark, sf_dir, "vectors").select("vec_id", "label", F.col("e").cast("array<float>").alias("e"))
    n = arrow_ipc.write_arrow(rows, folder, batch_rows=100)
    back = arrow_ipc.read_arrow(spark, folder, "e", key="vec_id", dimension=64, rows=n)
    return back.select(F.col("key").alias("vec_id"), F.size("embedding").cast("long").alias("dim"), F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def service(spark, sf_dir):
    """Workers by query number, 32 queries deferred at a time, against the scalar path."""
    queries = get(spark, sf_dir, "queries").select("query_id", F.floor(F.col("query_id") / 20).alias("number"))
    return refinement.serve(queries, get(spark, sf_dir, "scored").filter("model = 'coarse'"), 0.02)


def csr_round_trip(spark, sf_dir):
    """Scored pools as CSR rows and back."""
    pool = get(spark, sf_dir, "scored").filter("model = 'coarse'").select("query_id", "pos", "base_id", "score")
    return records.from_csr(records.to_csr(pool)).select("query_id", "pos", "base_id", F.round("score", 9).alias("score"))


def json_round_trip(spark, sf_dir):
    """Query rows as compressed JSON lines and back."""
    path, schema = shared_dir(spark), "query_id long, model string, loss_hits long, class string"
    records.write_json_lines(get(spark, sf_dir, "perq").select("query_id", "model", "loss_hits", "class"), path)
    return records.read_json_lines(spark, path, schema)


def streaming_refinement(spark, sf_dir):
    """Queries as a stream of files, refined by micro-batch."""
    root = shared_dir(spark)
    get(spark, sf_dir, "queries").select("query_id").repartition(4, "query_id").write.parquet(f"{root}/in")
    scored = get(spark, sf_dir, "scored").filter("model = 'coarse'").drop("model")
    refinement.refine_stream(spark, f"{root}/in", scored, 0.02, f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out").select("query_id", "rank", "base_id", "refined")


QUERIES = {f.__name__: f for f in (beam_search, beam_search_quantized, sharded_beam_search, native_heap, pq_lloyd, gaussian_matrix, seeded_permutations, orthogonal_rotation, index_round_trip, xvec_round_trip, raw_round_trip, packed_round_trip, table_sink, settings, service, csr_round_trip, json_round_trip, streaming_refinement, descent_graph, arrow_round_trip)}
#: SQL where a round trip gives a relation back.
SQL = {
    "orthogonal_rotation": (("gt",), "SELECT query_id, rk AS rank, base_id, round(d, 6) AS dist FROM pl_gt WHERE rk <= 10"),
    "index_round_trip": (("edges", "codes"), "SELECT src, dst, CAST(rk AS BIGINT) AS rank, CAST(c AS BIGINT) AS code FROM pl_edges JOIN pl_codes ON src = base_id WHERE m = 0"),
    "pq_lloyd": (("codebook",), "SELECT m, c, unnest(range(len(centroid))) AS j, round(unnest(centroid), 9) AS x FROM pl_codebook"),
    "xvec_round_trip": (("vectors",), "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, len(e)::BIGINT AS dim, round(list_sum(e), 6) AS total FROM pl_vectors"),
    "arrow_round_trip": (("vectors",), "SELECT vec_id, len(e)::BIGINT AS dim, round(list_sum(e), 6) AS total FROM pl_vectors"),
    "raw_round_trip": (
        ("vectors",),
        "WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, vec_id::DOUBLE AS i, e[1] AS x, label::DOUBLE AS l FROM pl_vectors) SELECT kind, pos, round(CASE WHEN kind IN ('f32', 'f64') THEN x WHEN kind IN ('i32', 'u8') THEN l ELSE i END, 6) AS value FROM v CROSS JOIN (SELECT unnest(['f32', 'f64', 'i32', 'i64', 'u8', 'u32']) AS kind)",
    ),
    "packed_round_trip": (("scored",), "SELECT query_id, pos, base_id, round(exact::FLOAT::DOUBLE, 6) AS exact, round(score::FLOAT::DOUBLE, 6) AS score FROM pl_scored WHERE model = 'coarse'"),
    "table_sink": (("perq", "gaps"), "SELECT query_id, model, loss_hits, NULL::DOUBLE AS gap FROM pl_perq UNION ALL SELECT query_id, NULL, NULL, round(gap, 9) FROM pl_gaps"),
    "settings": ((), "SELECT * FROM (VALUES ('ef', '16,32', 2::BIGINT), ('pairs', 'a:1,b:2', 2::BIGINT)) AS v(key, value, items)"),
    "service": (
        ("scored", "queries"),
        """WITH s AS (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score, pos) AS sr FROM pl_scored s WHERE model = 'coarse'),
        g AS (SELECT query_id, max(CASE WHEN sr = 12 THEN score END) - max(CASE WHEN sr = 9 THEN score END) <= 0.02 AS refined FROM s GROUP BY query_id),
        f AS (SELECT s.query_id, base_id, refined, row_number() OVER (PARTITION BY s.query_id ORDER BY CASE WHEN refined THEN exact ELSE score END, pos) AS rank FROM s JOIN g ON s.query_id = g.query_id WHERE sr <= 16),
        w AS (SELECT query_id, (query_id // 20) % 4 AS worker, (row_number() OVER (PARTITION BY (query_id // 20) % 4 ORDER BY query_id) - 1) // 32 AS batch FROM pl_queries)
        SELECT f.query_id, worker::BIGINT AS worker, batch::BIGINT AS batch, rank::BIGINT AS rank, base_id, refined, true AS same FROM f JOIN w ON f.query_id = w.query_id WHERE rank <= 10""",
    ),
    "csr_round_trip": (("scored",), "SELECT query_id, pos, base_id, round(score, 9) AS score FROM pl_scored WHERE model = 'coarse'"),
    "json_round_trip": (("perq",), "SELECT query_id, model, loss_hits, class FROM pl_perq"),
}
