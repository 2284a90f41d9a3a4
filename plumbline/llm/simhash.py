"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 fingerprint bits are grouped into partitions of correlated bits. If
partition i may differ in ``T[i]`` bits (-1: not searched) and the ``T[i] + 1``
sum to ``distance + 1``, then two fingerprints within ``distance`` agree on some
searched partition up to its threshold. The number of partitions and the
thresholds come from a dynamic programme over estimated probe and candidate
counts. Fingerprints probe the values around their own; candidates are verified
by counting differing bits.

Copies of a fingerprint are one entry. Buckets of more than ``BUCKET`` entries
are not paired: their entries go to the values at distance up to 1 from
themselves instead. Two fingerprints are within 2 bits exactly if they share
such a value, at most 65 fingerprints share one, and all of them are linked, so
a group of thousands of near copies costs 65 rows each.

Defined results: a null text has no words and, like an empty one, fingerprint 0;
repeated rows share a fingerprint; a null id never names a component that has
another id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, broadcast_if_small, materialize, release
from .graph import components

DISTANCE = 2
SHINGLE = 3
#: Entries up to which a bucket is searched pair by pair.
BUCKET = 64
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16
#: Ids of rows to be dropped up to which they are broadcast.
GONE_BROADCAST = 1_000_000
#: Cost of making and shuffling a probe, in verified candidates.
PROBE_COST = 40.0


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64 bits, each set if over half of the shingles' XXH64 have it set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    counts, n = np.zeros(64, dtype=np.int64), len(words) - width + 1
    for at in range(0, n, BLOCK):
        part = words[at : min(at + BLOCK, n) + width - 1]
        grams = map(b" ".join, zip(*[part[k:] for k in range(width)], strict=False))
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype="<u8", count=min(BLOCK, n - at))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for rows in batches:
            values = np.array([fingerprint(t, width) for t in rows["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": rows["doc_id"], "row": rows["row"], "fp": values})

    return run


def row_keys(docs: DataFrame) -> DataFrame:
    """``doc_id, text, row``: a hash of id and text tells rows apart that share an id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("row", F.xxhash64("doc_id", "text"))


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id, row, fp`` (the 64 bits as a signed long) of every row."""
    bound_batches(docs.sparkSession)
    return row_keys(docs).mapInPandas(_fingerprints(width), "doc_id long, row long, fp long")


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(values, dtype="<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    both = np.zeros((64, 64), dtype=np.int64)
    for rows in batches:
        x = _bits(rows["fp"].to_numpy()).astype(np.float32)
        both += (x.T @ x).round().astype(np.int64)
    i, j = np.triu_indices(64)
    yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "n": both[i, j]})


def group_bits(both: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """Partitions of (nearly) equal width; correlated bits come together."""
    p = np.diag(both) / max(total, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    r = np.abs(both / max(total, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(r, 0)
    left, groups = set(range(64)), []
    for k in range(parts):
        width = 64 // parts + (k < 64 % parts)
        group = [max(sorted(left), key=lambda b: r[b, sorted(left)].sum())]
        left.remove(group[0])
        while len(group) < width:
            b = max(sorted(left), key=lambda b: r[b, group].sum())
            group.append(b)
            left.remove(b)
        groups.append(sorted(group))
    return groups


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """``costs[i][t + 1]`` of threshold t -> the cheapest thresholds whose ``t + 1`` sum to ``distance + 1``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for spent, (value, chosen) in best.items():
            for u in range(min(len(cost), distance + 2 - spent)):
                if spent + u not in nxt or value + cost[u] < nxt[spent + u][0]:
                    nxt[spent + u] = (value + cost[u], [*chosen, u - 1])
        best = nxt
    return best[distance + 1]


def choose(entries: DataFrame, distance: int = DISTANCE, choices: tuple[int, ...] = (2, 3, 4)) -> tuple[list[list[int]], list[int]]:
    """Bit partitions and thresholds for the distinct fingerprints ``entries(fp)``.

    What comes to the driver is 2080 bit-pair counts and one sum a partition.
    """
    both, total = np.zeros((64, 64), dtype=np.float64), entries.count()
    for i, j, n in entries.select("fp").mapInPandas(_moments, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        both[i, j] = both[j, i] = n
    grouped = {m: group_bits(both, total, m) for m in choices}
    keys = [F.struct(F.lit(m).alias("m"), F.lit(k).alias("k"), F.col("fp").bitwiseAND(_mask(g)).alias("v")) for m, gs in grouped.items() for k, g in enumerate(gs)]
    sizes = entries.select(F.explode(F.array(*keys)).alias("e")).groupBy("e.m", "e.k", "e.v").agg(F.count(F.lit(1)).cast("double").alias("n"))
    same = {(m, k): s for m, k, s in sizes.groupBy("m", "k").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).collect()}
    p = np.diag(both) / max(total, 1)
    agree = p * p + (1 - p) * (1 - p)
    found = []
    for m, groups in grouped.items():
        costs = []
        for k, group in enumerate(groups):
            dist = np.array([1.0])  # of the number of bits in which two random entries differ
            for b in group:
                dist = np.convolve(dist, [agree[b], 1 - agree[b]])
            cost, ball = [0.0], 1.0
            for t in range(distance + 1):
                if t:
                    ball *= (len(group) - t + 1) / t
                    probes += ball
                else:
                    probes = 1.0
                pairs = same.get((m, k), 0.0) * dist[: t + 1].sum() / max(dist[0], 1e-300)
                cost.append(PROBE_COST * total * probes + pairs)
            costs.append(cost)
        value, thresholds = allocate(costs, distance)
        found.append((value, m, groups, thresholds))
    _, _, groups, thresholds = min(found, key=lambda x: x[:2])
    return groups, thresholds


def _probes(groups: list[list[int]], thresholds: list[int]):
    """Rows (part, v, fp, own) of all values within a partition's threshold."""
    plan = []
    for k, (group, t) in enumerate(zip(groups, thresholds, strict=True)):
        flips = {0} if t >= 0 else set()
        for _ in range(max(t, 0)):
            flips |= {f ^ (1 << b) for f in flips for b in group}
        plan += [(k, _mask(group), f - (1 << 64) if f >> 63 else f) for f in sorted(flips)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            fp = rows["fp"].to_numpy()
            for k, mask, flip in plan:
                yield pd.DataFrame({"part": np.full(len(fp), k, dtype=np.int32), "v": (fp & np.int64(mask)) ^ np.int64(flip), "fp": fp, "own": np.full(len(fp), flip == 0)})

    return run


def _verify(distance: int):
    def links(fp: np.ndarray, own: np.ndarray) -> list[tuple[int, int]]:
        near = (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance) & (own[:, None] | own[None, :])
        label, todo, out = np.full(len(fp), -1), list(range(len(fp))), []
        for s in todo:
            if label[s] >= 0:
                continue
            label[s], stack = s, [s]
            while stack:
                for x in np.flatnonzero(near[stack.pop()] & (label < 0)):
                    label[x] = s
                    stack.append(int(x))
                    out.append((int(fp[x].view(np.int64)), int(fp[s].view(np.int64))))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out: list[tuple[int, int]] = []
            for fps, owns in zip(rows["fps"], rows["owns"], strict=True):
                fp, own = np.asarray(fps, dtype=np.int64).view(np.uint64), np.asarray(owns, dtype=bool)
                if len(fp) == 2:
                    if np.bitwise_count(fp[0] ^ fp[1]) <= distance and own.any():
                        out.append((int(fps[0]), int(fps[1])))
                else:
                    out += links(fp, own)
            yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return run


def links(entries: DataFrame) -> DataFrame:
    """Links ``(u, v)`` whose components are those of all pairs within ``DISTANCE``, for which large buckets are exact."""
    groups, thresholds = choose(entries, DISTANCE)
    rows = materialize(entries.select("fp").mapInPandas(_probes(groups, thresholds), "part int, v long, fp long, own boolean"))
    hot = materialize(rows.groupBy("part", "v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET).select(F.col("part").alias("hp"), F.col("v").alias("hv")))
    n_hot = hot.count()
    large = broadcast_if_small(hot, n_hot)
    at = (F.col("part") == F.col("hp")) & (F.col("v") == F.col("hv"))
    buckets = rows.join(large, at, "left_anti").groupBy("part", "v").agg(F.collect_list("fp").alias("fps"), F.collect_list("own").alias("owns"))
    found = buckets.filter(F.size("fps") > 1).select("fps", "owns").mapInPandas(_verify(DISTANCE), "u long, v long")
    if n_hot:
        around = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
        crowd = rows.join(large, at, "left_semi").select("fp").distinct()
        met = crowd.select("fp", F.explode(F.concat(F.array("fp"), around)).alias("z")).groupBy("z").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
        found = found.union(met.select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")).filter("u <> v"))
    return found


def marked(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id, row, fp, component_id, part`` of every row; ``part`` is the component's own name."""
    rows = materialize(fingerprints(docs, width))
    entries = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(entries))
    joined = entries.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id")).select(F.col("root").alias("r"), "component_id")
    named = joined.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id", F.col("root").alias("part"))
    return rows.join(named, F.col("fp") == F.col("f")).select("doc_id", "row", "fp", "component_id", "part")


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``."""
    return marked(docs, width).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The row of ``docs`` with the smallest id of each component.

    Rows are linked by their fingerprints. With a ``similarity`` they are also linked
    by that of their sets of ``width``-word shingles: what is 0.8 alike is too far apart
    for fingerprints (see ``near_copies``). A component is what both together link.
    """
    if similarity is None:
        return keep_first(docs, marked(docs, width))
    from . import near_copies

    return keep_first(docs, joined(near_copies.marked(docs, similarity, width), marked(docs)))


def joined(marks: DataFrame, others: DataFrame) -> DataFrame:
    """``doc_id, row, part`` of components that links of ``marks`` and those of ``others`` make together.

    Parts of ``marks`` that share one of ``others`` are one, and so on; a part of any
    number of rows is one node.
    """
    marks = materialize(marks.select("doc_id", "row", "part"))
    by_row = others.groupBy("row").agg(F.min("part").alias("other"))
    pairs = materialize(marks.select("row", "part").distinct().join(by_row, "row").select("part", "other").distinct())
    least = pairs.groupBy("other").agg(F.min("part").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("other", "least")
    links = pairs.join(least, "other").filter("part <> least").select(F.col("part").alias("u"), F.col("least").alias("v"))
    return marks.join(components(links), F.col("part") == F.col("node"), "left").select("doc_id", "row", F.coalesce("root", "part").alias("part"))


def keep_first(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The row of each component of ``marks(doc_id, row, part)`` with the smallest id, columns as they are.

    Of rows of a component that share this id, the one with the least hash of its
    text stays, and of the same row many times one; rows of different components
    that share an id all stay. Rows without an id stay: nothing tells them apart.
    Rows that go are broadcast up to ``GONE_BROADCAST``; beyond, texts are shuffled.
    """
    rows = marks.filter("doc_id IS NOT NULL").groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.min("part").alias("part"), F.count(F.lit(1)).alias("n"))
    rows = materialize(rows)
    first = rows.groupBy("part").agg(F.min(F.struct("doc_id", "row")).alias("first")).select(F.col("part").alias("p"), "first")
    judged = materialize(rows.join(first, F.col("part") == F.col("p")).select(F.col("row").alias("__plumbline_gone"), "n", (F.col("row") != F.col("first.row")).alias("gone")))
    gone = judged.filter("gone").select("__plumbline_gone")
    near = F.broadcast(gone) if gone.count() <= GONE_BROADCAST else gone
    named = docs.withColumn("__plumbline_row", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    kept = named.join(near, F.col("doc_id").isNotNull() & (F.col("__plumbline_row") == F.col("__plumbline_gone")), "left_anti")
    if judged.filter("n > 1 AND NOT gone").limit(1).count():
        kept = kept.filter("doc_id IS NOT NULL").dropDuplicates(["__plumbline_row"]).union(kept.filter("doc_id IS NULL"))
    return kept.drop("__plumbline_row")
