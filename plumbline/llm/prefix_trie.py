"""The trie of conversations' first turns, built as a Patricia tree.

A turn becomes 16 bytes of a hash of its role and text, a conversation the string
of them. Equal strings are merged, the rest is dealt into ranges of their order,
and a task reads a range in order: it keeps the open points of one path only
(where conversations branch or end), closes those that the next string leaves, and
writes the nodes of the edge above a closed point from sums along that edge.

A prefix that goes on into the next range is open on both sides. Such nodes (at
most a path a range) are written as parts, whose numbers add up: members, leaves,
tokens; what is counted by node (children, own lengths) counts where a node begins.

Defined results: turns without a conversation take no part; null roles and texts
are empty; turns go by number (null first), then role, then hash of the turn;
repeated rows are turns of their own; conversations without turns are members of
the root and end there; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import placed
from .common import broadcast_if_small, materialize

#: Bytes of a turn's hash.
TURN = 16
#: Turns by which ranges are cut; strings that agree so far stay in one range.
CUT_TURNS = 64
#: Ids that are joined to one string at a time.
PIECE = 1 << 16

_NODES = "part boolean, point boolean, key binary, up binary, depth long, conv_id long, up_conv long, n long, children long, leaves long, own long, below long, single long, ends string"
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: hashes and code points of each conversation's turns in order; texts aren't shuffled."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    token = F.substring(F.sha2(F.concat_ws(":", F.char_length(role).cast("string"), F.concat(role, text)).cast("binary"), 256), 1, 2 * TURN)
    row = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").cast("long").alias("turn"), role.alias("role"), token.alias("token"), F.char_length(text).cast("long").alias("own"))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), row.alias("row"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return listed.select("conv_id", F.transform("rows", lambda r: F.struct(r["token"].alias("token"), r["own"].alias("own"))).alias("turns"))


def shared_beginnings(convs: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations whose first h turns are those of conversation c - c % ``every``; h: crc32(c) % ``most``.

    ``%`` is never negative. At most ``every`` conversations share a beginning.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    heads = convs.filter(F.pmod("conv_id", F.lit(every)) == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, most - 1).alias("head"))
    own = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(every)))
    joined = own.join(heads, F.col("base") == F.col("first"), "left")
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(head, rest).alias("turns"))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of (seq_id, piece): one hash a seq_id, a piece in memory at a time."""
    now, state = None, None
    for batch in batches:
        out = []
        for seq_id, text in zip(batch.column("seq_id").to_pylist(), batch.column("text").to_pylist()):
            if seq_id != now:
                if state:
                    out.append((now, state.hexdigest()))
                now, state = seq_id, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)], names=["seq_id", "ends"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=["seq_id", "ends"])


def ends(members: DataFrame) -> DataFrame:
    """``members(seq_id, conv_id)`` -> ``seq_id, ends``: SHA-256 of each group's ids, ascending, joined by commas.

    A large group is put in order by ranges and joined by pieces of 65,536 ids; its
    hash has to read the pieces one after the other, and holds one of them.
    """
    rows = placed(members, ["conv_id"], group=["seq_id"])
    pieces = rows.groupBy("seq_id", "n_", F.floor((F.col("r_") - 1) / PIECE).alias("piece")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("text"))
    pieces = materialize(pieces)
    one = pieces.filter(F.col("n_") <= PIECE).select("seq_id", F.sha2(F.col("text").cast("binary"), 256).alias("ends"))
    many = pieces.filter(F.col("n_") > PIECE).select("seq_id", "piece", "text").repartition("seq_id").sortWithinPartitions("seq_id", "piece")
    return one.unionByName(many.select("seq_id", "text").mapInArrow(_streamed, "seq_id string, ends string"))


def common_turns(a: bytes | None, b: bytes | None) -> int:
    """Turns that two strings share at their beginning."""
    a, b = a or b"", b or b""
    k, n = 0, min(len(a), len(b)) // TURN
    while k < n and a[TURN * k : TURN * (k + 1)] == b[TURN * k : TURN * (k + 1)]:
        k += 1
    return k


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        left = [common_turns(r["before"], r["low"]) for r in rows]
        right = [common_turns(r["high"], r["after"]) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column("range"), pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["range", "left", "right"])


class _Path:
    """The open points of one path through one range, as strings come in order."""

    def __init__(self, left: int, right: int):
        self.left, self.right = left, right
        self.rows: list[tuple] = []
        self.seq = b""
        self.own = [0]
        self.keys = [b""]
        self.common = -1  # turns shared with the range's first string
        self.points = [self.point(0)]

    @staticmethod
    def point(depth: int) -> dict:
        return {"depth": depth, "n": 0, "conv": None, "children": 0, "leaves": 0, "below": 0, "single": 0, "ends": None}

    def goes_on(self, depth: int) -> bool:
        """The node began in an earlier range."""
        return depth <= min(self.left, self.common)

    def close(self, above: int, last: bool) -> None:
        """Ends the deepest point; ``above`` is the depth of its parent in the compressed tree."""
        p = self.points.pop()
        if self.points[-1]["depth"] < above:
            self.points.append(self.point(above))
        up = self.points[-1]
        ends_here = not self.goes_on(p["depth"]) and not (last and p["depth"] <= self.right)  # else its children may all be in other ranges
        n, conv, leaves = p["n"], p["conv"], p["leaves"] or (1 if ends_here and not p["children"] else 0)
        children, below, single, ends = p["children"], p["below"], p["single"], p["ends"]
        for depth in range(p["depth"], above, -1):
            begun = self.goes_on(depth)
            part = begun or (last and depth <= self.right)
            single_parent = depth - 1 > above and not self.goes_on(depth - 1) and not (last and depth - 1 <= self.right)
            own = self.own[depth]
            self.rows.append((part, depth == p["depth"], self.keys[depth], self.keys[depth - 1], depth, conv, conv if single_parent else None, n, children, leaves, own, below, single, ends))
            below += n * own
            single += 0 if begun else own
            children, ends = (0 if begun else 1), None
        up["n"] += n
        up["conv"] = conv if up["conv"] is None else min(up["conv"], conv)
        up["leaves"] += leaves
        up["children"] += children
        up["below"] += below
        up["single"] += single

    def add(self, seq: bytes, own: list[int], conv: int, n: int, ends: str) -> None:
        shared = common_turns(self.seq, seq)
        while self.points[-1]["depth"] > shared:
            self.close(max(shared, self.points[-2]["depth"]), False)
        depth = len(seq) // TURN
        self.common = depth if self.common < 0 else min(self.common, shared)
        self.seq, self.own = seq, [0, *own]
        del self.keys[shared + 1 :]
        for k in range(shared, depth):
            self.keys.append(hashlib.sha256(self.keys[k] + seq[TURN * k : TURN * (k + 1)]).digest()[:TURN])
        if depth > self.points[-1]["depth"]:
            self.points.append(self.point(depth))
        p = self.points[-1]
        p["n"] += n
        p["conv"] = conv if p["conv"] is None else min(p["conv"], conv)
        p["ends"] = ends

    def end(self) -> None:
        while len(self.points) > 1:
            self.close(self.points[-2]["depth"], True)
        p = self.points[0]
        self.rows.append((True, True, b"", None, 0, p["conv"], None, p["n"], p["children"], p["leaves"], 0, p["below"], p["single"], p["ends"]))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.bool_()), ("point", pa.bool_()), ("key", pa.binary()), ("up", pa.binary()), *[(c, pa.int64()) for c in ("depth", "conv_id", "up_conv", "n", "children", "leaves", "own", "below", "single")], ("ends", pa.string())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    now, path = None, None
    for batch in batches:
        for r in batch.to_pylist():
            if r["range"] != now:
                if path:
                    path.end()
                    yield out(path.rows)
                now, path = r["range"], _Path(r["left"], r["right"])
            path.add(r["seq"], r["own"], r["conv_id"], r["n"], r["ends"])
            if len(path.rows) >= 10_000:
                yield out(path.rows)
                path.rows = []
    if path:
        path.end()
        yield out(path.rows)


def _parents(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with ``up_conv`` where ``known`` has their parent."""
    of = known.select(F.col("key").alias("k"), F.col("conv_id").alias("found"))
    return rows.join(of, F.col("up") == F.col("k"), "left").withColumn("up_conv", F.col("found")).drop("k", "found")


def trie(convs: DataFrame) -> DataFrame:
    """Nodes of ``convs(conv_id, turns)``: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    turns = F.col("turns")
    seq: Column = F.unhex(F.array_join(F.transform(turns, lambda t: t["token"]), ""))
    rows = materialize(convs.select("conv_id", seq.alias("seq"), F.transform(turns, lambda t: t["own"]).alias("own")).withColumn("seq_id", F.sha2("seq", 256)))
    distinct = rows.groupBy("seq_id", "seq").agg(F.first("own").alias("own"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    distinct = materialize(distinct.join(ends(rows.select("seq_id", "conv_id")), "seq_id").drop("seq_id"))
    dealt = materialize(distinct.repartitionByRange(F.substring("seq", 1, TURN * CUT_TURNS)).withColumn("range", F.spark_partition_id()))

    by = Window.orderBy("range")  # a row a range
    bounds = dealt.groupBy("range").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    bounds = bounds.select("range", "low", "high", F.lag("high").over(by).alias("before"), F.lead("low").over(by).alias("after")).mapInArrow(_edges, "range int, left long, right long")
    ordered = dealt.join(F.broadcast(bounds), "range").repartition("range").sortWithinPartitions("range", "seq")
    nodes = materialize(ordered.mapInArrow(_nodes, _NODES))

    inside = nodes.filter("NOT part")
    sums = [F.sum("n").alias("n"), F.sum("children").alias("children"), F.greatest(F.sum("leaves"), F.lit(1)).alias("leaves")]
    spine = nodes.filter("part").groupBy("key", "up", "depth", "own").agg(F.min("conv_id").alias("conv_id"), *sums, F.sum("below").alias("below"), F.sum("single").alias("single"), F.max("ends").alias("ends"))
    spine = materialize(spine)  # a path a range at most
    few = broadcast_if_small(spine, spine.count())
    columns = ["key", "up", "depth", "conv_id", "up_conv", "n", "children", "leaves", "own", "below", "single", "ends"]
    open_ = _parents(inside.filter("up_conv IS NULL").drop("up_conv"), few)
    found = open_.filter("up_conv IS NOT NULL").select(columns)
    deeper = _parents(open_.filter("up_conv IS NULL").drop("up_conv"), inside.filter("point")).select(columns)
    whole = inside.filter("up_conv IS NOT NULL").select(columns).unionByName(found).unionByName(deeper).unionByName(_parents(spine, few).select(columns))
    saved = (F.col("n") - 1) * F.col("own") + F.col("below") - F.col("single")
    return whole.select("conv_id", "depth", F.col("up_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends_sha256"))
