"""Removal of repeated passages by a distributed, sampled suffix sort.

Texts are written once, in chunks of about ``CHUNK`` bytes, to the shared folder;
what moves afterwards are suffixes and not texts.

1. Of every ``LENGTH``-byte string the ``GRAM``-byte gram with the least hash is
   an anchor. Equal strings have the same anchor at the same place, so suffixes
   that start at anchors (one in 15 bytes) are all that need comparing. In a run
   of one byte every place is an anchor with the same bytes around it; places in
   a row within such a run are one anchor with a length.
2. A chunk sends each of its anchors' hashes once; the hashes that several chunks
   have come back as a bitmap. Only anchors that several documents share go on.
3. A chunk sends the suffix at such an anchor (and the bytes before it) once for
   all its documents with the same bytes there, with the least id, to the range
   of suffixes in which its leading 16 bytes fall; the ranges are cut by sampled
   splitters. Suffixes with equal leading bytes are in one range, and a match
   is longer than that, so none crosses a boundary between ranges.
4. A range sorts its suffixes by multikey quicksort on 8-byte words. Runs whose
   common prefix is long enough, divided by the bytes before the anchor, are the
   equal strings; the least id of each goes back to the chunks. Bytes decide what
   is equal; hashes only say where to look.
5. A chunk removes the strings that have a smaller id elsewhere.

A passage that a third of all documents share costs each chunk one suffix an
anchor, except where different texts meet it, at its ends. There an anchor has a
kind for each neighbourhood. So an anchor that has ``HOT`` different
neighbourhoods, summed over the chunks, sends each of its strings alone, to a range that the whole string's
hash names: inside the passage these are few, and at its ends they are spread by
what is around it.
There are as many ranges as keep one at ``PART`` bytes of text. Chunks are read by name from the shared folder, so lost executors cost
a repetition only.

Defined results: a null text is empty; texts under ``LENGTH`` bytes stay whole; a
null id counts as larger than every other, and rows with equal (or null) ids
take nothing from each other; an empty table gives no rows.
"""

from __future__ import annotations

import decimal
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, shared_dir, shuffle_partitions
from .token_store import _file

LENGTH, GRAM = 50, 20
#: Grams of a string, and so the bytes before an anchor that can matter.
WINDOW = LENGTH - GRAM + 1
BEFORE = WINDOW - 1
CHUNK, BLOCK = 16_000_000, 1 << 20
#: Bytes of text for each range of hashes and of suffixes.
PART = 32 << 20
#: Sampled chunks, bytes of each, and anchors of each for the splitters.
SAMPLE_CHUNKS, SAMPLE_BYTES, SAMPLE_ANCHORS = 24, 1_000_000, 4000
#: Different neighbourhoods in all chunks together from which an anchor's strings are dealt out one by one.
HOT = 16_384
#: Rows of a stretch that multikey quicksort doesn't split any more.
SHORT = 2048
NO_ID = np.iinfo(np.int64).max
_M = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(33)]


class Chunk:
    """Documents of a file: ids, ends, and their bytes in a row."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, ends: np.ndarray, data: np.ndarray):
        self.ids, self.null, self.ends, self.data = ids, null, ends, data
        self.starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends

    @staticmethod
    def pack(ids: list[int | None], texts: list[bytes]) -> bytes:
        head = np.array([len(ids)], dtype="<i8").tobytes()
        known = np.array([0 if x is None else x for x in ids], dtype="<i8").tobytes()
        null = np.array([x is None for x in ids], dtype=np.uint8).tobytes()
        ends = np.cumsum([len(t) for t in texts], dtype="<i8").tobytes()
        return zstandard.ZstdCompressor(level=3).compress(b"".join([head, known, ends, null, *texts]))

    @classmethod
    def read(cls, folder: str, name: str) -> Chunk:
        system, at = _file(folder)
        with system.open_input_file(f"{at.rstrip('/')}/{name}") as file:
            return cls.read_bytes(file.read())

    @classmethod
    def read_bytes(cls, packed: bytes) -> Chunk:
        raw = zstandard.ZstdDecompressor().decompress(packed)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        ids, ends = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n, 8 + 8 * n)
        null = np.frombuffer(raw, np.uint8, n, 8 + 16 * n).astype(bool)
        return cls(np.where(null, NO_ID, ids), null, ends, np.frombuffer(raw, np.uint8, offset=8 + 17 * n))


def _write(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int | None] = []
        texts: list[bytes] = []
        size = 0

        def close() -> pd.DataFrame:
            system, at = _file(folder)
            name = uuid.uuid4().hex
            with system.open_output_stream(f"{at.rstrip('/')}/{name}") as out:
                out.write(Chunk.pack(ids, texts))
            row = pd.DataFrame({"file": [name], "n_bytes": [sum(map(len, texts))]})
            ids.clear(), texts.clear()
            return row

        for rows in batches:
            for key, text in zip(rows["doc_id"], rows["text"], strict=True):
                ids.append(None if pd.isna(key) else int(key))
                texts.append((text or "").encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= CHUNK:
                    yield close()
                    size = 0
        if ids:
            yield close()

    return run


def _slide(values: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every ``width`` values in a row."""
    out, have = values, 1
    while 2 * have <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    n = len(values) - width + 1
    return op(out[:n], out[width - have : width - have + n]) if have < width else out


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """48 mixed bits of each ``GRAM`` bytes, by doubling; never 0."""
    with np.errstate(over="ignore"):
        powers, have, whole, done = {1: data.astype(np.uint64) + np.uint64(1)}, 1, None, 0
        while 2 * have <= GRAM:
            low = powers[have]
            powers[2 * have] = low[:-have] * np.uint64(_M[have]) + low[have:]
            have *= 2
        n = len(data) - GRAM + 1
        for width in sorted(powers, reverse=True):
            if GRAM & width:
                part = powers[width][done : done + n]
                whole = part if whole is None else whole * np.uint64(_M[width]) + part
                done += width
        whole = (whole ^ (whole >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (whole >> np.uint64(16)) | np.uint64(1)


def anchors(chunk: Chunk, upto: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes and lengths of the anchors of all documents.

    An anchor of length n stands for n places in a row whose surroundings (``BEFORE``
    bytes before, ``LENGTH`` from it on, all of one document) are one byte repeated.
    """
    size = len(chunk.data) if upto is None else min(upto, len(chunk.data))
    places, hashes, lengths = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for at in range(0, size, BLOCK):
        a, b = max(0, at - BEFORE), min(len(chunk.data), at + BLOCK + BEFORE + LENGTH)
        if b - a < LENGTH:
            continue
        data = chunk.data[a:b]
        h = _gram_hashes(data)
        where = np.arange(a, a + len(h) - WINDOW + 1)
        end = chunk.ends[np.searchsorted(chunk.ends, where, side="right")]
        least = np.where(where + LENGTH <= end, _slide(h, WINDOW, np.minimum), np.uint64(0))
        most = _slide(np.concatenate([np.zeros(BEFORE, dtype=np.uint64), least, np.zeros(BEFORE, dtype=np.uint64)]), WINDOW, np.maximum)
        found = np.flatnonzero(most == h)
        found = found[(found + a >= at) & (found + a < at + BLOCK)]
        length = np.ones(len(found), dtype=np.int64)
        if len(found) > len(h) // 8:  # only runs have that many
            same = np.flatnonzero(np.concatenate([[True], data[1:] != data[:-1]]))  # where a run of one byte begins
            run = np.searchsorted(same, found, side="right") - 1
            first, last = same[run], np.append(same[1:], len(data))[run]
            doc = np.searchsorted(chunk.ends, found + a, side="right")
            first, last = np.maximum(first, chunk.starts[doc] - a), np.minimum(last, chunk.ends[doc] - a)
            inner = (found - BEFORE >= first) & (found + LENGTH <= last)
            goes_on = np.concatenate([[False], inner[1:] & inner[:-1] & (found[1:] == found[:-1] + 1) & (run[1:] == run[:-1]) & (doc[1:] == doc[:-1])])
            begin = np.flatnonzero(~goes_on)
            length, found = np.diff(np.append(begin, len(found))), found[begin]
        places.append(found + a)
        hashes.append(h[found])
        lengths.append(length)
    return np.concatenate(places), np.concatenate(hashes), np.concatenate(lengths)


def _delta(values: np.ndarray) -> bytes:
    steps = np.diff(values, prepend=np.uint64(0))
    wide = len(steps) and int(steps[1:].max(initial=0)) >> 32
    first = steps[:1].astype("<u8").tobytes()
    return bytes([8 if wide else 4]) + first + steps[1:].astype("<u8" if wide else "<u4").tobytes()


def _undelta(blob: bytes) -> np.ndarray:
    first = np.frombuffer(blob, "<u8", 1, 1)
    return np.cumsum(np.concatenate([first, np.frombuffer(blob, f"<u{blob[0]}", offset=9).astype(np.uint64)]), dtype=np.uint64)


def _parts_of(values: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` ranges begins in sorted 48-bit hashes of anchors.

    An anchor's hash is the least of ``WINDOW``, so small values are many: ranges
    have equal shares of such minima. Decimals give the same bounds everywhere.
    """
    one, root = decimal.Decimal(1), decimal.Decimal(1) / WINDOW
    bounds = [int((one - (one - one * k / parts) ** root) * (1 << 48)) for k in range(parts)]
    return np.searchsorted(values, np.array([*bounds, 1 << 48], dtype=np.uint64))


def neighbourhoods(chunk: Chunk, place: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes, and among how many different bytes (``BEFORE`` before, ``LENGTH`` after) each is."""
    doc = np.searchsorted(chunk.ends, place, side="right")
    words = np.ndarray((len(chunk.data) + BEFORE + LENGTH - 7,), "<u8", np.concatenate([np.zeros(BEFORE, np.uint8), chunk.data, np.zeros(LENGTH, np.uint8)]), 0, (1,))
    mixed, room, left = h.copy(), place - chunk.starts[doc], chunk.ends[doc] - place
    with np.errstate(over="ignore"):
        for at in (-BEFORE, -21, -13, -8, GRAM, 28, 36, LENGTH - 8):
            word = words[place + (BEFORE + at)]
            word[(room < -at) | (left < at + 8)] = 0
            mixed = (mixed ^ word) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
    _, one = np.unique(mixed, return_index=True)
    return np.unique(h[one], return_counts=True)


def _send_hashes(folder: str, parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = zstandard.ZstdCompressor(level=1)
        for rows in batches:
            for name in rows["file"]:
                chunk = Chunk.read(folder, name)
                place, h, _ = anchors(chunk)
                own, times = neighbourhoods(chunk, place, h)
                cut, times = _parts_of(own, parts), np.minimum(times, 0xFFFF).astype("<u2")
                full = [k for k in range(parts) if cut[k + 1] > cut[k]]
                at = [slice(cut[k], cut[k + 1]) for k in full]
                yield pd.DataFrame({"part": full, "file": name, "blob": [_delta(own[x]) for x in at], "times": [codec.compress(times[x].tobytes()) for x in at]}).astype({"part": "int32"})

    return run


def _whole_parts(batches: Iterator[pd.DataFrame]):
    """The rows of a task, each part's together; a task holds whole parts."""
    frames = [rows for rows in batches if len(rows)]
    if frames:
        yield from pd.concat(frames, ignore_index=True).groupby("part", sort=True)


def _bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _shared_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part, rows in _whole_parts(batches):
        unpack, lists = zstandard.ZstdDecompressor(), [_undelta(b) for b in rows["blob"]]
        value, of, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        again = value[n > 1]
        hot = value[np.bincount(of, weights=np.concatenate([np.frombuffer(unpack.decompress(b), "<u2") for b in rows["times"]])) >= HOT]
        marks = [np.packbits(np.isin(x, again, assume_unique=True)).tobytes() for x in lists]
        hots = [np.packbits(np.isin(x, hot, assume_unique=True)).tobytes() for x in lists]
        yield pd.DataFrame({"file": rows["file"].to_numpy(), "part": np.int32(part), "marks": marks, "hots": hots})


def _kinds(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows of 8-byte words: the first place of each kind, and the kind of each row.

    A hash sorts them, and the bytes of all rows are held against their kind's first.
    """
    with np.errstate(over="ignore"):
        h = np.full(len(rows), 0x1234567, dtype=np.uint64)
        for k in range(rows.shape[1]):
            h = (h ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    _, first, kind = np.unique(h, return_index=True, return_inverse=True)
    if len(rows) and (rows != rows[first[kind]]).any():
        _, first, kind = np.unique(np.ascontiguousarray(rows).view(f"V{8 * rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return first, kind


class Shared:
    """Anchors of a chunk that several documents have, and their distinct surroundings.

    ``place, length, doc, kind`` are by anchor (of hot ones by string), the rest by
    kind: ``around`` (bytes before and from the anchor), ``before``, ``after`` (how
    many of them are real), ``first``, ``least`` (id) and ``part`` (suffix range).
    Kinds are in order of parts. A kind stands for the strings that begin ``first``
    to ``before`` bytes before the anchor.
    """

    def __init__(self, chunk: Chunk, marks: list[tuple[int, bytes, bytes]], parts: int, splitters: np.ndarray):
        place, h, length = anchors(chunk)
        own, inverse = np.unique(h, return_inverse=True)
        cut, several, hot = _parts_of(own, parts), np.zeros(len(own), dtype=bool), np.zeros(len(own), dtype=bool)
        for k, shared, often in marks:
            n = cut[k + 1] - cut[k]
            several[cut[k] : cut[k + 1]], hot[cut[k] : cut[k + 1]] = _bits(shared, n), _bits(often, n)
        doc = np.searchsorted(chunk.ends, place, side="right").astype(np.int32)
        low, high = np.full(len(own), len(chunk.ends)), np.full(len(own), -1)
        np.minimum.at(low, inverse, doc)
        np.maximum.at(high, inverse, doc)
        keep = (several | (low < high))[inverse]
        hot = hot[inverse[keep]]
        del inverse, h
        place, doc, length = place[keep], doc[keep], length[keep]
        room, left = place - chunk.starts[doc], chunk.ends[doc] - place
        rows = [np.flatnonzero(~hot), *(np.flatnonzero(hot & (room >= o) & (left >= LENGTH - o)) for o in range(WINDOW))]
        one, sizes = np.concatenate(rows), [len(x) for x in rows]
        alone = np.repeat([0] + [1] * WINDOW, sizes)
        begin, last, upto = (np.repeat(x, sizes) for x in ([0, *range(WINDOW)], [BEFORE, *range(WINDOW)], [LENGTH, *range(LENGTH, LENGTH - WINDOW, -1)]))
        self.place, self.doc, self.length = place[one], doc[one], length[one]
        n, width = len(self.place), BEFORE + LENGTH
        padded = np.concatenate([np.zeros(BEFORE, np.uint8), chunk.data, np.zeros(LENGTH, np.uint8)])
        words, step = -(-width // 8), np.arange(width)
        kinds, kind = [np.zeros((0, words + 1), dtype="<u8")], np.zeros(n, dtype=np.int64)
        for a in range(0, n, 1 << 16):  # kinds of a block at a time: runs have few, however many places
            b = min(n, a + (1 << 16))
            before = np.minimum(last[a:b], self.place[a:b] - chunk.starts[self.doc[a:b]])
            after = np.minimum(upto[a:b], chunk.ends[self.doc[a:b]] - self.place[a:b])
            got = padded[self.place[a:b, None] + step]
            got[(step < BEFORE - before[:, None]) | (step >= BEFORE + after[:, None])] = 0
            around = np.zeros((b - a, 8 * words), dtype=np.uint8)
            around[:, :width] = got
            rows = np.column_stack([around.view("<u8"), (alone[a:b] << 24 | begin[a:b] << 16 | before << 8 | after).astype(np.uint64)])
            first, of = _kinds(rows)
            kind[a:b] = of + sum(map(len, kinds))
            kinds.append(rows[first])
        rows = np.concatenate(kinds)
        first, of = _kinds(rows)
        kind, rows = of[kind], np.ascontiguousarray(rows[first])
        least = np.full(len(first), NO_ID)
        np.minimum.at(least, kind, chunk.ids[self.doc])
        around = np.ascontiguousarray(rows[:, :words]).view(np.uint8)
        before, after = (rows[:, words] >> np.uint64(8) & np.uint64(255)).astype(np.uint8), (rows[:, words] & np.uint64(255)).astype(np.uint8)
        level, single = (rows[:, words] >> np.uint64(16) & np.uint64(255)).astype(np.uint8), np.flatnonzero(rows[:, words] >> np.uint64(24))
        leading = np.ascontiguousarray(around[:, BEFORE : BEFORE + 16]).view("S16").ravel()
        part = np.searchsorted(splitters, leading, side="right") if len(splitters) else np.zeros(len(first), dtype=np.int64)
        with np.errstate(over="ignore"):
            mixed = np.full(len(single), 0x1234567, dtype=np.uint64)
            for x in range(0, LENGTH, 8):  # the string's own bytes, the last 8 of them last
                at = BEFORE - level[single].astype(np.int64) + min(x, LENGTH - 8)
                word = np.ascontiguousarray(around[single[:, None], at[:, None] + np.arange(8)]).view("<u8").ravel()
                mixed = (mixed ^ word) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
        part[single] = (mixed >> np.uint64(16)) % np.uint64(len(splitters) + 1)
        order = np.argsort(part, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.kind = rank[kind].astype(np.int32)
        self.around, self.before, self.after, self.first = around[order, :width], before[order], after[order], level[order]
        self.least, self.part = least[order], part[order]


def _send_suffixes(folder: str, parts: int, splitters: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = zstandard.ZstdCompressor(level=3)
        for rows in batches:
            for name, marks in zip(rows["file"], rows["marks"], strict=True):
                got = Shared(Chunk.read(folder, name), [(int(m["part"]), m["marks"], m["hots"]) for m in marks], parts, splitters)
                out = []
                for k in np.unique(got.part):
                    at = slice(*np.searchsorted(got.part, [k, k + 1]))
                    blob = b"".join(x[at].tobytes() for x in (got.around, got.before, got.after, got.least.astype("<i8")))
                    out.append((int(k), name, at.stop - at.start, codec.compress(blob)))
                yield pd.DataFrame(out, columns=["part", "file", "n", "blob"]).astype({"part": "int32", "n": "int64"})

    return run


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Rows in lexicographic order of their words, by multikey quicksort (Bentley and Sedgewick, 1997).

    A stretch is split into rows whose word is less than, equal to and greater
    than a pivot; the equal ones go on with the next word. Short stretches are
    sorted by all words that are left.
    """
    order, todo = np.arange(len(words)), [(0, len(words), 0)]
    while todo:
        a, b, k = todo.pop()
        if k == words.shape[1] or b - a < 2:
            continue
        rows = order[a:b]
        if b - a <= SHORT:
            order[a:b] = rows[np.lexsort([words[rows, j] for j in range(words.shape[1] - 1, k - 1, -1)])]
            continue
        word = words[rows, k]
        pivot = np.sort(word[:: max(1, len(word) // 63)])[len(word[:: max(1, len(word) // 63)]) // 2]
        less, more = word < pivot, word > pivot
        n, m = int(less.sum()), int(more.sum())
        order[a:b] = np.concatenate([rows[less], rows[~(less | more)], rows[more]])
        todo += [(a, a + n, k), (a + n, b - m, k + 1), (b - m, b, k)]
    return order


def least_ids(around: np.ndarray, before: np.ndarray, after: np.ndarray, least: np.ndarray) -> np.ndarray:
    """``[suffix, o]``: the least id with the ``LENGTH`` bytes that start ``o`` before the anchor."""
    n = len(around)
    suffix = np.zeros((n, -(-LENGTH // 8) * 8), dtype=np.uint8)
    suffix[:, :LENGTH] = around[:, BEFORE:]
    order = multikey_order(suffix.view(">u8").astype(np.uint64))
    ids, out = least[order], np.repeat(least[:, None], WINDOW, axis=1)
    same = np.empty(max(0, n - 1), dtype=np.int64)
    for a in range(0, n - 1, 1 << 17):
        b = min(n - 1, a + (1 << 17))
        differ = suffix[order[a + 1 : b + 1], :LENGTH] != suffix[order[a:b], :LENGTH]
        same[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    reach = after[order].astype(np.int64)
    if n:
        same = np.minimum(same, np.minimum(reach[1:], reach[:-1]))
    have = before[order].astype(np.int64)
    left = np.zeros(n, dtype=np.int64)  # numbers of the different bytes before, longer by one each time
    for o in range(WINDOW):
        if o:
            left = np.unique(left * 256 + around[order, BEFORE - o], return_inverse=True)[1]
        linked = same >= LENGTH - o
        run = np.cumsum(np.concatenate([[True], ~linked])) if n else np.zeros(0, dtype=np.int64)
        at = np.flatnonzero((np.concatenate([[False], linked]) | np.concatenate([linked, [False]]))[:n] & (have >= o))
        if not len(at):
            continue
        key = run[at] * (n + 1) + left[at]
        by = np.argsort(key)
        edge = np.flatnonzero(np.concatenate([[True], key[by[1:]] != key[by[:-1]]]))
        low = np.minimum.reduceat(ids[at[by]], edge)
        out[order[at[by]], o] = np.repeat(low, np.diff(np.append(edge, len(by))))
    return out


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    width, pack, unpack = BEFORE + LENGTH, zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
    for part, rows in _whole_parts(batches):
        around, before, after, least = [], [], [], []
        for n, blob in zip(rows["n"], rows["blob"], strict=True):
            raw = unpack.decompress(blob)
            around.append(np.frombuffer(raw, np.uint8, n * width).reshape(n, width))
            before.append(np.frombuffer(raw, np.uint8, n, n * width))
            after.append(np.frombuffer(raw, np.uint8, n, n * (width + 1)))
            least.append(np.frombuffer(raw, "<i8", n, n * (width + 2)))
        own = np.concatenate(least)
        low = least_ids(np.concatenate(around), np.concatenate(before), np.concatenate(after), own)
        cut = np.concatenate([[0], np.cumsum(rows["n"])])
        back = [pack.compress((low[a:b] - own[a:b, None]).astype("<i8").T.tobytes()) for a, b in zip(cut, cut[1:], strict=False)]
        yield pd.DataFrame({"file": rows["file"].to_numpy(), "part": np.int32(part), "low": back})


def _remove(folder: str, parts: int, splitters: np.ndarray, with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for rows in batches:
            for name, marks, lows in zip(rows["file"], rows["marks"], rows["lows"], strict=True):
                chunk = Chunk.read(folder, name)
                got = Shared(chunk, [(int(m["part"]), m["marks"], m["hots"]) for m in marks], parts, splitters)
                low = [np.frombuffer(unpack.decompress(x["low"]), "<i8").reshape(WINDOW, -1) for x in sorted([] if lows is None else lows, key=lambda x: x["part"])]
                low = np.concatenate(low, axis=1) + got.least if low else np.zeros((WINDOW, 0), dtype=np.int64)
                edges = np.zeros(len(chunk.data) + 1, dtype=np.int32)
                for a in range(0, len(got.place), 1 << 18):
                    b = a + (1 << 18)
                    kind, place, length, ids = got.kind[a:b], got.place[a:b], got.length[a:b], chunk.ids[got.doc[a:b]]
                    before, after, first = got.before[kind], got.after[kind], got.first[kind]
                    for o in range(WINDOW):
                        goes = (before >= o) & (first <= o) & (after >= LENGTH - o) & (ids > low[o][kind])
                        start = place[goes] - o
                        np.add.at(edges, start, 1)
                        np.add.at(edges, start + LENGTH + length[goes] - 1, -1)
                gone, out = np.cumsum(edges[:-1]) > 0, []
                for key, null, a, b in zip(chunk.ids, chunk.null, chunk.starts, chunk.ends, strict=True):
                    x, data = gone[a:b], chunk.data[a:b]
                    spans = int(x[0]) + int((x[1:] & ~x[:-1]).sum()) if b > a else 0
                    out.append((None if null else int(key), b - a, int(x.sum()), spans, (data[~x] if spans else data).tobytes()))
                yield from _result(out, with_text)

    return run


def _result(out, with_text: bool):
    for a in range(0, len(out), 2000):
        part = out[a : a + 2000]
        frame = pd.DataFrame(
            {
                "doc_id": pd.array([x[0] for x in part], dtype="Int64"),
                "n_bytes": [x[1] for x in part],
                "n_removed": [x[2] for x in part],
                "n_spans": [x[3] for x in part],
                "kept_sha256": [hashlib.sha256(x[4]).hexdigest() for x in part],
            }
        ).astype({"n_bytes": "int64", "n_removed": "int64", "n_spans": "int64"})
        yield frame.assign(kept=[x[4].decode("utf-8", "replace") for x in part]) if with_text else frame


def _sample(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name in rows["file"]:
                chunk = Chunk.read(folder, name)
                place, _, _ = anchors(chunk, SAMPLE_BYTES)
                place = place[np.linspace(0, len(place) - 1, min(len(place), SAMPLE_ANCHORS)).astype(np.int64)] if len(place) else place
                yield pd.DataFrame({"leading": [chunk.data[p : p + 16].tobytes() for p in place]}, dtype=object)

    return run


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``.

    ``with_text`` adds ``kept``, what is left of the text (bytes of a character
    that was cut are replaced); the hash is over the exact bytes.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = shared_dir(spark)
    system, at = _file(folder)
    system.create_dir(at, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    files = materialize(rows.mapInPandas(_write(folder), "file string, n_bytes long"))
    n_files, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    files, parts = files.select("file"), max(shuffle_partitions(spark), -(-size // PART))
    tasks = max(1, min(n_files, 100_000))  # a chunk is a row of a small table: deal them out one by one
    dealt = files.repartition(tasks)
    sample = files.orderBy(F.xxhash64("file"), "file").limit(SAMPLE_CHUNKS).repartition(SAMPLE_CHUNKS).mapInPandas(_sample(folder), "leading binary").collect()
    leading = np.sort(np.array([bytes(x[0]) for x in sample], dtype="S16"))
    splitters = np.unique(leading[np.arange(1, parts) * len(leading) // parts]) if len(leading) else leading
    sent = dealt.mapInPandas(_send_hashes(folder, parts), "part int, file string, blob binary, times binary")
    marks = sent.repartitionById(parts, F.col("part")).mapInPandas(_shared_hashes, "file string, part int, marks binary, hots binary")
    marks = materialize(marks.groupBy("file").agg(F.collect_list(F.struct("part", "marks", "hots")).alias("marks")))
    whole = files.join(marks.withColumnRenamed("file", "f"), F.col("file") == F.col("f"), "left").select("file", F.coalesce("marks", F.array().cast("array<struct<part:int,marks:binary,hots:binary>>")).alias("marks"))
    whole = materialize(whole)
    suffixes = whole.repartition(tasks).mapInPandas(_send_suffixes(folder, parts, splitters), "part int, file string, n long, blob binary")
    lows = suffixes.repartitionById(parts, F.col("part")).mapInPandas(_compare, "file string, part int, low binary")
    lows = materialize(lows.groupBy("file").agg(F.collect_list(F.struct("part", "low")).alias("lows")).withColumnRenamed("file", "f"))
    last = whole.join(lows, F.col("file") == F.col("f"), "left").select("file", "marks", F.coalesce("lows", F.array().cast("array<struct<part:int,low:binary>>")).alias("lows"))
    last = last.repartition(tasks)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    return last.mapInPandas(_remove(folder, parts, splitters, with_text), schema)
