"""Packing of documents into sequences along a Hilbert curve.

A document's token counts are hashed to 1024 dimensions, scaled to length 1 and
projected to three; the cell of a 2^13 grid gives a 39-bit Hilbert key. 24 bits
of a hash of the id follow, so that a key shared by many documents can be cut.
Keys and ids are made once and written to the shared folder, documents in
segments of at most ``SEGMENT`` ids, so that rows weigh about the same; Spark
takes the ranges of the curve from the written keys, as many as keep a range at
about ``RANGE_BYTES``. Every range is sorted, and its documents are laid end to end,
cut every 1024 tokens. What is left at a range's end becomes sequences whose
lengths are powers of two, so nothing is padded at all.

The projection has whole numbers, so that sums are exact and keys the same
wherever and in whatever block a document is looked at.

Defined results: a null text is empty and has its end id only; rows with a null
id are packed as well; repeated rows are packed as often as they occur; an empty
table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, shuffle_partitions
from .tokens import blocks, encoder

LENGTH = 1024
DIMENSIONS, BITS, HASHED = 3, 13, 1024
#: Bytes of ids in a range, ids in a row, and documents whose counts are held at a time.
RANGE_BYTES, SEGMENT, DOCUMENTS = 32 << 20, 1024, 512


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Rows of grid coordinates -> their places on the Hilbert curve (Skilling, 2004)."""
    x = np.array(cells, dtype=np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        low = q - one
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t ^= np.where((x[n - 1] >> np.uint64(b)) & one, (one << np.uint64(b)) - one, np.uint64(0))
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def _projection() -> np.ndarray:
    return np.round(np.random.default_rng(20040707).standard_normal((HASHED, DIMENSIONS)) * 65536)


def curve_keys(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents whose token ids lie in a row."""
    plane, points, upto = _projection(), np.zeros((len(lengths), DIMENSIONS)), np.concatenate([[0], np.cumsum(lengths)])
    place = ((np.arange(1 << 16, dtype=np.uint32) * np.uint32(2654435761)) >> np.uint32(22)).astype(np.int32)
    for a in range(0, len(lengths), DOCUMENTS):
        b = min(a + DOCUMENTS, len(lengths))
        at = place[ids[upto[a] : upto[b]]]
        at += np.repeat(np.arange(b - a, dtype=np.int32) * np.int32(HASHED), lengths[a:b])
        counts = np.bincount(at, minlength=(b - a) * HASHED).reshape(b - a, HASHED).astype(np.float64)
        size = np.sqrt(np.einsum("ij,ij->i", counts, counts))
        points[a:b] = counts @ plane / (65536 * np.maximum(size, 1.0))[:, None]
    cells = np.clip((points + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64)
    return hilbert(cells)


def _mixed(keys: np.ndarray) -> np.ndarray:
    """24 well mixed bits of each id."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)).astype(np.int64)


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = encoder(path, end_id)
        for rows in batches:
            texts = [t or "" for t in rows["text"]]
            for a, b in blocks(texts):
                ids, lengths = codec.encode(texts[a:b])
                known = rows["doc_id"].iloc[a:b]
                key = curve_keys(ids, lengths) << 24
                key |= _mixed(known.fillna(-1).astype("int64").to_numpy())
                pieces = -(-lengths // SEGMENT)
                doc = np.repeat(np.arange(b - a), pieces)
                start = SEGMENT * (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                first = (np.cumsum(lengths) - lengths)[doc] + start
                size = np.minimum(SEGMENT, lengths[doc] - start)
                yield pd.DataFrame(
                    {
                        "key": key[doc],
                        "doc_id": known.astype("Int64").iloc[doc].reset_index(drop=True),
                        "start": start,
                        "doc_tokens": lengths[doc],
                        "ids": [ids[x:y].tobytes() for x, y in zip(first.tolist(), (first + size).tolist(), strict=True)],
                    }
                )

    return run


def _pack(length: int):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def row(doc, start, ids, total, sequence, offset):
        return (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, sequence, fill, open_ = TaskContext.get().partitionId(), 0, 0, []  # open_: pieces of the sequence that isn't full

        def close():
            nonlocal sequence
            out, left, size, at = [], fill, 0, 0
            for doc, start, ids, total in open_:
                while len(ids):
                    if at == size:
                        sequence += size > 0
                        size, at = 1 << (left.bit_length() - 1), 0
                        left -= size
                    n = min(len(ids), size - at)
                    out.append(row(doc, start, ids[:n], total, (part << 32) + sequence, at))
                    start, ids, at = start + n, ids[n:], at + n
            return out

        for rows in batches:
            out = []
            for doc, start, total, coded in zip(rows["doc_id"].astype(object), rows["start"].tolist(), rows["doc_tokens"].tolist(), rows["ids"], strict=True):
                ids, doc = np.frombuffer(coded, dtype="<u2"), None if pd.isna(doc) else int(doc)
                while len(ids):
                    n = min(len(ids), length - fill)
                    open_.append((doc, start, ids[:n], total))
                    start, ids, fill = start + n, ids[n:], fill + n
                    if fill == length:
                        at = 0
                        for d, s, x, t in open_:
                            out.append(row(d, s, x, t, (part << 32) + sequence, at))
                            at += len(x)
                        sequence, fill, open_ = sequence + 1, 0, []
            frame = pd.DataFrame(out, columns=columns)
            yield frame.astype({"doc_id": "Int64"})
        yield pd.DataFrame(close(), columns=columns).astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, path: str, end_id: int = 0, length: int = LENGTH) -> DataFrame:
    """A row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``length`` is a power of two.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = materialize(rows.mapInPandas(_encode(path, end_id), "key long, doc_id long, start long, doc_tokens long, ids binary"))
    size = coded.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-size // RANGE_BYTES))
    # a tie of key and id: rows that are repeated, or without an id
    laid = coded.repartitionByRange(parts, "key").sortWithinPartitions("key", "doc_id", "doc_tokens", "start", "ids")
    return laid.select("doc_id", "start", "doc_tokens", "ids").mapInPandas(_pack(length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
