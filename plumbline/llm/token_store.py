"""Token ids in binary files with Elias-Fano coded document boundaries.

A shard holds a run of documents in ascending id order::

    8 bytes   magic "PLTOKEF2"
    10 x u64  documents, ids, bytes an id, words of each of the six arrays,
              number of null document ids (they come first)
    u64s      boundaries: low bits, high bits, samples; document ids: the same
    2 x u64   least document id (signed), span of document ids
    ids       in a row, little-endian

Elias-Fano keeps n ascending numbers below u in about n * (2 + log2(u / n))
bits: ``l = floor(log2(u / n))`` low bits of each in one array, the rest as
unary gaps in another. ``select1`` on the high bits finds a number without the
others; the file also has the position of every 256th set bit, so it is a scan
of a few words. ``window`` answers for numbers in a row from the words that hold
them; nothing makes a table of all boundaries.

Shards are written under a name of their own by each attempt, then listed in a
manifest; only listed files are read, so a repeated task does no harm.

Defined results: a null text is empty and has its end id only; null ids come
first; repeated rows are documents of their own, in no particular order; an
empty table makes an empty manifest.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialize, shared_dir, shuffle_partitions
from .tokens import blocks, encoder

MAGIC = b"PLTOKEF2"
#: Ids after which a shard is closed at the next document.
SHARD_IDS = 8_000_000
SAMPLE = 256
#: Bytes of text for a range of ids.
RANGE_BYTES = 64 << 20
#: Documents that are read at a time.
ROWS = 4096


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value, one after the other, in u64 words."""
    if not width or not len(values):
        return np.zeros(0, dtype="<u8")
    bits = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    return np.packbits(np.pad(bits, (0, -len(bits) % 64)), bitorder="little").view("<u8")


class EliasFano:
    """Ascending non-negative numbers in near-minimal space, with ``select``."""

    def __init__(self, n: int, universe: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low, self.high, self.samples = n, universe, low, high, samples
        self.width = self.low_bits(n, universe)

    @property
    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.samples]

    @staticmethod
    def low_bits(n: int, universe: int) -> int:
        return max(0, (universe // n).bit_length() - 1) if n else 0

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        width = np.uint64(cls.low_bits(len(values), universe))
        ones = (values >> width).astype(np.int64) + np.arange(len(values))
        bits = np.zeros(-(-(int(ones[-1]) + 1 if len(ones) else 0) // 64) * 64, dtype=np.uint8)
        bits[ones] = 1
        return cls(len(values), universe, _pack(values, int(width)), np.packbits(bits, bitorder="little").view("<u8"), ones[::SAMPLE].astype("<u8"))

    def _low(self, k: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(k), dtype=np.uint64)
        at = k.astype(np.uint64) * np.uint64(self.width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        after = self.low[np.minimum(word + 1, len(self.low) - 1)]
        value = (self.low[word] >> shift) | np.where(shift > 0, after << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return value & np.uint64((1 << self.width) - 1)

    def select(self, k: int) -> int:
        """The k-th number, from the sampled bit onwards."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        at, left = int(self.samples[k // SAMPLE]), k % SAMPLE
        word = at >> 6
        value = int(self.high[word]) >> (at & 63) << (at & 63)
        while (ones := value.bit_count()) <= left:
            word, left = word + 1, left - ones
            value = int(self.high[word])
        for _ in range(left):
            value &= value - 1
        high = word * 64 + (value & -value).bit_length() - 1 - k
        return high << self.width | int(self._low(np.array([k]))[0])

    def window(self, a: int, b: int) -> np.ndarray:
        """Numbers ``a`` to ``b - 1``, from the words between the samples around them."""
        if not 0 <= a <= b <= self.n:
            raise IndexError((a, b))
        if a == b:
            return np.zeros(0, dtype=np.int64)
        first, after = a // SAMPLE, -(-b // SAMPLE)
        at = int(self.samples[first])
        end = (int(self.samples[after]) >> 6) + 1 if after < len(self.samples) else len(self.high)
        base = (at >> 6) * 64
        ones = np.flatnonzero(np.unpackbits(self.high[at >> 6 : end].view(np.uint8), bitorder="little")) + base
        ones = ones[np.searchsorted(ones, at) + a - first * SAMPLE :][: b - a]
        k = np.arange(a, b)
        return (((ones - k).astype(np.uint64) << np.uint64(self.width)) | self._low(k)).astype(np.int64)


class Shard:
    """A file's bytes; ``offset``/``ids`` answer for one document by ``select``."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        head = np.frombuffer(data, "<u8", 10, 8).astype(object)
        self.documents, self.n_ids, width, *words, self.nulls = (int(x) for x in head)
        parts, at = [], 88
        for n in words:
            parts.append(np.frombuffer(data, "<u8", n, at))
            at += 8 * n
        base = int(np.frombuffer(data, "<i8", 1, at)[0])
        span = int(np.frombuffer(data, "<u8", 1, at + 8)[0])
        self.bounds = EliasFano(self.documents + 1, self.n_ids + 1, *parts[:3])
        self.doc_ids = EliasFano(self.documents - self.nulls, span, *parts[3:])
        self.base, self.tokens = base, np.frombuffer(data, f"<u{width}", self.n_ids, at + 16)

    @staticmethod
    def build(doc_ids: list[int | None], lengths: list[int], tokens: bytes, width: int) -> bytes:
        known = np.array([x for x in doc_ids if x is not None], dtype=np.int64)
        n_ids, base = len(tokens) // width, int(known[0]) if len(known) else 0
        span = int(known[-1]) - base + 1 if len(known) else 1
        bounds = EliasFano.build(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), n_ids + 1)
        ids = EliasFano.build(known.astype(np.uint64) - np.uint64(base & (1 << 64) - 1), span)
        parts = [*bounds.arrays, *ids.arrays]
        head = np.array([len(doc_ids), n_ids, width, *map(len, parts), len(doc_ids) - len(known)], dtype="<u8")
        return b"".join([MAGIC, head.tobytes(), *(p.tobytes() for p in parts), np.array([base], dtype="<i8").tobytes(), np.array([span], dtype="<u8").tobytes(), tokens])

    def offset(self, k: int) -> int:
        return self.bounds.select(k)

    def ids(self, k: int) -> np.ndarray:
        return self.tokens[self.offset(k) : self.offset(k + 1)]

    def documents_ids(self, a: int, b: int) -> list[int | None]:
        """Ids of documents ``a`` to ``b - 1``."""
        nulls = max(0, min(b, self.nulls) - a)
        known = self.doc_ids.window(max(0, a - self.nulls), max(0, b - self.nulls))
        return [None] * nulls + [int(x) + self.base for x in known]


#: The manifest's place in the folder of a lasting store.
MANIFEST = "manifest.parquet"


def _file(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _write(folder: str, path: str, end_id: int):
    width = 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = encoder(path, end_id, f"<u{width}")
        ids: list[int | None] = []
        lengths: list[int] = []
        parts: list[bytes] = []
        total, part, place = 0, TaskContext.get().partitionId(), 0

        def close() -> pd.DataFrame:
            nonlocal total, place
            system, at = _file(folder)
            name = f"{at.rstrip('/')}/{uuid.uuid4().hex}.tok"
            with system.open_output_stream(name) as out:
                out.write(Shard.build(ids, lengths, b"".join(parts), width))
            row = pd.DataFrame({"file": [name.rsplit("/", 1)[1]], "part": [part], "place": [place], "first_id": pd.array([next((x for x in ids if x is not None), None)], dtype="Int64"), "last_id": pd.array([ids[-1]], dtype="Int64"), "n_ids": [total]})
            ids.clear(), lengths.clear(), parts.clear()
            total, place = 0, place + 1
            return row

        for rows in batches:
            texts = [t or "" for t in rows["text"]]
            keys = [None if pd.isna(x) else int(x) for x in rows["doc_id"]]
            for a, b in blocks(texts):
                coded, sizes = codec.encode(texts[a:b])
                ends, done = np.cumsum(sizes), 0
                while done < b - a:
                    before = int(ends[done - 1]) if done else 0
                    upto = min(b - a, int(np.searchsorted(ends, before + SHARD_IDS - total)) + 1)
                    ids += keys[a + done : a + upto]
                    lengths += sizes[done:upto].tolist()
                    parts.append(coded[before : ends[upto - 1]].tobytes())
                    total, done = total + int(ends[upto - 1]) - before, upto
                    if total >= SHARD_IDS:
                        yield close()
        if ids:
            yield close()

    return run


def write(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> tuple[str, DataFrame]:
    """Writes all of ``docs(doc_id, text)``; the folder and its manifest.

    The manifest has a row for each file: its range and place in it, ``start``
    being the ids before it. With a ``folder`` of the caller's both stay there when
    the application ends, and :func:`open_store` finds them; without, they go.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    lasting = folder is not None
    folder = folder or shared_dir(spark)
    system, at = _file(folder)
    system.create_dir(at, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the second column deals out a null or repeated id that many rows have
    tied = rows.withColumn("tie", F.rand(20040707))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-size // RANGE_BYTES))
    ordered = tied.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first()).select("doc_id", "text")
    files = materialize(ordered.mapInPandas(_write(folder, path, end_id), "file string, part int, place int, first_id long, last_id long, n_ids long"))
    # two levels: this window has a row a range, the next one a row a file of its range
    ranges = files.groupBy("part").agg(F.sum("n_ids").alias("of")).select(F.col("part").alias("p"), (F.sum("of").over(Window.orderBy("part")) - F.col("of")).alias("ranges_before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("place")) - F.col("n_ids")
    started = files.withColumn("within", within).join(F.broadcast(ranges), F.col("part") == F.col("p"))
    manifest = started.select(*files.columns, (F.col("ranges_before") + F.col("within")).cast("long").alias("start"))
    if not lasting:
        return folder, materialize(manifest)
    manifest.write.mode("error").parquet(f"{folder.rstrip('/')}/{MANIFEST}")  # last: a store without it isn't whole
    return folder, open_store(spark, folder)


def open_store(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a store that :func:`write` has left in ``folder``; an error where it didn't end."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{MANIFEST}")


def _read(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, at = _file(folder)
        for rows in batches:
            for name, start in zip(rows["file"], rows["start"], strict=True):
                with system.open_input_file(f"{at.rstrip('/')}/{name}") as file:
                    shard = Shard(file.read())
                for a in range(0, shard.documents, ROWS):
                    b = min(a + ROWS, shard.documents)
                    bounds = shard.bounds.window(a, b + 1)
                    crc = [zlib.crc32(shard.tokens[x:y].astype("<u4").tobytes()) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                    yield pd.DataFrame({"doc_id": pd.array(shard.documents_ids(a, b), dtype="Int64"), "start": bounds[:-1] + start, "n_tokens": np.diff(bounds), "ids_crc32": np.array(crc, dtype=np.int64)})

    return run


def read(folder: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files."""
    n = max(1, min(manifest.count(), 100_000))
    return manifest.select("file", "start").repartition(n).mapInPandas(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
