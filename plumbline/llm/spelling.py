"""Spelling variants: words one edit apart, found through two segments of a word.

A word of length l is cut in two at l div 2. Of two words one edit apart, one
segment of the shorter (or equally long) word stands unchanged in the other: at
the same place, or one place on if the other has a code point more before it.
Every word is indexed by its two segments, and probes the segments of words as
long as itself and of words one shorter. Meeting words are verified by distance.

A segment that many words share makes a large bucket. A bucket of more than
``most`` pairs isn't joined: its words agree but for what stands beside the
segment, so that rest is cut in two again and the words are dealt out by the rest's
segments, until buckets are small or a single place is left, where all that meet
are one edit apart. No bucket is cut off and none is compared as a whole.

Defined results: a null text has no words; a null id counts as an empty one;
repeated rows count as often as they occur; ties go to the smaller word in
code-point order; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, broadcast_if_small, materialize

#: Code points of a word and its occurrences, at least.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form has at least so many times the occurrences of its variant.
FACTOR = 2
#: Every so-manieth run (by hash of document and run) loses a code point; 0: none does.
DAMAGE = 97
#: Pairs of a bucket beyond which it is dealt out again.
MOST = 1024
#: Different words that a task holds before it hands on its counts.
HELD = 1 << 18
#: Parts of a hot key.
SALTS = 8

#: Latin-1 bytes: A-Z to a-z, letters to themselves, all else to a space.
_LETTERS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str | None) -> list[bytes]:
    """Maximal runs of [A-Za-zÀ-ÿ], A-Z lower-cased, a byte a code point."""
    return (text or "").encode("latin-1", "replace").translate(_LETTERS).split()


def damaged(run: bytes, h: int, every: int) -> bytes:
    """The run without one code point, if ``every`` divides its hash."""
    if not every or h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counts(least: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in held]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for word, n in Counter(runs(text)).items():
                    if len(word) < least:
                        continue
                    if every:
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                        word = damaged(word, h, every)
                        if len(word) < least:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return run


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = 0) -> DataFrame:
    """``word, n``: the words of all texts and their occurrences; tasks add up before the shuffle."""
    bound_batches(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_counts(least_length, every), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _dealt(state: DataFrame) -> DataFrame:
    """Words by the two segments of what is open in them (``lo``, ``size``, of words one longer as well).

    Where the shorter word has one place open (``m`` is 1), a bucket of its own
    takes the words of one length, and longer ones go by either of their two places.
    """
    m = F.col("size") - F.col("longer").cast("int")
    p, shift = (m / 2).cast("int"), F.col("longer").cast("int")
    text = F.substring("word", F.col("lo") + 1, F.col("size"))
    head = F.substring(text, F.lit(1), p)
    tail = F.substring(text, p + shift + 1, m - p)
    row = lambda key, lo, size, last: F.struct(key.alias("key"), lo.cast("int").alias("lo"), size.cast("int").alias("size"), F.lit(last).alias("last"))
    halves = F.array(
        row(F.xxhash64("key", F.lit(1), head), F.col("lo") + p, F.col("size") - p, False),
        row(F.xxhash64("key", F.lit(2), tail), F.col("lo"), p + shift, False),
    )
    first, second = F.substring(text, F.lit(1), m), F.substring(text, shift + 1, m)
    ends = [row(F.xxhash64("key", F.lit(k), x), F.col("lo"), F.col("size"), True) for k, x in ((3, first), (4, second))]
    same = row(F.xxhash64("key", F.lit(5)), F.col("lo"), F.col("size"), True)
    parts = F.when(m > 1, halves).when(F.col("longer"), F.array(*ends)).otherwise(F.array(same, *ends))
    return state.select("word", "n", "longer", F.explode(parts).alias("p")).select("word", "n", "longer", "p.*")


def _salted(rows: DataFrame, keys: DataFrame, n: int, how: str) -> DataFrame:
    """A join with few keys, each of which may hold any number of rows."""
    if n == 0:
        return rows if how == "left_anti" else rows.limit(0)
    salt = F.pmod(F.xxhash64("word"), F.lit(SALTS))
    many = keys.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return rows.withColumn("salt", salt).join(broadcast_if_small(many, n * SALTS), ["key", "salt"], how).drop("salt")


def near_words(counted: DataFrame, most: int = MOST) -> DataFrame:
    """``a, n_a, b, n_b``: every two words of ``counted(word, n)`` that differ by one edit, once."""
    length = F.char_length("word").cast("int")
    whole = lambda longer: counted.select("word", "n", F.lit(longer).alias("longer"), F.xxhash64(length - int(longer)).alias("key"), F.lit(0).alias("lo"), length.alias("size"))
    state, found = whole(False).unionByName(whole(True).filter("size > 1")), []
    while True:
        entries = materialize(_dealt(state))
        buckets = entries.groupBy("key").agg(F.sum((~F.col("longer")).cast("long")).alias("own"), F.sum(F.col("longer").cast("long")).alias("more"), F.max("last").alias("last"))
        pairs = F.col("own") * (F.col("own") - 1) / 2 + F.col("own") * F.col("more")
        heavy = materialize(buckets.filter((pairs > most) & ~F.col("last")).select("key"))
        n_heavy = heavy.count()
        light = _salted(entries, heavy, n_heavy, "left_anti")
        a = light.filter(~F.col("longer")).select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
        b = light.select(F.col("key").alias("k"), F.col("word").alias("b"), F.col("n").alias("n_b"), "longer")
        met = a.join(b, (F.col("key") == F.col("k")) & (F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
        found.append(materialize(met.select("a", "n_a", "b", "n_b")))
        if not n_heavy:
            break
        state = _salted(entries, heavy, n_heavy, "left_semi").drop("last")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates(["a", "b"])  # an added code point at the seam leaves both segments unchanged


def _roots(links: DataFrame) -> DataFrame:
    """``word, up``: links followed to their ends; each round doubles how far they reach.

    Occurrences double from a word to its form, so there are few rounds.
    """
    now = materialize(links)
    while True:
        on = now.select(F.col("word").alias("w"), F.col("up").alias("next"))
        after = materialize(now.join(on, F.col("up") == F.col("w"), "left").select("word", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
        now = after.select("word", "up")
        if after.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, every: int = 0, most: int = MOST) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the texts.

    ``form`` is the commonest word one edit away if it is ``factor`` times as common,
    ``root`` the end of the forms' chain. ``every`` damages runs, as the query does.
    """
    counted = materialize(words(docs, least_length, least_count, every))
    pairs = near_words(counted, most)
    back = pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    near = pairs.unionByName(back).groupBy(F.col("a").alias("w")).agg(F.count(F.lit(1)).alias("near"), F.min(F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("b"))).alias("best"))
    named = counted.join(near, counted["word"] == near["w"], "left")
    fits = -F.col("best.n") >= factor * F.col("n")
    forms = materialize(named.select("word", F.when(fits, F.col("best.b")).alias("form"), "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, -F.col("best.n")).alias("form_n")))
    roots = _roots(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("up"))).select(F.col("word").alias("w"), "up")
    return forms.join(roots, forms["word"] == roots["w"], "left").select("word", "form", F.coalesce("up", "word").alias("root"), "n", "n_near", "form_n")

