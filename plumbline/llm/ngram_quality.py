"""Quality by the perplexity of an interpolated modified Kneser-Ney model.

The model is trained on trusted text (labelled good) as a chain of count tables:
counts of 4-grams, continuation counts, context totals and interpolated
probabilities are grouped and joined in Spark, dealt out by n-gram. Symbols are
characters with two marks: a capital letter is a shift mark and the small
letter, and a word that repeats the word before is, with the white space between
them, one repeat mark. The 56 code points that are most frequent in the trusted
text are a symbol each; any other is spelled by three, a lead and two digits, as
a multi-byte character is. So no script loses what tells its characters apart, and
the four symbols of a gram reach over one spelled character into the next. Code
points 28,672 apart have the same spelling.

With 64 symbols a model has at most 64^4 numbers whatever the corpus: a proven bound,
within which the finished tables go to every executor, by way of files in the
shared folder. Every whole text is scored there; joining each document's own
n-grams instead would shuffle several times the input.

A row is kept if its perplexity is at most the ``quantile`` of the trusted rows
of its language; short texts are drawn towards the language's median by
``prior`` symbols.

Defined results: a null or empty text has no symbols and the language's median
perplexity, so it is kept; a language without ``min_trusted`` trusted rows (a
null language too) uses the quantile over all; without any trusted row nothing
is rejected; labels for absent or null ids and repeated labels do nothing;
repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, held, materialize, release, shared_dir
from .token_store import _file
from .tokens import blocks

ORDER, SYMBOL_BITS = 4, 6
SYMBOLS = 1 << SYMBOL_BITS
START, REPEAT, SHIFT = 0x110000, 0x110001, 0x110002
#: Leading symbols of code points that aren't among the frequent ones, and their mark in the table.
LEADS, SPELLED = 7, 255
#: Ids of trusted rows up to which they are broadcast.
TRUSTED_BROADCAST = 1_000_000


def marked_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points with marks, each text after three start marks; and the text of each."""
    lengths = np.array([len(t) for t in texts]) + ORDER - 1
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    pad = "\x00" * (ORDER - 1)
    raw = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int32)
    first = np.cumsum(lengths) - lengths
    mark = np.zeros(len(raw), dtype=bool)
    for k in range(ORDER - 1):
        mark[first + k] = True
    raw[mark] = START
    space = mark | (raw == 32) | ((raw >= 9) & (raw <= 13))
    keep = np.ones(len(raw), dtype=bool)
    at = np.flatnonzero(~space)
    if len(at):
        begin = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
        size = np.diff(np.append(begin, len(at)))
        place = np.arange(len(at)) - np.repeat(begin, size)
        power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, dtype=np.uint64))
        digest = np.add.reduceat(raw[at].astype(np.uint64) * power[place], begin)
        head = at[begin]
        again = np.zeros(len(begin), dtype=bool)
        again[1:] = (digest[1:] == digest[:-1]) & (size[1:] == size[:-1]) & (doc[head[1:]] == doc[head[:-1]])
        keep[at[np.repeat(again, size)]] = False
        keep[head[again]] = True
        gap = np.flatnonzero(space & ~mark)
        after = np.searchsorted(head, gap)
        gap, after = gap[after < len(head)], after[after < len(head)]
        keep[gap[again[after]]] = False
        raw[head[again]] = REPEAT
    raw, doc = raw[keep], doc[keep]
    small = _small()
    low = np.where(raw < len(small), small[np.minimum(raw, len(small) - 1)], raw)
    capital = low != raw
    if capital.any():
        times = 1 + capital.astype(np.int64)
        shift = (np.cumsum(times) - times)[capital]
        low, doc = np.repeat(low, times), np.repeat(doc, times)
        low[shift] = SHIFT
    return low, doc


def _small() -> np.ndarray:
    kept = sys.__dict__.setdefault("_plumbline_small", [])
    if not kept:
        kept.append(np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x2000)], dtype=np.int32))
    return kept[0]


def alphabet_table(frequent: list[int]) -> np.ndarray:
    """Code point (or mark) -> symbol; ``frequent`` in order, the rest is spelled."""
    table = np.full(SHIFT + 1, SPELLED, dtype=np.uint8)
    table[START] = 0
    for k, c in enumerate(frequent[: SYMBOLS - LEADS - 1]):
        table[c] = k + 1
    return table


def symbols(codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of code points, and of which place each is."""
    s, place = table[codes].astype(np.int32), np.arange(len(codes))
    spelled = s == SPELLED
    if spelled.any():
        times = np.where(spelled, 3, 1)
        at = (np.cumsum(times) - times)[spelled]
        s, place, code = np.repeat(s, times), np.repeat(place, times), codes[spelled]
        s[at] = SYMBOLS - LEADS + (code >> 2 * SYMBOL_BITS) % LEADS
        s[at + 1] = (code >> SYMBOL_BITS) & (SYMBOLS - 1)
        s[at + 2] = code & (SYMBOLS - 1)
    return s, place


def grams(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram codes that end in a symbol of a text, and the text of each."""
    codes, doc = marked_codes(texts)
    s, place = symbols(codes, table)
    g = s[3:] | (s[2:-1] << SYMBOL_BITS) | (s[1:-2] << 2 * SYMBOL_BITS) | (s[:-3] << 3 * SYMBOL_BITS)
    real = (codes != START)[place][3:]
    return g[real], doc[place][3:][real]


def _texts(rows: pd.DataFrame):
    texts = [t or "" for t in rows["text"]]
    for a, b in blocks(texts, 250_000):
        yield a, b, texts[a:b]


def _symbol_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    release()
    total = np.zeros(SHIFT + 1, dtype=np.int64)
    for rows in batches:
        for _, _, texts in _texts(rows):
            total += np.bincount(marked_codes(texts)[0], minlength=SHIFT + 1)
    total[START] = 0
    at = np.flatnonzero(total)
    yield pd.DataFrame({"code": at, "n": total[at]})


def _gram_counts(frequent: list[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        table, total = alphabet_table(frequent), pd.Series(dtype=np.int64)
        for rows in batches:
            for _, _, texts in _texts(rows):
                code, n = np.unique(grams(texts, table)[0], return_counts=True)
                total = total.add(pd.Series(n, index=code), fill_value=0)
        for k in range(0, len(total), 1 << 16):
            part = total.iloc[k : k + (1 << 16)]
            yield pd.DataFrame({"code": part.index.to_numpy(dtype=np.int64), "n": part.to_numpy(dtype=np.int64)})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.1), k + 0.9) for k, d in enumerate(raw)]


def train(trusted: DataFrame, frequent: list[int]) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: ``(code, p)`` of seen n-grams, ``(context, gamma)``."""
    counts = materialize(trusted.select(F.col("text").cast("string").alias("text")).mapInPandas(_gram_counts(frequent), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    by_order = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("code").bitwiseAND((1 << k * SYMBOL_BITS) - 1)
        by_order[k] = materialize(by_order[k + 1].groupBy(suffix.alias("code")).agg(F.count(F.lit(1)).alias("n")))
    lower, out = None, []
    for k in range(1, ORDER + 1):
        rows = by_order[k].withColumn("context", F.shiftright("code", SYMBOL_BITS))
        of = dict(rows.filter("n <= 4").groupBy("n").count().collect())
        d = discounts(*[of.get(i, 0) for i in (1, 2, 3, 4)])
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        context = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum(F.least(off, F.col("n"))).alias("off")).select("context", "total", (F.col("off") / F.col("total")).alias("gamma"))
        joined = rows.join(context, "context").withColumn("own", F.greatest(F.col("n") - off, F.lit(0.0)) / F.col("total"))
        if lower is None:
            seen = joined.select("code", (F.col("own") + F.col("gamma") / SYMBOLS).alias("p"))
        else:
            below = lower.select(F.col("code").alias("suffix"), F.col("p").alias("p_below"))
            seen = joined.join(below, F.col("code").bitwiseAND((1 << (k - 1) * SYMBOL_BITS) - 1) == F.col("suffix")).select("code", (F.col("own") + F.col("gamma") * F.col("p_below")).alias("p"))
        lower = materialize(seen)
        out.append((lower, materialize(context.select("context", "gamma"))))
    return out


class Costs:
    """-log p of 4-grams. Of each three-symbol context there are a bit for each
    symbol that was seen after it, the costs of those in order, and the cost of
    backing off to the last three symbols otherwise. No probability is 0: discounts
    leave every context a share for what wasn't seen."""

    def __init__(self, lower: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], parts):
        """``lower``: tables of orders 1 to 3; ``parts``: ``(contexts, gammas, codes, p)``, in order of codes."""
        p = np.full(SYMBOLS, 1 / SYMBOLS)
        for k, (code, value, context, gamma) in enumerate(lower, 1):
            back = np.ones(SYMBOLS ** (k - 1))
            back[context] = gamma
            p = (back.reshape(SYMBOLS, -1, 1) * p.reshape(1, -1, SYMBOLS) if k > 1 else back * p).reshape(-1)
            p[code] = value
        self.below = self._log(p)
        self.back, self.seen = np.zeros(len(p), dtype=np.float32), np.zeros(len(p), dtype=np.uint64)
        values = [np.zeros(0, dtype=np.float32)]
        for context, gamma, code, value in parts:
            self.back[context] = self._log(gamma)
            np.bitwise_or.at(self.seen, code >> SYMBOL_BITS, np.uint64(1) << (code & (SYMBOLS - 1)).astype(np.uint64))
            values.append(self._log(value))
        self.values = np.concatenate([*values, np.zeros(1, dtype=np.float32)])
        n = np.bitwise_count(self.seen).astype(np.int32)
        self.first = np.cumsum(n, dtype=np.int32) - n

    @staticmethod
    def _log(p: np.ndarray) -> np.ndarray:
        return -np.log(p).astype(np.float32)

    def __getitem__(self, code: np.ndarray) -> np.ndarray:
        context, symbol = code >> SYMBOL_BITS, (code & (SYMBOLS - 1)).astype(np.uint64)
        bits = self.seen[context]
        at = self.first[context] + np.bitwise_count(bits & ((np.uint64(1) << symbol) - np.uint64(1)))
        backed = self.back[context] + self.below[code & (SYMBOLS ** (ORDER - 1) - 1)]
        return np.where((bits >> symbol) & np.uint64(1), self.values[at], backed)


def dense(model: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], dtype=np.float32) -> np.ndarray:
    """-log p of every 4-gram code."""
    code, value, context, gamma = model[-1]
    order = np.argsort(code)
    costs, every = Costs(model[:-1], [(context, gamma, code[order], value[order])]), np.arange(SYMBOLS**ORDER)
    return np.concatenate([costs[c] for c in np.array_split(every, SYMBOLS)]).astype(dtype)


def _write_costs(folder: str):
    """A file for each first symbol: contexts, their gammas, codes and p, after the counts of both."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [rows for rows in batches if len(rows)]
        if frames:
            rows, name = pd.concat(frames, ignore_index=True).sort_values("code"), uuid.uuid4().hex
            context, seen = rows[rows["is_context"]], rows[~rows["is_context"]]
            head = np.array([len(context), len(seen)], dtype="<i8")
            system, at = _file(folder)
            with system.open_output_stream(f"{at.rstrip('/')}/{name}") as out:
                out.write(b"".join([head.tobytes(), *(t[c].to_numpy(d).tobytes() for t in (context, seen) for c, d in (("code", "<i8"), ("value", "<f8")))]))
            yield pd.DataFrame({"file": [name], "first": [int(rows["first"].iloc[0])]}).astype({"first": "int32"})

    return run


def _read_costs(folder: str, names: list[str]):
    system, at = _file(folder)
    for name in names:
        with system.open_input_file(f"{at.rstrip('/')}/{name}") as file:
            raw = file.read()
        n, m = (int(x) for x in np.frombuffer(raw, "<i8", 2))
        yield np.frombuffer(raw, "<i8", n, 16), np.frombuffer(raw, "<f8", n, 16 + 8 * n), np.frombuffer(raw, "<i8", m, 16 + 16 * n), np.frombuffer(raw, "<f8", m, 16 + 16 * n + 8 * m)


def _score(frequent: list[int], lower, folder: str, names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, cost = held(("ngrams", folder), lambda: (alphabet_table(frequent), Costs(lower.value, _read_costs(folder, names))))
        for rows in batches:
            total, n = np.zeros(len(rows)), np.zeros(len(rows), dtype=np.int64)
            for a, b, texts in _texts(rows):
                code, doc = grams(texts, table)
                total[a:b] = np.bincount(doc, weights=cost[code], minlength=b - a)
                n[a:b] = np.bincount(doc, minlength=b - a)
            yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "lang": rows["lang"], "n_symbols": n, "cost": total})

    return run


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.999, prior: int = 50, min_trusted: int = 200, margin: float = 0.05) -> DataFrame:
    """``doc_id, lang, n_symbols, perplexity, threshold, kept`` for every row of ``docs``.

    ``labels(doc_id, quality)`` says which rows are trusted (quality 1).
    ``margin`` widens a threshold, as a share of its logarithm, since a quantile
    near 1 is itself uncertain.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    trusted_ids = materialize(labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("trusted_id")).distinct())
    n_trusted = trusted_ids.count()
    near = F.broadcast(trusted_ids) if n_trusted <= TRUSTED_BROADCAST else trusted_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    trusted = rows.join(near, F.col("doc_id") == F.col("trusted_id"), "left_semi")
    common = trusted.select("text").mapInPandas(_symbol_counts, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "code").limit(SYMBOLS).collect()
    frequent = [int(c) for c, _ in common]
    *below, (seen, context) = train(trusted, frequent)
    lower = []
    for p, gamma in below:  # at most 64^3 rows
        a, b = p.toPandas(), gamma.toPandas()
        lower.append((a["code"].to_numpy(), a["p"].to_numpy(), b["context"].to_numpy(), b["gamma"].to_numpy()))
    folder = shared_dir(spark)
    system, at = _file(folder)
    system.create_dir(at, recursive=True)
    first = F.shiftright("code", (ORDER - 1) * SYMBOL_BITS).cast("int")
    whole = seen.select("code", F.col("p").alias("value"), F.lit(False).alias("is_context"), first.alias("first")).union(
        context.select(F.col("context").alias("code"), F.col("gamma").alias("value"), F.lit(True).alias("is_context"), F.shiftright("context", (ORDER - 2) * SYMBOL_BITS).cast("int").alias("first"))
    )
    files = materialize(whole.repartitionById(SYMBOLS, F.col("first")).mapInPandas(_write_costs(folder), "file string, first int"))
    names = [name for name, _ in files.orderBy("first").collect()]
    scored = materialize(rows.mapInPandas(_score(frequent, spark.sparkContext.broadcast(lower), folder, names), "doc_id long, lang string, n_symbols long, cost double"))
    good = scored.join(near, F.col("doc_id") == F.col("trusted_id"), "left_semi").filter("n_symbols > 0")
    middle = F.percentile_approx(F.col("cost") / F.col("n_symbols"), 0.5, 10_000)
    of_lang = good.groupBy("lang").agg(middle.alias("m"), F.count(F.lit(1)).alias("of"))
    m_all = good.agg(middle).first()[0] or 0.0
    medians = materialize(of_lang.filter(F.col("of") >= min_trusted).select(F.col("lang").alias("m_lang"), "m"))

    def drawn(df: DataFrame) -> DataFrame:
        m = F.coalesce("m", F.lit(m_all))
        return df.join(F.broadcast(medians), F.col("lang") == F.col("m_lang"), "left").withColumn("mean_cost", (F.col("cost") + prior * m) / (F.col("n_symbols") + prior))

    limit = F.percentile_approx("mean_cost", quantile, 100_000) * (1 + margin)
    marked = materialize(drawn(good).select("lang", "mean_cost"))
    limits = materialize(marked.groupBy("lang").agg(limit.alias("limit"), F.count(F.lit(1)).alias("of")).filter(F.col("of") >= min_trusted).select(F.col("lang").alias("l_lang"), "limit"))
    overall = marked.agg(limit).first()[0]
    bound = F.coalesce("limit", F.lit(float("inf") if overall is None else overall))
    return (
        drawn(scored)
        .join(F.broadcast(limits), F.col("lang") == F.col("l_lang"), "left")
        .select("doc_id", "lang", "n_symbols", F.exp("mean_cost").alias("perplexity"), F.exp(bound).alias("threshold"), (F.col("mean_cost") <= bound).alias("kept"))
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, columns as they are.

    An id goes if all of its rows are rejected.
    """
    gone = classify(docs, labels, **options).groupBy(F.col("doc_id").alias("__plumbline_gone")).agg(F.bool_or("kept").alias("any")).filter("NOT any").drop("any")
    gone = materialize(gone)
    n = gone.count()
    near = F.broadcast(gone) if n <= TRUSTED_BROADCAST else gone
    return docs.join(near, docs["doc_id"].eqNullSafe(near["__plumbline_gone"]), "left_anti")
