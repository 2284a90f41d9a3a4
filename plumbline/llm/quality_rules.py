"""Quality rules with thresholds that adapt to language and source.

DataFrame functions only. Every signal of a row is an integer in thousandths;
its sketch is a log-linear histogram (32 to 63 steps for each power of two), a
mergeable quantile summary with a relative error of 1/32: counts of a bucket
add up whatever the order of rows or partitions. Rows that fail the fixed base
rule are left out of the sketches.

No threshold is a number of its own; all are read off the sketches. A limit lies
as far beyond a percentile as that is from the median: for characters per word,
which is odd on both sides, beyond the ``LOW``-th and the ``HIGH``-th; for shares
(symbols, repeated lines, repeated words), which are 0 on most rows, beyond the
``TOP``-th. A value is compared by its step of the sketch.

Junk that passes the base rule can be more than the share above a percentile, and
would then set the limit itself. Rows far off the others are therefore left out
before the percentiles are read: the sketch is cut where its two sides differ most
(the largest variance between them), if the upper side has at most one row in
``JUNK``, enough rows to reach the percentile, and a mean ``APART`` deviations away.

A group with fewer than ``min_group`` rows in the sketch uses the sum of the
sketches of its language, and that failing, of all rows.

Defined results: a null text has no words; a null language or source is a group
of its own; an empty table gives no rows; repeated rows count as often as they
occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, materialize

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
SHARES = ["symbols_per_word", "dup_line_share", "repeat_share"]
LEVEL = "chars_per_word"
LOW, HIGH, TOP = 5, 95, 99
#: A separate upper part of a sketch: one row in so many at most, its mean so many deviations (of both parts) away.
JUNK, APART = 5, 8


def _bind(value: Column, body) -> Column:
    """``body`` over ``value``, computed once and not once an element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(hashes: Column) -> Column:
    """Words in 8-word windows that occur twice, from the windows' hashes."""
    keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = _bind(keyed, lambda a: F.filter(a, lambda e, k: ((k > 0) & (F.get(a, k - 1)["h"] == e["h"])) | ((k + 1 < F.size(a)) & (F.get(a, k + 1)["h"] == e["h"]))))
    starts = F.sort_array(F.transform(again, lambda e: e["i"]))
    steps = _bind(starts, lambda p: F.transform(p, lambda s, k: F.when(k + 1 < F.size(p), F.least(F.lit(8), F.get(p, k + 1) - s)).otherwise(F.lit(8))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)


def repeat_words(words: Column) -> Column:
    hashes = _bind(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 7), lambda i: F.xxhash64(F.slice(w, i, 8))))
    counted = _bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h)))
    return F.when(F.size(words) > 8, counted).otherwise(F.lit(0).cast("long"))


def signals(docs: DataFrame) -> DataFrame:
    """Counts of every row's whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    measured = docs.select(
        "doc_id",
        "lang",
        "source",
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _bind(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
    )
    return measured.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeat_words(F.col("words")).alias("n_repeat_words"), "n_lines"
    )


def _thousandths(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.expr(f"({part} * 1000) div {whole}")).otherwise(F.lit(0)).cast("long")


def _bucket(value: str) -> Column:
    """The lower end of a value's histogram step: its six leading bits stay."""
    cut = f"greatest(length(bin({value})) - 6, 0)"
    return F.expr(f"shiftleft(shiftright({value}, {cut}), {cut})")


def sketch(measured: DataFrame) -> DataFrame:
    """``lang, source, signal, bucket, n`` of the rows that pass the base rule."""
    names = [*SHARES, LEVEL]
    stacked = ", ".join(f"'{s}', {s}" for s in names)
    rows = measured.filter("NOT base_failed").select("lang", "source", F.expr(f"stack({len(names)}, {stacked}) as (signal, value)"))
    return rows.groupBy("lang", "source", "signal", _bucket("value").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _percentiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """A row a group: how many rows its sketch has, and the limits of each signal."""
    merged = sketches.groupBy(*by, "signal", "bucket").agg(F.sum("n").alias("n"))
    part = Window.partitionBy(*by, "signal")
    rising = part.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = F.col("bucket").cast("double")
    sums = {"upto": F.sum("n"), "s": F.sum(F.col("n") * x), "q": F.sum(F.col("n") * x * x)}
    run = merged.select("*", *[f.over(rising).alias(c) for c, f in sums.items()], *[f.over(part).alias(f"all_{c}") for c, f in sums.items()])
    # both sides of a cut behind each step: rows, means and variances
    rest = F.nullif(F.col("all_upto") - F.col("upto"), F.lit(0))
    low, high = F.col("s") / F.col("upto"), (F.col("all_s") - F.col("s")) / rest
    spread = F.col("q") / F.col("upto") - low * low + ((F.col("all_q") - F.col("q")) / rest - high * high)
    reach = F.when(F.col("signal") == LEVEL, 100 - HIGH).otherwise(100 - TOP)
    apart = (rest > 0) & (rest * JUNK <= F.col("all_upto")) & (rest * 100 > F.col("all_upto") * reach) & ((high - low) * (high - low) >= APART * APART * spread)
    between = F.when(apart, F.struct(F.col("upto") * (rest * ((high - low) * (high - low))), -F.col("bucket")))
    run = run.withColumn("top", F.max_by("bucket", between).over(part)).withColumn("of", F.col("all_upto"))
    run = run.filter(F.col("top").isNull() | (F.col("bucket") <= F.col("top"))).withColumn("kept", F.max("upto").over(part))
    at = lambda s, q: F.min(F.when((F.col("signal") == s) & (F.col("upto") * 100 >= F.col("kept") * q), F.col("bucket")))
    beyond = lambda s, q: 2 * at(s, q) - at(s, 50)
    limits = [beyond(LEVEL, LOW).alias("least"), beyond(LEVEL, HIGH).alias(f"most_{LEVEL}"), *[beyond(s, TOP).alias(f"most_{s}") for s in SHARES]]
    return run.groupBy(*by).agg(F.max("of").alias("of"), *limits)


def fences(sketches: DataFrame, groups: DataFrame, min_group: int) -> DataFrame:
    """``lang, source, least, most_<signal>`` of every group in ``groups(lang, source)``."""
    every = _percentiles(sketches, []).first()
    own, langs = _percentiles(sketches, ["lang", "source"]), _percentiles(sketches, ["lang"])
    own = own.withColumnsRenamed({c: f"g_{c}" for c in own.columns})
    langs = langs.withColumnsRenamed({c: f"l_{c}" for c in langs.columns})
    joined = groups.join(own, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left").join(langs, F.col("lang").eqNullSafe(F.col("l_lang")), "left")

    def pick(limit: str) -> Column:
        of_all = F.lit(every[limit] if every else None).cast("long")
        return F.when(F.col("g_of") >= min_group, F.col(f"g_{limit}")).when(F.col("l_of") >= min_group, F.col(f"l_{limit}")).otherwise(of_all).alias(limit)

    return joined.select("lang", "source", pick("least"), *[pick(f"most_{s}") for s in [LEVEL, *SHARES]])


def apply_rules(docs: DataFrame, min_group: int = 200, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for every row of ``docs``."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    measured = materialize(
        signals(docs).select(
            "*",
            failed.alias("base_failed"),
            _thousandths("n_symbols", "n_words").alias("symbols_per_word"),
            _thousandths("word_chars", "n_words").alias("chars_per_word"),
            _thousandths("n_dup_lines", "n_lines").alias("dup_line_share"),
            _thousandths("n_repeat_words", "n_words").alias("repeat_share"),
        )
    )
    found = materialize(fences(materialize(sketch(measured)), measured.select("lang", "source").distinct(), min_group))
    limits = broadcast_if_small(found.withColumnsRenamed({"lang": "f_lang", "source": "f_source"}), found.count())
    inside = _bucket(LEVEL) >= F.col("least")
    for s in [LEVEL, *SHARES]:
        inside = inside & (_bucket(s) <= F.col(f"most_{s}"))
    return measured.join(limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept")
    )
