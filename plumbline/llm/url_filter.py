"""Verdicts on URLs: a few rules by host and path, and a list of any length.

Listed URLs are brought to one form (see :func:`canonical`) and entered in a
blocked Bloom filter: one hash names a block of 256 bits, another sets two bits in
each of its four words. The filter is a table of at most ``MAX_BLOCKS`` rows,
whatever the list, and the only thing that is broadcast. URLs whose bits are all
set meet the list itself in a hash join, which takes the false hits out, so a
filter too full for its list costs time, not correctness.

The few URLs that are listed go back to the rows by a join whose keys are dealt
into parts, since one URL may be that of a third of all rows.

Defined results: a null URL, or one without ``://``, has an empty host and path, no
rule and no listed form, and is allowed; rows are judged one by one, repeated ones
too; of rules as long as one another the first by text wins; an empty list blocks
nothing; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

#: Bits of the filter for a listed URL, and its blocks at most (32 bytes each).
BITS, MAX_BLOCKS = 12, 1 << 18
#: Parts of a URL that many rows share.
SALTS = 8
#: Parameters of a query string that don't change the page.
TRACKING = "utm_[^=]*|ref|gclid|fbclid"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """Holds for a host and all below it, where the path begins with the rule's."""

    verdict: str
    host: str
    path: str


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The form in which URLs are listed; null where there is no host.

    Host without ``www.`` or ``m.`` in front and a usual port behind, path without a
    last ``/``, parameters in order without those that only track. No scheme and no
    fragment.
    """
    site = F.regexp_replace(F.regexp_replace(host(url), ":(80|443)$", ""), r"^(www|m)\.", "")
    given = F.split(F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(given, lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)"))), "&")
    return F.when(site != "", F.concat(site, F.regexp_replace(path(url), "/$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_of(rules: Sequence[Rule], site: Column, way: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; rules are part of the plan, so they are to be few."""
    text = verdict = F.lit(None).cast("string")
    by_text = sorted(rules, key=lambda r: r.host + r.path, reverse=True)
    for r in sorted(by_text, key=lambda r: len(r.host + r.path)):  # the last one is asked first
        fits = ((site == r.host) | site.endswith(f".{r.host}")) & way.startswith(r.path)
        text = F.when(fits, F.lit(r.host + r.path)).otherwise(text)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - int(math.log2(blocks))) if blocks > 1 else F.lit(0).cast("long")


def _words(key: str) -> list[Column]:
    """Two bits of a second hash in each of four words."""
    bit = lambda k: f"shiftleft(1L, cast(shiftright(xxhash64({key}, 11), {6 * k}) & 63 AS int))"
    return [F.expr(f"{bit(2 * j)} | {bit(2 * j + 1)}") for j in range(4)]


def bloom(listed: DataFrame, n: int, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """The filter of ``n`` URLs ``listed(key)``: ``block, w0 .. w3``, and the number of blocks, a power of two."""
    blocks = min(max_blocks, 1 << max(0, math.ceil(math.log2(max(1, n * BITS / 256)))))
    set_ = listed.select(_block(F.col("key"), blocks).alias("block"), *[w.alias(f"w{j}") for j, w in enumerate(_words("key"))])
    return set_.groupBy("block").agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(4)]), blocks


def possible(rows: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """``rows(key, ...)`` with ``possible``: all bits of the key are set. The filter has ``blocks`` rows at most."""
    hit = F.lit(True)
    for j, w in enumerate(_words("key")):
        hit &= F.col(f"w{j}").bitwiseAND(w) == w
    met = rows.join(F.broadcast(filter_), _block(F.col("key"), blocks) == F.col("block"), "left")
    return met.withColumn("possible", F.coalesce(hit, F.lit(False))).drop("block", "w0", "w1", "w2", "w3")


def _with_few(rows: DataFrame, few: DataFrame, how: str) -> DataFrame:
    """A join on ``key`` with keys that may each have any number of rows."""
    n = few.count()
    many = few.select("key", *[c for c in few.columns if c != "key"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return salted.join(broadcast_if_small(many, n * SALTS), ["key", "salt"], how).drop("salt")


def judge(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, row_id: str = "page_id", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``row_id, host, path, rule, verdict`` for every row of ``pages(row_id, url)``.

    ``verdict`` is the rule's; without a rule it is ``block`` where the URL is among
    ``listed(url)``, else ``allow``.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col(row_id).alias("id"), host(url).alias("host"), path(url).alias("path"), canonical(url).alias("key"))
    text, verdict = rule_of(rules, F.col("host"), F.col("path"))
    rows = rows.withColumn("rule", text).withColumn("verdict", verdict).withColumn("key", F.when(F.col("rule").isNull(), F.col("key")))
    known = materialize(listed.select(canonical(F.col("url").cast("string")).alias("key")).filter("key IS NOT NULL").distinct())
    filter_, blocks = bloom(known, known.count(), max_blocks)
    rows = materialize(possible(rows, filter_, blocks))
    maybe = rows.filter("possible")
    hits = materialize(maybe.select("key").distinct().join(known, "key", "left_semi")).withColumn("hit", F.lit(True))
    columns = [F.col("id").alias(row_id), "host", "path", "rule"]
    clear = rows.filter("NOT possible").select(*columns, F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    tested = _with_few(maybe, hits, "left").select(*columns, F.when(F.col("hit"), "block").otherwise("allow").alias("verdict"))
    return clear.unionByName(tested)


def keep_allowed(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame) -> DataFrame:
    """The rows whose URL is allowed, with all their columns."""
    urls = pages.select("url").filter("url IS NOT NULL").distinct()
    blocked = materialize(judge(urls.withColumn("id", F.col("url")), rules, listed, "id").filter("verdict = 'block'").select(F.col("id").alias("key")))
    spread = pages.select(F.struct("*").alias("row"), F.col("url").alias("key"))
    return _with_few(spread, blocked, "left_anti").select("row.*")


def named(pages: DataFrame, terms: Sequence[str]) -> DataFrame:
    """``url`` of the pages whose host has one of the terms between its dots and hyphens."""
    return pages.select("url").filter(F.arrays_overlap(F.split(host(F.col("url").cast("string")), "[.:-]"), F.array(*[F.lit(t) for t in terms])))
