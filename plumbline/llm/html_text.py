"""Main text of web pages by removal of site templates.

Spark counts, for each host, on how many pages of different content a subtree
occurs, in two senses:

* by its text: names, classes and words are the same;
* by its structure at its place: names and classes from the root down to it and
  below it, equal children counted once, and where it has text, whatever the
  words. Only subtrees beside the page's spine count, which is the chain of
  elements with over half of the page's text. On how many pages such a
  subtree is part of the spine itself is counted as well.

A subtree is a template, and deleted, if it is found on ``min_pages`` pages and
on a share of ``min_share`` of the host's or, on a large host, on
``PER_DOUBLING`` pages for each doubling of the host; by structure only if it is
beside the spine more often than in it. Inside an ``article`` or ``main`` element
paragraphs, headings, quotations and list items are prose and stay, however
often their words recur. Hosts with fewer than ``min_host`` pages are counted
together.

What is left is the text, except for elements whose name says that they hold
none (nav, header, footer, aside, form, script, ...). On the pages of hosts with
fewer than ``min_host`` pages, where counts say little, classes that say what an
element is ("ad", "sidebar", ...) count too, and if there are articles, only they
are taken.

Defined results: a null or empty page has an empty text; pages with a null or odd
url are counted with those of small hosts; repeated rows are extracted alike, and copies of a page count once;
other columns are not looked at; broken markup is read as far as it goes: unknown
end tags are skipped, open elements end with their parents, an unclosed comment
takes the rest.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, broadcast_if_small, materialize

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd figcaption td th tr tbody thead".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content isn't shown as text.
HIDDEN = frozenset("script style noscript template iframe svg select textarea head title object canvas audio video math".split())
#: Elements that never hold main text.
DROP = frozenset("nav header footer aside form script style noscript template iframe svg button select textarea input dialog menu head title object canvas audio video math".split())
#: Words in a class or an id that say the same, for hosts with few pages.
DROP_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer ad ads advert adverts advertisement adbox banner promo sponsor sponsored cookie cookies consent notice notices alert popup modal newsletter subscribe subscription signup share sharing social comment comments commentlist respond replies disqus related recommended widget toolbar login search pagination pager masthead copyright disclaimer".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: A start tag of the left closes an open element of the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl article section div body main".split())
#: Templates up to which their set is broadcast.
TEMPLATE_BROADCAST = 200_000
#: Pages that suffice for a template for each doubling of a large host.
PER_DOUBLING = 5
#: The group of hosts with few pages, and what a row of counts is about.
FEW = "\x00"
PAGE, TEXT, SPINE, BESIDE = range(4)

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_U64 = (1 << 64) - 1


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _tag_end(page: str, at: int) -> int:
    """The place of the > that ends a tag; quoted values may hold others."""
    while stop := _STOP.search(page, at):
        if stop[0] == ">":
            return stop.start()
        at = stop.end()
        if page[max(0, stop.start() - 8) : stop.start()].rstrip()[-1:] == "=":
            close = page.find(stop[0], at)
            at = close + 1 if close >= 0 else at
    return len(page)


class Page:
    """Elements and text pieces ``(element, block, text)`` in page order.

    Of an element there are its name, parent, the hash of its subtree with text,
    that of its structure at its place, whether its name and whether its class
    says that it holds no main text, and how long its text is.
    """

    def __init__(self, page: str):
        self.names, self.parents, self.hashes, self.places, self.drops, self.words, self.sizes, self.main = ["#"], [-1], [0], [0], [False], [False], [0], []
        self.pieces: list[tuple[int, int, str]] = []
        self._stack, self._digests, self._shapes, self._block = [0], [xxhash.xxh64()], [set()], 0
        self._open: dict[str, int] = {}
        self._labels: list[str] = []
        self._read(page)
        while self._stack:
            self._close()

    def _text(self, text: str) -> None:
        if text:
            self.pieces.append((self._stack[-1], self._block, text))
            if kept := " ".join(text.split()):
                self._digests[-1].update(kept)
                self._shapes[-1].add(0)
                self.sizes[self._stack[-1]] += len(kept)

    def _close(self) -> None:
        node, digest, inner = self._stack.pop(), self._digests.pop().intdigest(), self._shapes.pop()
        self.hashes[node] = digest
        name, hidden = self.names[node], self.names[node] in HIDDEN
        self._open[name] = self._open.get(name, 0) - 1
        if hidden:
            self.sizes[node] = 0
        if self._digests:
            self._digests[-1].update(digest.to_bytes(8, "little"))
            self.sizes[self.parents[node]] += self.sizes[node]
            if not hidden:
                place = self.places[node]
                self.places[node] = xxhash.xxh64_intdigest(repr((place, sorted(inner))))
                self._shapes[-1].add(xxhash.xxh64_intdigest(repr((name, self._labels.pop(), sorted(inner)))))
            else:
                self._labels.pop()

    def _start(self, name: str, attributes: str) -> None:
        if name in CLOSES or (name in BLOCK and name != "br"):
            shut = CLOSES.get(name, set()) | ({"p"} if name in BLOCK else set())
            for depth in range(len(self._stack) - 1, 0, -1) if any(self._open.get(x, 0) > 0 for x in shut) else ():
                open_ = self.names[self._stack[depth]]
                if open_ in shut:
                    while len(self._stack) > depth:
                        self._close()
                elif open_ in SCOPE:
                    break
        node, label, drop, word, main = len(self.names), "", name in DROP, False, name in ("article", "main")
        for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                label += f" {value}"
                word = word or (name not in ("html", "body", "article", "main") and not DROP_WORDS.isdisjoint(_WORD.findall(value))) or (name == "article" and "comment" in _WORD.findall(value))
            elif key == "role":
                drop, main = drop or value in DROP_ROLES, main or value == "main"
            elif name not in ("html", "body"):
                drop = drop or key == "hidden" or value == "true"
        self.names.append(name)
        self.parents.append(self._stack[-1])
        self.hashes.append(0)
        kind = " ".join(sorted(set(_WORD.findall(label)))) if label else ""
        self.places.append(xxhash.xxh64_intdigest(f"{self.places[self._stack[-1]]}<{name} {kind}>"))
        self.drops.append(drop)
        self.words.append(word)
        self.sizes.append(0)
        if main:
            self.main.append(node)
        self._block += name in BLOCK
        self._stack.append(node)
        self._open[name] = self._open.get(name, 0) + 1
        self._digests.append(xxhash.xxh64(f"<{name}{label}>"))
        self._shapes.append(set())
        self._labels.append(kind)
        if name in VOID:
            self._close()

    def _end(self, name: str) -> None:
        for depth in range(len(self._stack) - 1, 0, -1) if self._open.get(name, 0) > 0 else ():
            if self.names[self._stack[depth]] == name:
                while len(self._stack) > depth:
                    self._close()
                break
            if name not in SCOPE and self.names[self._stack[depth]] in ("article", "main", "body", "td", "th"):
                break
        self._block += name in BLOCK

    def _read(self, page: str) -> None:
        at = 0
        while m := _OPEN.search(page, at):
            self._text(page[at : m.start()])
            if m[1]:
                end = page.find("-->", m.end())
                at = end + 3 if end >= 0 else len(page)
                continue
            end = page.find(">", m.end()) if m[2] else _tag_end(page, m.end())
            end = len(page) if end < 0 else end
            at = end + 1
            if m[2]:
                continue
            name = m[4].lower()
            if m[3]:
                self._end(name)
                continue
            inside = page[m.end() : end]
            self._start(name, inside)
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
                self._text(page[at : close.start()] if close else page[at:])
                at = close.start() if close else len(page)
        self._text(page[at:])

    def under(self) -> list[int]:
        """For each element the nearest article or main element that holds it (or 0)."""
        out, mains = [0] * len(self.names), set(self.main)
        for k in range(1, len(self.names)):
            out[k] = k if k in mains else out[self.parents[k]]
        return out

    def templates(self) -> list[int]:
        """Hashes of the elements that may be deleted as templates."""
        inside = self.under()
        return [h for k, (n, h) in enumerate(zip(self.names, self.hashes, strict=True)) if n in BLOCK and n not in ("#", "html", "body", "br", "hr", "article", "main", "title") and not (inside[k] and n in PROSE)]

    def spine(self) -> tuple[list[int], list[int]]:
        """Elements with over half of the page's text, and those beside them."""
        children: dict[int, list[int]] = {}
        for k in range(1, len(self.names)):
            if self.sizes[k] and self.names[k] in BLOCK:
                children.setdefault(self.parents[k], []).append(k)
        at, spine, beside = 0, [], []
        while at in children:
            most = max(children[at], key=lambda k: (self.sizes[k], -k))
            if 2 * self.sizes[most] <= self.sizes[0] or self.names[most] in PROSE:
                break
            spine.append(most)
            beside += [k for k in children[at] if k != most]
            at = most
        return spine, beside

    def text(self, gone: set[int] | frozenset[int] = frozenset(), few: bool = True, lists: bool = True) -> str:
        """The main text without subtrees in ``gone``; ``few`` and ``lists`` say what else is dropped."""
        inside, n = self.under(), len(self.names)
        own, heading = [False] * n, [False] * n
        for k in range(1, n):
            up, name = self.parents[k], self.names[k]
            by_text = self.hashes[k] in gone and not (inside[k] and name in PROSE) and name not in ("article", "main")
            template = name in BLOCK and name not in ("html", "body") and (by_text or self.places[k] in gone)
            titled = name == "header" and inside[up] and not template
            heading[k] = name in HEADINGS or heading[up]
            listed = self.drops[k] or (few and self.words[k]) if lists else False
            own[k] = template or name in HIDDEN or (listed and not titled)
        header = [False] * n
        for k in range(1, n):
            header[k] = lists and (header[self.parents[k]] or (self.names[k] == "header" and bool(inside[k])))

        def fall(root: int) -> list[bool]:
            """What is dropped below ``root``."""
            out = [False] * n
            for k in range(root + 1, n):
                out[k] = own[k] or out[self.parents[k]]
            return out

        dropped = fall(0)
        chosen = few and lists
        mains = [k for k in self.main if not (self.drops[k] or self.words[k])] if chosen else []
        if mains and all(dropped[k] for k in self.main):
            # a wrapper with a misleading class: what is around the article doesn't count
            dropped = fall(max(mains, key=lambda k: (self.sizes[k], -k)))
        roots = {k for k in self.main if chosen and not dropped[k]}
        roots = {k for k in roots if self.names[k] == "article"} or roots
        below = [not roots] * n
        for k in range(1, n):
            below[k] = below[self.parents[k]] or k in roots
        out, parts, last = [], [], None
        for node, block, text in self.pieces:
            if below[node] and not dropped[node] and (not header[node] or heading[node]):
                if block != last:
                    out.append("".join(parts))
                    parts, last = [], block
                parts.append(text)
        out.append("".join(parts))
        return " ".join(x for b in out if (x := " ".join(html.unescape(b).split())))


COUNTED = "host string, key long, content long, kind int, subtree long"


def _subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for host, key, page in zip(rows["host"], rows["key"], rows["html"], strict=True):
            parsed = Page(page)
            spine, beside = parsed.spine()
            found = {(PAGE, 0), *((TEXT, h) for h in parsed.templates()), *((SPINE, parsed.places[k]) for k in spine), *((BESIDE, parsed.places[k]) for k in beside)}
            out += [(host, key, _signed(parsed.hashes[0]), kind, _signed(h)) for kind, h in found]
        yield pd.DataFrame(out, columns=["host", "key", "content", "kind", "subtree"]).astype({"key": "int64", "content": "int64", "kind": "int32", "subtree": "int64"})


def _elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All that may be a template on a page."""
    for rows in batches:
        out = []
        for host, key, page in zip(rows["host"], rows["key"], rows["html"], strict=True):
            parsed = Page(page)
            found = {0, *parsed.templates(), *(h for h, name in zip(parsed.places, parsed.names, strict=True) if name in BLOCK)}
            out += [(host, key, _signed(h)) for h in found]
        yield pd.DataFrame(out, columns=["host", "key", "subtree"]).astype({"key": "int64", "subtree": "int64"})


def _extract(templates, lists: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = templates.value if templates else {}
        for rows in batches:
            gone = rows["gone"] if "gone" in rows else [None] * len(rows)
            out = []
            for host, page, own in zip(rows["host"], rows["html"], gone, strict=True):
                drop = known.get(host, known.get(FEW, frozenset())) if own is None else {int(h) & _U64 for h in own}
                # every host with enough pages has the hash 0 as a mark
                out.append(Page(page).text(drop - {0}, few=0 not in drop, lists=lists) if page else "")
            yield pd.DataFrame({"page_id": rows["page_id"].astype("Int64"), "url": rows["url"], "text": out, "n_chars": [len(t) for t in out]})

    return run


def page_rows(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.withColumn("host", host).withColumn("key", F.xxhash64("url", "html"))


def site_templates(found: DataFrame, min_pages: int = 5, min_share: float = 0.2, min_host: int = 10) -> DataFrame:
    """``host, subtree`` of templates; hash 0 marks the hosts with enough pages, ``FEW`` is all others."""
    of_hosts = found.filter(F.col("kind") == PAGE).groupBy("host").agg(F.countDistinct("content").alias("of"))
    large = materialize(of_hosts.filter((F.col("of") >= min_host) & (F.col("host") != "")).withColumnRenamed("host", "h"))
    n = large.count()
    near = broadcast_if_small(large, n)
    small = found.join(near, F.col("host") == F.col("h"), "left_anti")
    of_small = small.filter(F.col("kind") == PAGE).select("content").distinct().count()

    def counted(rows: DataFrame, by: list[str]) -> DataFrame:
        once = rows.filter(F.col("kind") != PAGE).select(*by, "kind", "subtree", "content").distinct()
        times = {k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0)) for k in (TEXT, SPINE, BESIDE)}
        return once.groupBy(*by, "subtree").agg(times[TEXT].alias("by_text"), times[SPINE].alias("spine"), times[BESIDE].alias("beside"))

    def chosen(rows: DataFrame) -> DataFrame:
        need = F.greatest(F.lit(min_pages), F.least(min_share * F.col("of"), PER_DOUBLING * F.log2("of")))
        return rows.filter((F.col("by_text") >= need) | ((F.col("beside") >= need) & (F.col("beside") > F.col("spine")))).select("host", "subtree")

    repeated = counted(found, ["host"]).filter((F.col("by_text") >= min_pages) | (F.col("beside") >= min_pages))
    own = chosen(repeated.join(near, F.col("host") == F.col("h")))
    others = chosen(counted(small, []).select(F.lit(FEW).alias("host"), "subtree", "by_text", "spine", "beside", F.lit(of_small).alias("of")))
    return materialize(own.unionByName(others).unionByName(large.select(F.col("h").alias("host"), F.lit(0).cast("long").alias("subtree"))))


def extract(pages: DataFrame, min_pages: int = 5, min_share: float = 0.2, min_host: int = 10, broadcast_rows: int = TEMPLATE_BROADCAST, lists: bool = True) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``.

    ``lists=False`` leaves only the counts and what is never shown.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    rows = page_rows(pages)
    found = materialize(rows.filter("length(html) > 0").select("host", "key", "html").mapInPandas(_subtrees, COUNTED))
    templates = site_templates(found, min_pages, min_share, min_host)
    schema = "page_id long, url string, text string, n_chars long"
    if templates.count() <= broadcast_rows:
        known: dict[str, set[int]] = {}
        for h, subtree in templates.toLocalIterator():
            known.setdefault(h, set()).add(subtree & _U64)
        return rows.select("page_id", "url", "host", "html").mapInPandas(_extract(spark.sparkContext.broadcast(known), lists), schema)
    # the page's own templates, by its host or, without the mark of one, by those of small hosts
    subtrees = materialize(rows.filter("length(html) > 0").select("host", "key", "html").mapInPandas(_elements, "host string, key long, subtree long"))
    few = templates.filter(F.col("host") == FEW).select("subtree")
    mine = subtrees.join(templates, ["host", "subtree"]).groupBy("key").agg(F.collect_set("subtree").alias("mine"))
    shared = subtrees.join(few, "subtree").groupBy("key").agg(F.collect_set("subtree").alias("shared"))
    none = F.array().cast("array<long>")
    marked = mine.join(shared, "key", "full").select(F.col("key").alias("k"), F.when(F.array_contains(F.coalesce("mine", none), 0), F.col("mine")).otherwise(F.coalesce("shared", none)).alias("found"))
    joined = rows.join(marked, F.col("key") == F.col("k"), "left").withColumn("gone", F.coalesce("found", none))
    return joined.select("page_id", "url", "host", "html", "gone").mapInPandas(_extract(None, lists), schema)
