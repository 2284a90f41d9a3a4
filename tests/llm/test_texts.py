"""Personal data, quality model, repeated passages and pages."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import html_text, ngram_quality, pii, suffixes

from . import data


def slow_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if low <= len(d) <= high and (kind == 3 or pii.luhn(d)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab.@-+ ()0123459[]at", max_size=80))
def test_base_spans(text):
    got = sorted((s, k, e) for k, s, e, base in pii.matches(text) if base and k < 4)
    assert got == slow_base(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_long_runs_are_fast():
    import time

    began = time.time()
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "A1" * 100_000 + "(at)"):
        pii.matches(text)
    assert time.time() - began < 20


def test_find(spark):
    got = pii.find(data.table(spark)).collect()
    assert len(got) == len(data.rows())
    for r in got:
        for i, t, *_ in data.rows():
            if i == r["doc_id"] == 15:
                base = slow_base(t)
                written = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
                assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
                assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest() and r["spans"] == written
        if r["doc_id"] != 15:
            assert r["spans"] == ""
    assert pii.find(data.table(spark, [])).count() == 0


def test_weak_labels_add_spans(spark):
    texts = [f"please call my phone 523 555-{1000 + k} now, {data.prose(k, 9)}" for k in range(40)] + [f"write a mail to john.{k}@site.example.com {data.prose(k, 9)}" for k in range(40)]
    docs = data.table(spark, [(k, t, "en", "a", 0, *[None] * 10) for k, t in enumerate(texts)])
    got = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    assert all(got[k].startswith("phone_local:") for k in range(40)) and all(got[k].startswith("email:") for k in range(40, 80))
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    assert not [r for r in clean.select("text").collect() if re.search(r"@|555", r[0])]


def test_reliabilities_find_the_bad_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.5
    right = [0.95, 0.9, 0.9, 0.85, 0.5]
    vote = np.stack([np.where(rng.random(4000) < r, truth, ~truth) for r in right], axis=1).astype(int)
    table, p = pii.reliabilities(vote, np.ones(4000))
    assert ((p > 0.5) == truth).mean() > 0.95
    assert table[1, 0, 1] > 0.9 and abs(table[1, 4, 1] - 0.5) < 0.1


def test_redact_keeps_nulls(spark):
    got = {(r["doc_id"], r["text"]) for r in pii.redact(data.table(spark)).select("doc_id", "text").collect()}
    assert (2, None) in got and (3, "") in got and any(i == 15 and "<email>" in t and "<card>" in t for i, t in got)


def test_quality_by_held_out_accuracy(spark):
    good = [(k, data.prose(k, 60), "en", "a", 0, *[None] * 10) for k in range(400)]
    symbols = [(1000 + k, " ".join(w + "###" for w in data.prose(k, 60).split()), "en", "a", 0, *[None] * 10) for k in range(40)]
    shouting = [(2000 + k, data.prose(k, 60).upper(), "en", "a", 0, *[None] * 10) for k in range(40)]
    echo = [(3000 + k, " ".join(w for w in data.prose(k, 12).split() for _ in range(9)), "en", "a", 0, *[None] * 10) for k in range(40)]
    labels = spark.createDataFrame([(k, 1) for k in range(300)] + [(1000, 0), (None, 1), (7, 1)], "doc_id long, quality int")
    docs = data.table(spark, good + symbols + shouting + echo)
    kept = {r["doc_id"]: r["kept"] for r in ngram_quality.classify(docs, labels).collect()}
    assert np.mean([kept[r[0]] for r in good[300:]]) > 0.97
    assert not any(kept[r[0]] for r in symbols + shouting + echo)
    assert {r["doc_id"] for r in ngram_quality.keep_good(docs, labels).select("doc_id").collect()} == {k for k, v in kept.items() if v}


def test_quality_on_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (5, 1), (16, 1), (99, 1)], "doc_id long, quality int")
    got = ngram_quality.classify(data.table(spark), labels).collect()
    assert len(got) == len(data.rows()) and all(r["kept"] for r in got if r["doc_id"] in (2, 3))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r["kept"] for r in ngram_quality.classify(data.table(spark), none).collect())
    assert ngram_quality.classify(data.table(spark, []), labels).count() == 0


def test_model_sums_to_one(spark):
    docs = spark.createDataFrame([(data.prose(k, 50),) for k in range(20)], "text string")
    common = docs.mapInPandas(ngram_quality._symbol_counts, "code int, n long").groupBy("code").sum("n").orderBy("code").collect()
    tables = [(a.toPandas(), b.toPandas()) for a, b in ngram_quality.train(docs, [int(c) for c, _ in common])]
    cost = ngram_quality.dense([(a["code"].to_numpy(), a["p"].to_numpy(np.float32), b["context"].to_numpy(), b["gamma"].to_numpy()) for a, b in tables], np.float32)
    total = np.exp(-cost).reshape(-1, ngram_quality.SYMBOLS).sum(axis=1)
    assert abs(total - 1).max() < 1e-3


def spelled(codes, table):
    """Symbols of code points, one at a time."""
    out = []
    for c in codes:
        c = int(c)
        out += [int(table[c])] if table[c] != ngram_quality.SPELLED else [57 + (c >> 12) % 7, (c >> 6) & 63, c & 63]
    return out


def slow_kneser_ney(texts, table):
    """-log p of a 4-gram by the textbook formulas, with dictionaries and recursion."""
    from collections import Counter, defaultdict

    counts = Counter()
    for t in texts:
        s = spelled(ngram_quality.marked_codes([t])[0], table)
        counts.update(tuple(s[k - 3 : k + 1]) for k in range(3, len(s)))
    orders = {4: counts}
    for k in (3, 2, 1):
        orders[k] = Counter(g[1:] for g in orders[k + 1])
    off, total, saved = {}, defaultdict(int), defaultdict(float)
    for k, of in orders.items():
        n = Counter(of.values())
        d = ngram_quality.discounts(*[n[i] for i in (1, 2, 3, 4)])
        for g, c in of.items():
            off[g] = min(d[min(c, 3) - 1], c)
            total[g[:-1]] += c
            saved[g[:-1]] += off[g]

    def p(g):
        below = p(g[1:]) if len(g) > 1 else 1 / ngram_quality.SYMBOLS
        context = g[:-1]
        if not total[context]:
            return below
        own = (orders[len(g)][g] - off[g]) / total[context] if g in off else 0.0
        return own + saved[context] / total[context] * below

    return p


def test_perplexity_by_brute_force(spark):
    """Every row's mean cost against a model of dictionaries over the whole of the same trusted texts."""
    rows = [(k, data.prose(k, 25 + k % 9) if k % 7 else "Ünïcödé " + data.prose(k, 5), "en", "a", 0, *[None] * 10) for k in range(60)] + [(100, "zzz qqq 漢字 ###", "en", "a", 0, *[None] * 10), (101, "the the the", "de", "a", 0, *[None] * 10)]
    trusted = [t for k, t, *_ in rows if k < 40]
    docs = spark.createDataFrame([(t,) for t in trusted], "text string")
    common = docs.mapInPandas(ngram_quality._symbol_counts, "code int, n long").groupBy("code").sum("n").collect()
    frequent = [int(c) for c, _ in sorted(common, key=lambda r: (-r[1], r[0]))]
    table = ngram_quality.alphabet_table(frequent[: ngram_quality.SYMBOLS])
    p = slow_kneser_ney(trusted, table)
    labels = spark.createDataFrame([(k, 1) for k in range(40)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in ngram_quality.classify(data.table(spark, rows), labels, prior=0).collect()}
    for k, t, *_ in rows:
        s = spelled(ngram_quality.marked_codes([t])[0], table)
        cost = [-np.log(p(tuple(s[j - 3 : j + 1]))) for j in range(3, len(s))]
        assert got[k]["n_symbols"] == len(cost)
        assert np.log(got[k]["perplexity"]) == pytest.approx(np.mean(cost), abs=1e-4)


def test_rare_scripts(spark):
    """Nine of ten trusted texts are Latin; junk in Chinese, Japanese and Cyrillic letters stands out all the same."""
    rng = random.Random(3)
    blocks = {"zh": (0x4E00, 0x9FA5), "ja": (0x3041, 0x3096), "ru": (0x430, 0x44F)}
    lexicon = {k: ["".join(chr(rng.randint(*b)) for _ in range(2 if k == "zh" else 4)) for _ in range(25)] for k, b in blocks.items()}
    made = lambda k, n: ("" if k != "ru" else " ").join(rng.choice(lexicon[k]) for _ in range(n))
    junk = lambda k, n: "".join(chr(rng.randint(*blocks[k])) for _ in range(n))
    rows = [(k, data.prose(k, 60), "en") for k in range(2700)]
    for j, lang in enumerate(blocks):
        rows += [(10_000 * (j + 1) + k, made(lang, 60), lang) for k in range(220)]
        rows += [(10_000 * (j + 1) + 5000 + k, junk(lang, 200), lang) for k in range(20)]
        rows += [(10_000 * (j + 1) + 6000 + k, chr(blocks[lang][0] + k) * 100, lang) for k in range(5)]
    docs = data.table(spark, [(k, t, lang, "a", len(t), *[None] * 10) for k, t, lang in rows])
    labels = spark.createDataFrame([(k, 1) for k, *_ in rows if k % 10_000 < 5000 and k % 10 != 7], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in ngram_quality.classify(docs, labels, min_trusted=150).collect()}
    for j in range(3):
        of = {k: v for k, v in kept.items() if k // 10_000 == j + 1}
        assert np.mean([v for k, v in of.items() if k % 10_000 < 5000]) > 0.97, j
        assert not any(v for k, v in of.items() if k % 10_000 >= 5000)
    table = ngram_quality.alphabet_table([ord(c) for c in "abc"])
    assert len({tuple(ngram_quality.symbols(np.array([c]), table)[0]) for c in range(0x4E00, 0x4E00 + 28_672)}) == 28_672


def test_marks():
    codes, doc = ngram_quality.marked_codes(["The the\nTHE cat cat cat", "", "cat"])
    S, R, U = ngram_quality.START, ngram_quality.REPEAT, ngram_quality.SHIFT
    c = lambda s: [ord(x) for x in s]
    assert codes.tolist() == [S] * 3 + [U, *c("the the\n"), U, ord("t"), U, ord("h"), U, *c("e cat"), R, R] + [S] * 6 + c("cat")
    assert doc.tolist() == [0] * 24 + [1] * 3 + [2] * 6 or (np.diff(doc) >= 0).all()


def slow_repeats(rows, length=50):
    """``(id, text bytes)`` in order -> bytes removed, runs, rest."""
    seen, out = {}, []
    for i, b in rows:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            seen[w] = min(seen.get(w, float("inf")), float("inf") if i is None else i)
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] < (float("inf") if i is None else i):
                gone[k : k + length] = b"\1" * length
        rest = bytes(x for x, y in zip(b, gone) if not y)
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1])), hashlib.sha256(rest).hexdigest()))
    return out


def _repeats(spark, rows):
    docs = data.table(spark, [(i, t, "en", "a", 0, *[None] * 10) for i, t in rows])
    got = suffixes.remove_repeats(docs, with_text=False).collect()
    want = slow_repeats([(i, (t or "").encode()) for i, t in rows])
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_repeats_on_awkward_rows(spark):
    _repeats(spark, [(i, t if t is None or len(t) < 50_000 else t[:20_000]) for i, t, *_ in data.rows()])
    assert suffixes.remove_repeats(data.table(spark, [])).count() == 0


def test_repeats_at_random(spark, monkeypatch):
    """Small alphabets, shared passages around the length of 50, several chunks."""
    monkeypatch.setattr(suffixes, "CHUNK", 3000)
    monkeypatch.setattr(suffixes, "BLOCK", 512)
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghij é"))
    shared = ["".join(rng.choice(letters, n)) for n in (48, 49, 50, 51, 60, 75, 120, 400)]
    rows = []
    for k in range(150):
        text = "".join(rng.choice(letters, int(rng.integers(0, 120))))
        for _ in range(int(rng.integers(0, 3))):
            cut = rng.choice(shared)
            a = int(rng.integers(0, 6))
            text += cut[a:] + "".join(rng.choice(letters, int(rng.integers(0, 30))))
        rows.append((int(rng.integers(0, 200)), text))
    rows += [(300, "ab" * 90), (301, "xx" + "ab" * 60), (302, "a" * 49)]
    _repeats(spark, rows)


def test_multikey_order(monkeypatch):
    words = np.random.default_rng(1).integers(0, 3, (500, 5)).astype(np.uint64)
    for short in (suffixes.SHORT, 4):
        monkeypatch.setattr(suffixes, "SHORT", short)
        order = suffixes.multikey_order(words)
        assert [tuple(r) for r in words[order]] == sorted(tuple(r) for r in words)


def test_runs_by_brute_force(spark, monkeypatch):
    """Runs of one byte and of short periods, alone and in a row, within and across documents, whole and cut into blocks."""
    rng = np.random.default_rng(9)
    pieces = ["a" * 400, "b" * 130, "ab" * 150, "abc" * 90, "a" * 79, "a" * 80, "a" * 81, " " * 300]
    rows = [(k, "".join(str(rng.choice(pieces)) + "xyz"[: rng.integers(0, 4)] for _ in range(rng.integers(1, 5)))) for k in range(60)]
    rows += [(100, "a" * 3000), (101, "a" * 3000), (50, "c" * 2500), (102, "c" * 2500 + "d"), (103, "a" * 49), (104, "b" + "a" * 500)]
    _repeats(spark, rows)
    monkeypatch.setattr(suffixes, "CHUNK", 4000)
    monkeypatch.setattr(suffixes, "BLOCK", 600)
    _repeats(spark, rows)


def test_hot_anchors_by_brute_force(spark, monkeypatch):
    """Passages in many documents, behind and before different texts, dealt out string by string; several ranges and chunks."""
    rng = np.random.default_rng(8)
    letters = np.array(list("abcd "))
    passages = ["".join(rng.choice(letters, n)) for n in (50, 55, 70, 200)]
    rows = []
    for k in range(160):
        text = "".join(rng.choice(letters, int(rng.integers(0, 70))))
        for _ in range(int(rng.integers(0, 3))):
            text += str(rng.choice(["", "x", ". ", "the same words before "])) + str(rng.choice(passages)) + "".join(rng.choice(letters, int(rng.integers(0, 40))))
        rows.append((int(rng.integers(0, 300)), text))
    for hot in (1, 4, 30):
        monkeypatch.setattr(suffixes, "HOT", hot)
        _repeats(spark, rows)
    monkeypatch.setattr(suffixes, "CHUNK", 2500)
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    for hot in (1, 6):
        monkeypatch.setattr(suffixes, "HOT", hot)
        _repeats(spark, rows)


def test_hot_anchors_are_spread():
    """A passage between a thousand different texts, and a thousand copies: the passage's ends go to many ranges, copies aren't hot."""
    rng = np.random.default_rng(4)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    words = lambda n: rng.choice(letters, n).tobytes()
    passage, copy = words(300), words(500)
    texts = [words(60) + passage + words(60) for _ in range(1000)] + [copy] * 1000
    chunk = suffixes.Chunk.read_bytes(suffixes.Chunk.pack(list(range(2000)), texts))
    place, h, _ = suffixes.anchors(chunk)
    own, times = suffixes.neighbourhoods(chunk, place, h)
    assert times.max() >= 900 and 2 <= (times >= 500).sum() <= 10
    of = [copy.count(t) for t in {chunk.data[p : p + 20].tobytes() for p, x in zip(place, h) if times[np.searchsorted(own, x)] >= 500}]
    assert not any(of)
    bits = lambda x: np.packbits(x).tobytes()
    splitters = np.unique(np.array([words(16) for _ in range(1500)], dtype="S16"))
    largest = {}
    for hot in (False, True):
        got = suffixes.Shared(chunk, [(0, bits(np.zeros(len(own), dtype=bool)), bits((times >= 500) & hot))], 1, splitters)
        largest[hot] = np.bincount(got.part).max()
    assert largest[False] >= 900 and largest[True] < largest[False] / 3


def test_kinds_are_told_apart_by_bytes(monkeypatch):
    rows = np.random.default_rng(2).integers(0, 3, (300, 4)).astype("<u8")
    want = len({tuple(r) for r in rows})
    for constant in (None, 0):  # a hash that says nothing
        if constant is not None:
            real = np.unique
            monkeypatch.setattr(suffixes.np, "unique", lambda x, **o: real(np.zeros_like(x) if x.dtype == np.uint64 else x, **o))
        first, kind = suffixes._kinds(rows)
        assert len(first) == want and (rows[first[kind]] == rows).all()


def test_a_long_run_takes_little_memory():
    """16 MB of one byte in two documents: the surroundings of its 16 million anchors are few."""
    import resource

    text = b"z" * 16_000_000
    chunk = suffixes.Chunk.read_bytes(suffixes.Chunk.pack([1, 2], [text, text[:1_000_000]]))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    place, h, length = suffixes.anchors(chunk)
    assert len(place) < 1000 and length.sum() > 16_000_000
    every = np.packbits(np.ones(len(np.unique(h)), dtype=bool)).tobytes()
    got = suffixes.Shared(chunk, [(0, every, every)], 1, np.zeros(0, dtype="S16"))
    low = suffixes.least_ids(got.around, got.before, got.after, got.least)
    assert low.min() == 1 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href="/x">Menu</a></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Big &amp; bold</h1><p>First <b>para</b>graph&nbsp;here.<br>Next line<p>Second <i>one</i> <!-- no --> stays<div class="share">Share</div><form><input><button>Go</button></form></article>
<section id="comments"><article class="comment">A reader says</article></section><footer>&copy; 2020</footer></body></html>"""


def test_page():
    assert html_text.Page(PAGE).text() == "Big & bold First paragraph here. Next line Second one stays"
    assert html_text.Page("no markup &lt;at&gt; all").text() == "no markup <at> all"
    wrapped = '<div class="page with-sidebar"><article><p>Inside</p><aside>no</aside></article><aside>Out</aside></div>'
    assert html_text.Page(wrapped).text() == "Inside"
    assert html_text.Page("<div id='x'><main><p>One</p></main><footer>Two</footer></div>").text() == "One"
    assert html_text.Page("<article><header>By me<h1>Title</h1></header><p>Text</p></article>").text() == "Title Text"
    for broken in ("<", "<p", "<p class=", '<p class="x', "<!-- open", "</p></p>", "<script>never closed", "<a href='x>y", "&#x;", "<p><b><p></b>text</p>"):
        html_text.Page(broken).text()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"<>/=\"' !-&;pabi", "<p>", "</p>", "<article>", "</article>", "<div class='ad'>", "</div>", "<br>", "text "]), max_size=60).map("".join))
def test_any_markup_is_read(page):
    text = html_text.Page(page).text()
    assert text == " ".join(text.split())


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_site_templates(spark, rows):
    """A box without a telling name recurs on a host's pages; the same words once elsewhere stay."""
    box = "<div><p>Follow us for more every day</p></div>"
    pages = [(k, f"https://one.example.com/{k}", f"<body>{box}<div><p>{data.prose(k, 30)}</p></div></body>") for k in range(12)]
    pages += [(50, "https://two.example.com/", f"<body>{box}<p>{data.prose(99, 30)}</p></body>"), (51, None, None), (None, "odd", ""), (5, *pages[5][1:])]
    got = html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), broadcast_rows=rows).collect()
    assert len(got) == len(pages)
    for r in got:
        if r["page_id"] is not None and r["page_id"] < 12:
            assert r["text"] == data.prose(r["page_id"], 30)
        elif r["page_id"] == 50:
            assert r["text"].startswith("Follow us")
        else:
            assert r["text"] == "" and r["n_chars"] == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_rare_symbols_cost_what_the_model_says():
    """Backing off three times from contexts that leave 1e-6 to what wasn't seen: far below 1e-12, and no less."""
    n, one = ngram_quality.SYMBOLS, lambda x, t: np.array([x], dtype=t)
    lower = [(one(0, int), one(1 - 1e-6, float), np.arange(n ** (k - 1)), np.full(n ** (k - 1), 1e-6)) for k in (1, 2, 3)]
    costs = ngram_quality.Costs(lower, [(np.arange(n**3), np.full(n**3, 1e-6), one(0, int), one(1 - 1e-6, float))])
    assert costs[one(5, int)][0] == pytest.approx(-np.log(1e-24 / n), rel=1e-6)
    assert costs[one(0, int)][0] == pytest.approx(1e-6, rel=0.1)
