"""Weak supervision: planted cases of both kinds, and every span against plain Python."""

from collections import Counter

import pandas as pd

from plumbline.llm import pii

from . import data

REST = [None] * 10
PHONES = {"en": "please call my phone", "de": "Anruf unter der Rufnummer", "fr": "mon téléphone portable est le", "es": "llamar al teléfono"}


def planted():
    """Texts with loose personal data, and texts with what only looks like it."""
    good, bad = [], []
    for k in range(60):
        lang = list(PHONES)[k % 4]
        good.append((k, f"{data.prose(k, 8)} {PHONES[lang]} (0{30 + k}) {555 + k} {1000 + 7 * k} {data.prose(k + 500, 5)}", "phone_local"))
        good.append((100 + k, f"{data.prose(k, 8)} write to my mail anna{k} (at) host{k}.example (dot) com {data.prose(k, 5)}", "email_masked"))
        bad.append((200 + k, f"{data.prose(k, 8)} on {2000 + k % 20}-{10 + k % 3}-{11 + k % 17} version 10.{20 + k}.{300 + k} {data.prose(k, 5)}"))
        bad.append((300 + k, f"{data.prose(k, 8)} we looked at example.com and id {7000000000000001 + 10 * k * k} order {4000 + k} {1990 + k % 9} {data.prose(k, 5)}"))
        bad.append((400 + k, f'{data.prose(k, 8)} token = "9b0b3c6a{10**12 + k * 977}aa99c524f37a8" 999.{300 + k}.1.1'))
    return good, bad


def table(spark):
    good, bad = planted()
    return data.table(spark, [(k, t, "en", "a", 0, *REST) for k, t, *_ in good + bad])


def test_planted_cases(spark):
    good, bad = planted()
    got = {r["doc_id"]: r["spans"] for r in pii.find(table(spark)).collect()}
    assert sum(kind in got[k] for k, _, kind in good) >= 0.95 * len(good)
    assert sum(any(kind in got[k] for kind in pii.MORE) for k, _ in bad) <= 0.02 * len(bad)


def test_labelers_disagree(spark):
    """No labeler has one vote only, and loose candidates are rejected as well as accepted."""
    found = pii.report(table(spark))
    for name in pii.LABELERS:
        total = [sum(v[j] for v in found[name]) for j in range(3)]
        assert sum(x > 0 for x in total) >= 2, name
    loose = found[found["kind"].isin(pii.MORE)]
    assert 0 < loose["accepted"].sum() < loose["candidates"].sum()


def test_spans_by_plain_python(spark):
    """All spans of all rows from one loop over the texts."""
    rows = [(r["doc_id"], r["text"]) for r in table(spark).collect()] + [(r[0], r[1]) for r in data.rows()]
    counts = Counter()
    for _, t in rows:
        for k, _, _, _, v, f in pii.judged(t or ""):
            counts[k, v, f] += 1
    weights = pii.train(pd.DataFrame([(*k, n) for k, n in sorted(counts.items())], columns=["kind", "votes", "features", "n"]))
    want = Counter()
    for i, t in rows:
        found = pii.judged(t or "")
        spans = sorted((s, k, e) for k, s, e, base, *_ in found if base)
        scored = [(float((pii._design(pd.Series([k]).to_numpy(), pd.Series([f]).to_numpy()) @ weights)[0]), k, s, e) for k, s, e, base, _, f in found if not base]
        for value, k, s, e in sorted(scored, key=lambda x: (-x[0], x[2], x[1])):
            if value > 0 and not any(a < e and s < b for a, _, b in spans):
                spans.append((s, k, e))
        want[i, ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))] += 1
    docs = table(spark).union(data.table(spark))
    assert Counter((r["doc_id"], r["spans"]) for r in pii.find(docs).collect()) == want


def test_context_in_four_languages():
    near = lambda t, s: pii.votes(t, pii.KINDS.index("phone_local"), t.index(s), t.index(s) + len(s), False)[3]
    for words in PHONES.values():
        assert near(f"{words} 030 555 1234 bitte", "030 555 1234") == 1
    assert near("Bestellung 030 555 1234", "030 555 1234") == 0 and near("und 030 555 1234", "030 555 1234") == 2
    assert near("shipping 030 555 1234", "030 555 1234") == 2  # "ip" within a word says nothing


def test_gazetteer_is_a_parameter(spark):
    t = "signed by Dr. Zorblax Quimby today"
    at = pii.judged(t, frozenset(["zorblax"]))[0]
    assert pii.KINDS[at[0]] == "name" and pii._unpack(pd.Series([at[4]]).to_numpy())[0][2] == 1
    assert pii._unpack(pd.Series([pii.judged(t)[0][4]]).to_numpy())[0][2] == 2
