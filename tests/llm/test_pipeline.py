"""Every stage of the pipeline against plain Python on the rows that it is given."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd

import corpus_pipeline
from plumbline.llm import ngram_quality, pii, tokens
from tests.llm import test_near_copies, test_texts
from tests.llm.test_counts import WORD, slow_targets

from . import data

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng, rows = random.Random(11), []
    for k in range(60):
        rows.append((k, data.prose(k, 60), rng.choice(["a", "a", "b", None])))
    for k in range(8):
        rows.append((100 + k, " ".join(w + "###" for w in data.prose(k, 60).split()), "a"))  # junk
        rows.append((200 + k, data.prose(k, 60), "b"))  # copies
        words = data.prose(k + 20, 60).split()
        rows.append((300 + k, " ".join([*words[:59], "stone"]), "c"))  # near copies
        rows.append((400 + k, f"{data.prose(k + 40, 40)} write to some.one{k}@mail.example.com or call +1 (523) 555-66{k}8 {data.prose(k + 90, 30)}", "c"))
    rows += [(500, None, "a"), (501, "", None)]
    return [(k, t, "en", s, None if t is None else len(t)) for k, t, s in rows]


def ordered(values, q):
    """The value of rank ``ceil(q * n)``, as the engine's percentiles are on few rows."""
    return sorted(values)[max(0, math.ceil(q * len(values)) - 1)]


def slow_quality(rows, trusted):
    texts = [t or "" for k, t, *_ in rows if k in trusted]
    seen = Counter(c for t in texts for c in ngram_quality.marked_codes([t])[0].tolist() if c != ngram_quality.START)
    table = ngram_quality.alphabet_table([c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))][: ngram_quality.SYMBOLS])
    p = test_texts.slow_kneser_ney(texts, table)
    cost = {}
    for k, t, *_ in rows:
        s = test_texts.spelled(ngram_quality.marked_codes([t or ""])[0], table)
        cost[k] = (sum(-math.log(p(tuple(s[j - 3 : j + 1]))) for j in range(3, len(s))), len(s) - 3)
    good = [cost[k] for k in cost if k in trusted and cost[k][1]]
    middle = ordered([c / n for c, n in good], 0.5)
    mean = lambda c, n: (c + 50 * middle) / (n + 50)
    limit = ordered([mean(*x) for x in good], 0.999) * 1.05
    return {k for k in cost if mean(*cost[k]) <= limit}


def slow_redacted(rows):
    counts = Counter((k, v, f) for _, t, *_ in rows for k, _, _, _, v, f in pii.judged(t or ""))
    weights = pii.train(pd.DataFrame([(*k, n) for k, n in sorted(counts.items())], columns=["kind", "votes", "features", "n"]))
    out = []
    for k, t, lang, source, _ in rows:
        found = pii.judged(t or "")
        for s, kind, e in reversed(pii.choose(*zip(*[(f[0], f[1], f[2], f[3], f[5]) for f in found]), weights) if found else []):
            t = t[:s] + f"<{pii.KINDS[kind]}>" + t[e:]
        out.append((k, t, lang, source, None if t is None else len(t)))
    return out


def slow_mix(rows):
    size, sizes, taken = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}, defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += size[r[0]]
    target, copies = slow_targets({s: n for s, n in sizes.items() if n}), {}
    for r in sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()[:15]):
        s = r[3]
        if not size[r[0]]:
            copies[r[0]] = 1
            continue
        whole = math.floor(target[s] / sizes[s])
        taken[s] += size[r[0]]
        copies[r[0]] = whole + (taken[s] <= target[s] - whole * sizes[s])
    return [r for r in rows for _ in range(copies[r[0]])]


def test_stages_by_brute_force(spark, tmp_path):
    rows, trusted = documents(), {*range(0, 60, 2), *range(400, 408, 2)}
    spark.createDataFrame([(k, 1) for k in trusted] + [(100, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, COLUMNS)
    stages = dict(corpus_pipeline.STAGES)

    def after(name, docs, want):
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = sorted(map(tuple, out.collect()), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))
        assert got == sorted(want, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r)), name
        return spark.createDataFrame(want, COLUMNS)

    kept = slow_quality(rows, trusted)
    assert not kept & set(range(100, 108)) and len(kept & set(range(60))) >= 50
    rows = [r for r in rows if r[0] in kept]
    docs = after("quality", docs, rows)

    roots = test_near_copies.brute([r[1] or "" for r in rows])
    groups = defaultdict(list)
    for r, root in zip(rows, roots):
        groups[root].append(r)
    rows = [min(g, key=lambda r: r[0]) for g in groups.values()]
    assert not {200, 201, 300, 301} & {r[0] for r in rows}
    docs = after("near_duplicates", docs, rows)

    rows = slow_redacted(rows)
    assert sum("<email>" in (r[1] or "") and "<phone>" in r[1] for r in rows) >= 6
    docs = after("personal_data", docs, rows)

    rows = slow_mix(rows)
    docs = after("mix", docs, rows)

    codec = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json")).tokenizer
    want = Counter()
    for r in rows:
        ids = np.array(codec.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        want[r[0], len(ids)] += len(ids)
    pieces, sequences = Counter(), defaultdict(list)
    ids_of = {r[0]: np.array(codec.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4") for r in rows}
    for p in stages["pack"](spark, docs, str(tmp_path)).collect():
        pieces[p["doc_id"], p["doc_tokens"]] += p["length"]
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        assert p["ids_crc32"] == zlib.crc32(ids_of[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes())
    assert pieces == want
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024 and not ends[-1] & (ends[-1] - 1)
