"""Token files and packing: exact round trips."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import packing, token_store, tokens

from . import data

WORDS, BYTES = tokens.vocabulary("word_bpe_49k.json"), tokens.vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoders():
    return {p: tokens.Encoder(p) for p in (WORDS, BYTES)}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,!sSdDtTrRvVeEmMlL19ßéÉÀ×÷<|>_-"), st.characters(max_codepoint=0x2FF))))
def test_pieces_give_the_library_ids(text):
    for path in (WORDS, BYTES):
        codec = tokens.encoder(path)
        want = codec.tokenizer.encode(text, add_special_tokens=False).ids
        assert codec.encode([text])[0].tolist() == want


def _same(codec, texts):
    want = [e.ids + [] if codec.end_id is None else [*e.ids, codec.end_id] for e in codec.tokenizer.encode_batch(texts, add_special_tokens=False)]
    ids, lengths = codec.encode(texts)
    ends = np.cumsum(lengths)
    assert [ids[a:b].tolist() for a, b in zip(ends - lengths, ends)] == want and len(ids) == lengths.sum()


def test_encoder_on_awkward_texts(encoders):
    texts = [t or "" for _, t, *_ in data.rows()]
    for path, codec in encoders.items():
        _same(codec, texts)
        _same(tokens.Encoder(path, 2), texts)
        _same(codec, [])


def test_encoder_cuts_long_and_odd_texts(monkeypatch):
    """Small blocks, a table that begins anew, marks and odd letters in the midst."""
    monkeypatch.setattr(tokens, "BLOCK", 5000)
    monkeypatch.setattr(tokens, "PIECES", 300)
    odd = ["\x00", "\x01x", "don\u2019t", " \u6f22\u5b57 ", "e\u0301", "\u00a0", "<|endoftext|>", "a<|b", "\x1c", "\U0001f600", "1\u00b2"]
    rng = np.random.default_rng(3)
    texts = []
    for k in range(12):
        words = data.prose(k, 3000).split(" ")
        for at in rng.integers(0, len(words), 40 * (k % 3)):
            words[at] += str(rng.choice(odd))
        texts.append(" ".join(words))
    texts += ["x" * 20_000, " " * 12_000, "a b " * 4000, "it's 'S 'tis we'll''ve l'll 'd's 12's .'s \n's  't\t'm", "", "\x00\x01", "\u6f22" * 6000]
    for path in (WORDS, BYTES):
        codec = tokens.Encoder(path, 3)
        _same(codec, texts)
        _same(codec, texts[::-1])


def test_table_of_pieces():
    table, rng = tokens.Pieces("<u2"), np.random.default_rng(5)
    low = rng.integers(1, 1 << 63, 60_000).astype(np.uint64)
    high = np.where(rng.random(60_000) < 0.5, 0, rng.integers(1, 50, 60_000)).astype(np.uint64)
    for a in range(0, 60_000, 7000):
        new = table.add([np.array([k & 0xFFFF, 1], dtype="<u2") for k in range(a, min(a + 7000, 60_000))])
        table.insert(low[a : a + 7000], high[a : a + 7000], new)
    assert (table.find(low, high) == np.arange(60_000)).all()
    assert (table.find(low, high + np.uint64(100)) == -1).all()
    assert (table.pool[table.offset[: table.n]] == np.arange(60_000) % 65536).all()


@pytest.mark.parametrize("n,universe", [(0, 1), (1, 1), (1, 10**12), (1000, 1001), (5000, 10**9), (3000, 2000), (10, 2**62)])
def test_elias_fano(n, universe):
    values = np.sort(np.random.default_rng(1).integers(0, universe, n))
    coded = token_store.EliasFano.build(values, universe)
    assert (coded.window(0, n) == values).all()
    for a, b in np.sort(np.random.default_rng(2).integers(0, n + 1, (30, 2)), axis=1):
        assert (coded.window(a, b) == values[a:b]).all()
    assert [coded.select(k) for k in range(n)] == values.tolist()
    with pytest.raises(IndexError):
        coded.select(n)


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(2).integers(1, 3000, 20_000))
    coded = token_store.EliasFano.build(values, int(values[-1]) + 1)
    assert 64 * sum(map(len, coded.arrays)) < 20_000 * (2.2 + np.log2(values[-1] / 20_000) + 1)


def test_shard():
    ids, sizes = [None, -5, -5, 7], [3, 1, 2, 4]
    shard = token_store.Shard(token_store.Shard.build(ids, sizes, np.arange(10, dtype="<u2").tobytes(), 2))
    assert shard.documents_ids(0, 4) == ids and shard.documents_ids(1, 3) == ids[1:3] and shard.documents_ids(0, 1) == [None]
    assert [shard.ids(k).tolist() for k in range(4)] == [[0, 1, 2], [3], [4, 5], [6, 7, 8, 9]]


def test_store(spark, encoders):
    folder, manifest = token_store.write(data.table(spark), WORDS, 2)
    got = token_store.read(folder, manifest).collect()
    rows, at, seen = sorted(data.rows(), key=lambda r: (r[0] is not None, r[0] or 0)), 0, []
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(encoders[WORDS].tokenizer.encode(t or "", add_special_tokens=False).ids + [2])
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in [(len(x), crc(x)) for x in texts[r["doc_id"]]]
        at += r["n_tokens"]
        seen.append(r["doc_id"])
    assert seen == [r[0] for r in rows]
    folder, manifest = token_store.write(data.table(spark, []), WORDS, 2)
    assert token_store.read(folder, manifest).count() == 0


def test_small_shards_keep_order(spark, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_IDS", 50)
    folder, manifest = token_store.write(data.table(spark), WORDS, 2)
    got = sorted(token_store.read(folder, manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in data.rows()), key=lambda x: (x is not None, x or 0))
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]


def test_hilbert_is_a_walk():
    bits = 3
    side = np.arange(1 << bits)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = packing.hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(8**bits))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def _check_pieces(got, texts):
    docs, sequences = {}, {}
    for r in got:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and at & (at - 1) == 0
    for i, ids in texts.items():
        pieces = sorted({(r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in docs[i]})
        at = 0
        for start, length, crc, total in pieces:
            assert start == at and total == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)


def test_pack(spark, encoders):
    rows = [(k, r[1], *r[2:]) for k, r in enumerate(data.rows())]
    texts = {k: encoders[BYTES].tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for k, t, *_ in rows}
    _check_pieces(packing.pack(data.table(spark, rows), BYTES).collect(), texts)


def test_neighbours_on_the_curve_share_sequences(spark):
    """Documents of two kinds: most sequences hold one kind only, though ids alternate."""
    rows = [(k, ("alpha beta gamma delta " if k % 2 else "one two three four ") * (20 + k % 7), "en", "a", 0, *[None] * 10) for k in range(200)]
    kinds = {}
    for r in packing.pack(data.table(spark, rows), BYTES).collect():
        kinds.setdefault(r["sequence_id"], set()).add(r["doc_id"] % 2)
    assert len(kinds) > 10 and sum(len(k) == 2 for k in kinds.values()) <= 2


def test_keys_don_t_depend_on_the_block():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 400, 1200)
    ids = rng.integers(0, 50_000, lengths.sum()).astype("<u2")
    ends = np.cumsum(lengths)
    whole = packing.curve_keys(ids, lengths)
    alone = [packing.curve_keys(ids[e - n : e], np.array([n]))[0] for n, e in zip(lengths, ends)]
    assert whole.tolist() == alone


def test_many_rows_with_one_id(spark):
    rows = [(None if k % 3 else 5, data.prose(k, 40), "en", "a", 0, *[None] * 10) for k in range(300)]
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # small tables come in one range otherwise
    spark.conf.set(key, "false")
    try:
        folder, manifest = token_store.write(data.table(spark, rows), WORDS, 2)
        got = token_store.read(folder, manifest).collect()
    finally:
        spark.conf.unset(key)
    assert len(got) == 300 and manifest.count() > 1
    at = 0
    for k, r in enumerate(sorted(got, key=lambda r: r["start"])):
        assert r["start"] == at and r["doc_id"] == (None if k < 200 else 5)
        at += r["n_tokens"]


def test_pack_counts_repeats_and_null_ids(spark, encoders):
    got = packing.pack(data.table(spark), BYTES).collect()
    want = sum(len(encoders[BYTES].tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in data.rows())
    assert sum(r["length"] for r in got) == want
    assert packing.pack(data.table(spark, []), BYTES).count() == 0
    with pytest.raises(ValueError):
        packing.pack(data.table(spark), BYTES, length=1000)


def test_a_store_outlives_the_process_that_wrote_it(spark, tmp_path):
    """Another process writes into a folder of its caller's and ends; an unfinished store is an error."""
    import subprocess
    import sys

    folder = f"file://{tmp_path}/store"
    code = f"""
import sys
sys.path[:0] = {sys.path!r}
from pyspark.sql import SparkSession
from plumbline.llm import token_store
from tests.llm import data
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
token_store.write(data.table(spark), {WORDS!r}, 2, {folder!r})
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300)
    got = sorted(map(tuple, token_store.read(folder, token_store.open_store(spark, folder)).collect()), key=lambda r: r[1])
    here, manifest = token_store.write(data.table(spark), WORDS, 2)
    assert got == sorted(map(tuple, token_store.read(here, manifest).collect()), key=lambda r: r[1]) and got
    with pytest.raises(Exception):
        token_store.open_store(spark, f"file://{tmp_path}/none")
