"""Encoding of whole texts with a public tokenizer, a table of known pieces at a time.

A tokenizer first cuts a text into pieces (words, numbers, marks) and encodes
each by itself. Where a text has ASCII and Latin-1 letters only, that cut
depends on the classes of neighbouring characters, so it is made for a whole
block of texts at once, with NumPy. Pieces recur: the library encodes each of
them once, and its ids go to one flat array. A piece of up to 16 bytes is found
by its own bytes in an open-addressing table (never by a hash alone), so a block
of texts becomes ids by two gathers.

Between two ASCII letters a blank always begins a piece. So long texts are cut
there, and what has any other character, or the marks of a special token, goes
to the library from one such blank to the next. A file whose patterns aren't the
known ones is used without cutting.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import held

#: Known pieces, and ids of theirs, beyond which a worker process begins anew.
PIECES, POOL = 1 << 20, 1 << 23
#: Pieces longer than this aren't kept.
KEPT = 64
#: Characters that are cut at a time, and the pieces that the library gets in one text.
BLOCK, JOINED = 250_000, 64

_L = "A-Za-zÀ-ÖØ-öø-ÿ"
#: What the cuts below aren't proved for; the first two code points are marks of a block.
_ODD = re.compile(rf"[^\x02-\x1b\x20-\x7f{_L}]|<\|")
_UNIT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
#: The known patterns, word for word.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_MARK, _SPACE, _BLANK, _LETTER, _DIGIT, _OTHER, _NONE = range(7)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def _classes() -> np.ndarray:
    out = np.full(256, _NONE, dtype=np.uint8)
    for code in range(256):
        c = chr(code)
        if code < 2:
            out[code] = _MARK
        elif not _ODD.match(c):
            out[code] = _BLANK if c == " " else _SPACE if c in "\t\n\x0b\x0c\r" else _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _OTHER
    return out


_CLASS = _classes()
_SAFE = bytes(c for c in range(256) if c == 0 or _CLASS[c] not in (_MARK, _NONE))
_LOWER = np.array([ord(chr(c).lower()) if _CLASS[c] == _LETTER else c for c in range(256)], dtype=np.uint8)


def _known(path: str) -> str | None:
    """Which of the two ways of cutting below a file's own one is."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    cut, form = spec["pre_tokenizer"] or {}, spec["normalizer"]
    if form is None and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]:
        return "bytes"
    parts = [p["type"] for p in cut.get("pretokenizers", [])]
    if parts == ["Split", "ByteLevel"] and [n["type"] for n in (form or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
        if cut["pretokenizers"][0]["pattern"].get("Regex") == _WORDS and spec["model"].get("end_of_word_suffix") == "</w>":
            return "words"
    return None


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _latin(text: str) -> bytes | None:
    """Latin-1 bytes of a text without anything odd; byte 0, a mark, is let through."""
    if "<|" in text:
        return None
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if raw.translate(None, _SAFE) else raw


def _contractions(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Apostrophes that begin 's, 't, 'm, 'd, 're, 've or 'll, and the lengths of these."""
    at = np.flatnonzero(data == 39)
    at = at[first[at]]
    a, b = data[at + 1], data[at + 2]
    two = np.isin(a, np.frombuffer(b"stmd", np.uint8))
    three = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
    return at[two | three], np.where(two, 2, 3)[two | three]


def _cut_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = _CLASS[data]
    piece, single, change = c >= _LETTER, c == _DIGIT, np.empty(len(c) + 1, dtype=bool)
    change[0] = change[-1] = True
    np.not_equal(c[1:], c[:-1], out=change[1:-1])
    first, last = piece & (change[:-1] | single), piece & (change[1:] | single)
    at, size = _contractions(data, first)
    end = at + size - 1
    last[at] = first[at + 1] = False
    last[end] = True
    first[end + 1] |= c[end + 1] == _LETTER
    mark = c == _MARK
    starts = np.flatnonzero(first | mark)
    return starts, np.flatnonzero(last | mark) + 1 - starts


def _cut_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = _CLASS[data]
    space, change = (c == _SPACE) | (c == _BLANK), np.empty(len(c), dtype=bool)
    change[0] = True
    np.not_equal(c[1:], c[:-1], out=change[1:])
    first = (c >= _LETTER) & change
    first[1:] &= c[:-1] != _BLANK
    first[1:] |= space[1:] & ~space[:-1]
    first[1:-1] |= space[1:-1] & space[:-2] & (c[2:] >= _LETTER)
    at, size = _contractions(data, first & (c == _OTHER))
    first[at + 1] = False
    first[at + size] |= c[at + size] == _LETTER
    starts = np.flatnonzero(first | (c == _MARK))
    return starts, np.diff(starts, append=len(data))


class Pieces:
    """Exact table from pieces of 1 to 16 bytes (two words, no zero bytes) to entries of a flat array."""

    def __init__(self, dtype: str):
        self.pool, self.used = np.zeros(1 << 16, dtype=dtype), 0
        self.offset, self.count, self.n = np.zeros(1 << 14, dtype=np.int32), np.zeros(1 << 14, dtype=np.int32), 0
        self.known: dict[str, int] = {}
        self._resize(16)

    def _resize(self, bits: int) -> None:
        old = (self.low, self.high, self.entry) if bits > 16 else None
        self.bits, size = bits, 1 << bits
        self.low, self.high, self.entry = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.uint64), np.full(size, -1, dtype=np.int32)
        if old:
            at = np.flatnonzero(old[2] >= 0)
            self._place(old[0][at], old[1][at], old[2][at])

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (low ^ (high * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _place(self, low: np.ndarray, high: np.ndarray, entry: np.ndarray) -> None:
        at = self._slots(low, high)
        while len(at):
            free = np.flatnonzero(self.entry[at] < 0)
            self.entry[at[free]] = entry[free]
            won = self.entry[at] == entry
            self.low[at[won]], self.high[at[won]] = low[won], high[won]
            lost = ~won
            low, high, entry, at = low[lost], high[lost], entry[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The entry of each piece, -1 if unknown."""
        at = self._slots(low, high)
        out = self.entry[at]
        todo = np.flatnonzero((out >= 0) & ((self.low[at] != low) | (self.high[at] != high)))
        at = at[todo]
        while len(todo):
            at = (at + 1) & ((1 << self.bits) - 1)
            found = self.entry[at]
            out[todo] = found
            more = (found >= 0) & ((self.low[at] != low[todo]) | (self.high[at] != high[todo]))
            todo, at = todo[more], at[more]
        return out

    def add(self, ids: list[np.ndarray] | tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """New entries for the ids of pieces, given as lists or as all ids and the counts."""
        flat, count = ids if isinstance(ids, tuple) else (np.concatenate(ids) if ids else np.zeros(0, self.pool.dtype), np.array([len(x) for x in ids], dtype=np.int64))
        for name, need in (("offset", self.n + len(count)), ("count", self.n + len(count)), ("pool", self.used + len(flat))):
            now = getattr(self, name)
            if need > len(now):
                setattr(self, name, np.concatenate([now, np.zeros(max(need - len(now), len(now)), dtype=now.dtype)]))
        new = np.arange(self.n, self.n + len(count), dtype=np.int32)
        self.offset[new], self.count[new] = self.used + np.cumsum(count) - count, count
        self.pool[self.used : self.used + len(flat)] = flat
        self.n, self.used = self.n + len(count), self.used + len(flat)
        return new

    def insert(self, low: np.ndarray, high: np.ndarray, entry: np.ndarray) -> None:
        while 2 * self.n > 1 << self.bits:
            self._resize(self.bits + 1)
        self._place(low, high, entry)


class Encoder:
    """``encode(texts)`` -> all ids in a row, and how many each text has, ``end_id`` (if any) included."""

    def __init__(self, path: str, end_id: int | None = None, dtype: str = "<u2"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.dtype, self.way = Tokenizer.from_file(path), end_id, dtype, _known(path)
        vocabulary_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        if max(vocabulary_size - 1, end_id or 0) > np.iinfo(dtype).max:
            raise ValueError(f"ids of {path} don't fit in {dtype}")
        self.cut = {"words": _cut_words, "bytes": _cut_bytes, None: None}[self.way]
        if self.way == "words":
            self.ends = np.zeros(vocabulary_size, dtype=bool)
            for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items():
                self.ends[k] = token.endswith("</w>")
        elif self.way == "bytes":
            self.line = int(self._library(["\n"])[0][0])
        self._begin()

    def _begin(self) -> None:
        self.pieces = Pieces(self.dtype)
        self.end = self.pieces.add([np.array([] if self.end_id is None else [self.end_id], dtype=self.dtype)])[0]

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the count of each piece; a line's end keeps pieces without white space at their ends apart."""
        got = self._library(["\n".join(pieces[k : k + JOINED]) for k in range(0, len(pieces), JOINED)])
        flat = np.concatenate([*got, np.zeros(0, dtype=self.dtype)])
        if self.way == "words":
            count = np.diff(np.flatnonzero(self.ends[flat]), prepend=-1)
        else:
            lines = np.insert(flat, np.cumsum([len(x) for x in got], dtype=np.int64), self.line)  # an end of the line after each text as well
            count = np.diff(np.flatnonzero(lines == self.line), prepend=-1) - 1
            flat = flat[flat != self.line]
        if len(count) == len(pieces) and count.sum() == len(flat):
            return flat, count
        own = self._library(pieces)
        return np.concatenate([*own, np.zeros(0, dtype=self.dtype)]), np.array([len(x) for x in own], dtype=np.int64)

    def _units(self, part: str) -> tuple[str, list[str]]:
        """``part`` with a mark for each unit that has something odd, and these units."""
        out, odd = [], []
        for unit in _UNIT.split(part):
            if _ODD.search(unit):
                odd.append(unit)
                unit = "\x01"
            out.append(unit)
        return "".join(out), odd

    def _parts(self, texts: list[str]):
        """Lists of ``(text number, part of it, is it the last)`` of about ``BLOCK`` characters."""
        out, size = [], 0
        for k, t in enumerate(texts):
            while len(t) > BLOCK:
                cuts = [m.start() for m in _UNIT.finditer(t, BLOCK - 4096, BLOCK)][-1:] or [m.start() for m in [_UNIT.search(t, BLOCK)] if m]
                if not cuts:
                    break
                if out:
                    yield out
                yield [(k, t[: cuts[0]], False)]
                t, out, size = t[cuts[0] :], [], 0
            if out and size + len(t) > BLOCK:
                yield out
                out, size = [], 0
            out.append((k, t, True))
            size += len(t)
        if out:
            yield out

    def _kept(self, texts: list[str]) -> np.ndarray:
        """Entries of texts that go to the library one by one."""
        known, new = self.pieces.known, {}
        for t in texts:
            if t not in known:
                new.setdefault(t, len(new))
        entry = self.pieces.add(self._library(list(new)))
        out = np.array([known[t] if t in known else entry[new[t]] for t in texts], dtype=np.int32)
        known.update((t, int(entry[k])) for t, k in new.items() if len(t) <= KEPT)
        return out

    def _block(self, parts) -> tuple[np.ndarray, np.ndarray]:
        if self.pieces.n > PIECES or self.pieces.used > POOL:
            self._begin()
        marked, odd = [t for _, t, _ in parts], []
        raw = _latin("".join(t + "\x00" * last for _, t, last in parts))
        if raw is None or raw.count(0) != sum(last for *_, last in parts):
            for k, t in enumerate(marked):
                if _ODD.search(t):
                    marked[k], units = self._units(t)
                    odd += units
            raw = "".join(t + "\x00" * last for t, (_, _, last) in zip(marked, parts, strict=True)).encode("latin-1")
        # a mark before and 25 zero bytes after, so that neighbours and words exist everywhere
        n, data = len(raw) + 2, np.frombuffer(b"".join([b"\x00", raw, bytes(25)]), dtype=np.uint8)
        if self.way == "words":
            data = _LOWER[data]
        starts, size = self.cut(data[: n + 2])
        a, b = np.searchsorted(starts, [1, n - 1])
        starts, size = starts[a:b], size[a:b]
        words = np.ndarray((n + 16,), "<u8", data, 0, (1,))
        low = words[starts] & _MASK[np.minimum(size, 8)]
        high = words[starts + 8] & _MASK[np.clip(size - 8, 0, 8)]
        entry = self.pieces.find(low, high)
        head = data[starts]
        mark, long = head < 2, size > 16
        text = data[:n].tobytes().decode("latin-1")
        miss = np.flatnonzero((entry < 0) & ~mark & ~long)
        if len(miss):
            order = miss[np.lexsort((high[miss], low[miss]))]
            one = order[np.concatenate([[True], (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])])]
            kind = _CLASS[data[starts[one] + size[one] - 1]]
            white = (kind == _SPACE) | (kind == _BLANK)
            one, white = np.concatenate([one[~white], one[white]]), int(white.sum())
            new = [text[s:e] for s, e in zip(starts[one].tolist(), (starts[one] + size[one]).tolist(), strict=True)]
            new = np.concatenate([self.pieces.add(self._encode_pieces(new[: len(new) - white])), self.pieces.add(self._library(new[len(new) - white :]))])
            self.pieces.insert(low[one], high[one], new)
            entry[miss] = self.pieces.find(low[miss], high[miss])
        long = np.flatnonzero(long)
        if len(long):
            entry[long] = self._kept([text[s:e] for s, e in zip(starts[long].tolist(), (starts[long] + size[long]).tolist(), strict=True)])
        entry[mark] = self.end
        if odd:
            entry[np.flatnonzero(head == 1)] = self._kept(odd)
        count = self.pieces.count[entry]
        upto = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        at = np.repeat(self.pieces.offset[entry] - upto[:-1], count)
        at += np.arange(upto[-1])
        bounds = 1 + np.concatenate([[0], np.cumsum([len(t) + last for t, (_, _, last) in zip(marked, parts, strict=True)])])
        return self.pieces.pool[at], np.diff(upto[np.searchsorted(starts, bounds)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths, out = np.zeros(len(texts), dtype=np.int64), []
        if self.cut is None:
            end = np.array([] if self.end_id is None else [self.end_id], dtype=self.dtype)
            for k, ids in enumerate(self._library(texts)):
                out += [ids, end]
                lengths[k] = len(ids) + len(end)
        else:
            for parts in self._parts(texts):
                ids, n = self._block(parts)
                out.append(ids)
                np.add.at(lengths, [k for k, *_ in parts], n)
        return np.concatenate(out) if out else np.zeros(0, dtype=self.dtype), lengths


def encoder(path: str, end_id: int | None = None, dtype: str = "<u2") -> Encoder:
    """The worker process's encoder; its pieces outlive a task."""
    return held(("encoder", path, end_id, dtype), lambda: Encoder(path, end_id, dtype))


def blocks(texts: list[str], most: int = 1_000_000):
    """Ranges of rows of about ``most`` characters."""
    start = size = 0
    for k, t in enumerate(texts):
        if k > start and size + len(t) > most:
            yield start, k
            start, size = k, 0
        size += len(t)
    if texts:
        yield start, len(texts)
