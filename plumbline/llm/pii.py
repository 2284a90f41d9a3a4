"""Personal data by weak supervision.

Candidates are the matches of strict patterns (e-mail, IP address, card, phone),
those of them that fail their test (``card_like``, ...), and the matches of loose
patterns: groups of digits, addresses with "at" and "dot", IBANs, social security
numbers, titled names. Loose ones match a lot that is no personal data, such as
dates, versions, ids and plain prose. Five labelers vote on each candidate, for,
against or not at all: two on the form, a gazetteer, the words around (of four
languages, for and against), and the characters next to it. Counts of vote
patterns over all documents go through expectation-maximisation, which estimates
for each family of kinds how reliable each labeler is, and gives every pattern a
probability. These train the final classifier, a logistic regression on form and
context. Strict matches always stay; others are added if the classifier finds
them likelier than not and they overlap no span before them.

Only counts by kind, votes and features reach the driver; there are at most
``12 * 3**5 * 3456`` different ones whatever the corpus.

Defined results: a null or empty text has no spans; a table without candidates
has a classifier that adds nothing; repeated rows have the same spans; null ids
are carried along. Patterns run in time linear in the text.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, release

BASE = ("email", "ip", "card", "phone")
MORE = ("phone_local", "email_masked", "iban", "ssn", "name", "card_like", "ip_like", "phone_like")
KINDS = BASE + MORE
#: Kinds whose labelers are judged together.
FAMILY = {"email_masked": "email", "phone_local": "phone", "phone_like": "phone", "card_like": "card", "ip_like": "ip"}
#: The largest share of true values of a kind that fail its own test (mistyped numbers).
FAILS = 0.05
#: A strict kind's failed matches.
FAILED = {1: KINDS.index("ip_like"), 2: KINDS.index("card_like"), 3: KINDS.index("phone_like")}
LABELERS = ("form", "size", "gazetteer", "context", "edges")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NANP = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")
_PHONE_LOCAL = re.compile(rf"(?<![0-9A-Za-z+.,/-])(?:{_NANP.pattern}|\(?[0-9]{{2,5}}\)?(?:[ ./-][0-9]{{2,5}}){{1,4}})(?![0-9A-Za-z])")
_MASKED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:[\[(]at[\])]| at ) ?[A-Za-z0-9-]{1,63}(?:(?: ?[\[(]dot[\])] ?| dot |\.)[A-Za-z0-9-]{1,63}){1,8}")
#: What any match of the pattern above holds; quicker to look for.
_AT = re.compile(r"(?:[\[(]at[\])]| at ) ?[A-Za-z0-9-]{1,63}(?: ?[\[(]dot[\])]| dot |\.[A-Za-z0-9-])")
_YEAR = re.compile(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sra?|Don|Doña)\.? ((?:[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]{1,20})(?: [A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]{1,20}){0,2})")
_TITLES = re.compile(r"Mr|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sr|Don|Doña")

#: Beginnings of words near a candidate that speak for it, in English, German, French and Spanish.
CONTEXT = {
    "email": "mail e-mail contact write reach kontakt schreib adress courriel contacte écri correo contacto escrib",
    "ip": "ip host server address login client rechner adresse serveur hôte connexion servidor dirección conexión",
    "card": "card visa mastercard amex credit debit pay karte kredit zahl carte crédit paiement payer tarjeta crédito pago pagar",
    "phone": "phone call tel mobile cell fax dial ring anruf ruf handy mobil rufnummer appel portable joindre llam teléfono móvil celular",
    "iban": "iban bank account transfer konto überweis kontonummer compte virement banque cuenta banco transferencia",
    "ssn": "ssn social security tax sozial versicherung steuer sécurité sociale fiscal seguridad seguro",
    "name": "name signed dear contact author sincerely geehrte grüße unterschrieben cher chère signé cordialement estimad firmado atentamente",
}
CONTEXT |= {kind: CONTEXT[of] for kind, of in FAMILY.items()}
#: Those that speak against any.
AGAINST = "id token key hash sha serial order invoice version release isbn issn page chapter figure score ratio range sku bestellung rechnung seite kapitel abbildung fassung commande facture chapitre pedido factura página capítulo versión"


def _any(stems: str) -> re.Pattern:
    return re.compile(rf"(?<![^\W_])(?:{'|'.join(sorted(map(re.escape, stems.split()), key=len, reverse=True))})", re.IGNORECASE)


_FOR, _AGAINST = {kind: _any(stems) for kind, stems in CONTEXT.items()}, _any(AGAINST)
#: Endings of hosts: every two letters are taken for a country.
ENDINGS = frozenset("com org net edu gov info biz int mil name pro app dev".split())
#: Given names; ``gazetteer`` of :func:`find` replaces them.
GIVEN = frozenset("james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah karen hans peter klaus sabine jean pierre marie sophie jose carmen juan lucia".split())
IBAN_COUNTRIES = frozenset("AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from the @ signs."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            end = found.end()
        at = text.find("@", max(at + 1, end))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def matches(text: str) -> list[tuple[int, int, int, bool]]:
    """``(kind, start, end, base)`` of all candidates; those that aren't base overlap no base span."""
    out: list[tuple[int, int, int, bool]] = []
    loose: list[tuple[int, int, int, bool]] = []
    if "@" in text:
        out += [(0, a, b, True) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            good = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))
            (out if good else loose).append((1 if good else FAILED[1], m.start(), m.end(), good))
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if len(d) >= 8:
                good = 12 <= len(d) <= 19 and luhn(d)
                (out if good else loose).append((2 if good else FAILED[2], m.start(), m.end(), good))
        if "+" in text:
            for m in _PHONE.finditer(text):
                good = 9 <= len(_digits(m[0])) <= 15
                (out if good else loose).append((3 if good else FAILED[3], m.start(), m.end(), good))
        loose += [(4, m.start(), m.end(), False) for m in _PHONE_LOCAL.finditer(text) if 6 <= len(_digits(m[0])) <= 14]
        for kind, pattern in ((6, _IBAN), (7, _SSN)):
            loose += [(kind, m.start(), m.end(), False) for m in pattern.finditer(text)]
    if ("(at)" in text or "[at]" in text or " at " in text) and _AT.search(text):
        loose += [(5, m.start(), m.end(), False) for m in _MASKED.finditer(text)]
    if _TITLES.search(text):
        loose += [(8, m.start(1), m.end(1), False) for m in _NAME.finditer(text)]
    if out and loose:
        spans = sorted((a, b) for _, a, b, _ in out)
        starts, ends = [a for a, _ in spans], np.maximum.accumulate([b for _, b in spans])
        loose = [x for x in loose if not (k := bisect.bisect_left(starts, x[2])) or ends[k - 1] <= x[1]]
    return out + loose


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(text: str, kind: int, start: int, end: int, base: bool, given: frozenset[str] = GIVEN) -> tuple[int, ...]:
    """Of each labeler: 1 for personal data, 0 against, 2 abstains."""
    s, name = text[start:end], KINDS[kind]
    d = _digits(s)
    before, after = text[start - 1 : start], text[end : end + 1]
    groups = re.findall(r"[0-9]+", s)
    # the test that a value of the kind passes
    if kind < len(BASE):
        form = 1
    elif name == "phone_local":
        form = 1 if _NANP.fullmatch(s) else 0 if not 7 <= len(d) <= 12 else 2
    elif name == "email_masked":
        form = 0 if " at " in s and " dot " not in s else 1
    elif name == "iban":
        form = int(_iban(s))
    elif name == "ssn":
        form = int(s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00")
    else:
        form = 2 if name == "name" else 0
    size = {"email": 6 <= len(s) <= 60, "ip": 7 <= len(s) <= 15, "card": len(d) in (13, 14, 15, 16), "phone": 10 <= len(d) <= 13, "iban": 15 <= len(s.replace(" ", "")) <= 34, "ssn": len(d) == 9, "name": " " in s}[FAMILY.get(name, name)]
    if name == "phone_local":
        size = len(groups) <= 4 and 9 <= len(d) <= 11
    if name in ("email", "email_masked"):
        ending = re.split(r"[^a-z0-9]+", s.lower())[-1]
        gazetteer = int(ending in ENDINGS or (len(ending) == 2 and ending.isalpha()))
    elif name in ("card", "card_like"):
        gazetteer = int(d[0] in "3456")
    elif name == "iban":
        gazetteer = int(s[:2] in IBAN_COUNTRIES)
    elif name == "name":
        gazetteer = 1 if s.split(" ")[0].lower() in given else 2
    elif name in ("ip", "ip_like"):
        gazetteer = int(groups[0].lstrip("0") not in ("", "127", "255"))
    elif name == "phone_local":
        gazetteer = 0 if _YEAR.search(s) else 1 if s[0] in "(0" or _NANP.fullmatch(s) else 2
    elif name in ("phone", "phone_like"):
        gazetteer = int(d[0] != "0")
    else:
        gazetteer = 0 if _YEAR.search(s) else 2
    near = text[max(0, start - 40) : start] + " " + text[end : end + 20]
    speaks, against = bool(_FOR[name].search(near)), bool(_AGAINST.search(near))
    context = 2 if speaks == against else int(speaks)
    edges = int(not (before.isalnum() or after.isalnum() or before in ("=", "/", "#", "$", "€", "£", "_") or after in ("%", "=", "/", "_")))
    return int(form), int(size), gazetteer, context, edges


def features(text: str, kind: int, start: int, end: int, vote: tuple[int, ...]) -> int:
    """Form and context in one number below 3456: length, digits, characters next to it, the votes on form and words."""
    s = text[start:end]
    side = lambda c: 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3
    length = min(5, len(s) // 6)
    share = min(3, 4 * len(_digits(s)) // max(1, len(s)))
    shape = ((length * 4 + share) * 4 + side(text[start - 1 : start])) * 4 + side(text[end : end + 1])
    return (shape * 3 + vote[0]) * 3 + vote[3]


def judged(text: str, given: frozenset[str] = GIVEN) -> list[tuple[int, int, int, bool, int, int]]:
    """Candidates with their votes and features."""
    out = []
    for kind, start, end, base in matches(text):
        vote = votes(text, kind, start, end, base, given)
        out.append((kind, start, end, base, int("".join(map(str, vote)), 3), features(text, kind, start, end, vote)))
    return out


SPANS = "kind array<int>, start array<int>, end array<int>, base array<boolean>, votes array<int>, features array<int>"


def _candidates(given: frozenset[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for rows in batches:
            found = [judged(text or "", given) for text in rows["text"]]
            spans = {c: [[f[j] for f in x] for x in found] for j, c in enumerate(("kind", "start", "end", "base", "votes", "features"))}
            yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), **spans})

    return run


def candidates(docs: DataFrame, given: frozenset[str] = GIVEN) -> DataFrame:
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(_candidates(given), f"doc_id long, {SPANS}")


def pattern_counts(found: DataFrame) -> pd.DataFrame:
    spans = found.select(F.explode(F.arrays_zip("kind", "votes", "features")).alias("s"))
    return spans.groupBy("s.kind", "s.votes", "s.features").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "votes", "features").toPandas()


def _unpack(code: np.ndarray) -> np.ndarray:
    return np.stack([code // 3 ** (len(LABELERS) - 1 - k) % 3 for k in range(len(LABELERS))], axis=1)


def reliabilities(vote: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM of one kind: P(vote | truth) as [truth, labeler, vote], and P(true) a pattern.

    It starts from the share of votes in favour, or, where the first labeler votes,
    near its vote: a failed checksum outweighs looks. Counts carry a prior by which
    a labeler is right rather than wrong; that personal data fails the first
    labeler's test has a probability of ``FAILS`` at most.
    """
    cast = vote != 2
    p = ((vote == 1).sum(1) + 0.5) / (cast.sum(1) + 1.0)
    p = np.where(vote[:, 0] == 2, p, np.where(vote[:, 0] == 1, 0.5 + p / 2, p / 10))
    prior = np.array([[3.0, 1.0, 1.0], [1.0, 3.0, 1.0]])
    table = np.zeros((2, vote.shape[1], 3))
    for _ in range(rounds):
        for truth, w in ((0, (1 - p) * n), (1, p * n)):
            for v in range(3):
                table[truth, :, v] = ((vote == v) * w[:, None]).sum(0) + prior[truth, v]
        table /= table.sum(2, keepdims=True)
        # what is over the bound goes to the other votes
        table[1, 0] = np.where(np.arange(3) == 0, min(table[1, 0, 0], FAILS), table[1, 0] * (1 - min(table[1, 0, 0], FAILS)) / max(table[1, 0, 1:].sum(), 1e-9))
        share = ((p * n).sum() + 1) / (n.sum() + 2)
        log = [np.log(s) + np.take_along_axis(np.log(table[t])[None], vote[:, :, None], 2)[:, :, 0].sum(1) for t, s in ((0, 1 - share), (1, share))]
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return table, p


def _design(kind: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """One-hot rows of kind, length, digit share, both sides, and the votes on form and words, also by kind."""
    shape, form, words = feature // 9, feature // 3 % 3, feature % 3
    sides = [(kind, len(KINDS)), (shape // 64, 6), (shape // 16 % 4, 4), (shape // 4 % 4, 4), (shape % 4, 4), (form, 3), (words, 3), (kind * 3 + form, 3 * len(KINDS)), (kind * 3 + words, 3 * len(KINDS))]
    return np.concatenate([np.eye(size)[col] for col, size in sides], axis=1)


def train(counts: pd.DataFrame, rounds: int = 30) -> np.ndarray:
    """Weights of the span classifier from EM's probabilities (Newton steps)."""
    width = _design(np.zeros(1, dtype=int), np.zeros(1, dtype=int)).shape[1]
    weights = np.zeros(width)
    if counts.empty:
        return weights - 1.0
    kind, feature, n = (counts[c].to_numpy().astype(np.int64) for c in ("kind", "features", "n"))
    vote, target = _unpack(counts["votes"].to_numpy().astype(np.int64)), np.zeros(len(counts))
    families = np.array([KINDS.index(FAMILY.get(name, name)) for name in KINDS])[kind]
    for k in np.unique(families):
        at = families == k
        target[at] = reliabilities(vote[at], n[at].astype(float))[1]
    x = _design(kind, feature)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (n * (target - p)) - weights
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(width)
        weights = weights + np.linalg.solve(hessian, gradient)
    return weights


def choose(kind, start, end, base, feature, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the spans that stand, in order."""
    taken = [(int(s), int(k), int(e)) for k, s, e, b in zip(kind, start, end, base, strict=True) if b]
    loose = [(int(k), int(s), int(e), int(f)) for k, s, e, b, f in zip(kind, start, end, base, feature, strict=True) if not b and k >= len(BASE)]
    if loose:
        score = _design(np.array([x[0] for x in loose]), np.array([x[3] for x in loose])) @ weights
        for value, k, s, e, _ in sorted(((v, *x) for x, v in zip(loose, score.tolist(), strict=True)), key=lambda x: (-x[0], x[2], x[1])):
            if value > 0 and all(e <= a or s >= b for a, _, b in taken):
                taken.append((s, k, e))
    return sorted(taken)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _report(weights: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for kind, start, end, base, feature in zip(rows["kind"], rows["start"], rows["end"], rows["base"], rows["features"], strict=True):
                strict = sorted((int(s), int(k), int(e)) for k, s, e, b in zip(kind, start, end, base, strict=True) if b)
                of = [sum(k == i for _, k, _ in strict) for i in range(len(BASE))]
                out.append((*of, hashlib.sha256(_written(strict).encode()).hexdigest(), _written(choose(kind, start, end, base, feature, weights))))
            frame = pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
            frame.insert(0, "doc_id", rows["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield frame

    return run


def find(docs: DataFrame, given: frozenset[str] = GIVEN) -> DataFrame:
    """``doc_id``, counts and hash of the strict spans, and all spans, for every row."""
    found = materialize(candidates(docs, given))
    weights = train(pattern_counts(found))
    return found.mapInPandas(_report(weights), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def report(docs: DataFrame, given: frozenset[str] = GIVEN) -> pd.DataFrame:
    """A row for each kind: candidates, how many the classifier finds likelier than not, and votes (against, for, none) by labeler."""
    counts = pattern_counts(materialize(candidates(docs, given)))
    weights, out = train(counts), []
    kind, feature, n = (counts[c].to_numpy().astype(np.int64) for c in ("kind", "features", "n"))
    vote = _unpack(counts["votes"].to_numpy().astype(np.int64))
    likely = _design(kind, feature) @ weights > 0 if len(kind) else np.zeros(0, dtype=bool)
    for k in np.unique(kind):
        at = kind == k
        by = {name: tuple(int(n[at & (vote[:, j] == v)].sum()) for v in range(3)) for j, name in enumerate(LABELERS)}
        out.append({"kind": KINDS[k], "candidates": int(n[at].sum()), "accepted": int(n[at & likely].sum()), **by})
    return pd.DataFrame(out, columns=["kind", "candidates", "accepted", *LABELERS])


def _redact(weights: np.ndarray, given: frozenset[str]):
    def run(column: pd.Series) -> pd.Series:
        texts = []
        for text in column:
            found = judged(text, given) if text else []
            if found:
                kind, start, end, base, _, feature = zip(*found, strict=True)
                parts, at = [], 0
                for s, k, e in choose(kind, start, end, base, feature, weights):
                    if s >= at:
                        parts += [text[at:s], f"<{KINDS[k]}>"]
                    at = max(at, e)
                text = "".join([*parts, text[at:]])
            texts.append(text)
        return pd.Series(texts, index=column.index, dtype=object)

    return run


def redact(docs: DataFrame, given: frozenset[str] = GIVEN) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets.

    Overlapping spans become one. Other columns are as they are.
    """
    weights = train(pattern_counts(materialize(candidates(docs, given))))
    return docs.withColumn("text", F.pandas_udf(_redact(weights, given), "string")(F.col("text")))
