"""A small table of awkward documents, with columns whose names the operators use."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, fp long, words array<string>, key long, part int, prefix long, kept boolean, keep_id long, value string"
_WORDS = "the of and to house river stone walking under bright seven garden paper yellow morning silent quick letter window hand".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(_WORDS) + rng.choice(["", "", "", "ing", "ed", ",", "."]) for _ in range(n))


def rows():
    long_text = prose(1, 30_000)
    texts = [
        (1, prose(2, 80)), (2, None), (3, ""), (4, "  \n\t "), (5, prose(2, 80)), (5, prose(2, 80)), (None, prose(3, 60)), (None, None), (8, long_text), (9, long_text + " more"),
        (10, "word"), (11, "Two WORDS"), (12, "ünïcödé 漢字 text with odd spaces \x1c and 😀 <|endoftext|> end"), (13, prose(4, 40) + "\n" + prose(4, 40)), (14, "a " * 500),
        (15, "mail me at someone.else@mail.example.com or call +1 (523) 555-6688 today from 10.1.2.3, card 4111 1111 1111 1111."), (16, prose(5, 120)), (17, prose(5, 120).replace("river", "stone")), (18, prose(6, 3)), (19, "x" * 70_000), (-7, prose(7, 50)), (20, prose(8, 64) + " " + prose(2, 80)[:200]),
    ]
    out = []
    for k, (i, t) in enumerate(texts):
        lang, source = [("en", "a"), ("de", None), (None, "b"), ("en", "b")][k % 4]
        out.append((i, t, lang, source, None if t is None else len(t), 7, 7, 7, ["w"], 7, 7, 7, True, 7, "v"))
    return out


def table(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)
