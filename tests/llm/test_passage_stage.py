"""The pipeline's stage of repeated passages: over 50 words, or 400 bytes."""

import random
import re
from collections import Counter

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def slow_clean(texts, words=51, length=400):
    """Texts without strings of 400 bytes and runs of 51 words that also start elsewhere, all counted one by one."""
    data = [(t or "").encode() for t in texts]
    spans = [[m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\f]+", d)] for d in data]
    runs = [[(s[i][0], s[i + words - 1][1], tuple(d[a:b] for a, b in s[i : i + words])) for i in range(len(s) - words + 1)] for d, s in zip(data, spans, strict=True)]
    strings = [[(i, i + length, d[i : i + length]) for i in range(len(d) - length + 1)] for d in data]
    out = []
    counts = [Counter(x for own in found for _, _, x in own) for found in (runs, strings)]
    for d, own in zip(data, zip(runs, strings, strict=True), strict=True):
        gone = bytearray(len(d))
        for found, count in zip(own, counts, strict=True):
            for a, b, x in found:
                if count[x] > 1:
                    gone[a:b] = b"\1" * (b - a)
        out.append(bytes(c for c, g in zip(d, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


def test_passages_of_51_words_go(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10000)}" for _ in range(n))
    long, short, tiny = text(51), text(50), " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(51))
    unbroken = "".join(rng.choice("abcdefgh") for _ in range(400))
    assert 250 < len(long) < 330 and len(tiny) == 101
    heads, tails = [text(30) for _ in range(8)], [text(30) for _ in range(8)]
    middles = [long, long.replace(" ", "\n "), short, short, tiny, tiny, unbroken, unbroken]
    rows = [(i, f"{h} {m} {t}") for i, (h, m, t) in enumerate(zip(heads, middles, tails, strict=True))] + [(8, ""), (9, None), (10, long)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    for i in (0, 1, 4, 5):
        assert got[i] == (f"{heads[i]}  {tails[i]}", len(heads[i]) + len(tails[i]) + 2)
    for i in (2, 3, 8, 9):
        assert got[i][0] == rows[i][1]
    for i in (6, 7):
        assert got[i][0] == heads[i] + tails[i]  # the spaces beside it repeat too
    assert got[10][0] == ""
    assert [got[i][0] or "" for i in range(11)] == slow_clean([t for _, t in rows])
