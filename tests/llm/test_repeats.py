"""Removal of repeated byte strings against a brute-force count of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from arborql.llm import queries, repeats


def slow(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((bytes(np.frombuffer(t, np.uint8)[~gone]), [(int(a), int(b)) for a, b in edges.reshape(-1, 2)]))
    return out


def collection(seed, length, alphabet="abcdefgh", docs=40):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choices(alphabet, k=n))
    passages = [text(rng.randint(length // 2, length * 3)) for _ in range(6)]
    found = []
    for _ in range(docs):
        parts = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            a, b = sorted(rng.sample(range(len(p) + 1), 2))
            parts.append(rng.choice([text(rng.randint(0, 2 * length)), p, p[a:], p[:b], "ab" * rng.randint(0, length), "z" * rng.randint(0, 2 * length)]))
        found.append("".join(parts))
    return found + [found[0], None, "", "x", "é" * length, "é" * (length // 2), passages[0] * 3]


@pytest.mark.parametrize(("seed", "length", "spread", "most"), [(1, 40, 25, 10**6), (2, 40, 25, 3), (3, 17, 16, 10**6), (4, 400, 256, 10**6), (5, 12, 1, 10**6), (6, 60, 40, 1)])
def test_against_brute_force(spark, seed, length, spread, most):
    texts = collection(seed, length, docs=12 if length == 400 else 40)
    rows = [(i, t, "kept") for i, t in enumerate(texts)]
    rows += [(3, texts[3], "kept"), (None, "abc" * length, "kept"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, t string, kept string").repartition(3)
    got = repeats.remove_repeats(df, "t", length, spread, most).collect()
    want = slow([(t or "").encode() for _, t, _ in rows], length)
    key = lambda i, t, kept, runs: (i is None, i or 0, t or "", bytes(kept), runs)
    assert sorted(key(r.doc_id, r.t, r.kept, [(x.start, x.end) for x in r.removed]) for r in got) == sorted(key(i, t, kept, runs) for (i, t, _), (kept, runs) in zip(rows, want, strict=True))


def test_phrases_partition_the_starts():
    text = random.Random(1).randbytes(700_000)
    first, last, at, h = repeats.parse(text)
    assert first[0] == 0 and last[-1] == len(text) - repeats.LENGTH and (first[1:] == last[:-1] + 1).all()
    assert (at >= last).all() and (at - first < repeats.SPREAD).all()
    twice = repeats.parse(text[1000:50_000])
    shared = set(zip((twice[2] + 1000).tolist(), twice[3].tolist(), strict=True)) & set(zip(at.tolist(), h.tolist(), strict=True))
    assert len(shared) >= len(twice[0]) - 4


def test_query(spark, tmp_path):
    long = "the quick brown fox " * 30
    rows = [(0, "a" + long, "en"), (1, long + "ü", "en"), (2, None, None), (3, "unique", "en"), (3, "unique", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op4_repeats(spark, str(tmp_path)).collect()
    got = sorted(tuple(r)[:5] for r in found)
    want = sorted((i, len((t or "").encode()), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest()) for (i, t, _), (kept, runs) in zip(rows, slow([(t or "").encode() for _, t, _ in rows], 400), strict=True))
    assert got == want and sorted((r.doc_id, r.text) for r in found) == [(0, "a"), (1, "ü"), (2, ""), (3, "unique"), (3, "unique")]
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op4_repeats(spark, f"{tmp_path}/none").count() == 0
