"""The pipeline's near-duplicate stage against brute-force Jaccard."""

import random
from itertools import combinations

import corpus_pipeline
import pytest

from arborql.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def slow_shingles(text, words=5):
    tokens = (text or "").lower().split()
    return {tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set()


def slow_kept(rows):
    """Rows left: the least of each component of pairs with a likeness of at least 0.8."""
    sets = {i: slow_shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i for i in sets if find(i) == i}


@pytest.mark.parametrize(("stars", "block"), [(jaccard.STARS, jaccard.BLOCK), (0, 7)])
def test_near_copies_go(spark, monkeypatch, stars, block):
    monkeypatch.setattr(jaccard, "STARS", stars)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for i in range(60):
        base = [word() for _ in range(rng.randint(60, 400))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(60 if i == 0 else 4):
            copy = list(base)
            for at in rng.sample(range(len(copy)), max(1, round(len(copy) * rng.choice([0.01, 0.02, 0.03, 0.05])))):
                copy[at] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "one two"), (len(rows) + 3, "One  two"), (len(rows) + 4, "one")]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    rows = [(i, t) for i, (_, t) in zip(ids, rows, strict=True)]
    want = slow_kept(rows)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want
    assert 60 < len(want) < 260
