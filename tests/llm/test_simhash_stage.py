"""The SimHash signatures that the pipeline's near-duplicate stage meets by."""

import random

import corpus_pipeline
import numpy as np
import pytest
from test_near_stage import slow_shingles

from arborql.llm import jaccard, simhash


def near_texts(seed, families):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    for _ in range(families):
        base = [word() for _ in range(rng.randint(40, 300))]
        copy = list(base)
        for at in rng.sample(range(len(copy)), max(1, round(len(copy) * rng.choice([0.005, 0.01, 0.02])))):
            copy[at] = word()
        yield " ".join(base), " ".join(copy)


def alike(a, b):
    a, b = slow_shingles(a), slow_shingles(b)
    return len(a & b) / len(a | b) >= 0.8


def test_stage_goes_through_simhash(spark, monkeypatch):
    assert "SimHash" in corpus_pipeline.STAGES[1][0]
    asked = []
    meetings = simhash.meetings
    monkeypatch.setattr(simhash, "meetings", lambda nodes, *a: asked.append(nodes.columns) or meetings(nodes, *a))
    docs = spark.createDataFrame([(1, "a b c d e f g h i j", "en", "a", 19), (2, "a b c d e f g h i J", "en", "a", 19)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()] == [1] and asked


def test_signature_is_simhash():
    text = next(near_texts(1, 1))[0]
    hashes = jaccard.shingles(text, 3)
    ones = [sum(int(h) >> i & 1 for h in hashes) for i in range(64)]
    assert int(simhash.signature(hashes)[0]) == sum(1 << i for i, n in enumerate(ones) if 2 * n > len(hashes)) == simhash.fingerprint(text)


@pytest.mark.parametrize(("bits", "at_once"), [(3, 512), (11, 512), (11, 1)])
def test_near_pairs_meet(spark, monkeypatch, bits, at_once):
    """Every pair from 0.8 on shares a key, in tables of few and of many bits; so do members of buckets that are compared one by one."""
    sets, pairs = [], []
    for a, b in near_texts(bits, 400):
        if alike(a, b):
            pairs.append((len(sets), len(sets) + 1))
        sets += [jaccard.shingles(a), jaccard.shingles(b)]
    assert len(pairs) > 200
    words = np.array([simhash.signature(x) for x in sets])
    keys = simhash.table_keys(words, bits, 80)
    a, b = map(list, zip(*pairs, strict=True))
    assert (keys[a] == keys[b]).any(axis=1).all()
    assert simhash.within(words[a], words[b], simhash.radius(80)).all()
    groups = lambda x, n: (monkeypatch.setattr(simhash, "AT_ONCE", n), simhash._groups(words[x], np.array([len(sets[i]) for i in x]), 80))[1]
    for i, j in pairs[:50]:
        found = groups([i, j, *range(100, 120)], at_once)
        assert found[0] == found[1] >= 0


def test_meetings_of_whole_buckets(spark, monkeypatch):
    """Pairs meet no matter how a task's rows are gathered; sets of fewer than four shingles meet none."""
    texts = [t for pair in near_texts(7, 150) for t in pair] + ["one two three four five six seven"]
    sets = [jaccard.shingles(t) for t in texts]
    rows = [(i, len(x), bytearray(simhash.signature(x).tobytes())) for i, x in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "node long, size int, sketch binary")
    keys = {}
    for r in simhash.meetings(nodes, 2, 80).collect():
        keys.setdefault(r.key, []).append(r)
    assert all(len(x) == x[0].n >= 2 for x in keys.values())
    met = {frozenset((x.node, y.node)) for found in keys.values() for x in found for y in found if x.node < y.node}
    assert {frozenset((i, i + 1)) for i in range(0, 300, 2) if alike(texts[i], texts[i + 1])} <= met
    assert not any(300 in x for x in met)


def test_families_give_few_links(spark, monkeypatch):
    """All links of a family are found in whatever blocks, and a block gives no more rows than it has members."""
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = []
    for n in range(120):
        copy = list(base)
        for at in rng.sample(range(200), 2 if n % 2 else 6):
            copy[at] = f"v{rng.randrange(5000)}"
        texts.append(" ".join(copy))
    sets = [jaccard.shingles(t) for t in texts]
    pairs = {(i, j) for i in range(120) for j in range(i + 1, 120) if alike(texts[i], texts[j])}
    nodes = spark.createDataFrame([(i, len(x), bytearray(simhash.signature(x).tobytes())) for i, x in enumerate(sets)], "node long, size int, sketch binary")
    whole = spark.createDataFrame([(i, x.view(np.int64).tolist()) for i, x in enumerate(sets)], "node long, shingles array<long>")
    open_ = nodes.selectExpr("7L key", "node", "size", "node root")
    found = [tuple(r) for r in jaccard._linked_in_families(open_, nodes, whole, 120, 80).collect()]

    def parts(links):
        root = list(range(120))
        for _ in range(120):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert set(found) <= pairs and parts(found) == parts(pairs) and len(set(parts(pairs))) > 1
    assert len(found) <= 120 * 6 < len(pairs)
