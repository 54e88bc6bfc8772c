"""The n-gram model against dictionaries, and its sequences against sorted arrays."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from arborql.llm import ngrams, queries
from arborql.llm.trie import EliasFano, Trie


@pytest.mark.parametrize(("n", "top"), [(0, 0), (1, 0), (1, 9), (10, 3), (1000, 10**6), (5000, 4000), (70_000, 10**12)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64)
    e = EliasFano.build(values)
    if n:
        i = rng.integers(0, n, 2000)
        assert (e.access(i) == values[i]).all()
        x = np.concatenate([rng.integers(0, top + 5, 2000).astype(np.uint64), values[i]])
        assert (e.successor(x) == np.searchsorted(values, x)).all()
        place = np.minimum(np.searchsorted(values, x), n - 1)
        assert (e.find(x) == np.where(values[place] == x, place, n)).all()


def slow_scores(texts, learned, order, mass):
    tokens = [[w for w in (t or "").lower().split()] + [None] for t in texts]
    count = Counter(w for t, y in zip(tokens, learned, strict=True) if y for w in t)
    grams = Counter()
    for t, y in zip(tokens, learned, strict=True):
        if y:
            padded = ["<"] * (order - 1) + t
            for i in range(order - 1, len(padded)):
                for n in range(2, order + 1):
                    grams[tuple(padded[i - n + 1 : i + 1])] += 1
    contexts = Counter()
    for g, c in grams.items():
        contexts[g[:-1]] += c
    total, kinds = sum(count.values()), len(count)
    out = []
    for t in tokens:
        padded, base, score = ["<"] * (order - 1) + t, 0.0, 0.0
        for i in range(order - 1, len(padded)):
            p = (count[padded[i]] + 1) / (total + kinds + 1)
            base += math.log10(p)
            for n in range(2, order + 1):
                g = tuple(padded[i - n + 1 : i + 1])
                p = (grams[g] + mass[n - 2] * p) / (contexts[g[:-1]] + mass[n - 2])
            score += math.log10(p)
        out.append((len(t), sum(count[w] > 0 for w in t), total, base, score))
    return out


@pytest.mark.parametrize(("order", "per_shard"), [(2, 10**6), (3, 10**6), (3, 40), (4, 100)])
def test_against_dictionaries(spark, monkeypatch, order, per_shard):
    monkeypatch.setattr(ngrams, "TOKENS_PER_SHARD", per_shard)
    monkeypatch.setattr(ngrams, "WORDS_PER_SHARD", 7 if per_shard < 10**6 else 10**6)
    rng = random.Random(order)
    words = [f"w{i}" for i in range(12)] + ["é", "É", "Word"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(60)] + [None, "", "W1 w2\tW3", "unknown w1 w2 stranger w3"]
    learned = [i % 7 != 2 and i < 62 for i in range(len(texts))]
    texts = [t and t.replace("É", "e") for t in texts]
    df = spark.createDataFrame(list(zip(range(len(texts)), texts, learned, strict=True)), "i long, t string, y boolean").repartition(3)
    mass = (2.0, 1.5, 1.0)
    model = ngrams.train(df, "t", df["y"], order, mass)
    got = {r.id: r for r in ngrams.score(df, "i", "t", model).collect()}
    for i, (n, known, total, base, score) in enumerate(slow_scores(texts, learned, order, mass)):
        assert (got[i].n_tokens, got[i].n_known, model.vocabulary.tokens) == (n, known, total)
        assert got[i].base_score == pytest.approx(base) and got[i].score == pytest.approx(score, abs=0.012 * order * n)


def test_hashes_tell_words_apart(monkeypatch):
    monkeypatch.setattr(ngrams, "CHUNK", 50)
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["a", "b", "ab", "ba", "Ab", "x" * 70, "é", "aa", "aaa"], k=rng.randint(0, 40))).replace(" ", rng.choice([" ", "\n\t "])).encode() for _ in range(50)] + [b"", b"  ", b"\x00", b"y" * 3_000_000]
    morse = [bytes(97 + (i.bit_count() + flip) % 2 for i in range(2048)) for flip in (0, 1)]  # polynomials modulo 2^64 don't tell these apart
    texts += [morse[0], morse[1] + b" " + morse[0].upper()]
    found = ngrams.Hashed(texts, 3)
    hashes, sizes = found.whole, found.sizes
    words = [w for t in texts for w in [*t.lower().split(), b""]]
    assert sizes.tolist() == [len(t.split()) + 1 for t in texts] and len(hashes) == len(words)
    assert len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))
    values, checks, back, counts = found.distinct(inverse=True, counts=True)
    assert [checks[i] for i in back] == [xxhash.xxh64_intdigest(w, 0) if w else 0 for w in words]
    assert counts.tolist() == [Counter(hashes.tolist())[v] for v in values.tolist()]
    assert ngrams.Hashed([], 0).sizes.tolist() == [] and len(ngrams.Hashed([], 0).distinct()[0]) == 0


def test_a_trie_survives_its_file():
    roots = np.array([2, 5, 9])
    trie = Trie.build(roots, [(np.array([0, 0, 2]), np.array([1, 7, 0]), np.array([0.5, 0.25, 1.0]), np.array([0.5, 1.0, 0.1])), (np.array([1, 2, 2]), np.array([3, 3, 4]), np.array([0.1, 0.2, 0.3]), None)])
    again = Trie.from_buffer(np.frombuffer(trie.to_bytes(), np.uint8))
    for t in (trie, again):
        node = t.child(0, t.root(np.array([2, 2, 5, 9, 3])), np.array([7, 3, 1, 0, 1]))
        assert node.tolist() == [1, -1, -1, 2, -1]
        assert t.child(1, node, np.array([3, 3, 3, 4, 1])).tolist() == [0, -1, -1, 2, -1]
        assert t.p(0, node) == pytest.approx([0.25, 0, 0, 1, 0], rel=0.03) and t.weight(0, node) == pytest.approx([1, 1, 1, 0.1, 1], rel=0.03)


def test_query(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["a", "b c", "b c d", "e"], k=20))) for i in range(80)] + [(None, "a b"), (200, None), (201, ""), (201, ""), (202, "x" * 100_000), (203, "b c " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "'q' as id", "2 as n_tokens")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_language_model(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out) for r in got) == sorted((i is None, i or 0, y) for (i, _), y in zip(rows, held, strict=True))
    want = slow_scores([t for _, t in rows], [i is not None and not y for (i, _), y in zip(rows, held, strict=True)], ngrams.ORDER, ngrams.MASS)
    by = {i: w for (i, _), w in zip(rows, want, strict=True)}
    for r in got:
        n, known, total, base, score = by[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score, abs=0.04 * n)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op2_language_model(spark, f"{tmp_path}/none").count() == 0
