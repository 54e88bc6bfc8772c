"""Toxicity by bags of subwords: character n-gram embeddings, averaged, under a linear softmax, trained together in numpy.

A word is the mean of the embeddings of its hashed character n-grams and of itself, a window of WINDOW words the mean of its
words, and a softmax of two classes over it says how likely the window is toxic; a misspelling shares most n-grams with the
word, so it needs no entry of its own. A text is toxic if one of its windows is: its score is 1 - prod(1 - p) over all of
them. Embeddings and softmax are trained jointly on whole texts through that product, by full-batch Adam.

With two classes only the difference u of the softmax's columns matters, and a window's logit is SCALE * u . mean + bias. So a
word's part in it is one number, and scoring a text needs no more than a table of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import remainder, small_batches, utf8
from .labelled import sample

WINDOW = 8
SCALE = 8.0
BUCKETS = 1 << 16
DIM = 8
STEPS = 150
RATE = 0.05
DECAY = 1e-6
#: Labelled rows of either class that are learned from.
PER_CLASS = 1200
REMEMBERED = 500_000


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all the words' character n-grams of 3 to 5, with marks for the ends, and of the words; the word of each."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    word = np.repeat(np.arange(len(marked)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    buckets = [np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in marked), np.int32, len(marked))]
    owners = [np.arange(len(marked))]
    rolled = codes
    for n in range(2, 6):
        rolled = rolled[:-1] * np.uint32(0x01000193) + codes[n - 1 :] * np.uint32(0x9E3779B1) if len(rolled) else rolled
        if n > 2 and len(rolled):
            whole = np.flatnonzero(left[: len(rolled)] >= n)
            mixed = (rolled[whole] + np.uint32(n)) * np.uint32(0x85EBCA6B)
            buckets.append(((mixed ^ mixed >> np.uint32(15)) % np.uint32(BUCKETS)).astype(np.int32))
            owners.append(word[whole])
    return np.concatenate(buckets), np.concatenate(owners)


def split(text: bytes) -> list[str]:
    """Lower-case words, one empty word at least; long ones are cut into runs of 40 characters, so all of
    them counts. A word that follows itself counts once: saying it again makes nothing more toxic."""
    found = text.decode("utf-8", "replace").lower().split() or [""]
    if len(text) > 64 and max(map(len, found)) > 64:
        found = [w[i : i + 40] for w in found for i in range(0, len(w), 40)]
    return [w for w, before in zip(found, [None, *found], strict=False) if w != before]


@dataclass
class Model:
    embeddings: np.ndarray
    softmax: np.ndarray
    bias: float

    def gram_values(self) -> np.ndarray:
        return SCALE * (self.embeddings @ (self.softmax[:, 1] - self.softmax[:, 0]))

    def scorer(self):
        values = self.gram_values()
        known: dict[str, float] = {}
        bias = self.bias

        def score(text: bytes) -> float:
            found = split(text)
            new = [w for w in set(found) if w not in known]
            if new:
                if len(known) > REMEMBERED:
                    known.clear()
                    new = list(set(found))
                at, word = grams(new)
                known.update(zip(new, (np.bincount(word, values[at]) / np.bincount(word)).tolist(), strict=True))
            x = np.fromiter(map(known.__getitem__, found), float, len(found))
            starts = np.arange(0, len(x), WINDOW)
            z = np.add.reduceat(x, starts) / np.minimum(WINDOW, len(x) - starts) + bias
            return float(-np.expm1(-np.logaddexp(0, z).sum()))

        return score


def fit(texts: list[bytes], y: np.ndarray, steps: int = STEPS, seed: int = 7) -> Model:
    """Trained embeddings and softmax. No texts give a model that says 0 almost surely."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, DIM))
    u = rng.normal(0, 0.5, (DIM, 2))
    bias = -5.0
    if not texts or y.min() == y.max():
        return Model(np.zeros_like(e), u, 20.0 if len(y) and y.min() else -20.0)
    ids: dict[str, int] = {}
    flat, window_sizes, windows = [], [], []
    for t in texts:
        found = split(t)
        flat.append(np.fromiter((ids.setdefault(w, len(ids)) for w in found), np.int64, len(found)))
        n = -(-len(found) // WINDOW)
        windows.append(n)
        window_sizes.append(np.minimum(WINDOW, len(found) - np.arange(n) * WINDOW))
    word_at = np.concatenate(flat)
    sizes = np.concatenate(window_sizes)
    first_word = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    first_window = np.concatenate([[0], np.cumsum(windows)[:-1]])
    gram_at, word_of = grams(list(ids))
    gram_at, word_of = gram_at[order := np.argsort(word_of, kind="stable")], word_of[order]
    n_grams = np.bincount(word_of)
    first_gram = np.concatenate([[0], np.cumsum(n_grams)[:-1]])
    del ids, word_of, order
    params = [e, u, np.array([bias])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    sign = np.where(y == 1, 1.0, 0.0)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for step in range(1, steps + 1):
        d = params[1][:, 1] - params[1][:, 0]
        per_word = np.add.reduceat((SCALE * (params[0] @ d))[gram_at], first_gram) / n_grams
        z = np.add.reduceat(per_word[word_at], first_word) / sizes + params[2][0]
        total = np.add.reduceat(np.logaddexp(0, z), first_window)
        slope = np.where(sign == 1, -1 / np.expm1(np.maximum(total, 1e-6)), 1.0) * weight / len(y)
        dz = np.repeat(slope, windows) / (1 + np.exp(-np.clip(z, -500, 500)))
        to_word = np.bincount(word_at, np.repeat(dz / sizes, sizes), len(n_grams)) / n_grams
        to_gram = SCALE * np.bincount(gram_at, np.repeat(to_word, n_grams), BUCKETS)
        du = params[0].T @ to_gram
        grads = [np.outer(to_gram, d) + DECAY * params[0], np.column_stack([-du, du]) + DECAY * params[1], np.array([dz.sum()])]
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Model(params[0].astype(np.float32), params[1], float(params[2][0]))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn: Column, per_class: int = PER_CLASS) -> Model:
    texts, y, _ = sample(docs, labels, id_col, text_col, label_col, learn, per_class, most_chars=8_000)
    return fit([t.encode("utf-8", "surrogatepass") for t in texts], y)


def score(df: DataFrame, text_col: str, model: Model, into: str = "score") -> DataFrame:
    """``df`` with ``into``: how likely the whole text is toxic. Null and empty texts are one window without words; a column
    named ``into`` is replaced; other columns and repeated rows stay."""
    kept = df.select(*(df[c] for c in df.columns if c != into))
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in small_batches(batches):
            found = [scorer(t) for t in utf8(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, into])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{into}` double"])
    return kept.mapInArrow(run, fields)


def learn_rows(id_col: str = "doc_id", folds: int = 5) -> Column:
    return remainder(id_col, folds) != 0
