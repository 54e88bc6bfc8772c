"""A quality classifier by compression: a text goes to the class whose dictionary makes it smaller.

Two zstandard dictionaries are built from labelled text, one of good and one of bad documents. A text is cut into pieces
of about a kilobyte, so that the dictionary and not the text's own past decides, and each piece is compressed with either.
The difference of the two sizes over the number of bytes, with the size under the good dictionary that puts it on its
scale, is calibrated to a probability by logistic regression on labelled documents that the dictionaries haven't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame

from ._shared import remainder, small_batches, utf8
from .labelled import logistic, sample

PIECE = 1024
DICTIONARY = 110 << 10
LEVEL = 3
#: Labelled rows of either class that are learned from.
PER_CLASS = 3000


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of the texts' pieces; of few texts, their end. Never empty."""
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICTIONARY:].rjust(8, b" ")


class Sizes:
    """Compressed sizes of texts under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.coders = []
        for raw in (good, bad):
            held = zstandard.ZstdCompressionDict(raw)
            held.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: bytes) -> tuple[float, float]:
        """The size difference, bad less good, and the good size, each over the number of bytes. Empty: zeros."""
        if not text:
            return 0.0, 0.0
        good, bad = (c.compress for c in self.coders)
        a = b = 0
        for i in range(0, len(text), PIECE):
            piece = text[i : i + PIECE]
            a += len(good(piece))
            b += len(bad(piece))
        return (b - a) / len(text), a / len(text)


def features(sizes: np.ndarray) -> np.ndarray:
    """What is calibrated: the difference, relative and absolute, and the size that it is measured against."""
    d, g = sizes[:, 0], sizes[:, 1]
    return np.column_stack([d, d / np.maximum(g, 1e-3), g, g * g])


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray

    def scorer(self):
        sizes = Sizes(self.good, self.bad)
        w = self.weights

        def score(texts: list[bytes]) -> np.ndarray:
            x = features(np.array([sizes(t) for t in texts]).reshape(-1, 2))
            return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -500, 500)))

        return score


def fit(texts: list[str], y: np.ndarray, prior: float | None = None) -> Model:
    """Dictionaries from two of three texts, the calibration from the third; ``prior``: the share of good ones where it's known."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    held = np.arange(len(y)) % 3 == 2
    kinds = [dictionary([data[i] for i in range(len(y)) if not held[i] and y[i] == k]) for k in (1, 0)]
    sizes = Sizes(*kinds)
    at = np.flatnonzero(held) if len(set(y[held])) == 2 else np.arange(len(y))
    w = logistic(features(np.array([sizes(data[i]) for i in at]).reshape(-1, 2)), y[at])
    if prior is not None and len(at) and 0 < (rate := y[at].mean()) < 1:
        w[-1] += np.log(prior / (1 - prior)) - np.log(rate / (1 - rate))
    return Model(*kinds, w)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn: Column, per_class: int = PER_CLASS) -> Model:
    """Learns from rows for which ``learn`` holds alone: texts, labels and the share of good ones."""
    texts, y, share = sample(docs, labels, id_col, text_col, label_col, learn, per_class)
    return fit(texts, y, min(max(share, 0.01), 0.99) if share is not None else None)


def score(df: DataFrame, text_col: str, model: Model, into: str = "score") -> DataFrame:
    """``df`` with ``into``: the probability that the text is good, over the whole text. Null and empty texts have the score
    of a text without evidence; a column named ``into`` is replaced; other columns and repeated rows stay."""
    kept = df.select(*(df[c] for c in df.columns if c != into))
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in small_batches(batches):
            found = scorer(utf8(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, into])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{into}` double"])
    return kept.mapInArrow(run, fields)


def learn_rows(id_col: str = "doc_id", folds: int = 5) -> Column:
    return remainder(id_col, folds) != 0
