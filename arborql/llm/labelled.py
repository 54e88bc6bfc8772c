"""Bounded samples of labelled documents for the classifiers, and the calibration that they share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import scratch, stored


def sample(docs: DataFrame, *args, **options) -> tuple[list[str], np.ndarray, float | None]:
    """See ``_sample``; no table of it is left."""
    with scratch(docs.sparkSession):
        return _sample(docs, *args, **options)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn, per_class: int, most_chars: int = 20_000) -> tuple[list[str], np.ndarray, float | None]:
    """Texts and 0/1 labels to learn from: up to ``per_class`` rows of each label, those with the least hash of their id;
    and the share of label 1 among all rows that may be drawn, None if there are none.

    Only rows for which the column ``learn`` holds and whose text has at most ``most_chars`` characters are drawn, so
    what reaches the driver is at most 2 * per_class * most_chars characters however large the tables are. Rows with a
    null id, text or label are passed over; of repeated ids one row each of documents and labels counts.
    """
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id is not null and y in (0, 1)").dropDuplicates(["id"])
    ids = stored(docs.where(learn).where(F.length(docs[text_col]).between(1, most_chars)).select(docs[id_col].alias("id")).join(known, "id").dropDuplicates(["id"]), "labelled")
    share = ids.agg(F.avg(F.col("y").cast("double"))).first()[0]
    drawn = [r for y in (0, 1) for r in ids.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class).collect()]
    if not drawn:
        return [], np.zeros(0, int), share
    chosen = docs.sparkSession.createDataFrame([(r["id"], r["y"]) for r in drawn], "id long, y int")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where(F.length("text").between(1, most_chars)).join(F.broadcast(chosen), "id").dropDuplicates(["id"]).collect()
    rows.sort(key=lambda r: r["id"])
    return [r["text"] for r in rows], np.array([r["y"] for r in rows]), share


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-6, steps: int = 100) -> np.ndarray:
    """Weights, the intercept last, of a logistic regression by damped Newton steps. One class only gives its smoothed rate."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if not len(y):
        return w
    rate = (y.sum() + 1) / (len(y) + 2)
    w[-1] = np.log(rate / (1 - rate))
    if y.min() == y.max():
        return w
    ridge = np.full(len(w), penalty * len(y))
    ridge[-1] = 0

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(ridge * w * w))

    at = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > at:
            size /= 2
        w = w - size * step
        now = loss(w)
        if at - now < 1e-9 * (1 + abs(at)):
            break
        at = now
    return w
