"""Bounded samples of labelled rows, and the logistic regression that calibrates scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parcelsight.llm.common import held_out

MAX_CLASSES = 200


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, label: str, per_class: int) -> tuple[DataFrame, dict]:
    """Whole rows of `docs` with their `label`: at most `per_class` ids of every label outside the held-out fold,
    drawn by hash, and the number of labelled ids by label.

    Only ids and labels are ranked. The ranking is cut to `per_class` rows per label within every task
    before it is shuffled. The chosen ids are at most per_class * MAX_CLASSES, so they may be broadcast.
    """
    known = (labels.select(F.col(key).cast("bigint").alias("_id"), F.col(label).alias("_label"))
             .where(F.col("_label").isNotNull() & F.col("_id").isNotNull() & ~held_out("_id"))
             .groupBy("_id").agg(F.min("_label").alias("_label")))
    sizes = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).limit(MAX_CLASSES + 1).collect()}
    if len(sizes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} labels")
    order = W.partitionBy("_label").orderBy(F.xxhash64("_id"), "_id")
    chosen = known.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_class).drop("_n")
    rows = docs.select(F.struct("*").alias("row")).join(F.broadcast(chosen), F.col(f"row.{key}") == F.col("_id"))
    return rows.select(F.col("_id").alias("id"), F.col("_label").alias("label"), "row"), sizes


def fit_logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Newton's method with a ridge on all but the constant; columns are scaled inside. Returns the
    coefficients with the constant last."""
    scale = np.maximum(x.std(axis=0), 1e-12)
    a = np.column_stack([x / scale, np.ones(len(x))])
    w, keep = np.zeros(a.shape[1]), np.append(np.full(x.shape[1], ridge * max(1.0, weights.sum())), 1e-9)
    for _ in range(rounds):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(keep),
                               a.T @ (weights * (y - p)) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def prior_weights(y: np.ndarray, sizes: dict) -> np.ndarray:
    """Row weights that give a sample the label frequencies of all labelled rows."""
    total = max(1, sum(sizes.values()))
    out = np.ones(len(y))
    for label in np.unique(y):
        mine = y == label
        out[mine] = sizes.get(label, mine.sum()) / total * len(y) / mine.sum()
    return out
