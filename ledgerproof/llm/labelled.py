"""Training rows for the two classifiers: a bounded, repeatable sample of the labels that may be learned from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows whose checksum leaves 0 by this are held out.
FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def candidates(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, label of the rows that may be learned from: not held out, with a doc_id and a label."""
    return labels.select("doc_id", F.col(label).alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())


def learnable(docs: DataFrame, labels: DataFrame, label: str) -> dict[int, int]:
    """How many documents of docs (doc_id) each label may be learned from, sampled or not."""
    rows = candidates(labels, label).groupBy("doc_id").agg(F.min("label").alias("label"))
    return {r["label"]: r["n"] for r in rows.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("label").agg(F.count("*").alias("n")).collect()}


def weights(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Of each sampled row with label y the number of learnable rows it stands for, so that the mix of labels is theirs;
    scaled to a mean of 1, as the fits add fixed amounts to their sums."""
    w = np.ones(len(y))
    for v, n in counts.items():
        if (y == v).any():
            w[y == v] = n / (y == v).sum()
    return w / w.mean() if len(w) else w


def sample(labels: DataFrame, label: str, most: dict[int, int]) -> DataFrame:
    """doc_id, label of at most most[v] rows with label v, the first in the order of a hash; rows that are held out, or
    lack a doc_id or label, are no candidates."""
    rows = candidates(labels, label)
    parts = [rows.filter(F.col("label") == v).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(n) for v, n in most.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.dropDuplicates(["doc_id"])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 30, weight: np.ndarray | None = None) -> np.ndarray:
    """Newton's method; the first column of x is the constant; a row counts as often as its weight says."""
    each = np.ones(len(y)) if weight is None else weight
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (each * (p - y)) + ridge * w
        w -= np.linalg.solve((x.T * (each * p * (1 - p) + 1e-9)) @ x + ridge * np.eye(len(w)), slope)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
