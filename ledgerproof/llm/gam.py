"""Quality by a generalised additive model with pairwise interactions.

Statistics of a text (the quality rules' and a few more) are cut into bins. Cyclic boosting visits one
statistic after another, fits a shallow tree (two cuts) to the residuals of the logistic loss over its bins
and adds it, shrunk, to that statistic's lookup table; then the same for the pairs that explain most of what
is left, on coarse grids. A score is a sum of table entries, added for a whole batch at once.

The fit uses at most SAMPLE_GOOD + SAMPLE_BAD labelled rows, a few numbers each, weighted to the mix of all that may be learned from; the tables, a few tens of
kilobytes, are sent to the executors.

Edge cases: a null or empty text has all statistics 0 and is scored by them; without good or without bad
labels every score is the share of good labels (0.5 without labels); a null doc_id is not held out; repeated
rows give repeated results; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerproof.llm.labelled import held_out, learnable, sample, sigmoid, weights
from ledgerproof.llm.parts import text_slices
from ledgerproof.llm.quality_rules import BLANKS, COUNTS, RULES, measure
from ledgerproof.llm.ship import ship
from ledgerproof.session import materialise

# Bounds of the labelled sample.
SAMPLE_GOOD, SAMPLE_BAD = 30_000, 10_000
BINS, GRID = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 40, 6
RATE = 0.15
# Rows that a leaf needs, and what is added to its curvature.
MIN_LEAF, RIDGE = 5, 1.0

STATISTICS = (*RULES, "log_words", "digit_share", "lower_share", "distinct_share", "line_length", "stop_share", "bar_share")
MEASURED = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)
LOWER, DIGITS, STOPS = (bytes(x) for x in (range(ord("a"), ord("z") + 1), range(ord("0"), ord("9") + 1), b".,;:?"))


def statistics(text: str) -> list[float]:
    own = measure(text)
    n, chars = own[0], own[1]
    if not n:
        return [0.0] * len(STATISTICS)
    data = text.encode()
    share = [(len(data) - len(data.translate(None, kind))) / len(data) for kind in (DIGITS, LOWER)]
    lines = sum(1 for line in text.split("\n") if line.strip(BLANKS))
    stops = len(data) - len(data.translate(None, STOPS))
    return [*own[len(COUNTS) :], float(np.log1p(n)), *share, len(set(data.split())) / n, n / lines, stops / chars, text.count("|") / n]


@dataclass
class Gam:
    start: float
    # Upper edges of all bins but the last, per statistic, fine and coarse.
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for i, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[i], x[:, i], "right")]
        for (i, j), table in self.pairs.items():
            total += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return sigmoid(total)


def cut(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="higher"))


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins, (0, 0) if there is none."""
    if len(g) < 2:
        return 0.0, 0
    left = [np.cumsum(x)[:-1] for x in (g, h, n)]
    right = [x.sum() - c for x, c in zip((g, h, n), left, strict=True)]
    gains = np.where((left[2] >= MIN_LEAF) & (right[2] >= MIN_LEAF), gain(*left[:2]) + gain(*right[:2]) - gain(g.sum(), h.sum()), 0.0)
    k = int(gains.argmax())
    return float(gains[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Newton steps of a tree with at most two cuts over ordered bins."""
    leaves = [(0, len(g))]
    for _ in range(2):
        found = [(*best_cut(g[a:b], h[a:b], n[a:b]), a, b) for a, b in leaves]
        value, k, a, b = max(found)
        if value <= 1e-9:
            break
        leaves.remove((a, b))
        leaves += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def fit(x: np.ndarray, y: np.ndarray, counts: dict[int, int] | None = None) -> Gam:
    """counts: learnable rows by label, if the rows are a sample that holds the labels in other shares."""
    w = weights(y, counts or {})
    share = np.clip(np.average(y, weights=w) if len(y) else 0.5, 1e-12, 1 - 1e-12)
    model = Gam(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    model.edges = [cut(c, BINS) for c in x.T]
    model.coarse = [cut(c, GRID) for c in x.T]
    fine = [np.searchsorted(e, c, "right") for e, c in zip(model.edges, x.T, strict=True)]
    grid = [np.searchsorted(e, c, "right") for e, c in zip(model.coarse, x.T, strict=True)]
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    total = np.full(len(y), model.start)
    for _ in range(ROUNDS):
        for i, (b, s) in enumerate(zip(fine, sizes, strict=True)):
            p = sigmoid(total)
            step = RATE * shallow_tree(np.bincount(b, w * (p - y), s), np.bincount(b, w * p * (1 - p), s), np.bincount(b, minlength=s))
            model.tables[i] += step
            total += step[b]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        width = len(model.coarse[j]) + 1
        cell, size = grid[i] * width + grid[j], (len(model.coarse[i]) + 1) * width
        p = sigmoid(total)
        return cell, np.bincount(cell, w * (p - y), size), np.bincount(cell, w * p * (1 - p), size), np.bincount(cell, minlength=size), width

    explained = {(i, j): gain(*sums(i, j)[1:3]).sum() for i, j in combinations(range(x.shape[1]), 2)}
    for i, j in sorted(explained, key=lambda p: (-explained[p], p))[:PAIRS]:
        model.pairs[i, j] = np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1))
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in model.pairs.items():
            cell, g, h, n, width = sums(i, j)
            step = np.where(n >= MIN_LEAF, -RATE * g / (h + RIDGE), 0.0)
            table += step.reshape(-1, width)
            total += step[cell]
    return model


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and STATISTICS of every whole text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            rows = np.array([statistics(t) for t in texts])
            yield pa.record_batch([batch.column("doc_id"), *map(pa.array, rows.T)], ["doc_id", *STATISTICS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MEASURED)


def trained(measured: DataFrame, labels: DataFrame) -> Gam:
    chosen = sample(labels, "quality", {1: SAMPLE_GOOD, 0: SAMPLE_BAD})
    # At most SAMPLE_GOOD + SAMPLE_BAD ids.
    rows = measured.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    return fit(rows[list(STATISTICS)].to_numpy(float).reshape(-1, len(STATISTICS)), rows["label"].to_numpy(float), learnable(measured, labels, "quality"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    measured = materialise(measures(docs), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(trained(measured, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATISTICS])
            yield pa.record_batch([batch.column("doc_id"), pa.array(model.value.score(x))], ["doc_id", "score"])

    rows = measured.mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
