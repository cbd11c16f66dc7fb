"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled rows: the ordinary one holds the words that most ordinary
documents use, the toxic one holds the same and, nearest to the data, the words that toxic documents use far
more often than ordinary ones (by document counts). A window is one word between two spaces; its distance is
how many bytes shorter it gets with the toxic dictionary. A document is described by how many of its windows
reach each distance; weights over these counts are calibrated by logistic regression on the same rows.
Distances of words are kept in a bounded cache, so most windows are compressed once per worker.

The fit uses at most SAMPLE_TOXIC + SAMPLE_ORDINARY labelled rows, weighted to the mix of all that may be learned from; its result, a few tens of kilobytes, is
sent to the executors. Scores cover every window of every text.

Edge cases: a null or empty text has no window and gets the score of that (well below 0.5 unless almost all
labels are toxic); without toxic or without ordinary labels every score is the share of toxic labels (0.0
without labels); a null doc_id is not held out; repeated rows give repeated results; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerproof.llm.labelled import held_out, learnable, logistic, sample, sigmoid, weights
from ledgerproof.llm.parts import MARKS, Kept, text_slices
from ledgerproof.llm.ship import ship

# Bounds of the labelled sample.
SAMPLE_TOXIC, SAMPLE_ORDINARY = 3_000, 6_000
# Words of the ordinary dictionary; a word must be in so many toxic rows, so many times likelier there than in
# ordinary rows, with such a z-value, to be in the toxic one.
COMMON_WORDS, MIN_ROWS, MIN_RATIO, MIN_Z = 4_000, 3, 4.0, 5.0
LEVEL = 12
# Distances are counted in bytes, from 1 to this.
FARTHEST = 8

TO_SPACE = str.maketrans({c: " " for c in MARKS})
SCORED = "doc_id long, score double"


def windows(text: str) -> list[str]:
    return text.lower().translate(TO_SPACE).split()


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float]

    def score(self, counts: np.ndarray) -> np.ndarray:
        return sigmoid(features(counts) @ np.array(self.weights))


def features(counts: np.ndarray) -> np.ndarray:
    """Of the numbers of windows by distance 0..FARTHEST, a row per document."""
    reach = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1].astype(float)
    any_, two = (reach[:, 4:7] >= 1).astype(float), (reach[:, 4:6] >= 2).astype(float)
    return np.column_stack([np.ones(len(counts)), np.log1p(reach[:, 1:7]), np.log1p(reach[:, 0]), any_, two])


class Distances:
    """Distances of windows, kept by word."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        form = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        compress = []
        for content in (ordinary, toxic):
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=LEVEL)
            compress.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=form).compress)
        self.compress = compress
        self.of = Kept(self.distance)

    def distance(self, word: str) -> int:
        window = f" {word} ".encode()
        a, b = (len(c(window)) for c in self.compress)
        return min(max(a - b, 0), FARTHEST)

    def counts(self, text: str) -> list[int]:
        seen = Counter(map(self.of.__getitem__, windows(text)))
        return [seen[d] for d in range(FARTHEST + 1)]


def fit(texts: list[str], toxic: list[int], counts: dict[int, int] | None = None) -> Model:
    """counts: learnable rows by label, if texts is a sample that holds the labels in other shares."""
    y = np.array(toxic, float)
    weight = weights(y, counts or {})
    rows: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in zip(texts, toxic, strict=True):
        rows[label].update(set(windows(text)))
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    if not n0 or not n1:
        share = np.clip(y.mean() if len(y) else 0.0, 1e-12, 1 - 1e-12)
        return Model(b" ", b" ", [float(np.log(share / (1 - share))), *[0.0] * (features(np.zeros((1, FARTHEST + 1))).shape[1] - 1)])

    def telling(word: str, n: int) -> bool:
        p, q = n / n1, (rows[0][word] + 0.5) / n0
        both = (n + rows[0][word] + 0.5) / (n0 + n1)
        return len(word) > 2 and n >= MIN_ROWS and p >= MIN_RATIO * q and p - q >= MIN_Z * np.sqrt(both * (1 - both) * (1 / n0 + 1 / n1))

    common = [w for w, _ in sorted(rows[0].items(), key=lambda x: (-x[1], x[0]))[:COMMON_WORDS]]
    told = sorted((n, w) for w, n in rows[1].items() if telling(w, n))
    ordinary = f" {' '.join(reversed(common))} ".encode()
    model = Model(ordinary, ordinary + f" {' '.join(w for _, w in told)} ".encode(), [])
    distances = Distances(model.ordinary, model.toxic)
    model.weights = logistic(features(np.array([distances.counts(t) for t in texts])), y, weight=weight).tolist()
    return model


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    chosen = sample(labels, "toxic", {1: SAMPLE_TOXIC, 0: SAMPLE_ORDINARY})
    # At most SAMPLE_TOXIC + SAMPLE_ORDINARY ids.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").select("text", "label").toPandas()
    return fit([t or "" for t in rows["text"]], [int(x) for x in rows["label"]], learnable(docs, labels, "toxic"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        distances = Distances(m.ordinary, m.toxic)
        for batch, texts in text_slices(batches):
            scores = m.score(np.array([distances.counts(t) for t in texts]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
