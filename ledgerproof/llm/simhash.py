"""SimHash near-duplicates by meeting in the middle.

Two fingerprints with at most RADIUS differing bits have a common variant that differs from each in at most
half as many. So every distinct fingerprint stands for all variants within that half, variants are brought
together by a shuffle, and fingerprints that share one are linked. The variants are emitted packed: those of
one fingerprint that begin with the same `prefix_bits` bits travel as one row (prefix, fingerprint), and the
task that gets a prefix writes them out in numpy, sorts them and takes the equal ones. The number of bits
grows with the number of fingerprints, so a prefix holds about PER_PREFIX of them; where near copies crowd,
a prefix is cut further, bit by bit, until its variants fit BLOCK.

Copies share a fingerprint and are one row before anything is emitted. Within a prefix only a spanning set of
verified links is kept; components over all links come from `components`.

Edge cases: a null or wordless text has fingerprint zero, linked like any other; a text with fewer words than
a shingle is one shingle; a null doc_id can't be a component's id unless nothing else is in it; rows that repeat
a doc_id have one result each, and drop_near() judges them one by one; other columns are not read by near_groups() and are kept by drop_near(); an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerproof.llm.components import components
from ledgerproof.llm.parts import text_slices
from ledgerproof.llm.ship import ship
from ledgerproof.session import broadcast_if_small, materialise

SHINGLE = 4
SEED = 42
RADIUS = 4
PER_PREFIX = 256
# Variants that a task holds at once (8 bytes each, and as much again for sorting).
BLOCK = 4_000_000
BITS = 64


def shingle_hashes(words: list[bytes], shingle: int, seed: int = SEED) -> list[int]:
    """XXH64 of every run of `shingle` words, or of all words if there are fewer."""
    if not words:
        return []
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - k].tolist()]
    return [xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)]


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 majority bits over the XXH64 of all shingles of a text's words, A-Z in lower case."""
    hashes = shingle_hashes(text.encode().lower().split(), shingle, seed)
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            fps = np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


# -- meeting of variants


def ball(bits: int, flips: int) -> np.ndarray:
    """All masks of at most `flips` of the lowest `bits` bits."""
    masks, last = [np.zeros(1, np.uint64)], [(0, -1)]
    for _ in range(flips):
        last = [(m | 1 << i, i) for m, top in last for i in range(top + 1, bits)]
        masks.append(np.array([m for m, _ in last], np.uint64))
    return np.concatenate(masks)


class Meeting:
    """Links among fingerprints of which each has some flips left in its lowest bits."""

    def __init__(self, fps: np.ndarray, radius: int):
        self.fps, self.radius = fps, radius
        self.balls: dict[tuple[int, int], np.ndarray] = {}
        self.label = np.arange(len(fps))

    def masks(self, bits: int, flips: int) -> np.ndarray:
        if (bits, flips) not in self.balls:
            self.balls[bits, flips] = ball(bits, flips)
        return self.balls[bits, flips]

    def meet(self, at: np.ndarray, left: np.ndarray, bits: int) -> None:
        """at: places in fps; left: flips each still has; bits: those not settled yet."""
        if len(at) < 2:
            return
        sizes = {f: len(self.masks(bits, f)) * int((left == f).sum()) for f in range(int(left.max()) + 1)}
        if sum(sizes.values()) > BLOCK and bits > 0:
            bits -= 1  # settle the next bit, as 0 and as 1
            own = (self.fps[at] >> np.uint64(bits) & np.uint64(1)).astype(np.int64)
            for value in (0, 1):
                cost = own ^ value
                stay = left >= cost
                self.meet(at[stay], (left - cost)[stay], bits)
            return
        low = np.uint64((1 << bits) - 1)
        values, origins = [], []
        for f in sizes:
            of = at[left == f]
            masks = self.masks(bits, f)
            values.append(((self.fps[of] & low)[:, None] ^ masks).ravel())
            origins.append(np.repeat(of, len(masks)))
        value, origin = np.concatenate(values), np.concatenate(origins)
        ordered = np.sort(value)
        shared = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(shared):
            return
        shared = shared[np.concatenate([[True], shared[1:] != shared[:-1]])]
        hit = shared[np.minimum(np.searchsorted(shared, value), len(shared) - 1)] == value
        value, origin = value[hit], origin[hit]
        order = np.argsort(value, kind="stable")
        value, origin = value[order], origin[order]
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        head = origin[np.repeat(first, np.diff(np.append(first, len(value))))]
        pairs = np.unique(head * len(self.fps) + origin)
        a, b = pairs // len(self.fps), pairs % len(self.fps)
        near = np.bitwise_count(self.fps[a] ^ self.fps[b]) <= self.radius
        self.join(a[near], b[near])

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Least labels along the links, until they agree."""
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            low = np.minimum(x, y)
            np.minimum.at(label, np.maximum(x, y), low)
            while (label[label] != label).any():
                label[:] = label[label]


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links a, b among the fingerprints of `distinct` (fp) that connect all with at most `radius` differing bits."""
    half = radius // 2
    n = distinct.count()
    prefix_bits = min(BITS // 2, max(4, (n // PER_PREFIX).bit_length()))
    masks = F.array(*[F.lit(int(m)) for m in ball(prefix_bits, half).tolist()])
    own = F.expr(f"shiftrightunsigned(fp, {BITS - prefix_bits})")
    rows = distinct.select("fp", F.explode(masks).alias("mask")).select("fp", own.bitwiseXOR(F.col("mask")).alias("prefix"))

    ship(distinct.sparkSession)

    def link(key: tuple, table: pa.Table) -> pa.Table:
        fps = np.unique(table.column("fp").to_numpy()).view(np.uint64)
        (prefix,) = (x.as_py() for x in key)
        used = np.bitwise_count(fps >> np.uint64(BITS - prefix_bits) ^ np.uint64(prefix)).astype(np.int64)
        meeting = Meeting(fps, radius)
        meeting.meet(np.arange(len(fps)), half - used, BITS - prefix_bits)
        linked = np.flatnonzero(meeting.label != np.arange(len(fps)))
        return pa.table({"a": fps[linked].view(np.int64), "b": fps[meeting.label[linked]].view(np.int64)})

    return rows.groupBy("prefix").applyInArrow(link, "a long, b long")


def grouped(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, component_id (the least doc_id reachable) of every fingerprint of rows (doc_id, fp)."""
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "fingerprints")
    roots = components(near_links(distinct.select("fp"), radius))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "root").select("fp", "component_id")


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    rows = materialise(fingerprints(docs), "simhash")
    return rows.join(grouped(rows, radius), "fp").select("doc_id", "fp", "component_id")


# What the JVM side takes for white space and letters, as bytes.split() and bytes.lower() do.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def node() -> F.Column:
    """The XXH64 (seed 42) of a text's words, A-Z in lower case, space-joined: what a fingerprint is a function of."""
    words = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower()), BLANKS, " ")
    return F.xxhash64(F.trim(words))


def drop_near(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of every component, with all columns."""
    rows = near_groups(docs.select(node().alias("doc_id"), "text"), radius)
    return keep_least(docs, rows.select(F.col("doc_id").alias("node"), F.col("component_id").alias("root")).distinct())


def keep_least(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """One row of docs of every component of roots (node, root; a node that isn't there is alone), that of the least doc_id
    (null last), then of the least node. Of rows that agree in both the one with the least text stays.

    A row is known by its doc_id and its words together, so rows that share a doc_id and not their words are
    judged apart. Verdicts are broadcast while they are few enough, so texts are not shuffled; beyond that a join meets them.
    """
    pairs = docs.select("doc_id", node().alias("words")).groupBy("doc_id", "words").agg(F.count("*").alias("n"))
    own = roots.select(F.col("node").alias("words"), "root")
    placed = materialise(pairs.join(own, "words", "left").withColumn("root", F.coalesce("root", "words")), "near_placed")
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "words")).alias("first"))
    judged = placed.join(first, "root").withColumn("gone", ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("words") != F.col("first.words")))
    judged = judged.filter("gone or n > 1").select(F.col("doc_id").alias("__near_id"), F.col("words").alias("__near_node"), F.col("gone").alias("__near_gone"))
    judged = materialise(judged, "near_copies")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumn("__near_own", node())
    match = F.col("doc_id").eqNullSafe(F.col("__near_id")) & (F.col("__near_own") == F.col("__near_node"))
    rows = rows.join(broadcast_if_small(judged, judged.count()), match, "left")
    single = rows.filter("__near_gone is null").select(*columns)
    if judged.filter("not __near_gone").isEmpty():
        return single
    row = F.min_by(F.struct(*columns), F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*columns))).alias("row")
    return single.unionByName(rows.filter("not __near_gone").groupBy("__near_id", "__near_node").agg(row).select("row.*"))
