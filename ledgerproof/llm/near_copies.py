"""Near copies for the pipeline: SimHash's links, and all that share four fifths of their five-word shingles.

A radius of four bits reaches nearly identical texts only, and texts that share 0.8 of their shingles differ in
about ten bits, which no ball of a payable size covers. So these are met by MinHash: BANDS bands of ROWS minima
each; two texts with a similarity of 0.8 share a band with probability 1 - 2e-5, closer ones with more. Every pair
that shares a band is verified by the exact Jaccard similarity of its shingles, unless other links join it already.

Texts with equal words (A-Z in lower case) are one node, named by the XXH64 of these words. Pairs are tried in
rounds: first each band's nodes with the one that meets most others, so a crowd of copies costs a pair per node; then the nodes
that share a band and still are apart meet by their rarest shingles, as many as two similar texts cannot all miss (an exact
bound), and not by band: a crowd that shares most of its shingles, but less than 0.8, hardly meets that way. A pair is tried once.

Edge cases as in `simhash`: a null or wordless text has no shingle and meets no other by MinHash; equal words are linked whatever
their doc_ids; a null doc_id is no component's id unless nothing else is in it, and its row goes before any other; rows that share a doc_id are
judged one by one; other columns are not read by near_groups() and are kept by drop_near(); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerproof.llm.components import components
from ledgerproof.llm.parts import byte_slices, then_give_back
from ledgerproof.llm.ship import ship
from ledgerproof.llm.simhash import SEED, fingerprint, keep_least, near_links, node, shingle_hashes
from ledgerproof.session import broadcast_if_small, materialise

SHINGLE = 5
# Similarity that is reached, in tenths.
TENTHS = 8
BANDS, ROWS = 60, 8
# Rounds with one node per band, and the pairs per member of a band up to which all are tried at once.
STAR_ROUNDS, PAIRS_PER_MEMBER = 1, 4
# Shingles multiplied at once.
CHUNK = 512
# Odd, so that multiplying permutes the 64-bit hashes.
FACTORS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
MEASURED = "doc_id long, fp long, node long, bands array<long>"


def shingles(words: list[bytes]) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(words, SHINGLE), np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """A hash of the minima of each band, unsigned."""
    if not len(hashes):
        return []
    least = np.full(len(FACTORS), 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), CHUNK):
        np.minimum(least, (hashes[i : i + CHUNK, None] * FACTORS).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, fp (SimHash), node, bands of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_slices(batches):
            fps, met = [], []
            for text in texts:
                fps.append(fingerprint(text))
                met.append(np.array(bands(shingles(text.encode().lower().split())), np.uint64).view(np.int64))
            fps = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.record_batch([batch.column("doc_id"), fps, batch.column("node"), pa.array(met, pa.list_(pa.int64()))], ["doc_id", "fp", "node", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), node().alias("node"), "text").mapInArrow(then_give_back(run), MEASURED)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles (distinct hashes) of the nodes of wanted (node). Only their texts leave the JVM, and in a stage of
    their own: two Python passes in one stage would keep two workers a task."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_slices(batches):
            found = [shingles(t.encode().lower().split()).view(np.int64) for t in texts]
            yield pa.record_batch([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])

    rows = docs.select(node().alias("node"), "text")
    rows = rows.join(broadcast_if_small(wanted, wanted.count()), "node", "left_semi").dropDuplicates(["node"])
    return materialise(rows.mapInArrow(then_give_back(sets), "node long, shingles array<long>"), "near_sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that are similar."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    rows = pairs.join(x, "a").join(y, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    return rows.filter(10 * F.col("both") >= TENTHS * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b")


def simhash_links(nodes: DataFrame) -> DataFrame:
    """Links a, b among nodes (node, fp) whose fingerprints are equal or near."""
    least = materialise(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    same = nodes.join(least, "fp").select(F.col("node").alias("a"), F.col("least").alias("b")).filter("a != b")
    at_a, at_b = (least.select(F.col("fp").alias(x), F.col("least").alias(f"node_{x}")) for x in "ab")
    near = near_links(least.select("fp")).join(at_a, "a").join(at_b, "b")
    return materialise(same.unionByName(near.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))), "near_links")


def rarest(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root, n, at, shingle: the rarest shingles of each of nodes (node, root), by their place `at` among its n.

    Two similar texts share one of them: of m shingles all but n * TENTHS / 10 are taken, and one more. Shingles that no
    other of nodes has count as places, but are left out.
    """
    each = sets.join(nodes, "node").select("node", "root", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle"))
    held = each.groupBy("shingle").agg(F.count("*").alias("of"))
    ranked = each.join(held, "shingle").groupBy("node", "root", "n").agg(F.array_sort(F.collect_list(F.struct("of", "shingle"))).alias("ranked"))
    taken = F.slice("ranked", F.lit(1), (F.floor((10 - TENTHS) * F.col("n") / 10) + 1).cast("int"))
    placed = ranked.select("node", "root", "n", F.posexplode(taken).alias("at", "held"))
    return placed.filter("held.of > 1").select("node", "root", "n", F.col("at").cast("long").alias("at"), F.col("held.shingle").alias("shingle"))


def meeting_pairs(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs a, b of nodes (node, root) of different roots that may be similar: they share one of their rarest shingles, and
    what follows it in both leaves room for the similarity.

    Of the pairs at a shingle one node at least is not of the root that most have there, so these are joined with all: a
    large component that meets few others costs its size, not its square.
    """
    rows = materialise(rarest(sets, nodes), "near_rarest")
    roots = rows.groupBy("shingle", "root").agg(F.count("*").alias("k"))
    most = roots.groupBy("shingle").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("k", "root")).alias("most")).filter("roots > 1")
    few = rows.join(most, "shingle").filter("root != most")
    few = few.select("shingle", F.col("node").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"), F.col("at").alias("ax"))
    left = F.least(F.col("n") - F.col("at"), F.col("nx") - F.col("ax"))
    room = (10 + TENTHS) * left >= TENTHS * (F.col("n") + F.col("nx"))
    pairs = few.join(rows, "shingle").filter((F.col("root") != F.col("rx")) & room)
    return pairs.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")).distinct()


def similar_links(docs: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """links, and those verified among nodes (node, bands), as far as they connect what isn't connected yet."""
    members = nodes.select(F.explode("bands").alias("band"), "node")
    crowded = materialise(members.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1"), "bands")
    members = members.join(broadcast_if_small(crowded, crowded.count()), "band")
    # The node that meets most others is nearest to them, so it is tried first. (A node has a row per band at most.)
    weight = F.sum("m").over(Window.partitionBy("node"))
    members = materialise(members.withColumn("weight", weight).drop("m"), "members")
    sets = sets_of(docs, materialise(members.select("node").distinct(), "met"))
    tried, found = None, 1
    for turn in range(STAR_ROUNDS + 1):
        # The first round takes no link as given, as its pairs cost less than the components.
        placed = members.withColumn("root", F.col("node"))
        if turn:
            placed = members.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        rank = F.struct(-F.col("weight"), F.xxhash64("node"))
        sizes = placed.groupBy("band", "root").agg(F.count("*").alias("k"), F.min(F.struct(rank.alias("rank"), "node")).alias("first"))
        sizes = sizes.groupBy("band").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("squares"), F.count("*").alias("roots"), F.min("first")["node"].alias("hub"))
        split = materialise(sizes.filter("roots > 1"), "split_bands")
        n, cross = split.agg(F.sum("m"), F.sum((F.col("m") * F.col("m") - F.col("squares")) / 2)).first()
        if not n:
            return links
        every = turn == STAR_ROUNDS or not found or cross <= PAIRS_PER_MEMBER * n
        here = placed.join(broadcast_if_small(split.select("band", "hub"), split.count()), "band")
        if every:
            pairs = meeting_pairs(sets, materialise(here.select("node", "root").distinct(), "placed"))
        else:
            here = materialise(here.select("band", "hub", "node", "root"), "placed")
            hubs = here.filter("node = hub").select("band", F.col("node").alias("x"), F.col("root").alias("rx"))
            pairs = here.join(hubs, "band").filter(F.col("root") != F.col("rx"))
            pairs = pairs.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "near_pairs")
        new = materialise(verified(pairs, sets), "near_links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links, found = links.unionByName(new), new.count()
        if every:
            return links


def near_roots(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, node of every row, and node, root of the nodes that are linked with another."""
    rows = materialise(measured(docs), "near_measured")
    nodes = materialise(rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("fp", "bands"))), "near_nodes")
    return rows.select("doc_id", "node"), components(similar_links(docs, nodes, simhash_links(nodes)))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, component_id (the least doc_id reachable) of every row."""
    rows, roots = near_roots(docs)
    placed = materialise(rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "near_placed")
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "root").select("doc_id", "component_id")


def drop_near(docs: DataFrame) -> DataFrame:
    """One row of every component, that of its least doc_id, with all columns."""
    return keep_least(docs, near_roots(docs)[1])
