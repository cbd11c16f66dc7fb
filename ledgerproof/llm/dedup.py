"""Exact deduplication with two passes over Bloom bits, in DataFrame functions only.

Texts are equal when they are after deleting white space; their SHA-256 stands for them. The first
pass has every row set HASHES bits of a filter (about BITS_PER_ROW bits per row) and counts how often
each bit is set; the bits set more than once form the second filter, kept as 4 KB bitmaps. The second
pass tests every row against it: only rows whose bits are all there may be repeated, and only those
are shuffled and grouped; the others pass straight through, texts and all.

The filter is broadcast while it has at most BROADCAST_BITMAPS bitmaps; beyond that rows meet their
bitmaps in a join, which adaptive execution may split. Bits are counted with a combining step in each
task, so a hash that a third of all rows share arrives once per task.

Edge cases: a null text counts as empty; empty and all-white texts are one group; a null doc_id loses
a tie against any other; rows that repeat a doc_id with equal text count in group_size and share its
verdict (drop_repeats keeps one of them); other columns stay as they are, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerproof.session import materialise

# Bits of the filter per row of the table, and bits that each row sets.
BITS_PER_ROW = 16
HASHES = 2
# A bitmap of Spark's bitmap functions has 32,768 bits.
BITMAP_BITS = 32_768
# Bitmaps (4 KB each) that are sent to every executor at most.
BROADCAST_BITMAPS = 8_192

# The characters that are deleted before texts are compared.
DELETED = " \t\n\x0b\f\r"


def normalised(text) -> F.Column:
    return F.translate(F.coalesce(text, F.lit("")), DELETED, "")


DIGEST, POINTS, BEST, SIZE = "__dedup_digest", "__dedup_points", "__dedup_best", "__dedup_size"


def with_digest(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.withColumns({DIGEST: F.sha2(normalised(text).cast("binary"), 256), POINTS: F.coalesce(F.length(text), F.lit(0))})


def places(n_bits: int) -> list[F.Column]:
    """The bits of a row: parts of its digest, which is uniform."""
    return [F.pmod(F.conv(F.substring(DIGEST, 1 + 15 * i, 15), 16, 10).cast("long"), F.lit(n_bits)) for i in range(HASHES)]


def repeated_bits(digests: DataFrame, n_bits: int) -> DataFrame:
    """First pass. The second filter: bucket, bitmap of the bits that more than one row sets."""
    once = digests.select(F.explode(F.array_distinct(F.array(*places(n_bits)))).alias("bit")).groupBy("bit").agg(F.count("*").alias("n"))
    bitmaps = once.filter("n > 1").groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bitmap"))
    return materialise(bitmaps, "bloom")


def with_test(rows: DataFrame, filter_: DataFrame, n_bits: int) -> DataFrame:
    """Second pass: rows with MAYBE, false only if no other row has the same digest."""
    small, hits = filter_.count() <= BROADCAST_BITMAPS, []
    columns = rows.columns
    for i, place in enumerate(places(n_bits)):
        bit, bucket, bitmap = (f"__dedup_{x}_{i}" for x in ("bit", "bucket", "bitmap"))
        own = filter_.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap))
        rows = rows.withColumn(bit, place).withColumn(bucket, F.expr(f"bitmap_bucket_number({bit})"))
        rows = rows.join(F.broadcast(own) if small else own, bucket, "left")
        at = f"bitmap_bit_position({bit})"
        byte = f"cast(conv(hex(substring({bitmap}, cast({at} div 8 as int) + 1, 1)), 16, 10) as int)"
        hits.append(f"coalesce(getbit({byte}, cast({at} % 8 as int)) = 1, false)")
    return rows.select(*[F.col(f"`{c}`") for c in columns], F.expr(" and ".join(hits)).alias(MAYBE))


MAYBE = "__dedup_maybe"


def decided(docs: DataFrame, with_columns: bool) -> DataFrame:
    """Rows with DIGEST, BEST (doc_id of the row of its group that stays) and SIZE (rows of the group), either of
    doc_id alone or with all columns of docs, texts too.

    Of equal texts the row with the most code points stays, then the smallest doc_id.
    """
    digests = materialise(with_digest(docs).select("doc_id", DIGEST, POINTS), "digests")
    n_bits = max(1, -(-digests.count() * BITS_PER_ROW // BITMAP_BITS)) * BITMAP_BITS
    filter_ = repeated_bits(digests, n_bits)
    rank = F.struct((-F.col(POINTS)).alias("points"), F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("doc_id"))
    groups = with_test(digests, filter_, n_bits).filter(MAYBE).groupBy(DIGEST).agg(F.min(rank).alias("best"), F.count("*").alias(SIZE))
    groups = groups.select(DIGEST, F.col("best.doc_id").alias(BEST), SIZE)
    rows = with_test(with_digest(docs) if with_columns else digests, filter_, n_bits)
    single = rows.filter(~F.col(MAYBE)).withColumns({BEST: F.col("doc_id"), SIZE: F.lit(1).cast("long")})
    return rows.filter(MAYBE).join(groups, DIGEST).unionByName(single)


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    rows = decided(docs.select("doc_id", "text"), with_columns=False)
    return rows.select("doc_id", F.col(BEST).alias("keep_id"), F.col(SIZE).alias("group_size"), F.col("doc_id").eqNullSafe(F.col(BEST)).alias("kept"), F.col(DIGEST).alias("text_sha256"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The rows that stay, one of each group, with all their columns. Only possibly repeated rows are shuffled."""
    rows = decided(docs, with_columns=True).filter(F.col("doc_id").eqNullSafe(F.col(BEST)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = rows.filter(F.col(SIZE) == 1).select(*columns)
    return rows.filter(F.col(SIZE) > 1).dropDuplicates([DIGEST]).select(*columns).unionByName(single)
