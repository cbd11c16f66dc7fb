"""Pages at any depth of a long listing.

`offset` gathers all rows before a page. Here the listing is written once in sorted ranges, one directory each, beside
an index of one row per range: how many rows come before it. A page then reads the ranges it lies in, and no others;
a task numbers the rows of one range. `after` goes on from the last row seen instead, without any index.

The order must be total (end with a unique column), or rows that tie may change places between two builds.

Edge cases: NULLs go where the order says; a page beyond the end and any page of an empty table are empty; repeated
rows are rows of their own; a page number below 1 or a size below 1 is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerproof.operators.sequence import Sort
from ledgerproof.session import materialise, shared_dir

# Rows of a range, about: bounds are sampled. A page costs one such range, and a table of n rows n / RANGE_ROWS directories.
RANGE_ROWS = 1_000_000
RANGE, START, ROWS, RANK = "__range", "start", "rows", "rank"


@dataclass(frozen=True)
class Listing:
    """A sorted listing on disk (path, schema, order) and its index: RANGE, START, ROWS of each range that has rows."""

    path: str
    table: DataFrame
    order: tuple[Sort, ...]
    index: DataFrame

    def total(self) -> int:
        return self.index.agg(F.coalesce(F.sum(ROWS), F.lit(0))).first()[0]

    def page(self, number: int, size: int = 50) -> DataFrame:
        """Rows (number - 1) * size and on, `size` at most, in order, with their RANK from 0."""
        if number < 1 or size < 1:
            raise ValueError(f"page {number} of {size} rows")
        first = (number - 1) * size
        inside = (F.col(START) < first + size) & (F.col(START) + F.col(ROWS) > first)
        # Every range of the index has a row of this page, so there are at most `size`.
        hits = self.index.filter(inside).select(RANGE, START).collect()
        spark, columns = self.table.sparkSession, [c for c in self.table.columns if c != RANGE]
        if not hits:
            return self.table.limit(0).withColumn(RANK, F.lit(0).cast("long")).drop(RANGE)
        folders = [f"{self.path}/{RANGE}={r[RANGE]}" for r in hits]
        rows = spark.read.schema(self.table.schema).option("basePath", self.path).parquet(*folders)
        start = F.broadcast(spark.createDataFrame(hits, f"{RANGE} int, {START} long"))
        place = F.row_number().over(W.partitionBy(RANGE).orderBy(*[s.order() for s in self.order]))
        rows = rows.withColumn(RANK, place).join(start.withColumnRenamed(START, "__start"), RANGE)
        rows = rows.withColumn(RANK, F.col("__start") + F.col(RANK) - 1)
        return rows.filter((F.col(RANK) >= first) & (F.col(RANK) < first + size)).orderBy(RANK).select(*[F.col(f"`{c}`") for c in columns], RANK)


def listing(df: DataFrame, order: Sequence[Sort], range_rows: int = RANGE_ROWS) -> Listing:
    """Write df in sorted ranges of about range_rows rows. df must have no column RANGE, RANK or __start."""
    clash = {RANGE, RANK, "__start"} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are taken by the listing")
    path = f"{shared_dir(df.sparkSession)}/listing-{uuid.uuid4().hex}"
    keys = [s.order() for s in order]
    ranges = max(1, -(-df.count() // range_rows))
    ranged = df.repartitionByRange(ranges, *keys).withColumn(RANGE, F.spark_partition_id())
    ranged.sortWithinPartitions(RANGE, *keys).write.partitionBy(RANGE).parquet(path)
    table = df.sparkSession.read.schema(ranged.schema).parquet(path)
    counts = table.groupBy(RANGE).agg(F.count("*").alias(ROWS))
    # One row per range.
    before = F.sum(ROWS).over(W.orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1))
    index = counts.withColumn(START, F.coalesce(before, F.lit(0)))
    return Listing(path, table, tuple(order), materialise(index, "listing_index"))


def _beyond(key: Sort, value) -> Column:
    """Whether a row's key comes after value."""
    col = F.expr(key.expr)
    first = key.nulls_first and not key.desc
    if value is None:
        return col.isNotNull() if first else F.lit(False)
    # NULL for a NULL key, which a filter reads as false; coalesce would keep it from the scan.
    later = col < F.lit(value) if key.desc else col > F.lit(value)
    return later if first else later | col.isNull()


def after(df: DataFrame, order: Sequence[Sort], last: Mapping[str, object] | None, size: int = 50) -> DataFrame:
    """The next `size` rows after the row whose keys (by expression) are `last`; the first ones if it is None. Each task
    keeps `size` rows, and the condition on the first key reaches the scan."""
    if last is not None:
        past, same = [], F.lit(True)
        for key in order:
            past.append(same & _beyond(key, last[key.expr]))
            same = same & F.expr(key.expr).eqNullSafe(F.lit(last[key.expr]))
        head = order[0]
        df = df.filter(_beyond(head, last[head.expr]) | F.expr(head.expr).eqNullSafe(F.lit(last[head.expr]))).filter(reduce(Column.__or__, past))
    return df.orderBy(*[s.order() for s in order]).limit(size)
