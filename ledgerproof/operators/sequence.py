"""Ordered scans per key that survive a key holding a large part of all rows.

A statement is an ordered run of rows, and most of the work is `lag`, running sum or
"last known value" along it. For ordinary runs that is one window over one hash shuffle.
A run above `hot_rows` would land in a single task, so its rows are range-partitioned on
(key, order) into blocks, written once, scanned per block, and joined with a carry table
of one row per block: exact results, no task larger than a block.

Windows sort on plain columns wherever possible, so windows of one order share one sort.
"""

from __future__ import annotations

import math
from collections.abc import Sequence as Seq
from dataclasses import dataclass, replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerproof.session import BROADCAST_ROWS, broadcast_if_small, materialise

HOT_ROWS = 1_000_000
BLOCK_ROWS = 500_000
BLOCK = "_block"


class Sort(NamedTuple):
    """One sort key: a column (or SQL expression), and where NULLs go."""

    expr: str
    desc: bool = False  # numbers only
    nulls_first: bool = False

    def order(self) -> Column:
        col = F.col(self.expr) if self.expr.isidentifier() else F.expr(self.expr)
        if self.desc:
            return col.desc_nulls_last()
        return col.asc_nulls_first() if self.nulls_first else col.asc_nulls_last()

    def rank(self) -> list[Column]:
        """The same order as ascending values, for comparisons inside structs."""
        col = F.expr(self.expr)
        return [col.isNotNull() if self.nulls_first else col.isNull(), -col if self.desc else col]


# Total orders: the arrival number `seq` ends each of them.
ARRIVAL = (Sort("txn_date"), Sort("seq"))
PRINTED = (Sort("txn_date"), Sort("balance", desc=True), Sort("seq"))
DEBIT_FIRST = (Sort("txn_date"), Sort("CASE WHEN amount < 0 THEN -1 ELSE 1 END"), Sort("balance"), Sort("seq"))


def order_struct(order: Seq[Sort]) -> Column:
    parts = [c for key in order for c in key.rank()]
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(parts)])


@dataclass(frozen=True)
class Ordered:
    """Rows, the key they are grouped by, and their total order within the key."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[Sort, ...]
    blocks: int = 0  # 0: every key fits one task; else the number of range blocks
    hot_keys: int | None = 0  # keys laid out in blocks; None: not known

    @property
    def part(self) -> list[str]:
        return [*self.keys, BLOCK] if self.blocks else list(self.keys)

    @property
    def window(self):
        return W.partitionBy(*self.part).orderBy(*[k.order() for k in self.order])

    @property
    def so_far(self):
        return self.window.rowsBetween(W.unboundedPreceding, W.currentRow)

    @property
    def rank(self) -> Column:
        return order_struct(self.order)

    def over(self, df: DataFrame) -> Ordered:
        return replace(self, df=df)

    def ordered_by(self, order: Seq[Sort]) -> Ordered:
        return replace(self, order=tuple(order))

    def with_column(self, name: str, col: Column) -> Ordered:
        return self.over(self.df.withColumn(name, col))

    @property
    def pieces(self) -> int:
        """Most pairs of key and block: a border between blocks cuts one key."""
        return BROADCAST_ROWS + 1 if self.hot_keys is None else self.hot_keys + self.blocks

    def per_block(self, *aggs: Column) -> DataFrame:
        return self.df.groupBy(*self.part).agg(*aggs)

    @property
    def earlier_blocks(self):
        """Window over the per-block table: the blocks before this one."""
        return W.partitionBy(*self.keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)

    def join_carry(self, carry: DataFrame) -> DataFrame:
        """At most one row per block and hot key, so its size is known before the join."""
        return self.df.join(broadcast_if_small(carry, 2 * self.blocks), self.part, "left")

    def running_sum(self, value: Column, name: str) -> Ordered:
        local = F.sum(value).over(self.so_far)
        if not self.blocks:
            return self.with_column(name, local)
        totals = self.per_block(F.sum(value).alias("_total"))
        carry = totals.select(*self.part, F.sum("_total").over(self.earlier_blocks).alias("_carry"))
        out = self.join_carry(carry.filter("_carry is not null"))
        return self.over(out.withColumn(name, local + F.coalesce("_carry", F.lit(0))).drop("_carry"))

    def lag(self, value: Column, name: str) -> Ordered:
        """`value` of the previous row; pass a struct for several columns."""
        local = F.lag(F.struct(value.alias("v"))).over(self.window)
        if not self.blocks:
            return self.with_column(name, local["v"])
        last = self.per_block(F.max_by(F.struct(value.alias("v")), self.rank).alias("_last"))
        before = W.partitionBy(*self.keys).orderBy(BLOCK)
        carry = last.select(*self.part, F.lag("_last").over(before).alias("_carry"))
        out = self.join_carry(carry.filter("_carry is not null"))
        return self.over(out.withColumn(name, F.coalesce(local, F.col("_carry"))["v"]).drop("_carry"))

    def last_known(self, value: Column, name: str) -> Ordered:
        """The latest non-NULL `value` up to and including this row."""
        local = F.last(value, ignorenulls=True).over(self.so_far)
        if not self.blocks:
            return self.with_column(name, local)
        last = self.per_block(F.max_by(value, F.when(value.isNotNull(), self.rank)).alias("_last"))
        carry = last.select(
            *self.part, F.last("_last", ignorenulls=True).over(self.earlier_blocks).alias("_carry")
        )
        out = self.join_carry(carry.filter("_carry is not null"))
        return self.over(out.withColumn(name, F.coalesce(local, F.col("_carry"))).drop("_carry"))

    def strictly_earlier(self, value: Column, name: str, ts: str = "txn_date", previous: str | None = None) -> Ordered:
        """`value` of the last row whose `ts` is earlier than this row's (an as-of look-back). `previous` names a
        column for what is read on the way: `ts` and `v` of the row before, NULL on the first."""
        seen = self.lag(F.struct(F.col(ts).alias("ts"), value.alias("v")), "_prev")
        opens = F.when(
            F.col("_prev").isNotNull() & ~F.col(ts).eqNullSafe(F.col("_prev")["ts"]),
            F.struct(F.col("_prev")["v"].alias("v")),
        )
        known = seen.over(seen.df.withColumn("_opens", opens)).last_known(F.col("_opens"), "_known")
        found = known.df.withColumn(name, F.col("_known")["v"]).drop("_opens", "_known")
        return known.over(found.withColumnRenamed("_prev", previous) if previous else found.drop("_prev"))

    def per_key(self, **aggs: Column) -> Ordered:
        """Aggregates of the whole key on each row."""
        if not self.blocks:
            everything = W.partitionBy(*self.keys)
            cols = {n: a.over(everything) for n, a in aggs.items()}
            return self.over(self.df.withColumns(cols))
        table = self.df.groupBy(*self.keys).agg(*[a.alias(n) for n, a in aggs.items()])
        out = self.df.join(broadcast_if_small(table, self.pieces), list(self.keys), "left")
        return self.over(out)


class Hot(int):
    """The number of rows of hot keys; `keys`: how many keys, None if not counted."""

    keys: int | None

    def __new__(cls, rows: int, keys: int | None = 0) -> Hot:
        out = super().__new__(cls, rows)
        out.keys = keys
        return out


def split_hot(
    df: DataFrame, keys: Seq[str], hot_rows: int = HOT_ROWS, at_most: int | None = None
) -> tuple[DataFrame, DataFrame | None, int]:
    """(ordinary rows, rows of hot keys or None, number of hot rows as a `Hot`).

    `at_most` is an upper bound on the rows of any one key; when no key can be hot, nothing runs.
    """
    if at_most is not None and at_most <= hot_rows:
        return df, None, Hot(0)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    n_keys, n_rows = sizes.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if not n_keys:
        return df, None, Hot(0)
    hot = broadcast_if_small(sizes.select(*keys), n_keys)
    return df.join(hot, list(keys), "left_anti"), df.join(hot, list(keys), "left_semi"), Hot(n_rows, n_keys)


def plain(df: DataFrame, keys: Seq[str], order: Seq[Sort]) -> Ordered:
    return Ordered(df, tuple(keys), tuple(order))


def blocked(
    df: DataFrame, keys: Seq[str], order: Seq[Sort], rows: int, block_rows: int = BLOCK_ROWS
) -> Ordered:
    """Lay hot rows out in range blocks. Written to the shared folder, because range bounds
    are sampled anew whenever a plan is evaluated and the block numbers must not move."""
    n = max(2, math.ceil(rows / block_rows))
    laid = df.repartitionByRange(n, *keys, *[k.order() for k in order]).withColumn(BLOCK, F.spark_partition_id())
    return Ordered(materialise(laid, "blocks"), tuple(keys), tuple(order), n, getattr(rows, "keys", None))


@dataclass(frozen=True)
class Sizing:
    """When a key counts as hot, how large a block is, and what is known about the input (`at_most`: the
    rows that any one key can have)."""

    hot_rows: int = HOT_ROWS
    block_rows: int = BLOCK_ROWS
    at_most: int | None = None


def scan(df: DataFrame, keys: Seq[str], order: Seq[Sort], step, sizing: Sizing = Sizing()) -> DataFrame:
    """Run `step(Ordered) -> DataFrame` on ordinary and, if there are any, on hot keys."""
    cold, hot, rows = split_hot(df, keys, sizing.hot_rows, sizing.at_most)
    out = step(plain(cold, keys, order))
    if hot is None:
        return out
    more = step(blocked(hot, keys, order, rows, sizing.block_rows)).drop(BLOCK)
    return out.unionByName(more)
