"""Order of rows that share a timestamp.

A group of 2-6 tied rows (not the first group of its run) takes the order in which most
printed balances are explained by the balance printed just before; the first best order in
lexicographic order wins. What a group needs from the rows before it is one number, the
printed balance it starts from, and that is one of the (at most six) balances of the group
before it. So each group is a small table "entry row -> exit row":

* within a block the tables are chained in one pass over sorted Arrow batches, holding no
  more than a batch in memory;
* across the blocks of a hot run the chained tables (six numbers per block) are composed,
  and only then are the blocks ordered, each by its own task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerproof.functions import amounts as A
from ledgerproof.operators.sequence import BLOCK, Ordered, Sort
from ledgerproof.session import broadcast_if_small

# The functions below travel to the executors by value: nothing needs to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Larger groups keep the printed order (720 orders of six rows are compared); see `left_in_printed_order`.
MAX_TIED = 6
# Groups compared at once: at most 6 x 720 scores each.
SLICE = 4_096
SCALE = 100_000  # DECIMAL(22,5) as whole numbers
_EXACT = 1_000  # 0.01 in those units
ORDERS = {n: np.array(list(permutations(range(n)))) for n in range(2, MAX_TIED + 1)}
NO_ENTRY = -1

WORK = ["_tie_balance", "_tie_delta", "_head", "_head_balance"]


def tie_delta() -> Column:
    """The apply rule with both implicit fees on, whatever the run's votes say, in whole units."""
    c = F.col
    moved = A.movement(c("acc_prvdr_code"), c("format"), c("is_signed"), c("txn_type"), c("txn_direction"), c("amount"))
    implicit = F.when(c("acc_prvdr_code") == "UMTN", F.lit(0).cast(A.MONEY)).otherwise(
        A.implicit_fee(c("amount"), c("description"), F.lit(True), F.lit(True))
    )
    return _whole(A.apply_delta(moved, A.money(c("fee")), implicit))


def _whole(col: Column) -> Column:
    return (col * SCALE).cast("long")


def mark_open(rows: Ordered) -> Ordered:
    """`_open`: the row is in a group to be ordered; `_starts`: another timestamp precedes it; `_head`: the row starts a
    group that no open group precedes (in plain runs every start of a group is marked, `_place` clears the others).

    For hot runs a small group cut by a block border is moved whole into the earlier block.
    Expects `_tie_delta`; everything here shares the one sort of the printed order.
    """
    df = rows.df
    if rows.blocks:
        counts = df.groupBy(*rows.keys, "txn_date", BLOCK).agg(F.count(F.lit(1)).alias("_n"))
        # Only the first and last timestamp of a block can be cut by its border.
        border = rows.per_block(F.min("txn_date").alias("_lo"), F.max("txn_date").alias("_hi"))
        edge = counts.join(broadcast_if_small(border, rows.pieces), rows.part).filter("txn_date in (_lo, _hi)")
        cut = edge.groupBy(*rows.keys, "txn_date").agg(
            F.sum("_n").alias("_whole"), F.min(BLOCK).alias("_home"), F.count(F.lit(1)).alias("_pieces")
        ).filter("_pieces > 1").drop("_pieces")
        df = df.join(broadcast_if_small(cut, 2 * rows.blocks), [*rows.keys, "txn_date"], "left")
        df = df.withColumn(BLOCK, F.when(F.col("_whole") <= MAX_TIED, F.col("_home")).otherwise(F.col(BLOCK)))
    else:
        df = df.withColumn("_whole", F.lit(None).cast("long"))
    seen = rows.over(df.withColumn("_tie_balance", _whole(F.col("balance"))))
    seen = seen.lag(F.struct(F.col("txn_date").alias("ts"), F.col("_tie_balance").alias("balance")), "_prev")
    # Rows of the same timestamp are peers of this frame.
    peers = W.partitionBy(*rows.part).orderBy(F.col("txn_date").asc_nulls_last()).rangeBetween(W.currentRow, W.currentRow)
    tied = F.coalesce(F.col("_whole"), F.count(F.lit(1)).over(peers))
    if rows.blocks:
        first = seen.with_column("_tied", tied).per_key(_first_ts=F.min("txn_date"))
    else:  # rows come in the order of their dates, so the first date of a run is the least so far
        first = seen.with_column("_first_ts", F.min("txn_date").over(rows.so_far)).with_column("_tied", tied)
    is_open = (
        (F.col("format") != "format_2") & F.col("_tied").between(2, MAX_TIED) & (F.col("txn_date") > F.col("_first_ts"))
    )
    opened = first.with_column("_open", F.coalesce(is_open, F.lit(False)))
    starts = ~F.col("txn_date").eqNullSafe(F.col("_prev")["ts"])
    head = F.col("_open") & starts
    if rows.blocks:  # in plain runs the pass over the rows sees the row before
        opened = opened.lag(F.col("_open"), "_prev_open")
        head = head & ~F.coalesce(F.col("_prev_open"), F.lit(False))
    return opened.over(
        opened.df.withColumn("_head", head).withColumn("_starts", starts)
        .withColumn("_head_balance", F.when(F.col("_head"), F.col("_prev")["balance"]))
        .drop("_prev", "_prev_open", "_tied", "_first_ts", "_whole", "_home")
    )


# -- numpy helpers on a run of whole groups ---------------------------------------------


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a - b) < _EXACT


def _choices(bal: np.ndarray, known: np.ndarray, delta: np.ndarray, entry: np.ndarray, entry_known: np.ndarray) -> np.ndarray:
    """Best order number per (group, entry) for groups of one size: bal (G,n), entry (G,m)."""
    orders = ORDERS[bal.shape[1]]
    step = _close(bal[:, :, None] + delta[:, None, :], bal[:, None, :])
    step &= known[:, :, None] & known[:, None, :]
    inner = sum(step[:, orders[:, k], orders[:, k + 1]].astype(np.int8) for k in range(orders.shape[1] - 1))
    lead = _close(entry[:, :, None] + delta[:, None, :], bal[:, None, :])
    lead &= entry_known[:, :, None] & known[:, None, :]
    return (inner[:, None, :] + lead[:, :, orders[:, 0]]).argmax(axis=2)


class _Chain:
    """What must be remembered between batches: the last group and the state in it."""

    def __init__(self) -> None:
        self.balance = np.zeros(MAX_TIED, np.int64)
        self.known = np.zeros(MAX_TIED, bool)
        self.states = np.zeros(1, np.int64)


def _flags(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().to_numpy(zero_copy_only=False)


def _table_columns(table: pa.Table) -> dict[str, np.ndarray]:
    out = {}
    for name in ("_tie_balance", "_tie_delta", "_head_balance"):
        col = table[name].combine_chunks()
        out[name] = col.fill_null(0).to_numpy(zero_copy_only=False)
        out[name + "?"] = col.is_valid().to_numpy(zero_copy_only=False)
    for name in ("_head", "_starts"):
        out[name] = _flags(table, name)
    return out


def _walk(table: pa.Table, chain: _Chain, lanes: bool):
    """Yield (first row, size, chosen orders, states) per group.

    `lanes` follows every possible entry of a block at once (states has one slot per entry
    row of the block before); otherwise there is a single state.
    """
    cols = _table_columns(table)
    start = np.flatnonzero(cols["_starts"])
    size = np.diff(np.append(start, table.num_rows))
    groups = len(start)
    slot = np.minimum(np.arange(MAX_TIED)[None, :], size[:, None] - 1)
    at = start[:, None] + slot
    bal, delta = cols["_tie_balance"][at], cols["_tie_delta"][at]
    known = cols["_tie_balance?"][at] & (np.arange(MAX_TIED)[None, :] < size[:, None])
    head = cols["_head"][start]
    entry, entry_known = np.empty_like(bal), np.empty_like(known)
    entry[1:], entry_known[1:] = bal[:-1], known[:-1]
    entry[0], entry_known[0] = chain.balance, chain.known
    entry[head] = cols["_head_balance"][start][head][:, None]
    entry_known[head] = cols["_head_balance?"][start][head][:, None]
    choice = np.zeros((groups, MAX_TIED), np.int64)
    for n in np.unique(size):
        of_size = np.flatnonzero(size == n)
        for at_once in range(0, len(of_size), SLICE):
            rows = of_size[at_once : at_once + SLICE]
            choice[rows] = _choices(bal[rows, :n], known[rows, :n], delta[rows, :n], entry[rows], entry_known[rows])
    for g in range(groups):
        orders = ORDERS[int(size[g])]
        if head[g]:
            chain.states = np.zeros(MAX_TIED if lanes else 1, np.int64)
        picked = choice[g, chain.states]
        chain.states = orders[picked, -1]
        yield int(start[g]), int(size[g]), orders[picked]
    chain.balance, chain.known = bal[-1], known[-1]


def _whole_groups(batches: Iterator[pa.Array]) -> Iterator[pa.Table]:
    """Re-cut batches so that no open group is split. At most six rows are held back."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([pa.RecordBatch.from_struct_array(batch)])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        cut = table.num_rows
        if cut and table["_open"][-1].as_py():
            tail = table.slice(max(0, cut - MAX_TIED - 1))
            cut -= tail.num_rows - int(np.flatnonzero(_flags(tail, "_starts"))[-1])
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _place(entries: bool):
    """Place of each row in its group (0 elsewhere), from the columns of GROUP (and `_entry`), rows in printed order."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        chain = _Chain()
        before = False
        for table in _whole_groups(batches):
            is_open = _flags(table, "_open")
            if not entries:  # no row of a run's first group is open, so the row before is of the same run
                head = _flags(table, "_head") & ~np.append(before, is_open[:-1])
                table = table.set_column(table.column_names.index("_head"), "_head", pa.array(head))
                before = is_open[-1]
            at = np.flatnonzero(is_open)
            tie = np.zeros(table.num_rows, np.int32)
            opened = table.take(at)
            for offset, piece in _parts(opened) if entries else [(0, opened)]:
                if not piece.num_rows:
                    continue
                if entries:
                    _enter(chain, piece)
                for start, n, orders in _walk(piece, chain, lanes=False):
                    tie[at[offset + start + orders[0]]] = np.arange(n)
            yield pa.array(tie)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # It depends on the order of rows, so nothing may be moved across it.
    return F.arrow_udf(run, "int").asNondeterministic()


def _parts(table: pa.Table) -> list[tuple[int, pa.Table]]:
    """Cut where a block starts with a known entry (the entry is set on those rows only)."""
    marks = np.flatnonzero(table["_entry"].combine_chunks().is_valid().to_numpy(zero_copy_only=False))
    cuts = sorted({0, *marks.tolist()})
    ends = [*cuts[1:], table.num_rows]
    return [(a, table.slice(a, b - a)) for a, b in zip(cuts, ends, strict=True) if b > a]


def _enter(chain: _Chain, piece: pa.Table) -> None:
    """Load the balance the block's first group starts from."""
    entry = piece["_entry"][0].as_py()
    if entry is not None:
        chain.balance = np.full(MAX_TIED, 0 if entry["balance"] is None else entry["balance"], np.int64)
        chain.known = np.full(MAX_TIED, entry["balance"] is not None)
        chain.states = np.zeros(1, np.int64)


def _placed(df: DataFrame, entries: bool) -> DataFrame:
    """All rows with `_tie`, in a pass over partitions the windows have sorted already. Flags and, of open rows, three numbers
    go to Python; the rows wait in the JVM and keep their partitioning, so the replay needs no other shuffle."""
    c = F.col
    numbers = [F.when(c("_open"), c(n)).alias(n) for n in ("_tie_balance", "_tie_delta", "_head_balance")]
    group = F.struct("_open", "_starts", "_head", *numbers, *(["_entry"] if entries else []))
    return df.withColumn("_tie", _place(entries)(group)).drop(*WORK, "_open", "_starts", "_entry")


def order_plain(rows: Ordered) -> DataFrame:
    laid = rows.df.sortWithinPartitions(*rows.part, *[k.order() for k in rows.order])
    return _placed(laid, entries=False)


# -- hot runs: compose the blocks' tables first -------------------------------------------


def _block_table(names: list[str]):
    """Per block: entry row (of the block before) -> row the block's last group ends on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        chain = _Chain()
        entry = pdf["_candidates"].iloc[0]
        lanes = MAX_TIED
        if entry is not None and len(entry):
            for i, v in enumerate(entry):
                chain.balance[i], chain.known[i] = (0, False) if v is None or pd.isna(v) else (int(v), True)
        chain.states = np.arange(lanes)
        table = pa.table(
            {
                "_tie_balance": pa.array(pdf["_tie_balance"].astype("Int64")),
                "_tie_delta": pa.array(pdf["_tie_delta"].astype("Int64")),
                "_head_balance": pa.array(pdf["_head_balance"].astype("Int64")),
                **{f: pa.array(pdf[f].astype(bool)) for f in ("_head", "_starts")},
            }
        )
        last = None
        for _, _, orders in _walk(table, chain, lanes=True):
            last = orders[:, -1]
        return pd.DataFrame([{**{n: pdf[n].iloc[0] for n in names}, "exit_rows": last.tolist()}])

    return run


def _compose(names: list[str]):
    """Fold the block tables of one run in block order: six numbers per block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLOCK)
        state, out = 0, []
        for row in pdf.itertuples(index=False):
            out.append(state if row.continued else NO_ENTRY)
            state = int(row.exit_rows[state if row.continued else 0])
        return pd.DataFrame({**{n: pdf[n].to_numpy() for n in names}, "_state": out})

    return run


def _entry_states(rows: Ordered) -> DataFrame:
    """Per continued block of a hot run: the balance its first group starts from."""
    opened = rows.df.filter("_open").withColumn("_at", F.row_number().over(rows.window))
    edge = rows.per_block(F.max("txn_date").alias("_hi"), F.min("txn_date").alias("_lo"))
    edge = broadcast_if_small(edge, rows.pieces)
    # The last group of a block when it is open: at most six balances in printed order.
    listed = F.sort_array(F.collect_list(F.struct("_at", F.col("_tie_balance").alias("balance"))))
    last = (
        opened.join(edge, rows.part)
        .filter("txn_date = _hi")
        .groupBy(*rows.part)
        .agg(F.transform(listed, lambda e: e["balance"]).alias("_last"))
    )
    starts = opened.join(edge, rows.part).filter("txn_date = _lo").groupBy(*rows.part).agg((~F.bool_or("_head")).alias("continued"))
    before = W.partitionBy(*rows.keys).orderBy(BLOCK)
    border = edge.select(*rows.part).join(last, rows.part, "left").withColumn("_candidates", F.lag("_last").over(before))
    border = border.join(starts, rows.part, "left").select(*rows.part, "_candidates", F.coalesce("continued", F.lit(False)).alias("continued"))
    border = broadcast_if_small(border, rows.pieces)
    slim = opened.select(*rows.part, "_at", "_tie_balance", "_tie_delta", "_starts", "_head", "_head_balance").join(border, rows.part)
    names = [*rows.part, "continued"]
    kinds = ", ".join(f"{n} {rows.df.schema[n].dataType.simpleString()}" for n in rows.part)
    table = slim.groupBy(*names).applyInPandas(
        _block_table(names), f"{kinds}, continued boolean, exit_rows array<bigint>"
    )
    # A block without open rows breaks the chain, so its successor is not `continued`.
    states = table.groupBy(*rows.keys).applyInPandas(_compose(rows.part), f"{kinds}, _state int")
    return (
        states.filter(F.col("_state") != NO_ENTRY)
        .join(border, rows.part)
        .select(*rows.part, F.struct(F.get("_candidates", F.col("_state")).alias("balance")).alias("_entry"))
    )


def order_blocked(rows: Ordered) -> DataFrame:
    entries = broadcast_if_small(_entry_states(rows), 2 * rows.blocks)  # blocks that continue a run
    laid = rows.df.join(entries, rows.part, "left")
    first = F.row_number().over(rows.window) == 1
    laid = laid.withColumn("_entry", F.when(first, F.col("_entry")))
    laid = laid.repartition(*rows.part).sortWithinPartitions(*rows.part, *[k.order() for k in rows.order])
    return _placed(laid, entries=True)


def resolve_ties(rows: Ordered) -> Ordered:
    """Adds `_tie`; order by (txn_date, _tie, printed order). Drops undated rows of the
    formats whose groups are ordered, as those never enter a group."""
    marked = mark_open(rows.over(rows.df.filter((F.col("format") == "format_2") | F.col("txn_date").isNotNull())))
    placed = order_blocked(marked) if marked.blocks else order_plain(marked)
    order = (rows.order[0], Sort("_tie"), *rows.order[1:])
    return rows.over(placed).ordered_by(order)
