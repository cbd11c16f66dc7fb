"""Looking into statements: mismatches and their context, movement patterns, samples,
pages of a listing, filters, and set operations on runs."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerproof.functions.amounts import TOLERANCE
from ledgerproof.operators.sequence import Ordered, Sizing, Sort, plain, scan, split_hot

BY_BALANCE = (Sort("txn_date"), Sort("balance", nulls_first=True), Sort("seq"))


# -- mismatches ----------------------------------------------------------------------------


def first_mismatch(processed: DataFrame) -> DataFrame:
    off = F.abs(F.col("balance_diff")) > F.lit(TOLERANCE)
    facts = F.struct("pos", "seq", "txn_date", "amount", "balance", "balance_diff")
    first = processed.filter(off).groupBy("run_id").agg(F.min_by(facts, "pos").alias("_m"))
    return first.select("run_id", "_m.*")


def mismatch_context(processed: DataFrame, rows: int = 3, sizing: Sizing = Sizing()) -> DataFrame:
    """The rows up to and including the first mismatch. The place of the mismatch reaches the
    rows of its run in the partitions the replay left them in; only hot runs need a join,
    against one row per hot run."""
    at = F.min(F.when(F.abs(F.col("balance_diff")) > F.lit(TOLERANCE), F.col("pos")))
    cold, hot, n = split_hot(processed, ["run_id"], sizing.hot_rows, sizing.at_most)
    out = plain(cold, ["run_id"], (Sort("pos"),)).per_key(_at=at).df
    if hot is not None:
        hot_runs = Ordered(hot, ("run_id",), (Sort("pos"),), n // sizing.hot_rows + 1)
        out = out.unionByName(hot_runs.per_key(_at=at).df)
    out = out.filter(F.col("pos").between(F.col("_at") - (rows - 1), F.col("_at")))
    return out.withColumn("before_mismatch", (F.col("_at") - F.col("pos")).cast("long")).drop("_at")


def movement_patterns(txn: DataFrame, sizing: Sizing = Sizing()) -> DataFrame:
    """Does the balance since the last earlier timestamp move by +amount, -amount or neither?"""

    def step(rows: Ordered) -> DataFrame:
        return rows.strictly_earlier(F.col("balance"), "previous_balance").df

    seen = scan(txn, ["run_id"], BY_BALANCE, step, sizing)
    change = F.col("balance") - F.col("previous_balance")
    tol = F.lit(TOLERANCE)
    pattern = (
        F.when(F.abs(change - F.col("amount")) < tol, "+amount").when(F.abs(change + F.col("amount")) < tol, "-amount").otherwise("unknown")
    )
    return seen.withColumn("balance_change", change).withColumn("pattern", F.when(change.isNotNull(), pattern))


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """Top k per group. The rank limit is applied before the shuffle, so large groups shrink
    to k rows per task first."""
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= k).withColumn(name, F.col(name).cast("long"))


def endpoints(txn: DataFrame, k: int = 5) -> DataFrame:
    """First and last k rows of each statement."""
    rows = txn.filter("txn_date is not null")
    head = first_per_group(rows, ["run_id"], [F.asc("txn_date"), F.asc("seq")], k).withColumn("side", F.lit("first"))
    tail = first_per_group(rows, ["run_id"], [F.desc("txn_date"), F.desc("seq")], k).withColumn("side", F.lit("last"))
    return head.unionByName(tail)


# -- samples ---------------------------------------------------------------------------------


def month_type_sample(files: DataFrame, k: int = 2) -> DataFrame:
    return first_per_group(files, ["month", "file_type"], [F.asc("run_id")], k)


def stratified_sample(df: DataFrame, stratum: str, k: int, seed: str) -> DataFrame:
    """k rows per stratum in the order of a seeded digest of the run id: repeatable."""
    digest = F.md5(F.concat_ws("|", F.col("run_id"), F.lit(seed)))
    return first_per_group(df.withColumn("_digest", digest), [stratum], [F.asc("_digest"), F.asc("run_id")], k).drop("_digest")


# -- filters and pages -------------------------------------------------------------------------


def _same(col: str, value: str) -> Column:
    return F.lower(col) == value.lower()


def _like(col: str, value: str) -> Column:
    return F.lower(col).contains(value.lower())


def predicates(
    search: str | None = None,
    rm_name: str | None = None,
    from_date: str | None = None,
    to_date: str | None = None,
    date_column: str = "submitted_date",
    **equal: str | None,
) -> Column:
    """Conjunction of the filters that are set. Text compares without case, like the tables it
    comes from; values never become SQL text."""
    parts = [_same(name, value) for name, value in equal.items() if value]
    if search:
        parts.append(_like("run_id", search) | _like("acc_number", search))
    if rm_name:
        parts.append(_like("rm_name", rm_name))
    if from_date:
        parts.append(F.col(date_column) >= F.lit(from_date).cast("timestamp"))
    if to_date:
        parts.append(F.col(date_column) <= F.lit(to_date).cast("timestamp"))
    return reduce(Column.__and__, parts, F.lit(True))


def page(df: DataFrame, where: Column, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    return df.filter(where).orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, where: Column, size: int = 50) -> DataFrame:
    n = F.count(F.lit(1))
    return df.filter(where).agg(n.alias("total"), F.ceil(n / size).alias("pages"))


def options(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def in_month(col: str, month: str) -> Column:
    """Whether a date or time is in a month (yyyy-MM). Compares the bare column, so files and row groups can be skipped;
    NULL is in no month, and a text that is no month is an error."""
    first = date.fromisoformat(f"{month}-01")
    following = date(first.year + first.month // 12, first.month % 12 + 1, 1)
    return (F.col(col) >= F.lit(first)) & (F.col(col) < F.lit(following))


def candidates(mapper: DataFrame, provider: str, lambda_status: str, month: str | None = None) -> DataFrame:
    """Runs to process: by provider, status and month, newest first."""
    rows = mapper.filter((F.col("acc_prvdr_code") == provider) & (F.col("lambda_status") == lambda_status))
    if month:
        rows = rows.filter(in_month("created_date", month))
    return rows.orderBy(F.desc("created_date"), "run_id")


def incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.filter(reduce(Column.__or__, [F.col(c).isNull() for c in columns]))


# -- retracting statements ------------------------------------------------------------------------


def retract(tables: dict[str, DataFrame], runs: DataFrame, everything: bool = False, derived: tuple[str, ...] = ("processed", "summary")) -> dict[str, DataFrame]:
    """The tables without the given runs; only derived tables unless `everything`."""
    gone = runs.select("run_id").distinct()
    return {
        name: df.join(gone, "run_id", "left_anti") if everything or name in derived else df for name, df in tables.items()
    }


def retract_counts(tables: dict[str, DataFrame], runs: DataFrame) -> DataFrame:
    gone = runs.select("run_id").distinct()
    parts = [
        df.select("run_id").join(gone, "run_id", "left_semi").agg(F.count(F.lit(1)).alias("removed")).select(F.lit(name).alias("table_name"), "removed")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
