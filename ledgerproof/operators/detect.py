"""Row-level detection: duplicates, special movements, format-2 rules, fee votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerproof.functions import amounts as A
from ledgerproof.operators.sequence import ARRIVAL, DEBIT_FIRST, Ordered, Sizing, plain, scan, split_hot

RUN = ["run_id"]
DUPLICATE_KEYS = ["run_id", "txn_id", "txn_date", "amount", "description"]

# Marker texts and the names they are reported under, weakest first.
SPECIAL_PREFIX = ("commission disbursement", "Commission Disbursement")
SPECIAL_TEXTS = (
    ("deallocation", "Deallocation Transfer"),
    ("transaction reversal", "Transaction Reversal"),
    ("rollback", "Rollback"),
)
DROPPED_STATUSES = ("FAILED", "ROLLBACKED")


def flag_later_copies(df: DataFrame, keys: list[str], name: str, where: Column | None = None) -> DataFrame:
    """True for every row of a key but its first arrival.

    Groups are counted with map-side combine and only repeated keys are joined back, so a
    key with very many copies never gathers in one task (the join side is skew-splittable).
    """
    rows = df if where is None else df.filter(where)
    repeated = (
        rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys])
        .agg(F.min("seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    later = F.coalesce(F.col("seq") > F.col("_first"), F.lit(False))
    if where is not None:
        later = later & F.coalesce(where, F.lit(False))
    out = df.join(repeated, same, "left").withColumn(name, later)
    return out.drop("_first", *[f"_k_{k}" for k in keys])


def mark_duplicates(rows: Ordered) -> Ordered:
    """All but the first arrival of rows equal in id, time, amount and text.

    In ordinary runs a window within the partitions the replay needs anyway; hot runs are
    counted instead, as one group of copies may be most of such a run.
    """
    if rows.blocks:
        return rows.over(flag_later_copies(rows.df, DUPLICATE_KEYS, "is_duplicate"))
    copies = W.partitionBy(*DUPLICATE_KEYS).orderBy("seq")
    return rows.with_column("is_duplicate", F.row_number().over(copies) > 1)


def flag_duplicates(txn: DataFrame, sizing: Sizing = Sizing()) -> DataFrame:
    cold, hot, _ = split_hot(txn, RUN, sizing.hot_rows, sizing.at_most)
    out = mark_duplicates(plain(cold, RUN, ARRIVAL)).df
    return out if hot is None else out.unionByName(flag_later_copies(hot, DUPLICATE_KEYS, "is_duplicate"))


def special_type(description: Column) -> Column:
    """Strongest marker wins: rollback, reversal, deallocation, then the prefix rule."""
    text = F.lower(description)
    out = None
    for needle, name in reversed(SPECIAL_TEXTS):
        out = (F if out is None else out).when(text.contains(needle), name)
    return out.when(text.startswith(SPECIAL_PREFIX[0]), SPECIAL_PREFIX[1])


def flag_special(txn: DataFrame) -> DataFrame:
    kind = special_type(F.col("description"))
    return txn.withColumn("special_txn_type", kind).withColumn("is_special_txn", F.col("special_txn_type").isNotNull())


# -- format-2 arrival rules -------------------------------------------------------------


def drop_failed(txn: DataFrame) -> DataFrame:
    """Rows without a status are kept."""
    return txn.filter(~F.upper(F.coalesce("status", F.lit(""))).isin(*DROPPED_STATUSES))


def dedupe_commissions(txn: DataFrame) -> DataFrame:
    """Commission rows printed again with the same date, amount and balance."""
    about = F.lower("description").contains("commission")
    flagged = flag_later_copies(txn, ["run_id", "txn_date", "amount", "balance"], "_again", about)
    return flagged.filter(~F.col("_again")).drop("_again")


def restarts(description: Column) -> Column:
    """Rows whose printed balance belongs to another wallet: the balance restarts there."""
    text = F.lower(description)
    found = (text.contains("commission") & text.contains("disbursement")) | F.lit(False)
    for needle in ("deallocation", "rollback", "transaction reversal"):
        found = found | text.contains(needle)
    return F.coalesce(found, F.lit(False))


def format2_rules(txn: DataFrame) -> DataFrame:
    kept = dedupe_commissions(drop_failed(txn))
    return kept.withColumn("balance_restart", restarts(F.col("description")))


def number_within_date(txn: DataFrame, sizing: Sizing = Sizing()) -> DataFrame:
    """Position among the rows of the same timestamp in debit-first order."""

    def step(rows: Ordered) -> DataFrame:
        counted = rows.running_sum(F.lit(1), "_n")
        return counted.df.withColumn("sequence", (F.col("_n") - 1).cast("long")).drop("_n")

    return scan(txn, ["run_id", "txn_date"], DEBIT_FIRST, step, sizing)


# -- fee votes --------------------------------------------------------------------------

VOTES = ("cashback_for", "cashback_against", "ind02_for", "ind02_against")


def _lean(previous: Column, with_fee: Column) -> tuple[Column, Column]:
    """Which of the two readings explains the printed balance clearly better."""
    printed, amount = A.money(F.col("balance")), A.money(F.col("amount"))
    with_it = F.abs(printed - (previous + amount + with_fee))
    without = F.abs(printed - (previous + amount))
    return with_it < without - F.lit(A.TOLERANCE), without < with_it - F.lit(A.TOLERANCE)


def mark_votes(rows: Ordered, previous: str | None = None) -> Ordered:
    """One 0/1 column per vote. The first row of a run never votes; fees are left out. `previous`: a column with the
    balance of the row before as `v` (`Ordered.strictly_earlier`), dropped here."""
    name = previous or "_prev"
    seen = rows if previous else rows.lag(F.struct(F.col("balance").alias("v")), name)
    amount, text = F.col("amount"), F.col("description")
    before, voter = A.money(F.col(name)["v"]), F.col(name).isNotNull()
    cash_for, cash_against = _lean(before, A.cashback_of(amount))
    ind_for, ind_against = _lean(before, -A.commission_of(amount))

    def flag(on: Column, lean: Column) -> Column:
        return F.coalesce((voter & on & lean), F.lit(False)).cast("int")

    cash, ind = A.has_cashback(text), A.has_commission(text)
    return seen.over(
        seen.df.withColumns(
            {
                VOTES[0]: flag(cash, cash_for),
                VOTES[1]: flag(cash, cash_against),
                VOTES[2]: flag(ind, ind_for),
                VOTES[3]: flag(ind, ind_against),
            }
        ).drop(name)
    )


def fee_votes(txn: DataFrame, sizing: Sizing = Sizing()) -> DataFrame:
    """One row per run: vote counts and the two decisions (majority, default off)."""
    voted = scan(txn.select("run_id", "seq", "txn_date", "description", "amount", "balance"), RUN, ARRIVAL,
                 lambda rows: mark_votes(rows).df, sizing)
    counts = voted.groupBy("run_id").agg(*[F.sum(v).alias(v) for v in VOTES])
    return counts.withColumn("uses_implicit_cashback", F.col(VOTES[0]) > F.col(VOTES[1])).withColumn(
        "uses_implicit_ind02_commission", F.col(VOTES[2]) > F.col(VOTES[3])
    )


def signed_runs(txn: DataFrame) -> DataFrame:
    """Runs that print any negative amount."""
    return txn.groupBy("run_id").agg(F.coalesce(F.bool_or(F.col("amount") < 0), F.lit(False)).alias("is_signed"))
