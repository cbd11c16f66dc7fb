"""Exports: processed rows, summaries, report tabs, JSON records, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What readers see for statements without a summary.
SUMMARY_DEFAULTS = {
    "verification_status": "Not Processed",
    "balance_match": "N/A",
    "duplicate_count": 0,
    "balance_diff_changes": 0,
    "balance_diff_change_ratio": 0.0,
    "meta_title": "N/A",
    "meta_author": "N/A",
    "meta_producer": "N/A",
}
SUMMARY_FIELDS = (
    "run_id", "acc_number", "acc_prvdr_code", "rm_name", "num_rows", "processing_status", "verification_status", "balance_match",
    "duplicate_count", "balance_diff_changes", "balance_diff_change_ratio", "calculated_closing_balance", "last_balance",
    "meta_title", "meta_author", "meta_producer", "meta_created_at", "meta_modified_at",
)


def _chosen(df: DataFrame, run_ids: list[str] | None, account: str | None, provider: str | None) -> DataFrame:
    if run_ids:
        df = df.filter(F.col("run_id").isin(run_ids))
    if account:
        df = df.filter(F.col("acc_number") == account)
    if provider:
        df = df.filter(F.col("acc_prvdr_code") == provider)
    return df


def processed_rows(processed: DataFrame, run_ids: list[str] | None = None, account: str | None = None, provider: str | None = None) -> DataFrame:
    """Rows of all providers, ordered within files: ranges of (run, date) need no total sort."""
    return _chosen(processed, run_ids, account, provider).repartitionByRange("run_id", "txn_date", "seq").sortWithinPartitions("run_id", "txn_date", "seq")


def summary_rows(unified: DataFrame, run_ids: list[str] | None = None, account: str | None = None, provider: str | None = None) -> DataFrame:
    rows = _chosen(unified, run_ids, account, provider).select(*SUMMARY_FIELDS).fillna(SUMMARY_DEFAULTS)
    money = ("calculated_closing_balance", "last_balance")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in money})


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_tabs(tabs: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One folder per tab."""
    for name, df in tabs.items():
        df.write.mode("overwrite").format(fmt).save(f"{path}/{name}")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_records(df: DataFrame) -> DataFrame:
    return df.select("run_id", F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))


def upsert(old: DataFrame, new: DataFrame, key: str = "run_id", order: str | None = None) -> DataFrame:
    """New rows replace old ones of the same key. Of several new rows of a key one stays: with `order` the one with the highest,
    else one that depends on the rows' values alone."""
    last = F.col(order) if order else F.xxhash64(*new.columns)
    new = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), last).alias("row")).select("row.*")
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)
