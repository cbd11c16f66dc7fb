"""Risk reports over unified statements, customers and loans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerproof.functions.amounts import MONEY

# Principal buckets with their labels, report texts.
PRINCIPALS = {
    250000: "0.2M", 500000: "0.5M", 750000: "0.8M", 1000000: "1.0M", 1500000: "1.5M", 2000000: "2.0M",
    2500000: "2.5M", 3000000: "3.0M", 4000000: "4.0M", 5000000: "5.0M",
}
OTHERS, TOTAL = "Others", "TOTAL"
OPEN_STATUSES = ("ongoing", "due")
NEW_SINCE = "2025-07-01"


def n_if(cond: Column) -> Column:
    return F.count_if(cond)


def sum_if(cond: Column, value: str | Column) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(F.when(cond, v)), F.lit(0)).cast(MONEY)


def total(value: str) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast(MONEY)


def ratio(col: str, places: int, factor: int = 1) -> Column:
    return F.round(F.avg(col) * factor, places)


def share(count: str, over: list[str] | None = None, places: int = 1) -> Column:
    """Percent of the total; the window runs over the few rows left after aggregation."""
    w = W.partitionBy(*(over or []))
    return F.round(F.col(count) * 100.0 / F.sum(count).over(w), places)


def verdict_order(col: str = "custom_verification") -> Column:
    v = F.col(col)
    return F.when(v == "FATAL", 1).when(v == "CRITICAL", 2).when(v == "NO_ISSUES", 3).otherwise(4)


# -- flagged customers ----------------------------------------------------------------------


def flagged_statements(unified: DataFrame, customers: DataFrame, provider: str = "UATL") -> DataFrame:
    c = F.col
    fatal = unified.filter(
        (c("acc_prvdr_code") == provider) & (c("custom_verification") == "FATAL") & c("format").isin("format_1", "format_2")
    )
    return fatal.join(customers.select("run_id", "cust_id", "borrower_biz_name"), "run_id", "left")


def fraud_stats(flagged: DataFrame) -> DataFrame:
    """Per customer: counts, dates, first / last RM, and the RM seen most (earliest on ties).

    The most-seen RM comes from (customer, RM) counts, not from a window over a customer's
    statements.
    """
    rows = flagged.filter("cust_id is not null")
    rank = F.struct("submitted_date", "run_id")
    base = rows.groupBy("cust_id").agg(
        F.count(F.lit(1)).alias("no_of_times_fraud"),
        F.min("submitted_date").alias("first_submitted_date"),
        F.max("submitted_date").alias("last_submitted_date"),
        F.min_by(F.struct("rm_name"), rank)["rm_name"].alias("first_rm_name"),
        F.max_by(F.struct("rm_name"), rank)["rm_name"].alias("last_rm_name"),
    )
    per_rm = rows.filter("rm_name is not null").groupBy("cust_id", "rm_name").agg(
        F.count(F.lit(1)).alias("n"), F.min(rank).alias("seen")
    )
    modal = per_rm.groupBy("cust_id").agg(F.min_by("rm_name", F.struct((-F.col("n")).alias("n"), "seen")).alias("rm_name"))
    return base.join(modal, "cust_id", "left")


def loan_stats(loans: DataFrame, as_of: str) -> DataFrame:
    c = F.col
    paid, days = c("paid_date").isNotNull(), c("overdue_days_calc")
    last = F.max_by(F.struct("status", "loan_principal"), F.struct("disbursal_date", "loan_doc_id"))
    out = loans.groupBy("cust_id").agg(
        F.count(F.lit(1)).alias("tot_loans"),
        F.min("disbursal_date").alias("first_loan_date"),
        F.max("disbursal_date").alias("last_loan_date"),
        last.alias("_last"),
        n_if(paid & (days <= 1)).alias("tot_ontime_count"),
        n_if(paid).alias("_paid"),
        n_if(paid & (days > 3)).alias("tot_3_day_late_loans"),
        n_if(paid & (days >= 10)).alias("tot_10_day_late_loans"),
        n_if(c("status") == "overdue").alias("tot_overdue_loans"),
        sum_if(c("status").isin(*OPEN_STATUSES), "os_amount").alias("tot_os_amount"),
        sum_if(c("status") == "overdue", "os_amount").alias("tot_od_amount"),
        sum_if(paid, "flow_fee").alias("tot_revenue"),
    )
    percent = F.when(c("_paid") > 0, F.round(c("tot_ontime_count") * 100 / c("_paid"), 2)).otherwise(0.0)
    return out.withColumns(
        {
            "last_loan_status": c("_last.status"),
            "last_loan_amount": c("_last.loan_principal").cast(MONEY),
            "days_since_last_loan": F.datediff(F.lit(as_of).cast("date"), "last_loan_date"),
            "tot_ontime_perc": percent,
        }
    ).drop("_last", "_paid")


LOAN_COUNTS = ("tot_loans", "tot_ontime_count", "tot_3_day_late_loans", "tot_10_day_late_loans", "tot_overdue_loans")
LOAN_SUMS = ("tot_os_amount", "tot_od_amount", "tot_revenue", "last_loan_amount")


def analysis_raw(flagged: DataFrame, loans: DataFrame, customers: DataFrame, as_of: str) -> DataFrame:
    """One row per distinct customer profile with flagged statements; zeros without loans."""
    stats = fraud_stats(flagged)
    who = customers.join(stats.select("cust_id"), "cust_id", "left_semi").select(
        "cust_id", "borrower_biz_name", F.col("reg_rm_name").alias("registered_rm"), F.col("current_rm_name").alias("current_rm"), "crnt_fa_limit"
    ).distinct()
    out = who.join(stats, "cust_id", "left").join(loan_stats(loans, as_of), "cust_id", "left")
    zeros = {c: F.coalesce(c, F.lit(0)) for c in LOAN_COUNTS} | {c: F.coalesce(c, F.lit(0)).cast(MONEY) for c in LOAN_SUMS}
    return out.withColumns(
        {
            **zeros,
            "tot_ontime_perc": F.coalesce("tot_ontime_perc", F.lit(0.0)),
            "last_loan_status": F.coalesce("last_loan_status", F.lit("No Loans")),
        }
    )


def business_impact(analysis: DataFrame) -> DataFrame:
    """Long form: one (metric, value) row per figure."""
    c = F.col
    s = c("last_loan_status")
    one = analysis.filter("no_of_times_fraud > 0").agg(
        F.count(F.lit(1)).cast("double").alias("Total FATAL Customers"),
        n_if(s.isin(*OPEN_STATUSES)).cast("double").alias("Customers Ongoing/Due"),
        n_if(s == "overdue").cast("double").alias("Customers Overdue"),
        n_if(s == "settled").cast("double").alias("Customers Settled"),
        n_if(s == "No Loans").cast("double").alias("Customers No Loans"),
        n_if(c("days_since_last_loan") <= 30).cast("double").alias("Customers Active (loan in last 30 days)"),
        total("tot_os_amount").cast("double").alias("Total Outstanding Amount (ongoing/due) (UGX)"),
        total("tot_od_amount").cast("double").alias("Total Overdue Amount (UGX)"),
        total("tot_revenue").cast("double").alias("Total Revenue Collected (UGX)"),
        (total("tot_revenue") - total("tot_os_amount") - total("tot_od_amount")).cast("double").alias("Net Impact (Revenue - OS - OD) (UGX)"),
    )
    return one.unpivot([], one.columns, "metric", "value")


def rm_involvement(analysis: DataFrame, flagged: DataFrame) -> DataFrame:
    c = F.col
    per_rm = analysis.filter("no_of_times_fraud > 0 and rm_name is not null").groupBy("rm_name").agg(
        F.count(F.lit(1)).alias("unique_customers"),
        F.sum("no_of_times_fraud").alias("total_fraud_submissions"),
        total("tot_os_amount").alias("total_os_amount"),
        total("tot_od_amount").alias("total_od_amount"),
        total("tot_revenue").alias("total_revenue"),
        n_if(c("tot_overdue_loans") > 0).alias("customers_in_overdue"),
    )
    fresh = flagged.groupBy("rm_name").agg(
        n_if((c("format") == "format_1") & (c("submitted_date") >= F.lit(NEW_SINCE).cast("date"))).alias("new_submissions")
    )
    out = per_rm.join(fresh, "rm_name", "left").withColumn("new_submissions", F.coalesce("new_submissions", F.lit(0)))
    return out.orderBy(F.desc("total_fraud_submissions"), "rm_name")


def applier_analysis(loans: DataFrame) -> DataFrame:
    named = loans.filter("loan_applier_name is not null and loan_applier_role is not null")
    return named.groupBy("loan_applier_name", "loan_applier_role").agg(
        F.countDistinct("cust_id").alias("unique_customers"),
        F.count(F.lit(1)).alias("total_loans_applied"),
        n_if(F.col("status") == "overdue").alias("total_loans_overdue"),
    ).orderBy(F.desc("total_loans_applied"), "loan_applier_name")


def statement_formats(unified: DataFrame) -> DataFrame:
    c = F.col
    v = c("custom_verification")
    known = ((c("acc_prvdr_code") == "UATL") & c("format").isin("format_1", "format_2")) | (
        (c("acc_prvdr_code") == "UMTN") & (c("format") == "excel")
    )
    return unified.filter(known).groupBy(c("acc_prvdr_code").alias("provider"), "format").agg(
        F.count(F.lit(1)).alias("no_of_submissions"),
        F.min("submitted_date").alias("started"),
        F.max("submitted_date").alias("ended"),
        n_if(v.isin("FATAL", "CRITICAL")).alias("fraud"),
        n_if(v == "NO_ISSUES").alias("valid"),
        n_if(v.isNull()).alias("unknown"),
    ).orderBy("provider", "format")


def os_vs_revenue(analysis: DataFrame) -> DataFrame:
    net = F.col("net_impact")
    out = analysis.filter("no_of_times_fraud > 0").select("cust_id", "borrower_biz_name", "tot_revenue", "tot_os_amount")
    out = out.withColumn("net_impact", (F.col("tot_revenue") - F.col("tot_os_amount")).cast(MONEY))
    return out.withColumn("status", F.when(net > 0, "Profitable").when(net < 0, "Loss").otherwise("Break Even")).orderBy("net_impact", "cust_id")


def monthly_trends(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy(F.date_format("submitted_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("total_submissions"), F.countDistinct("cust_id").alias("unique_customers")
    ).orderBy(F.desc("month"))


def principal_label(principal: Column) -> Column:
    """Label of an exact standard principal, else 'Others'."""
    out = F
    for amount, name in PRINCIPALS.items():
        out = out.when(principal == amount, name)
    return out.otherwise(OTHERS)


def exposure(loans: DataFrame) -> DataFrame:
    """Money by exact principal, with empty buckets as zero and a TOTAL row from `rollup`."""
    c = F.col
    spark = loans.sparkSession
    buckets = F.array(*[F.lit(v) for v in [*PRINCIPALS.values(), OTHERS]])
    table = spark.range(1).select(F.posexplode(buckets).alias("place", "bucket"))
    paid, days = c("paid_date").isNotNull(), c("overdue_days_calc")
    # Reduced to one row per bucket before the literal table comes in.
    sums = loans.withColumn("bucket", principal_label(c("loan_principal"))).groupBy("bucket").agg(
        total("loan_principal").alias("total_disbursed"),
        sum_if(c("status").isin(*OPEN_STATUSES), "os_amount").alias("ongoing"),
        sum_if(c("status") == "overdue", "os_amount").alias("overdue"),
        sum_if(c("status") == "settled", "loan_principal").alias("settled"),
        sum_if(paid & (days <= 1), "loan_principal").alias("paid_ontime"),
        sum_if(paid & (days > 3), "loan_principal").alias("paid_late"),
    )
    names = [n for n in sums.columns if n != "bucket"]
    full = table.join(sums, "bucket", "left").rollup("bucket").agg(
        *[total(n).alias(n) for n in names], F.grouping_id().alias("_all"), F.max("place").alias("_place")
    )
    full = full.withColumn("bucket", F.when(c("_all") == 1, TOTAL).otherwise(c("bucket")))
    return full.orderBy("_all", "_place").select(c("bucket").alias("loan_principal"), *names)


# -- statement reports -------------------------------------------------------------------------


def verdict_stats(unified: DataFrame) -> DataFrame:
    return unified.filter(F.col("acc_prvdr_code").isin("UATL", "UMTN")).groupBy("format", "acc_prvdr_code", "custom_verification").agg(
        F.count(F.lit(1)).alias("statements"),
        ratio("balance_diff_change_ratio", 2, 100).alias("avg_balance_diff_pct"),
        total("credits").alias("total_credits"),
        total("debits").alias("total_debits"),
    ).orderBy("acc_prvdr_code", "format", verdict_order())


def statements_tab(unified: DataFrame, customers: DataFrame, provider: str, fmt: str) -> DataFrame:
    rows = unified.filter((F.col("acc_prvdr_code") == provider) & (F.col("format") == fmt))
    out = rows.join(customers.select("run_id", "cust_id", "borrower_biz_name"), "run_id", "left")
    return out.orderBy(F.desc("submitted_date"), "run_id")


def _fee_figures(summary: DataFrame, *keys: str) -> DataFrame:
    c = F.col
    apart = F.abs(c("calculated_closing_balance") - c("last_balance")).cast("double")
    return summary.filter("acc_prvdr_code = 'UATL'").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        n_if(c("balance_match") == "Success").alias("success_count"),
        F.round(n_if(c("balance_match") == "Success") * 100.0 / F.count(F.lit(1)), 4).alias("success_rate"),
        ratio("balance_diff_changes", 6).alias("avg_diff_changes"),
        ratio("balance_diff_change_ratio", 6).alias("avg_diff_ratio"),
        F.round(F.avg(apart), 4).alias("avg_closing_diff"),
        n_if(c("uses_implicit_cashback")).alias("cashback_enabled"),
        n_if(c("uses_implicit_ind02_commission")).alias("ind02_enabled"),
    )


def strategy_baseline(summary: DataFrame) -> DataFrame:
    """Success rate, drift and flag counts of the statements that have fee flags."""
    return _fee_figures(summary)


def strategy_scores(runs: DataFrame) -> DataFrame:
    """Figures per strategy and a point for each of the three it is best at."""
    everything = W.partitionBy()  # three rows
    c = F.col

    def best(name: str, extreme) -> Column:
        return (c(name) == extreme(name).over(everything)).cast("long")

    score = best("success_rate", F.max) + best("avg_diff_changes", F.min) + best("avg_closing_diff", F.min)
    return _fee_figures(runs, "strategy").withColumn("score", score)


def compare_strategies(runs: DataFrame, base: str = "voting", others: tuple[str, ...] = ("always_enable", "always_disable")) -> DataFrame:
    """Runs with fewer, more or as many drift changes than under voting, in one pass."""

    def changes(name: str) -> Column:
        return F.max(F.when(F.col("strategy") == name, F.col("balance_diff_changes")))

    per_run = runs.groupBy("run_id").agg(changes(base).alias("_base"), *[changes(o).alias(o) for o in others])
    long = per_run.unpivot(["run_id", "_base"], list(others), "strategy", "_changes")
    step = F.col("_changes") - F.col("_base")
    return long.groupBy("strategy").agg(
        n_if(step < 0).alias("improvements"), n_if(step > 0).alias("degradations"), n_if(step == 0).alias("unchanged")
    )


def by_fee_flags(summary: DataFrame) -> DataFrame:
    return summary.filter("acc_prvdr_code = 'UATL'").groupBy("uses_implicit_cashback", "uses_implicit_ind02_commission").agg(
        F.count(F.lit(1)).alias("statements"),
        n_if(F.col("balance_match") == "Success").alias("success_count"),
        ratio("balance_diff_changes", 6).alias("avg_diff_changes"),
    )


def null_coverage(meta: DataFrame, columns: list[str]) -> DataFrame:
    """Long form: column, rows, filled rows and whole percent."""
    one = meta.agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(c) for c in columns])
    long = one.unpivot(["total"], columns, "column_name", "filled")
    return long.withColumn("percent", F.when(F.col("total") > 0, F.floor(F.col("filled") * 100 / F.col("total"))).otherwise(0))


def distribution(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("records")).withColumn("percent", share("records"))


def repeat_offenders(unified: DataFrame, rollup: DataFrame) -> DataFrame:
    bad = unified.join(rollup.filter("is_manipulated"), "run_id", "left_semi")
    return bad.groupBy("acc_number").agg(
        F.count(F.lit(1)).alias("statements"),
        F.sum("duplicate_count").alias("total_duplicates"),
        ratio("balance_diff_change_ratio", 4).alias("avg_change_ratio"),
    ).filter("statements > 1").orderBy(F.desc("statements"), F.desc("total_duplicates"), "acc_number")


def verdict_mix(unified: DataFrame) -> DataFrame:
    out = unified.filter("acc_prvdr_code = 'UATL'").groupBy("custom_verification").agg(
        F.count(F.lit(1)).alias("statements"), ratio("balance_diff_change_ratio", 2, 100).alias("avg_balance_diff")
    )
    return out.withColumn("percentage", share("statements")).orderBy(verdict_order())


def rm_performance(unified: DataFrame, at_least: int = 10) -> DataFrame:
    c = F.col
    out = unified.filter("acc_prvdr_code = 'UATL' and rm_name is not null").groupBy("rm_name").agg(
        n_if(c("custom_verification") == "FATAL").alias("fatal_count"),
        n_if(c("custom_verification") == "NO_ISSUES").alias("verified_count"),
        F.count(F.lit(1)).alias("total_statements"),
    )
    out = out.withColumn("fatal_rate", F.round(c("fatal_count") * 100.0 / c("total_statements"), 2))
    return out.filter(c("total_statements") >= at_least).orderBy(F.desc("fatal_count"), "rm_name")


def flagged_borrowers(unified: DataFrame, customers: DataFrame, at_least: int = 2) -> DataFrame:
    fatal = unified.filter("custom_verification = 'FATAL'").select("run_id")
    out = customers.join(fatal, "run_id", "left_semi").groupBy("borrower_biz_name", "cust_id", "risk_category", "crnt_fa_limit").agg(
        F.count(F.lit(1)).alias("fatal_count")
    )
    return out.filter(F.col("fatal_count") >= at_least).orderBy(F.desc("fatal_count"), "cust_id")


def gap_distribution(summary: DataFrame) -> DataFrame:
    out = summary.filter("gap_related_balance_changes > 0").groupBy("gap_related_balance_changes").agg(F.count(F.lit(1)).alias("statement_count"))
    return out.withColumn("percentage", share("statement_count")).orderBy("gap_related_balance_changes")


def gap_consistency(summary: DataFrame) -> DataFrame:
    return summary.agg(
        n_if(F.col("missing_days_detected")).alias("with_missing_days"), n_if(F.col("gap_related_balance_changes") > 0).alias("with_gap_changes")
    )


def weekly_gaps(unified: DataFrame, high: int = 5) -> DataFrame:
    return unified.filter("verification_status is not null").groupBy(F.weekofyear("submitted_date").cast("long").alias("week")).agg(
        F.count(F.lit(1)).alias("total"), n_if(F.col("gap_related_balance_changes") >= high).alias("high_gaps")
    ).orderBy(F.desc("week"))


def registering_rms(analysis: DataFrame) -> DataFrame:
    return analysis.filter("registered_rm is not null").groupBy("registered_rm").agg(
        F.countDistinct("cust_id").alias("customers_registered"), total("tot_os_amount").alias("total_os_amount")
    ).orderBy(F.desc("customers_registered"), "registered_rm")


def overdue_rms(loans: DataFrame, rm: str = "statement_rm_name") -> DataFrame:
    return loans.filter("status = 'overdue'").groupBy(F.col(rm).alias("rm_name")).agg(
        F.count(F.lit(1)).alias("overdue_loan_disbursals"), total("os_amount").alias("total_os_amount")
    ).orderBy(F.desc("overdue_loan_disbursals"), "rm_name")


def payment_performance(analysis: DataFrame) -> DataFrame:
    c = F.col
    return analysis.agg(
        F.lit("Payment Performance").alias("category"),
        n_if(c("tot_ontime_count") == c("tot_loans")).alias("customers_paying_ontime"),
        n_if((c("tot_3_day_late_loans") > 0) | (c("tot_10_day_late_loans") > 0)).alias("customers_paying_late"),
        n_if(c("last_loan_status") == "ongoing").alias("customers_currently_ongoing"),
        n_if(c("tot_overdue_loans") > 0).alias("customers_currently_overdue"),
        total("tot_os_amount").alias("total_os_amount"),
        n_if(c("days_since_last_loan") <= 30).alias("customers_active_last_30_days"),
    )


def first_submission_trend(analysis: DataFrame) -> DataFrame:
    return analysis.groupBy(F.date_format("first_submitted_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("fraud_submissions"), F.countDistinct("cust_id").alias("unique_customers")
    ).orderBy(F.desc("month"))


def batch_outcome(requested: DataFrame, already: DataFrame, processed: DataFrame) -> DataFrame:
    """Outcome of a processing request: skipped when summarised before, failed when no rows
    came out, with the number of transactions handled."""
    sized = processed.groupBy("run_id").agg(F.count(F.lit(1)).alias("_rows"))
    out = requested.select("run_id").join(already.select("run_id", F.lit(True).alias("_done")), "run_id", "left").join(sized, "run_id", "left")
    status = F.when(F.col("_done"), "skipped").when(F.col("_rows") > 0, "success").otherwise("failed")
    handled = F.when(F.col("status") == "success", F.col("_rows")).otherwise(0)
    return out.withColumn("status", status).groupBy("status").agg(
        F.count(F.lit(1)).alias("statements"), F.sum(handled).alias("transactions")
    )


def quality_by_account(rows: DataFrame) -> DataFrame:
    return rows.filter("has_quality_issue").groupBy("acc_number").agg(
        F.count(F.lit(1)).alias("issue_count"), F.countDistinct("run_id").alias("affected_statements")
    ).orderBy(F.desc("issue_count"), "acc_number")


def quality_percentages(meta: DataFrame) -> DataFrame:
    pct = F.round(F.try_divide(F.col("quality_issues_count"), F.col("num_rows")) * 100, 2)
    return meta.filter("quality_issues_count > 0").select(
        "run_id", "acc_number", "quality_issues_count", "num_rows", pct.alias("quality_issue_percentage")
    ).orderBy(F.desc("quality_issues_count"), "run_id")


def issue_type(raw: Column) -> Column:
    return F.when(raw.contains("-"), "Trailing minus sign").when(raw.rlike("[A-Za-z]"), "Contains letters").otherwise("Other issue")


def gap_impact(summary: DataFrame) -> DataFrame:
    gaps = n_if(F.col("missing_days_detected"))
    return summary.filter("balance_match = 'Failed'").agg(
        F.count(F.lit(1)).alias("total_statements"),
        gaps.alias("statements_with_gaps"),
        F.round(gaps * 100.0 / F.count(F.lit(1)), 2).alias("gap_percentage"),
        F.sum("gap_related_balance_changes").alias("total_gap_related_changes"),
        F.sum("balance_diff_changes").alias("total_balance_changes"),
    )


def mostly_gaps(unified: DataFrame, top: int = 20) -> DataFrame:
    c = F.col
    pct = F.round(c("gap_related_balance_changes") * 100.0 / c("balance_diff_changes"), 1)
    return unified.filter("missing_days_detected and balance_diff_changes > 0").select(
        "run_id", "acc_number", "gap_related_balance_changes", "balance_diff_changes", pct.alias("gap_percentage")
    ).orderBy(F.desc("gap_percentage"), "run_id").limit(top)


def reversals_of_failed(summary: DataFrame, flagged: DataFrame) -> DataFrame:
    """Reversals are counted per run before the join, so long statements stay cheap."""
    n = flagged.filter("special_txn_type = 'Transaction Reversal'").groupBy("run_id").agg(F.count(F.lit(1)).alias("reversal_count"))
    failed = summary.filter("balance_match = 'Failed'").select("run_id", "acc_number", "balance_diff_changes", "verification_status")
    return failed.join(n, "run_id").orderBy(F.desc("reversal_count"), "run_id")


def provider_statements(summary: DataFrame) -> DataFrame:
    return summary.groupBy(F.col("acc_prvdr_code").alias("provider")).agg(
        F.count(F.lit(1)).alias("total_statements"),
        F.sum("duplicate_count").alias("total_duplicates"),
        ratio("balance_diff_change_ratio", 6).alias("avg_change_ratio"),
        n_if(F.col("balance_match") == "Failed").alias("failed_verifications"),
    )


def provider_rows(summary: DataFrame) -> DataFrame:
    """Rows and duplicates, from the statements' own counts."""
    return summary.groupBy(F.col("acc_prvdr_code").alias("provider")).agg(
        F.sum("num_rows").alias("total_transactions"), F.sum("duplicate_count").alias("duplicates")
    )


def accounts_at_several(meta: DataFrame) -> DataFrame:
    """Accounts with statements of more than one provider (the list is of provider codes)."""
    return meta.groupBy("acc_number").agg(
        F.array_join(F.array_sort(F.collect_set("acc_prvdr_code")), ",").alias("providers"),
        F.count(F.lit(1)).alias("statement_count"),
        F.countDistinct("acc_prvdr_code").alias("_n"),
    ).filter("_n > 1").drop("_n")


def rm_verdicts(unified: DataFrame) -> DataFrame:
    return unified.filter("acc_prvdr_code = 'UATL' and custom_verification is not null").groupBy("rm_name", "custom_verification").agg(
        F.count(F.lit(1)).alias("statements"), ratio("balance_diff_change_ratio", 6).alias("avg_balance_diff")
    ).orderBy("rm_name", verdict_order())


def fatal_per_rm(unified: DataFrame) -> DataFrame:
    return unified.filter("acc_prvdr_code = 'UATL' and custom_verification = 'FATAL'").groupBy("rm_name").agg(
        F.count(F.lit(1)).alias("fatal_count")
    ).orderBy(F.desc("fatal_count"), "rm_name")


def by_status(unified: DataFrame) -> DataFrame:
    return unified.groupBy("unified_status", "processing_status").agg(F.count(F.lit(1)).alias("statements"))


def statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and statements per table and provider."""
    out = None
    for name, df in tables.items():
        part = df.groupBy("acc_prvdr_code").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("run_id").alias("statements"))
        part = part.select(F.lit(name).alias("table_name"), "acc_prvdr_code", "records", "statements")
        out = part if out is None else out.unionByName(part)
    return out


def reprocess_rollup(compared: DataFrame) -> DataFrame:
    c = F.col
    return compared.agg(
        *[n_if(c("outcome") == o).alias(o.lower()) for o in ("IMPROVED", "DEGRADED", "UNCHANGED", "NEW")],
        n_if(c("balance_match") == "Success").alias("success"),
        n_if(c("balance_match") == "Failed").alias("failed"),
        n_if(c("uses_implicit_cashback")).alias("cashback_enabled"),
        n_if(c("uses_implicit_ind02_commission")).alias("ind02_enabled"),
    )


def pass_rates(unified: DataFrame) -> DataFrame:
    """Overall, by file type and by month in one pass (grouping sets)."""
    c = F.col
    rows = unified.withColumns({"file_type": F.lower(F.regexp_extract("pdf_path", r"\.([^.]+)$", 1)), "month": F.date_format("submitted_date", "yyyy-MM")})
    per = rows.groupingSets([[c("file_type")], [c("month")], []], c("file_type"), c("month")).agg(
        F.count(F.lit(1)).alias("total"),
        n_if(c("verification_status") == "PASS").alias("passed"),
        n_if(c("verification_status") == "FAIL").alias("failed"),
    )
    return per.withColumn("pass_rate", F.round(c("passed") * 100.0 / c("total"), 1))
