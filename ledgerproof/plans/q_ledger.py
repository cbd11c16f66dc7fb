"""Queries: row-level detection, ordering, running balance, statement summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerproof.functions import amounts as A
from ledgerproof.operators import detect, ledger
from ledgerproof.operators.sequence import ARRIVAL, PRINTED, order_struct, scan
from ledgerproof.plans.registry import query

RUN = ["run_id"]


@query("c19_loan_repayment_sign", "SELECT run_id, seq, (-amount)::DOUBLE AS amount FROM txn WHERE acc_prvdr_code = 'UMTN' AND txn_type = 'LOAN_REPAYMENT' AND amount > 0")
def _(t):
    return ledger.normalise_signs(t.umtn, t.sizing).filter("txn_type = 'LOAN_REPAYMENT' and amount < 0").select("run_id", "seq", "amount")


@query("c20_adjustment_sign", "SELECT run_id, seq, amount::DOUBLE AS amount FROM normal WHERE txn_type = 'ADJUSTMENT'")
def _(t):
    return ledger.normalise_signs(t.umtn, t.sizing).filter("txn_type = 'ADJUSTMENT'").select("run_id", "seq", "amount")


@query("d1_duplicates", "SELECT run_id, seq, txn_id, is_duplicate FROM flagged")
def _(t):
    return detect.flag_duplicates(ledger.normalise_signs(t.txn, t.sizing), t.sizing).select("run_id", "seq", "txn_id", "is_duplicate")


@query("d2_special_transactions", "SELECT run_id, seq, special_txn_type IS NOT NULL AS is_special_txn, special_txn_type FROM flagged")
def _(t):
    return detect.flag_special(t.txn).select("run_id", "seq", "is_special_txn", "special_txn_type")


@query("d3_status_filter", "SELECT run_id, count(*) AS kept FROM uatl_txn WHERE format = 'format_2' AND upper(coalesce(status, '')) NOT IN ('FAILED', 'ROLLBACKED') GROUP BY run_id")
def _(t):
    return detect.drop_failed(t.uatl.filter("format = 'format_2'")).groupBy("run_id").agg(F.count(F.lit(1)).alias("kept"))


FORMAT2 = {
    "f2_kept": """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, txn_date, amount, balance, lower(description) LIKE '%commission%' ORDER BY seq) AS rn
  FROM uatl_txn WHERE format = 'format_2' AND upper(coalesce(status, '')) NOT IN ('FAILED', 'ROLLBACKED'))
WHERE rn = 1 OR lower(description) NOT LIKE '%commission%'
""",
    "f2_marked": """
SELECT *, (lower(description) LIKE '%commission%' AND lower(description) LIKE '%disbursement%') OR lower(description) LIKE '%deallocation%'
       OR lower(description) LIKE '%rollback%' OR lower(description) LIKE '%transaction reversal%' AS balance_restart FROM f2_kept
""",
}


def _format2(t):
    return detect.format2_rules(t.uatl.filter("format = 'format_2'"))


@query("d4_commission_dedupe", "SELECT run_id, seq FROM f2_kept", FORMAT2)
def _(t):
    return _format2(t).select("run_id", "seq")


@query("d5_restart_marks", "SELECT run_id, seq, balance_restart FROM f2_marked", FORMAT2)
def _(t):
    return _format2(t).select("run_id", "seq", "balance_restart")


@query(
    "d6_sequence_in_date",
    """SELECT run_id, seq, row_number() OVER (PARTITION BY run_id, txn_date ORDER BY CASE WHEN amount < 0 THEN -1 ELSE 1 END, balance, seq) - 1 AS sequence FROM f2_kept""",
    FORMAT2,
)
def _(t):
    return detect.number_within_date(_format2(t), t.sizing).select("run_id", "seq", "sequence")


@query("d7_implicit_fee", "SELECT run_id, seq, (x_ind - x_cash)::DOUBLE AS implicit_fee FROM moved WHERE acc_prvdr_code = 'UATL'")
def _(t):
    fee = A.implicit_fee(F.col("amount"), F.col("description"), F.lit(True), F.lit(True))
    return t.uatl.select("run_id", "seq", fee.alias("implicit_fee"))


@query(
    "d8_cashback_vote",
    "SELECT run_id, cashback_for, cashback_against, cashback_for > cashback_against AS uses_implicit_cashback FROM votes WHERE run_id LIKE 'U%'",
)
def _(t):
    return detect.fee_votes(t.uatl, t.sizing).select("run_id", "cashback_for", "cashback_against", "uses_implicit_cashback")


@query(
    "d9_commission_vote",
    "SELECT run_id, ind02_for, ind02_against, ind02_for > ind02_against AS uses_implicit_ind02_commission FROM votes WHERE run_id LIKE 'U%'",
)
def _(t):
    return detect.fee_votes(t.uatl, t.sizing).select("run_id", "ind02_for", "ind02_against", "uses_implicit_ind02_commission")


@query("d10_signed_runs", "SELECT run_id, bool_or(amount < 0) AS is_signed FROM uatl_txn GROUP BY run_id")
def _(t):
    return detect.signed_runs(t.uatl)


@query("b1_base_order", "SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY txn_date NULLS LAST, balance DESC NULLS LAST, seq) AS base_pos FROM txn")
def _(t):
    def step(rows):
        return rows.running_sum(F.lit(1), "base_pos").df

    return scan(t.txn, RUN, PRINTED, step, t.sizing).select("run_id", "seq", F.col("base_pos").cast("long").alias("base_pos"))


@query("b2_tie_order_format1", "SELECT run_id, seq, pos FROM processed WHERE format = 'format_1'")
def _(t):
    return ledger.verify(t.uatl.filter("format = 'format_1'"), t.sizing, keep=()).select("run_id", "seq", "pos")


@query(
    "b2_left_in_printed_order",
    """SELECT run_id, coalesce(sum(n) FILTER (WHERE txn_date IS NULL), 0)::BIGINT AS undated_rows, count(*) FILTER (WHERE n > 6 AND txn_date > first_date) AS large_groups
       FROM (SELECT run_id, txn_date, count(*) AS n, min(txn_date) OVER (PARTITION BY run_id) AS first_date FROM txn WHERE format <> 'format_2' GROUP BY run_id, txn_date) GROUP BY run_id""",
)
def _(t):
    return ledger.left_in_printed_order(t.txn)


@query("b3_tie_order_sheets", "SELECT run_id, seq, pos FROM processed WHERE acc_prvdr_code = 'UMTN'")
def _(t):
    return ledger.verify(t.umtn, t.sizing, keep=()).select("run_id", "seq", "pos")


@query("b4_opening_balance", "SELECT run_id, opening::DOUBLE AS opening_balance FROM r1 WHERE pos = 1")
def _(t):
    # The first row of the final order is the first of the base order: the first group is never re-ordered.
    known = scan(t.txn, RUN, ARRIVAL, ledger._prepared, t.sizing)
    moved = ledger.with_movements(known.filter("format = 'format_2' or txn_date is not null"))
    return moved.groupBy("run_id").agg(F.min_by("_opening", order_struct(PRINTED)).alias("opening_balance"))


@query("b5_apply_rule_first_provider", "SELECT run_id, seq, (s - f - x)::DOUBLE AS delta FROM moved WHERE acc_prvdr_code = 'UATL'")
def _(t):
    known = scan(t.uatl, RUN, ARRIVAL, ledger._prepared, t.sizing)
    plain = known.withColumns({"is_duplicate": F.lit(False), "special_txn_type": F.lit(None).cast("string")})
    return ledger.with_movements(plain).select("run_id", "seq", F.col("_delta").alias("delta"))


@query("b6_apply_rule_sheets", "SELECT run_id, seq, (s - f)::DOUBLE AS delta FROM moved WHERE acc_prvdr_code = 'UMTN'")
def _(t):
    c = F.col
    rows = ledger.normalise_signs(t.umtn, t.sizing)
    moved = A.movement(c("acc_prvdr_code"), c("format"), F.lit(False), c("txn_type"), c("txn_direction"), c("amount"))
    return rows.select("run_id", "seq", A.apply_delta(moved, A.money(c("fee")), A.money(F.lit(0))).alias("delta"))


@query(
    "b7_running_balance",
    "SELECT run_id, seq, pos, calc::DOUBLE AS calculated_running_balance FROM processed",
)
def _(t):
    return t.replay.select("run_id", "seq", "pos", "calculated_running_balance")


@query("b8_balance_diff", "SELECT run_id, seq, diff::DOUBLE AS balance_diff FROM processed")
def _(t):
    return t.replay.select("run_id", "seq", "balance_diff")


@query("b9_diff_changes", "SELECT run_id, seq, changes AS balance_diff_change_count FROM processed")
def _(t):
    return t.replay.select("run_id", "seq", "balance_diff_change_count")


@query(
    "b10_gap_changes",
    "SELECT run_id, count(*) FILTER (WHERE gap) > 0 AS missing_days_detected, count(*) FILTER (WHERE gap) AS gap_related_balance_changes FROM processed GROUP BY run_id",
)
def _(t):
    out = t.replay.groupBy("run_id").agg(F.count_if("gap_related").alias("gap_related_balance_changes"))
    return out.withColumn("missing_days_detected", F.col("gap_related_balance_changes") > 0)


CLOSED = {
    **FORMAT2,
    "cf_rows": """
SELECT run_id, format, seq, txn_date, amount, fee, balance, txn_direction, balance_restart FROM f2_marked
UNION ALL SELECT run_id, format, seq, txn_date, amount, fee, balance, txn_direction, false FROM uatl_txn WHERE format = 'format_1'
""",
    "cf_ord": """
SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY txn_date, CASE WHEN amount < 0 THEN -1 ELSE 1 END, balance, seq) AS rn FROM cf_rows
""",
    "cf_last": "SELECT run_id, max(rn) FILTER (WHERE balance_restart) AS last_rn, count(*) FILTER (WHERE balance_restart) AS restarts FROM cf_ord GROUP BY run_id",
    "cf_agg": """
SELECT run_id, any_value(format) AS format, any_value(restarts) AS restarts, arg_min(balance, rn) AS fb, arg_min(amount, rn) AS fa, arg_min(fee, rn) AS ff, arg_min(lower(txn_direction), rn) AS fd,
       arg_max(balance, rn) AS stmt, arg_max(balance, rn) FILTER (WHERE balance_restart) AS rb, coalesce(sum(amount) FILTER (WHERE rn > last_rn), 0) AS after_sum, sum(amount) AS all_sum,
       coalesce(sum(amount) FILTER (WHERE CASE WHEN format = 'format_2' THEN amount > 0 ELSE lower(txn_direction) = 'credit' END), 0) AS credits,
       coalesce(sum(CASE WHEN format = 'format_2' THEN -amount ELSE amount END) FILTER (WHERE CASE WHEN format = 'format_2' THEN amount < 0 ELSE lower(txn_direction) = 'debit' END), 0) AS debits,
       sum(fee) AS fees
FROM cf_ord JOIN cf_last USING (run_id) GROUP BY run_id
""",
    "cf": """
SELECT *, CASE WHEN format = 'format_2' THEN fb - fa WHEN fd = 'credit' THEN fb - fa - ff ELSE fb + fa + ff END AS opening,
       CASE WHEN format = 'format_2' THEN coalesce(rb + after_sum, opening + all_sum)
            WHEN fees > 0 AND abs(opening + credits - debits - fees - stmt) < abs(opening + credits - debits - stmt) THEN opening + credits - debits - fees
            ELSE opening + credits - debits END AS closing
FROM cf_agg
""",
}


@query(
    "b11_segmented_close",
    "SELECT run_id, restarts, opening::DOUBLE AS opening_balance, closing::DOUBLE AS calculated_closing_balance FROM cf WHERE format = 'format_2'",
    CLOSED,
)
def _(t):
    return ledger.segmented_close(_format2(t))


@query(
    "b12_closed_form_summary",
    """SELECT run_id, format, opening::DOUBLE AS opening_balance, credits::DOUBLE AS credits, debits::DOUBLE AS debits, fees::DOUBLE AS fees, 0::DOUBLE AS charges,
       closing::DOUBLE AS calculated_closing_balance, stmt::DOUBLE AS stmt_closing_balance, abs(closing - stmt)::DOUBLE AS balance_diff,
       CASE WHEN abs(closing - stmt) < 0.01 THEN 'Success' ELSE 'Failed' END AS balance_match FROM cf""",
    CLOSED,
)
def _(t):
    one = t.uatl.filter("format = 'format_1'").withColumn("balance_restart", F.lit(False))
    return ledger.closed_form_summary(_format2(t).unionByName(one))


@query(
    "b13_credits_debits",
    """SELECT run_id, coalesce(sum(amount) FILTER (WHERE CASE WHEN format = 'format_1' AND NOT sg THEN lower(txn_direction) = 'credit' ELSE amount > 0 END), 0)::DOUBLE AS credits,
       abs(coalesce(sum(amount) FILTER (WHERE CASE WHEN format = 'format_1' AND NOT sg THEN lower(txn_direction) = 'debit' ELSE amount < 0 END), 0))::DOUBLE AS debits
       FROM (SELECT *, bool_or(amount < 0) OVER (PARTITION BY run_id) AS sg FROM normal) GROUP BY run_id""",
)
def _(t):
    return ledger.credits_debits(ledger.normalise_signs(t.txn, t.sizing))


_SUMMARY_SQL = """SELECT run_id, acc_prvdr_code, format, num_rows, first_balance::DOUBLE AS first_balance, last_balance::DOUBLE AS last_balance,
   calculated_closing_balance::DOUBLE AS calculated_closing_balance, balance_diff_changes, duplicate_count, gap_related_balance_changes, missing_days_detected,
   credits::DOUBLE AS credits, debits::DOUBLE AS debits, fees::DOUBLE AS fees, 0::DOUBLE AS charges, start_date, end_date, uses_implicit_cashback, uses_implicit_ind02_commission,
   balance_match, balance_diff_change_ratio, verification_status, verification_reason FROM summary"""


@query("b14_statement_summary", _SUMMARY_SQL)
def _(t):
    return t.summary


@query(
    "b15_date_span",
    """SELECT run_id, min(CAST(txn_date AS DATE)) AS start_date, max(CAST(txn_date AS DATE)) AS end_date, arg_min(balance, (txn_date, seq))::DOUBLE AS first_balance,
       arg_max(balance, (txn_date, seq))::DOUBLE AS last_balance, count(*) AS num_rows FROM txn GROUP BY run_id""",
)
def _(t):
    return ledger.date_span(t.txn)
