"""Queries: lineage joins, loan and statement reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerproof.operators import detect, forensic, ledger, lineage, reports
from ledgerproof.plans.oracles import BLOCKS, replay_steps
from ledgerproof.plans.q_forensic import HEADERS
from ledgerproof.plans.registry import query

LOANS_AS_OF = "2001-08-20"

BLOCKS["mapper"] = """
SELECT run_id, acc_number, rm_name, acc_prvdr_code, 'active' AS status, CASE WHEN num % 5 = 0 THEN 'score_calc_failed' ELSE 'score_calc_success' END AS lambda_status, submitted_date AS created_date
FROM statement_meta WHERE num % 4 <> 3
"""


def mapper(t):
    return t.meta.filter("num % 4 <> 3").selectExpr(
        "run_id", "acc_number", "rm_name", "acc_prvdr_code", "'active' AS status",
        "CASE WHEN num % 5 = 0 THEN 'score_calc_failed' ELSE 'score_calc_success' END AS lambda_status", "submitted_date AS created_date",
    )


# -- joins -----------------------------------------------------------------------------------


@query("j1_metadata_summary", "SELECT run_id, num_rows, balance_match, verification_status, processing_status FROM unified")
def _(t):
    return t.unified.select("run_id", "num_rows", "balance_match", "verification_status", "processing_status")


@query("j2_statements_customers", "SELECT run_id, unified_status, cust_id, borrower_biz_name FROM unified LEFT JOIN customer_details USING (run_id)")
def _(t):
    return t.unified.join(t.customers.select("run_id", "cust_id", "borrower_biz_name"), "run_id", "left").select(
        "run_id", "unified_status", "cust_id", "borrower_biz_name"
    )


BLOCKS["final_entity"] = """
SELECT r.id AS stmt_request_id, flow_req_id AS run_id, acc_number, acc_prvdr_code, lambda_status, CAST(created_at AS DATE) AS created_date, created_by, r.entity AS direct_entity, r.entity_id AS direct_entity_id,
  c.id AS customer_statement_id, c.entity AS cs_entity, c.status AS cs_status, CASE WHEN r.entity = 'customer_statement' THEN c.entity ELSE r.entity END AS final_entity_type,
  CASE WHEN r.entity = 'customer_statement' THEN TRY_CAST(c.entity_id AS BIGINT) ELSE r.entity_id END AS final_entity_id
FROM stmt_requests r LEFT JOIN customer_statements c ON r.entity = 'customer_statement' AND c.id = r.entity_id
"""


def _final(t):
    return lineage.final_entities(t.requests, t.customer_statements)


@query("j3_final_entity", "SELECT * EXCLUDE (created_by) FROM final_entity")
def _(t):
    return _final(t).drop("created_by")


@query(
    "j4_entity_details",
    """SELECT stmt_request_id, l.id AS lead_id, l.cust_id AS cust_id, biz_name, NULL::BIGINT AS reassessment_id, NULL::DOUBLE AS rr_prev_limit FROM final_entity f JOIN leads l ON f.final_entity_type = 'lead' AND l.id = f.final_entity_id
       UNION ALL SELECT stmt_request_id, NULL, r.cust_id, NULL, r.id, r.prev_limit::DOUBLE FROM final_entity f JOIN reassessments r ON f.final_entity_type = 'reassessment_result' AND r.id = f.final_entity_id""",
)
def _(t):
    leads = lineage.lead_details(_final(t), t.leads).withColumnsRenamed({"lead_cust_id": "cust_id", "lead_biz_name": "biz_name"})
    rr = lineage.reassessment_details(_final(t), t.reassessments).withColumnRenamed("rr_cust_id", "cust_id")
    return leads.unionByName(rr, allowMissingColumns=True)


BLOCKS["entities"] = """
SELECT f.*, l.id AS lead_id, l.biz_name AS lead_biz_name, r.id AS reassessment_id, r.prev_limit AS rr_prev_limit, coalesce(l.cust_id, r.cust_id) AS cust_id
FROM final_entity f LEFT JOIN leads l ON f.final_entity_type = 'lead' AND l.id = f.final_entity_id LEFT JOIN reassessments r ON f.final_entity_type = 'reassessment_result' AND r.id = f.final_entity_id
"""


@query("j5_borrower_key", "SELECT e.stmt_request_id, e.cust_id, b.id AS borrower_id, b.biz_name AS borrower_biz_name FROM entities e JOIN borrowers b USING (cust_id)")
def _(t):
    e = lineage.with_entities(_final(t), t.leads, t.reassessments).select("stmt_request_id", "cust_id")
    b = t.borrowers.select("cust_id", F.col("id").alias("borrower_id"), F.col("biz_name").alias("borrower_biz_name"))
    return e.join(b, "cust_id")


BLOCKS["lineage_rows"] = """
SELECT e.*, p.id AS rm_id, CASE WHEN p.id IS NOT NULL THEN concat_ws(' ', p.first_name, p.middle_name, p.last_name) END AS rm_name, b.id AS borrower_id, b.cust_id AS borrower_cust_id, b.biz_name AS borrower_biz_name, b.crnt_fa_limit,
  g.id AS reg_rm_id, CASE WHEN g.id IS NOT NULL THEN concat_ws(' ', g.first_name, g.middle_name, g.last_name) END AS reg_rm_name, k.id AS current_rm_id, CASE WHEN k.id IS NOT NULL THEN concat_ws(' ', k.first_name, k.middle_name, k.last_name) END AS current_rm_name
FROM entities e LEFT JOIN persons p ON p.id = e.created_by LEFT JOIN borrowers b ON b.cust_id = e.cust_id LEFT JOIN persons g ON g.id = b.reg_flow_rel_mgr_id LEFT JOIN persons k ON k.id = b.flow_rel_mgr_id
"""


def _lineage(t, **kw):
    return lineage.customer_lineage(t.requests, t.customer_statements, t.leads, t.reassessments, t.borrowers, t.persons, **kw)


@query("j6_person_roles", "SELECT run_id, rm_name, reg_rm_name, current_rm_name FROM lineage_rows")
def _(t):
    return _lineage(t).select("run_id", "rm_name", "reg_rm_name", "current_rm_name")


@query("j7_customer_lineage", "SELECT * EXCLUDE (created_by) REPLACE (rr_prev_limit::DOUBLE AS rr_prev_limit, crnt_fa_limit::DOUBLE AS crnt_fa_limit) FROM lineage_rows WHERE created_date >= DATE '2025-03-10'")
def _(t):
    return _lineage(t, cutoff="2025-03-10 00:00:00")


@query("c22_full_names", "SELECT id, concat_ws(' ', first_name, middle_name, last_name) AS full_name FROM persons")
def _(t):
    return t.persons.select("id", lineage.full_name().alias("full_name"))


@query(
    "j8_enrich_metadata",
    """SELECT m.run_id, coalesce(CASE WHEN c.known THEN c.rm_name ELSE x.rm_name END, m.rm_name) AS rm_name, CASE WHEN c.known THEN m.acc_prvdr_code ELSE coalesce(x.acc_prvdr_code, m.acc_prvdr_code) END AS acc_prvdr_code,
       CASE WHEN c.known THEN m.acc_number ELSE coalesce(x.acc_number, m.acc_number) END AS acc_number, CASE WHEN c.known THEN m.submitted_date ELSE coalesce(x.created_date, m.submitted_date) END AS submitted_date
       FROM statement_meta m LEFT JOIN (SELECT run_id, reg_rm_name AS rm_name, true AS known FROM customer_details WHERE cust_id IS NOT NULL) c USING (run_id) LEFT JOIN mapper x USING (run_id)""",
)
def _(t):
    primary = t.customers.filter("cust_id is not null").select("run_id", F.col("reg_rm_name").alias("rm_name"))
    return lineage.enrich(t.meta, primary, mapper(t)).select("run_id", "rm_name", "acc_prvdr_code", "acc_number", "submitted_date")


@query("j9_latest_mapping", "SELECT acc_number, arg_max(run_id, (created_date, run_id)) AS run_id, max(created_date) AS created_date FROM mapper GROUP BY acc_number")
def _(t):
    return lineage.latest_per_account(mapper(t)).select("acc_number", "run_id", "created_date")


BLOCKS["flagged_stmts"] = """
SELECT u.*, c.cust_id, c.borrower_biz_name FROM unified u LEFT JOIN customer_details c USING (run_id)
WHERE acc_prvdr_code = 'UATL' AND custom_verification = 'FATAL' AND format IN ('format_1', 'format_2')
"""
BLOCKS["cust_rms"] = "SELECT cust_id, arg_max(rm_name, (submitted_date, run_id)) AS statement_rm_name FROM flagged_stmts WHERE cust_id IS NOT NULL GROUP BY cust_id"
BLOCKS["loans_raw"] = f"""
SELECT l.*, concat_ws(' ', p.first_name, p.middle_name, p.last_name) AS loan_applier_name, u.role_codes AS loan_applier_role, r.statement_rm_name,
  date_diff('day', due_date, coalesce(paid_date, DATE '{LOANS_AS_OF}')) AS overdue_days_calc
FROM loans l JOIN cust_rms r USING (cust_id) LEFT JOIN app_users u ON u.id = l.loan_applied_by LEFT JOIN persons p ON p.id = u.person_id
WHERE l.product_id NOT IN (SELECT id FROM loan_products WHERE product_type = 'float_vending') AND l.status NOT IN ('voided', 'hold', 'pending_approval', 'rejected')
"""


def _flagged(t):
    return reports.flagged_statements(t.unified, t.customers)


def _loans(t):
    return lineage.loans_of(_flagged(t), t.loans, t.app_users, t.persons, t.products, LOANS_AS_OF)


@query("j10_customer_loans", "SELECT loan_doc_id, cust_id, product_id, status, loan_applier_name, loan_applier_role, overdue_days_calc FROM loans_raw")
def _(t):
    return _loans(t).select("loan_doc_id", "cust_id", "product_id", "status", "loan_applier_name", "loan_applier_role", "overdue_days_calc")


@query("j11_flagged_customers", "SELECT run_id, cust_id FROM customer_details WHERE cust_id IN (SELECT cust_id FROM flagged_stmts WHERE cust_id IS NOT NULL)")
def _(t):
    return t.customers.join(_flagged(t).filter("cust_id is not null").select("cust_id"), "cust_id", "left_semi").select("run_id", "cust_id")


@query("j12_unprocessed_runs", "SELECT run_id FROM statement_meta WHERE acc_prvdr_code = 'UATL' AND run_id NOT IN (SELECT run_id FROM summary WHERE num_rows > 50)")
def _(t):
    return lineage.unprocessed(t.meta, t.summary.filter("num_rows > 50"), "UATL")


@query("j13_not_imported", "SELECT run_id FROM statement_meta WHERE run_id NOT IN (SELECT run_id FROM uatl_txn WHERE num % 2 = 0 UNION SELECT run_id FROM mapper)")
def _(t):
    return lineage.not_imported(t.meta.select("run_id"), t.uatl.filter("num % 2 = 0"), mapper(t))


@query(
    "j14_fill_missing",
    """SELECT m.run_id, coalesce(CASE WHEN num % 3 <> 0 THEN m.rm_name END, x.rm_name) AS rm_name, coalesce(CASE WHEN num % 5 <> 0 THEN submitted_date END, x.created_date) AS submitted_date,
       coalesce(CASE WHEN num % 4 <> 0 THEN m.num_rows END, s.n) AS num_rows, s.a AS start_date, s.b AS end_date, s.fb::DOUBLE AS first_balance, s.lb::DOUBLE AS last_balance
       FROM statement_meta m LEFT JOIN (SELECT run_id, count(*) AS n, min(CAST(txn_date AS DATE)) AS a, max(CAST(txn_date AS DATE)) AS b, arg_min(balance, (txn_date, seq)) AS fb, arg_max(balance, (txn_date, seq)) AS lb FROM txn GROUP BY run_id) s USING (run_id)
       LEFT JOIN mapper x USING (run_id)""",
)
def _(t):
    holes = t.meta.selectExpr(
        "run_id", "CASE WHEN num % 3 <> 0 THEN rm_name END AS rm_name", "CASE WHEN num % 5 <> 0 THEN submitted_date END AS submitted_date",
        "CASE WHEN num % 4 <> 0 THEN num_rows END AS num_rows", "CAST(NULL AS DATE) AS start_date", "CAST(NULL AS DATE) AS end_date",
        "CAST(NULL AS DECIMAL(18,2)) AS first_balance", "CAST(NULL AS DECIMAL(18,2)) AS last_balance",
    )
    known = mapper(t).withColumnRenamed("created_date", "submitted_date")
    raw = dict.fromkeys(("num_rows", "start_date", "end_date", "first_balance", "last_balance"), "raw")
    return lineage.fill_missing(holes, ledger.date_span(t.txn), known, {"rm_name": "mapper", "submitted_date": "mapper", **raw})


@query("j15_loan_statement_rm", "SELECT loan_doc_id, cust_id, statement_rm_name FROM loans_raw")
def _(t):
    return _loans(t).select("loan_doc_id", "cust_id", "statement_rm_name")


# -- fee strategies and re-runs -----------------------------------------------------------------

STRATEGY = {
    "s_rows": """
SELECT p.* EXCLUDE (x, cb, ind), strategy, CASE strategy WHEN 'voting' THEN cb ELSE strategy = 'always_enable' END AS cb, CASE strategy WHEN 'voting' THEN ind ELSE strategy = 'always_enable' END AS ind,
  CAST(CASE WHEN CASE strategy WHEN 'voting' THEN p.ind ELSE strategy = 'always_enable' END THEN x_ind ELSE 0 END - CASE WHEN CASE strategy WHEN 'voting' THEN p.cb ELSE strategy = 'always_enable' END THEN x_cash ELSE 0 END AS DECIMAL(22,5)) AS x
FROM placed p, (VALUES ('always_enable'), ('always_disable'), ('voting')) AS v(strategy) WHERE acc_prvdr_code = 'UATL'
""",
    **replay_steps("s_rows", "s_", "strategy, run_id"),
    "s_sums": """
SELECT strategy, run_id, count(*) AS num_rows, max(changes) AS balance_diff_changes, round(CAST(max(changes) AS DOUBLE) / count(*), 6) AS balance_diff_change_ratio,
  abs(arg_max(calc, pos) - arg_max(balance, pos))::DOUBLE AS apart, CASE WHEN abs(arg_max(calc, pos) - arg_max(balance, pos)) < 0.01 THEN 'Success' ELSE 'Failed' END AS balance_match,
  bool_or(cb) AS uses_implicit_cashback, bool_or(ind) AS uses_implicit_ind02_commission
FROM s_processed GROUP BY strategy, run_id
""",
    "s_stats": """
SELECT strategy, count(*) AS total, count(*) FILTER (WHERE balance_match = 'Success') AS success_count, round(count(*) FILTER (WHERE balance_match = 'Success') * 100.0::DOUBLE / count(*), 4) AS success_rate,
  round(avg(balance_diff_changes), 6) AS avg_diff_changes, round(avg(balance_diff_change_ratio), 6) AS avg_diff_ratio, round(avg(apart), 4) AS avg_closing_diff,
  count(*) FILTER (WHERE uses_implicit_cashback) AS cashback_enabled, count(*) FILTER (WHERE uses_implicit_ind02_commission) AS ind02_enabled
FROM s_sums GROUP BY strategy
""",
    "s_old": "SELECT * FROM s_sums WHERE strategy = 'always_enable' AND run_id NOT LIKE '%9'",
    "s_cmp": """
SELECT n.run_id, n.balance_match, n.uses_implicit_cashback, n.uses_implicit_ind02_commission, CASE WHEN o.run_id IS NULL THEN 'NEW' WHEN (o.balance_match = 'Success' AND n.balance_match = 'Failed') OR n.balance_diff_changes > o.balance_diff_changes THEN 'DEGRADED'
  WHEN (o.balance_match = 'Failed' AND n.balance_match = 'Success') OR n.balance_diff_changes < o.balance_diff_changes THEN 'IMPROVED' ELSE 'UNCHANGED' END AS outcome,
  CASE outcome WHEN 'DEGRADED' THEN concat_ws('; ', CASE WHEN o.balance_match = 'Success' AND n.balance_match = 'Failed' THEN 'balance_match degraded from Success to Failed' END, CASE WHEN n.balance_diff_changes > o.balance_diff_changes THEN concat('balance_diff_changes increased by ', n.balance_diff_changes - o.balance_diff_changes) END)
    WHEN 'IMPROVED' THEN concat_ws('; ', CASE WHEN o.balance_match = 'Failed' AND n.balance_match = 'Success' THEN 'balance_match improved from Failed to Success' END, CASE WHEN n.balance_diff_changes < o.balance_diff_changes THEN concat('balance_diff_changes decreased by ', o.balance_diff_changes - n.balance_diff_changes) END) ELSE '' END AS reasons
FROM (SELECT * FROM s_sums WHERE strategy = 'voting') n LEFT JOIN s_old o USING (run_id)
""",
}


def _compared(t):
    runs = t.strategies
    old = runs.filter("strategy = 'always_enable' and run_id not like '%9'")
    return lineage.compare_runs(old, runs.filter("strategy = 'voting'"))


@query("j16_old_new_comparison", "SELECT run_id, outcome, reasons FROM s_cmp", STRATEGY)
def _(t):
    return _compared(t).select("run_id", "outcome", F.array_join("reasons", "; ").alias("reasons"))


@query(
    "j17_strategy_comparison",
    """SELECT o.strategy, count(*) FILTER (WHERE o.balance_diff_changes < v.balance_diff_changes) AS improvements, count(*) FILTER (WHERE o.balance_diff_changes > v.balance_diff_changes) AS degradations,
       count(*) FILTER (WHERE o.balance_diff_changes = v.balance_diff_changes) AS unchanged FROM s_sums o JOIN s_sums v USING (run_id) WHERE v.strategy = 'voting' AND o.strategy <> 'voting' GROUP BY o.strategy""",
    STRATEGY,
)
def _(t):
    return reports.compare_strategies(t.strategies)


@query(
    "a14_strategy_winner",
    """SELECT *, (success_rate = max(success_rate) OVER ())::BIGINT + (avg_diff_changes = min(avg_diff_changes) OVER ())::BIGINT + (avg_closing_diff = min(avg_closing_diff) OVER ())::BIGINT AS score FROM s_stats""",
    STRATEGY,
)
def _(t):
    return reports.strategy_scores(t.strategies)


@query(
    "a20_reprocess_rollup",
    """SELECT count(*) FILTER (WHERE outcome = 'IMPROVED') AS improved, count(*) FILTER (WHERE outcome = 'DEGRADED') AS degraded, count(*) FILTER (WHERE outcome = 'UNCHANGED') AS unchanged, count(*) FILTER (WHERE outcome = 'NEW') AS new,
       count(*) FILTER (WHERE balance_match = 'Success') AS success, count(*) FILTER (WHERE balance_match = 'Failed') AS failed, count(*) FILTER (WHERE uses_implicit_cashback) AS cashback_enabled, count(*) FILTER (WHERE uses_implicit_ind02_commission) AS ind02_enabled FROM s_cmp""",
    STRATEGY,
)
def _(t):
    return reports.reprocess_rollup(_compared(t))


@query(
    "j18_import_differences",
    """SELECT run_id, coalesce(l, 0) AS left_rows, coalesce(r, 0) AS right_rows FROM (SELECT run_id, count(*) AS l FROM uatl_txn WHERE num % 10 <> 4 GROUP BY run_id)
       FULL JOIN (SELECT run_id, count(*) AS r FROM flagged WHERE acc_prvdr_code = 'UATL' AND num % 10 <> 3 AND (NOT is_duplicate OR num % 2 = 0) GROUP BY run_id) USING (run_id) WHERE l IS DISTINCT FROM r""",
)
def _(t):
    deduped = detect.flag_duplicates(t.uatl, t.sizing).filter("num % 10 <> 3 and (not is_duplicate or num % 2 = 0)")
    return lineage.import_differences(t.uatl.filter("num % 10 <> 4"), deduped)


@query("j19_without_details", "SELECT run_id, acc_number, acc_prvdr_code FROM statement_meta WHERE run_id NOT IN (SELECT run_id FROM customer_details WHERE cust_id IS NOT NULL)")
def _(t):
    return lineage.without_details(t.meta, t.customers.filter("cust_id is not null"))


BLOCKS["loan_counts"] = "SELECT cust_id, count(*) AS tot_loans, count(*) FILTER (WHERE status = 'overdue') AS tot_default_loans FROM loans GROUP BY cust_id"


@query(
    "j20_borrower_context",
    """SELECT run_id, u.acc_number, unified_status, c.borrower_biz_name, tot_loans, tot_default_loans, risk_category, crnt_fa_limit::DOUBLE AS crnt_fa_limit
       FROM unified u JOIN customer_details c USING (run_id) JOIN loan_counts USING (cust_id) WHERE tot_loans > 10 ORDER BY tot_default_loans DESC, run_id LIMIT 20""",
)
def _(t):
    counts = t.loans.groupBy("cust_id").agg(F.count(F.lit(1)).alias("tot_loans"), F.count_if(F.col("status") == "overdue").alias("tot_default_loans"))
    details = t.customers.join(counts, "cust_id").filter("tot_loans > 10").drop("rm_name")
    out = t.unified.join(details, "run_id").orderBy(F.desc("tot_default_loans"), "run_id").limit(20)
    return out.select("run_id", "acc_number", "unified_status", "borrower_biz_name", "tot_loans", "tot_default_loans", "risk_category", "crnt_fa_limit")


# -- flagged-customer report ----------------------------------------------------------------------

BLOCKS["fraud_rms"] = "SELECT cust_id, rm_name, count(*) AS n, min((submitted_date, run_id)) AS seen FROM flagged_stmts WHERE cust_id IS NOT NULL AND rm_name IS NOT NULL GROUP BY cust_id, rm_name"
BLOCKS["fraud"] = """
SELECT f.*, m.rm_name FROM (SELECT cust_id, count(*) AS no_of_times_fraud, min(submitted_date) AS first_submitted_date, max(submitted_date) AS last_submitted_date, arg_min(rm_name, (submitted_date, run_id)) AS first_rm_name,
  arg_max(rm_name, (submitted_date, run_id)) AS last_rm_name FROM flagged_stmts WHERE cust_id IS NOT NULL GROUP BY cust_id) f
LEFT JOIN (SELECT cust_id, rm_name FROM (SELECT *, row_number() OVER (PARTITION BY cust_id ORDER BY n DESC, seen) AS k FROM fraud_rms) WHERE k = 1) m USING (cust_id)
"""
BLOCKS["lstats"] = f"""
SELECT cust_id, count(*) AS tot_loans, min(disbursal_date) AS first_loan_date, max(disbursal_date) AS last_loan_date, count(*) FILTER (WHERE paid_date IS NOT NULL AND overdue_days_calc <= 1) AS tot_ontime_count,
  count(*) FILTER (WHERE paid_date IS NOT NULL AND overdue_days_calc > 3) AS tot_3_day_late_loans, count(*) FILTER (WHERE paid_date IS NOT NULL AND overdue_days_calc >= 10) AS tot_10_day_late_loans, count(*) FILTER (WHERE status = 'overdue') AS tot_overdue_loans,
  coalesce(sum(os_amount) FILTER (WHERE status IN ('ongoing', 'due')), 0) AS tot_os_amount, coalesce(sum(os_amount) FILTER (WHERE status = 'overdue'), 0) AS tot_od_amount, coalesce(sum(flow_fee) FILTER (WHERE paid_date IS NOT NULL), 0) AS tot_revenue,
  arg_max(status, (disbursal_date, loan_doc_id)) AS last_loan_status, arg_max(loan_principal, (disbursal_date, loan_doc_id)) AS last_loan_amount, date_diff('day', max(disbursal_date), DATE '{LOANS_AS_OF}') AS days_since_last_loan,
  CASE WHEN count(paid_date) > 0 THEN round(count(*) FILTER (WHERE paid_date IS NOT NULL AND overdue_days_calc <= 1) * 100::DOUBLE / count(paid_date), 2) ELSE 0 END AS tot_ontime_perc
FROM loans_raw GROUP BY cust_id
"""
BLOCKS["analysis"] = """
SELECT w.*, f.* EXCLUDE (cust_id), l.first_loan_date, l.last_loan_date, l.days_since_last_loan, coalesce(tot_loans, 0) AS tot_loans, coalesce(tot_ontime_count, 0) AS tot_ontime_count, coalesce(tot_3_day_late_loans, 0) AS tot_3_day_late_loans,
  coalesce(tot_10_day_late_loans, 0) AS tot_10_day_late_loans, coalesce(tot_overdue_loans, 0) AS tot_overdue_loans, coalesce(tot_os_amount, 0)::DOUBLE AS tot_os_amount, coalesce(tot_od_amount, 0)::DOUBLE AS tot_od_amount, coalesce(tot_revenue, 0)::DOUBLE AS tot_revenue,
  coalesce(last_loan_amount, 0)::DOUBLE AS last_loan_amount, coalesce(tot_ontime_perc, 0)::DOUBLE AS tot_ontime_perc, coalesce(last_loan_status, 'No Loans') AS last_loan_status
FROM (SELECT DISTINCT cust_id, borrower_biz_name, reg_rm_name AS registered_rm, current_rm_name AS current_rm, crnt_fa_limit::DOUBLE AS crnt_fa_limit FROM customer_details WHERE cust_id IN (SELECT cust_id FROM fraud)) w
LEFT JOIN fraud f USING (cust_id) LEFT JOIN lstats l USING (cust_id)
"""


def _analysis(t):
    return reports.analysis_raw(_flagged(t), _loans(t), t.customers, LOANS_AS_OF)


@query("a1_fraud_stats", "SELECT * FROM fraud")
def _(t):
    return reports.fraud_stats(_flagged(t))


@query("a2_loan_stats", "SELECT * REPLACE (tot_os_amount::DOUBLE AS tot_os_amount, tot_od_amount::DOUBLE AS tot_od_amount, tot_revenue::DOUBLE AS tot_revenue, last_loan_amount::DOUBLE AS last_loan_amount) FROM lstats")
def _(t):
    return reports.loan_stats(_loans(t), LOANS_AS_OF)


@query("a3_analysis_raw", "SELECT * FROM analysis")
def _(t):
    return _analysis(t)


_IMPACT = [
    ("Total FATAL Customers", "count(*)"),
    ("Customers Ongoing/Due", "count(*) FILTER (WHERE last_loan_status IN ('ongoing', 'due'))"),
    ("Customers Overdue", "count(*) FILTER (WHERE last_loan_status = 'overdue')"),
    ("Customers Settled", "count(*) FILTER (WHERE last_loan_status = 'settled')"),
    ("Customers No Loans", "count(*) FILTER (WHERE last_loan_status = 'No Loans')"),
    ("Customers Active (loan in last 30 days)", "count(*) FILTER (WHERE days_since_last_loan <= 30)"),
    ("Total Outstanding Amount (ongoing/due) (UGX)", "sum(tot_os_amount::DECIMAL(18,2))"),
    ("Total Overdue Amount (UGX)", "sum(tot_od_amount::DECIMAL(18,2))"),
    ("Total Revenue Collected (UGX)", "sum(tot_revenue::DECIMAL(18,2))"),
    ("Net Impact (Revenue - OS - OD) (UGX)", "sum(tot_revenue::DECIMAL(18,2)) - sum(tot_os_amount::DECIMAL(18,2)) - sum(tot_od_amount::DECIMAL(18,2))"),
]


@query("a4_business_impact", " UNION ALL ".join(f"SELECT '{m}' AS metric, coalesce({e}, 0)::DOUBLE AS value FROM analysis" for m, e in _IMPACT))
def _(t):
    return reports.business_impact(_analysis(t))


@query(
    "a5_rm_involvement",
    """SELECT a.*, coalesce(n, 0) AS new_submissions FROM (SELECT rm_name, count(*) AS unique_customers, sum(no_of_times_fraud)::BIGINT AS total_fraud_submissions, sum(tot_os_amount::DECIMAL(18,2))::DOUBLE AS total_os_amount,
       sum(tot_od_amount::DECIMAL(18,2))::DOUBLE AS total_od_amount, sum(tot_revenue::DECIMAL(18,2))::DOUBLE AS total_revenue, count(*) FILTER (WHERE tot_overdue_loans > 0) AS customers_in_overdue FROM analysis WHERE rm_name IS NOT NULL GROUP BY rm_name) a
       LEFT JOIN (SELECT rm_name, count(*) FILTER (WHERE format = 'format_1' AND submitted_date >= DATE '2025-07-01') AS n FROM flagged_stmts GROUP BY rm_name) USING (rm_name)""",
)
def _(t):
    return reports.rm_involvement(_analysis(t), _flagged(t))


@query(
    "a6_applier_analysis",
    """SELECT loan_applier_name, loan_applier_role, count(DISTINCT cust_id) AS unique_customers, count(*) AS total_loans_applied, count(*) FILTER (WHERE status = 'overdue') AS total_loans_overdue
       FROM loans_raw WHERE loan_applier_name IS NOT NULL AND loan_applier_role IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    return reports.applier_analysis(_loans(t))


@query(
    "a7_statement_formats",
    """SELECT acc_prvdr_code AS provider, format, count(*) AS no_of_submissions, min(submitted_date) AS started, max(submitted_date) AS ended, count(*) FILTER (WHERE custom_verification IN ('FATAL', 'CRITICAL')) AS fraud,
       count(*) FILTER (WHERE custom_verification = 'NO_ISSUES') AS valid, count(*) FILTER (WHERE custom_verification IS NULL) AS unknown FROM unified GROUP BY 1, 2""",
)
def _(t):
    return reports.statement_formats(t.unified)


@query(
    "a8_os_vs_revenue",
    """SELECT cust_id, borrower_biz_name, tot_revenue, tot_os_amount, (tot_revenue::DECIMAL(18,2) - tot_os_amount::DECIMAL(18,2))::DOUBLE AS net_impact,
       CASE WHEN tot_revenue > tot_os_amount THEN 'Profitable' WHEN tot_revenue < tot_os_amount THEN 'Loss' ELSE 'Break Even' END AS status FROM analysis""",
)
def _(t):
    return reports.os_vs_revenue(_analysis(t))


@query("a9_monthly_trends", "SELECT strftime(submitted_date, '%Y-%m') AS month, count(*) AS total_submissions, count(DISTINCT cust_id) AS unique_customers FROM flagged_stmts GROUP BY 1")
def _(t):
    return reports.monthly_trends(_flagged(t))


_BUCKET = "CASE loan_principal " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in reports.PRINCIPALS.items()) + " ELSE 'Others' END"
_SUMS = """coalesce(sum(loan_principal), 0)::DOUBLE AS total_disbursed, coalesce(sum(os_amount) FILTER (WHERE status IN ('ongoing', 'due')), 0)::DOUBLE AS ongoing, coalesce(sum(os_amount) FILTER (WHERE status = 'overdue'), 0)::DOUBLE AS overdue,
  coalesce(sum(loan_principal) FILTER (WHERE status = 'settled'), 0)::DOUBLE AS settled, coalesce(sum(loan_principal) FILTER (WHERE paid_date IS NOT NULL AND overdue_days_calc <= 1), 0)::DOUBLE AS paid_ontime,
  coalesce(sum(loan_principal) FILTER (WHERE paid_date IS NOT NULL AND overdue_days_calc > 3), 0)::DOUBLE AS paid_late"""


@query(
    "a10_exposure",
    f"""SELECT b.label AS loan_principal, coalesce(s.total_disbursed, 0) AS total_disbursed, coalesce(s.ongoing, 0) AS ongoing, coalesce(s.overdue, 0) AS overdue, coalesce(s.settled, 0) AS settled, coalesce(s.paid_ontime, 0) AS paid_ontime, coalesce(s.paid_late, 0) AS paid_late
       FROM (VALUES {", ".join(f"('{v}')" for v in [*reports.PRINCIPALS.values(), "Others"])}) AS b(label) LEFT JOIN (SELECT {_BUCKET} AS label, {_SUMS} FROM loans_raw GROUP BY 1) s USING (label)
       UNION ALL SELECT 'TOTAL', {_SUMS} FROM loans_raw""",
)
def _(t):
    return reports.exposure(_loans(t))


@query("c24_principal_labels", f"SELECT loan_doc_id, {_BUCKET} AS label FROM loans")
def _(t):
    return t.loans.select("loan_doc_id", reports.principal_label(F.col("loan_principal")).alias("label"))


@query(
    "a11_verdict_stats",
    """SELECT format, acc_prvdr_code, custom_verification, count(*) AS statements, round(avg(balance_diff_change_ratio) * 100, 2) AS avg_balance_diff_pct, sum(credits)::DOUBLE AS total_credits, sum(debits)::DOUBLE AS total_debits FROM unified GROUP BY 1, 2, 3""",
)
def _(t):
    return reports.verdict_stats(t.unified)


@query("a12_statements_tab", "SELECT run_id, submitted_date, custom_verification, cust_id, borrower_biz_name FROM unified LEFT JOIN customer_details USING (run_id) WHERE acc_prvdr_code = 'UATL' AND format = 'format_2'")
def _(t):
    return reports.statements_tab(t.unified, t.customers, "UATL", "format_2").select("run_id", "submitted_date", "custom_verification", "cust_id", "borrower_biz_name")


@query("a13_strategy_baseline", "SELECT * EXCLUDE (strategy) FROM s_stats WHERE strategy = 'voting'", STRATEGY)
def _(t):
    return reports.strategy_baseline(t.summary)


@query(
    "a15_by_fee_flags",
    """SELECT uses_implicit_cashback, uses_implicit_ind02_commission, count(*) AS statements, count(*) FILTER (WHERE balance_match = 'Success') AS success_count, round(avg(balance_diff_changes), 6) AS avg_diff_changes FROM summary WHERE acc_prvdr_code = 'UATL' GROUP BY 1, 2""",
)
def _(t):
    return reports.by_fee_flags(t.summary)


_AUDIT = ["format", "rm_name", "meta_title", "meta_author", "meta_producer", "meta_created_at", "meta_modified_at", "submitted_date"]


@query("a16_null_coverage", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS total, count({c}) AS filled, floor(count({c}) * 100 / count(*))::BIGINT AS percent FROM statement_meta" for c in _AUDIT))
def _(t):
    return reports.null_coverage(t.meta, _AUDIT)


@query("a17_entity_distribution", "SELECT acc_prvdr_code, final_entity_type, cust_id IS NOT NULL AS with_cust_id, borrower_id IS NOT NULL AS with_borrower, count(*) AS records, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS percent FROM lineage_rows GROUP BY 1, 2, 3, 4")
def _(t):
    rows = _lineage(t).withColumns({"with_cust_id": F.col("cust_id").isNotNull(), "with_borrower": F.col("borrower_id").isNotNull()})
    return reports.distribution(rows, ["acc_prvdr_code", "final_entity_type", "with_cust_id", "with_borrower"])


@query(
    "a19_statistics",
    """SELECT 'raw' AS table_name, acc_prvdr_code, count(*) AS records, count(DISTINCT run_id) AS statements FROM txn GROUP BY 2 UNION ALL SELECT 'metadata', acc_prvdr_code, count(*), count(DISTINCT run_id) FROM statement_meta GROUP BY 2
       UNION ALL SELECT 'summary', acc_prvdr_code, count(*), count(DISTINCT run_id) FROM summary GROUP BY 2""",
)
def _(t):
    return reports.statistics({"raw": t.txn, "metadata": t.meta, "summary": t.summary})


@query(
    "a21_pass_rates",
    """SELECT file_type, month, count(*) AS total, count(*) FILTER (WHERE verification_status = 'PASS') AS passed, count(*) FILTER (WHERE verification_status = 'FAIL') AS failed, round(count(*) FILTER (WHERE verification_status = 'PASS') * 100.0::DOUBLE / count(*), 1) AS pass_rate
       FROM (SELECT *, lower(regexp_extract(pdf_path, '\\.([^.]+)$', 1)) AS file_type, strftime(submitted_date, '%Y-%m') AS month FROM unified) GROUP BY GROUPING SETS ((file_type), (month), ())""",
)
def _(t):
    return reports.pass_rates(t.unified)


@query(
    "a22_repeat_offenders",
    """SELECT acc_number, count(*) AS statements, sum(duplicate_count)::BIGINT AS total_duplicates, round(avg(balance_diff_change_ratio), 4) AS avg_change_ratio FROM unified
       WHERE run_id IN (SELECT run_id FROM scanned_two WHERE reason IS NOT NULL) GROUP BY acc_number HAVING count(*) > 1""",
    HEADERS,
)
def _(t):
    return reports.repeat_offenders(t.unified, forensic.header_rollup(forensic.header_scan(forensic.scannable(t.pages, t.meta))))


@query(
    "a23_verdict_mix",
    """SELECT custom_verification, count(*) AS statements, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS percentage, round(avg(balance_diff_change_ratio) * 100, 2) AS avg_balance_diff FROM unified WHERE acc_prvdr_code = 'UATL' GROUP BY 1""",
)
def _(t):
    return reports.verdict_mix(t.unified)


@query(
    "a24_rm_performance",
    """SELECT rm_name, count(*) FILTER (WHERE custom_verification = 'FATAL') AS fatal_count, count(*) FILTER (WHERE custom_verification = 'NO_ISSUES') AS verified_count, count(*) AS total_statements,
       round(count(*) FILTER (WHERE custom_verification = 'FATAL') * 100.0::DOUBLE / count(*), 2) AS fatal_rate FROM unified WHERE acc_prvdr_code = 'UATL' AND rm_name IS NOT NULL GROUP BY rm_name HAVING count(*) >= 10""",
)
def _(t):
    return reports.rm_performance(t.unified)


@query(
    "a25_flagged_borrowers",
    """SELECT borrower_biz_name, cust_id, risk_category, crnt_fa_limit::DOUBLE AS crnt_fa_limit, count(*) AS fatal_count FROM customer_details JOIN unified USING (run_id) WHERE custom_verification = 'FATAL' GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2""",
)
def _(t):
    return reports.flagged_borrowers(t.unified, t.customers)


@query("a26_gap_distribution", "SELECT gap_related_balance_changes, count(*) AS statement_count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS percentage FROM summary WHERE gap_related_balance_changes > 0 GROUP BY 1")
def _(t):
    return reports.gap_distribution(t.summary)


@query("a27_gap_consistency", "SELECT count(*) FILTER (WHERE missing_days_detected) AS with_missing_days, count(*) FILTER (WHERE gap_related_balance_changes > 0) AS with_gap_changes FROM summary")
def _(t):
    return reports.gap_consistency(t.summary)


@query("a28_weekly_gaps", "SELECT weekofyear(submitted_date) AS week, count(*) AS total, count(*) FILTER (WHERE gap_related_balance_changes >= 5) AS high_gaps FROM unified GROUP BY 1")
def _(t):
    return reports.weekly_gaps(t.unified)


@query("a29_registering_rms", "SELECT registered_rm, count(DISTINCT cust_id) AS customers_registered, sum(tot_os_amount::DECIMAL(18,2))::DOUBLE AS total_os_amount FROM analysis WHERE registered_rm IS NOT NULL GROUP BY 1")
def _(t):
    return reports.registering_rms(_analysis(t))


@query("a29_overdue_rms", "SELECT statement_rm_name AS rm_name, count(*) AS overdue_loan_disbursals, sum(os_amount)::DOUBLE AS total_os_amount FROM loans_raw WHERE status = 'overdue' GROUP BY 1")
def _(t):
    return reports.overdue_rms(_loans(t))


@query(
    "a30_payment_performance",
    """SELECT 'Payment Performance' AS category, count(*) FILTER (WHERE tot_ontime_count = tot_loans) AS customers_paying_ontime, count(*) FILTER (WHERE tot_3_day_late_loans > 0 OR tot_10_day_late_loans > 0) AS customers_paying_late,
       count(*) FILTER (WHERE last_loan_status = 'ongoing') AS customers_currently_ongoing, count(*) FILTER (WHERE tot_overdue_loans > 0) AS customers_currently_overdue, coalesce(sum(tot_os_amount::DECIMAL(18,2)), 0)::DOUBLE AS total_os_amount,
       count(*) FILTER (WHERE days_since_last_loan <= 30) AS customers_active_last_30_days FROM analysis""",
)
def _(t):
    return reports.payment_performance(_analysis(t))


@query("a31_first_submission_trend", "SELECT strftime(first_submitted_date, '%Y-%m') AS month, count(*) AS fraud_submissions, count(DISTINCT cust_id) AS unique_customers FROM analysis GROUP BY 1")
def _(t):
    return reports.first_submission_trend(_analysis(t))


@query(
    "a32_batch_outcome",
    """SELECT status, count(*) AS statements, sum(CASE WHEN status = 'success' THEN n ELSE 0 END)::BIGINT AS transactions FROM (SELECT m.run_id, s.n, CASE WHEN num % 6 = 0 THEN 'skipped' WHEN s.n > 0 THEN 'success' ELSE 'failed' END AS status
       FROM statement_meta m LEFT JOIN (SELECT run_id, count(*) AS n FROM txn WHERE num % 10 <> 7 GROUP BY run_id) s USING (run_id)) GROUP BY status""",
)
def _(t):
    return reports.batch_outcome(t.meta, t.meta.filter("num % 6 = 0"), t.txn.filter("num % 10 <> 7"))


@query("a33_flagged_tab", "SELECT run_id, acc_number, submitted_date, rm_name, custom_verification_reason, cust_id, borrower_biz_name FROM flagged_stmts")
def _(t):
    return _flagged(t).orderBy(F.desc("submitted_date"), "run_id").select("run_id", "acc_number", "submitted_date", "rm_name", "custom_verification_reason", "cust_id", "borrower_biz_name")


@query("a35_quality_percentages", "SELECT run_id, acc_number, quality_issues_count, num_rows, round(quality_issues_count::DOUBLE / num_rows * 100, 2) AS quality_issue_percentage FROM statement_meta WHERE quality_issues_count > 0")
def _(t):
    return reports.quality_percentages(t.meta)


@query(
    "a37_gap_impact",
    """SELECT count(*) AS total_statements, count(*) FILTER (WHERE missing_days_detected) AS statements_with_gaps, round(count(*) FILTER (WHERE missing_days_detected) * 100.0::DOUBLE / count(*), 2) AS gap_percentage,
       sum(gap_related_balance_changes)::BIGINT AS total_gap_related_changes, sum(balance_diff_changes)::BIGINT AS total_balance_changes FROM summary WHERE balance_match = 'Failed'""",
)
def _(t):
    return reports.gap_impact(t.summary)


@query(
    "a38_mostly_gaps",
    """SELECT run_id, acc_number, gap_related_balance_changes, balance_diff_changes, round(gap_related_balance_changes * 100.0::DOUBLE / balance_diff_changes, 1) AS gap_percentage FROM unified
       WHERE missing_days_detected AND balance_diff_changes > 0 ORDER BY gap_percentage DESC, run_id LIMIT 20""",
)
def _(t):
    return reports.mostly_gaps(t.unified)


@query(
    "a39_reversals_of_failed",
    """SELECT run_id, u.acc_number, u.balance_diff_changes, u.verification_status, n AS reversal_count FROM unified u JOIN (SELECT run_id, count(*) AS n FROM processed WHERE special_txn_type = 'Transaction Reversal' GROUP BY run_id) USING (run_id) WHERE balance_match = 'Failed'""",
)
def _(t):
    return reports.reversals_of_failed(t.unified, detect.flag_special(ledger.replayable(t.txn)))


@query(
    "a40_provider_statements",
    """SELECT acc_prvdr_code AS provider, count(*) AS total_statements, sum(duplicate_count)::BIGINT AS total_duplicates, round(avg(balance_diff_change_ratio), 6) AS avg_change_ratio, count(*) FILTER (WHERE balance_match = 'Failed') AS failed_verifications FROM summary GROUP BY 1""",
)
def _(t):
    return reports.provider_statements(t.summary)


@query("a40_provider_rows", "SELECT acc_prvdr_code AS provider, count(*) AS total_transactions, count(*) FILTER (WHERE is_duplicate) AS duplicates FROM processed GROUP BY 1")
def _(t):
    return reports.provider_rows(t.summary)


@query("a41_accounts_at_several", "SELECT acc_number, string_agg(DISTINCT acc_prvdr_code, ',' ORDER BY acc_prvdr_code) AS providers, count(*) AS statement_count FROM statement_meta GROUP BY 1 HAVING count(DISTINCT acc_prvdr_code) > 1")
def _(t):
    return reports.accounts_at_several(t.meta)


@query("a42_rm_verdicts", "SELECT rm_name, custom_verification, count(*) AS statements, round(avg(balance_diff_change_ratio), 6) AS avg_balance_diff FROM unified WHERE acc_prvdr_code = 'UATL' AND custom_verification IS NOT NULL GROUP BY 1, 2")
def _(t):
    return reports.rm_verdicts(t.unified)


@query("a43_fatal_per_rm", "SELECT rm_name, count(*) AS fatal_count FROM unified WHERE acc_prvdr_code = 'UATL' AND custom_verification = 'FATAL' GROUP BY 1")
def _(t):
    return reports.fatal_per_rm(t.unified)


@query("a44_by_status", "SELECT unified_status, processing_status, count(*) AS statements FROM unified GROUP BY 1, 2")
def _(t):
    return reports.by_status(t.unified)
