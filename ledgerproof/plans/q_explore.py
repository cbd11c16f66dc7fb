"""Queries: windows, top-k, samples, pages, filters, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerproof.operators import explore, ledger, lineage, paging, reports
from ledgerproof.operators.sequence import ARRIVAL, Sort, scan
from ledgerproof.plans.oracles import BLOCKS
from ledgerproof.plans.q_reports import mapper
from ledgerproof.plans.registry import query

STATEMENTS_AS_OF = "2025-07-15"


@query(
    "w1_window_primitives",
    """SELECT run_id, seq, (lag(balance) OVER w)::DOUBLE AS previous_balance, (sum(amount) OVER w)::DOUBLE AS running_amount, (first_value(balance) OVER w)::DOUBLE AS first_balance,
       (last_value(CASE WHEN fee > 0 THEN fee END IGNORE NULLS) OVER w)::DOUBLE AS last_fee FROM txn WINDOW w AS (PARTITION BY run_id ORDER BY txn_date, seq)""",
)
def _(t):
    def step(rows):
        known = rows.lag(F.col("balance"), "previous_balance").running_sum(F.col("amount"), "running_amount")
        return known.last_known(F.when(F.col("fee") > 0, F.col("fee")), "last_fee").per_key(
            first_balance=F.min_by("balance", rows.rank)
        ).df

    return scan(t.txn, ["run_id"], ARRIVAL, step, t.sizing).select("run_id", "seq", "previous_balance", "running_amount", "first_balance", "last_fee")


MISMATCH = {"first_off": "SELECT run_id, min(pos) AS off_pos FROM processed WHERE abs(diff) > 0.01 GROUP BY run_id"}


@query(
    "w2_first_mismatch",
    "SELECT p.run_id, pos, seq, txn_date, amount::DOUBLE AS amount, balance::DOUBLE AS balance, diff::DOUBLE AS balance_diff FROM processed p JOIN first_off f ON p.run_id = f.run_id AND p.pos = f.off_pos",
    MISMATCH,
)
def _(t):
    return explore.first_mismatch(t.replay)


@query(
    "w3_mismatch_context",
    "SELECT p.run_id, pos, f.off_pos - pos AS before_mismatch, seq, diff::DOUBLE AS balance_diff FROM processed p JOIN first_off f ON p.run_id = f.run_id AND p.pos BETWEEN f.off_pos - 2 AND f.off_pos",
    MISMATCH,
)
def _(t):
    return explore.mismatch_context(t.replay, sizing=t.sizing).select("run_id", "pos", "before_mismatch", "seq", "balance_diff")


PATTERN = {
    "pattern_rows": """
SELECT *, arg_max(balance, epoch_us(txn_date)::HUGEINT * 1000000000000 + CAST(balance * 100 AS HUGEINT)) OVER (PARTITION BY run_id ORDER BY epoch_us(txn_date) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_balance FROM umtn_named
""",
    "umtn_named": "SELECT * RENAME (float_balance AS balance) FROM umtn_txn",
    "patterns": """
SELECT run_id, seq, txn_type, txn_date, (balance - previous_balance)::DOUBLE AS balance_change, CASE WHEN previous_balance IS NULL THEN NULL WHEN abs(balance - previous_balance - amount) < 0.01 THEN '+amount' WHEN abs(balance - previous_balance + amount) < 0.01 THEN '-amount' ELSE 'unknown' END AS pattern FROM pattern_rows
""",
}


@query("w4_movement_patterns", "SELECT txn_type, pattern, count(*) AS records FROM patterns GROUP BY 1, 2", PATTERN)
def _(t):
    return explore.movement_patterns(t.umtn, t.sizing).groupBy("txn_type", "pattern").agg(F.count(F.lit(1)).alias("records"))


@query("w4_pattern_examples", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY txn_type ORDER BY txn_date, seq) AS rank FROM patterns) WHERE rank <= 5", PATTERN)
def _(t):
    rows = explore.movement_patterns(t.umtn, t.sizing).select("run_id", "seq", "txn_type", "txn_date", "balance_change", "pattern")
    return explore.first_per_group(rows, ["txn_type"], [F.asc("txn_date"), F.asc("seq")], 5)


@query(
    "w5_endpoints",
    """SELECT run_id, seq, 'first' AS side, a AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY txn_date, seq) AS a FROM umtn_txn) WHERE a <= 5
       UNION ALL SELECT run_id, seq, 'last', a FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY txn_date DESC, seq DESC) AS a FROM umtn_txn) WHERE a <= 5""",
)
def _(t):
    return explore.endpoints(t.umtn, 5).select("run_id", "seq", "side", "rank")


BLOCKS["files"] = "SELECT run_id, acc_number, strftime(submitted_date, '%Y-%m') AS month, lower(regexp_extract(pdf_path, '\\.([^.]+)$', 1)) AS file_type FROM statement_meta"


@query("w6_month_type_sample", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY month, file_type ORDER BY run_id) AS rank FROM files) WHERE rank <= 2")
def _(t):
    files = t.meta.select(
        "run_id", "acc_number", F.date_format("submitted_date", "yyyy-MM").alias("month"), F.lower(F.regexp_extract("pdf_path", r"\.([^.]+)$", 1)).alias("file_type")
    )
    return explore.month_type_sample(files)


@query(
    "w7_stratified_sample",
    "SELECT run_id, balance_match, rank FROM (SELECT *, row_number() OVER (PARTITION BY balance_match ORDER BY md5(concat(run_id, '|', 'seed-1')), run_id) AS rank FROM summary WHERE acc_prvdr_code = 'UATL' AND uses_implicit_cashback IS NOT NULL) WHERE rank <= 500",
)
def _(t):
    known = t.summary.filter("acc_prvdr_code = 'UATL' and uses_implicit_cashback is not null")
    return explore.stratified_sample(known, "balance_match", 500, "seed-1").select("run_id", "balance_match", "rank")


@query("w8_statement_page", "SELECT run_id, acc_number, submitted_date, unified_status FROM unified WHERE acc_prvdr_code = 'UATL' ORDER BY submitted_date DESC, run_id LIMIT 25 OFFSET 25")
def _(t):
    out = explore.page(t.unified, explore.predicates(acc_prvdr_code="UATL"), [F.desc("submitted_date"), F.asc("run_id")], 2, 25)
    return out.select("run_id", "acc_number", "submitted_date", "unified_status")


@query("w8_page_count", "SELECT count(*) AS total, CAST(ceil(count(*) / 25) AS BIGINT) AS pages FROM unified WHERE acc_prvdr_code = 'UATL'")
def _(t):
    return explore.page_count(t.unified, explore.predicates(acc_prvdr_code="UATL"), 25)


NEWEST = (Sort("txn_date", desc=True), Sort("run_id"), Sort("seq"))


@query(
    "w8_deep_page",
    """SELECT run_id, seq, txn_date, rank FROM (SELECT run_id, seq, txn_date, row_number() OVER (ORDER BY txn_date DESC NULLS LAST, run_id, seq) - 1 AS rank, count(*) OVER () AS n FROM txn)
       WHERE rank >= n // 50 * 25 AND rank < n // 50 * 25 + 25""",
)
def _(t):
    rows = paging.listing(t.txn.select("run_id", "seq", "txn_date"), NEWEST)
    return rows.page(rows.total() // 50 + 1, 25)


@query(
    "w8_next_page",
    """SELECT run_id, seq, txn_date FROM (SELECT *, row_number() OVER (ORDER BY txn_date DESC NULLS LAST, run_id, seq) AS place FROM txn) WHERE place BETWEEN 26 AND 50""",
)
def _(t):
    rows = t.txn.select("run_id", "seq", "txn_date")
    last = paging.after(rows, NEWEST, None, 25).tail(1)
    return paging.after(rows, NEWEST, last[0].asDict() if last else None, 25)


@query(
    "w9_many_gaps",
    """SELECT run_id, acc_prvdr_code, format, gap_related_balance_changes, start_date, end_date, date_diff('day', start_date, end_date) AS days_span, num_rows FROM unified WHERE gap_related_balance_changes >= 5 ORDER BY gap_related_balance_changes DESC, run_id LIMIT 20""",
)
def _(t):
    rows = t.unified.filter("gap_related_balance_changes >= 5").withColumn("days_span", F.datediff("end_date", "start_date"))
    out = rows.orderBy(F.desc("gap_related_balance_changes"), "run_id").limit(20)
    return out.select("run_id", "acc_prvdr_code", "format", "gap_related_balance_changes", "start_date", "end_date", "days_span", "num_rows")


@query(
    "w9_needs_review",
    """SELECT run_id, acc_number, balance_diff_change_ratio, gap_related_balance_changes, duplicate_count, quality_issues_count, meta_producer, rm_name FROM unified
       WHERE acc_prvdr_code = 'UATL' AND custom_verification IS NULL AND balance_match = 'Failed' AND balance_diff_change_ratio > 0.05 ORDER BY balance_diff_change_ratio DESC, run_id LIMIT 100""",
)
def _(t):
    c = F.col
    rows = t.unified.filter(
        (c("acc_prvdr_code") == "UATL") & c("custom_verification").isNull() & (c("balance_match") == "Failed") & (c("balance_diff_change_ratio") > 0.05)
    )
    return rows.orderBy(F.desc("balance_diff_change_ratio"), "run_id").limit(100).select(
        "run_id", "acc_number", "balance_diff_change_ratio", "gap_related_balance_changes", "duplicate_count", "quality_issues_count", "meta_producer", "rm_name"
    )


@query(
    "w9_fatal_list",
    "SELECT run_id, acc_number, custom_verification_reason, balance_diff_change_ratio, meta_producer, submitted_date, rm_name FROM unified WHERE acc_prvdr_code = 'UATL' AND custom_verification = 'FATAL'",
)
def _(t):
    rows = t.unified.filter("acc_prvdr_code = 'UATL' and custom_verification = 'FATAL'").orderBy(F.desc("balance_diff_change_ratio"), "run_id")
    return rows.select("run_id", "acc_number", "custom_verification_reason", "balance_diff_change_ratio", "meta_producer", "submitted_date", "rm_name")


@query(
    "w9_recent_flagged",
    f"SELECT run_id, acc_number, custom_verification, submitted_date, rm_name FROM unified WHERE acc_prvdr_code = 'UATL' AND custom_verification IN ('FATAL', 'CRITICAL') AND submitted_date >= DATE '{STATEMENTS_AS_OF}' - 60",
)
def _(t):
    since = F.date_sub(F.lit(STATEMENTS_AS_OF).cast("date"), 60)
    rows = t.unified.filter(F.col("acc_prvdr_code") == "UATL").filter(F.col("custom_verification").isin("FATAL", "CRITICAL") & (F.col("submitted_date") >= since))
    return rows.orderBy(F.desc("submitted_date"), "run_id").select("run_id", "acc_number", "custom_verification", "submitted_date", "rm_name")


@query(
    "w9_account_history",
    """SELECT run_id, submitted_date, custom_verification, borrower_biz_name, risk_category FROM unified LEFT JOIN customer_details USING (run_id) WHERE acc_number = '700000007'""",
)
def _(t):
    rows = t.unified.filter("acc_number = '700000007'").join(t.customers.select("run_id", "borrower_biz_name", "risk_category"), "run_id", "left")
    return rows.orderBy(F.desc("submitted_date"), "run_id").select("run_id", "submitted_date", "custom_verification", "borrower_biz_name", "risk_category")


# -- filters and sets ----------------------------------------------------------------------------


@query(
    "p1_filter_set",
    """SELECT run_id, acc_number, rm_name, submitted_date, unified_status FROM unified WHERE (lower(run_id) LIKE '%1%' OR lower(acc_number) LIKE '%1%') AND lower(rm_name) LIKE '%nation_1%' AND acc_prvdr_code = 'UATL'
       AND unified_status = 'FLAGGED' AND submitted_date >= DATE '2025-03-05' AND submitted_date <= DATE '2025-06-01'""",
)
def _(t):
    where = explore.predicates(
        search="1", rm_name="nation_1", from_date="2025-03-05", to_date="2025-06-01", acc_prvdr_code="uatl", unified_status="flagged"
    )
    return t.unified.filter(where).select("run_id", "acc_number", "rm_name", "submitted_date", "unified_status")


@query("p2_filter_options", "SELECT DISTINCT 'format' AS option, format AS value FROM unified UNION ALL SELECT DISTINCT 'rm_name', rm_name FROM mapper WHERE rm_name IS NOT NULL")
def _(t):
    formats = explore.options(t.unified, "format").select(F.lit("format").alias("option"), F.col("format").alias("value"))
    rms = explore.options(mapper(t), "rm_name").select(F.lit("rm_name").alias("option"), F.col("rm_name").alias("value"))
    return formats.unionByName(rms)


@query("p3_candidates", "SELECT run_id, acc_number, created_date FROM mapper WHERE acc_prvdr_code = 'UMTN' AND lambda_status = 'score_calc_success' AND strftime(created_date, '%Y-%m') = '2025-04'")
def _(t):
    return explore.candidates(mapper(t), "UMTN", "score_calc_success", "2025-04").select("run_id", "acc_number", "created_date")


@query("p4_union_processed", "SELECT run_id, seq, acc_prvdr_code, txn_type, balance::DOUBLE AS balance, (CASE WHEN acc_prvdr_code = 'UMTN' THEN fee END)::DOUBLE AS tax FROM processed")
def _(t):
    one = ledger.verify(t.uatl, t.sizing, keep=("txn_type",))
    two = ledger.verify(t.umtn, t.sizing, keep=("txn_type",)).withColumn("tax", F.col("fee"))
    return one.unionByName(two, allowMissingColumns=True).select("run_id", "seq", "acc_prvdr_code", "txn_type", "balance", "tax")


@query(
    "p5_detection_rows",
    """SELECT * FROM (SELECT run_id, source, seq, txn_id, row_number() OVER (PARTITION BY run_id ORDER BY txn_id, source, seq) AS rank FROM
       (SELECT run_id, seq, txn_id, 'processed' AS source FROM processed WHERE acc_prvdr_code = 'UATL' UNION ALL SELECT run_id, seq, txn_id, 'raw' FROM uatl_txn)) WHERE rank <= 100""",
)
def _(t):
    cols = ["run_id", "seq", "txn_id"]
    done = ledger.verify(t.uatl, t.sizing, keep=("txn_id",)).select(*cols, F.lit("processed").alias("source"))
    both = done.unionByName(t.uatl.select(*cols, F.lit("raw").alias("source")))
    return explore.first_per_group(both, ["run_id"], [F.asc("txn_id"), F.asc("source"), F.asc("seq")], 100)


@query("p6_known_runs", "SELECT run_id FROM uatl_txn UNION SELECT run_id FROM statement_meta WHERE num % 2 = 0 UNION SELECT run_id FROM mapper")
def _(t):
    return lineage.known_runs(t.uatl, t.meta.filter("num % 2 = 0"), mapper(t))


@query(
    "p7_retract_counts",
    """SELECT 'raw' AS table_name, count(*) AS removed FROM txn WHERE num % 7 = 3 UNION ALL SELECT 'metadata', count(*) FROM statement_meta WHERE num % 7 = 3
       UNION ALL SELECT 'summary', count(*) FROM summary JOIN statement_meta m USING (run_id) WHERE m.num % 7 = 3""",
)
def _(t):
    return explore.retract_counts({"raw": t.txn, "metadata": t.meta, "summary": t.summary}, t.meta.filter("num % 7 = 3"))


@query("p7_retract_processed", "SELECT run_id, count(*) AS records FROM txn WHERE num % 7 <> 3 GROUP BY run_id")
def _(t):
    left = explore.retract({"processed": t.processed, "raw": t.txn}, t.meta.filter("num % 7 = 3"))
    return left["processed"].groupBy("run_id").agg(F.count(F.lit(1)).alias("records"))


@query("p8_incomplete", "SELECT run_id FROM statement_meta WHERE meta_title IS NULL OR meta_author IS NULL OR meta_created_at IS NULL")
def _(t):
    return explore.incomplete(t.meta, ["meta_title", "meta_author", "meta_created_at"]).select("run_id")


@query("a17_share", "SELECT parsing_status, count(*) AS records, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS percent FROM statement_meta GROUP BY 1")
def _(t):
    return reports.distribution(t.meta, ["parsing_status"])
