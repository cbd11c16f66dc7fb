"""Queries: forensic metrics, verdicts and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerproof.operators import forensic, verdict
from ledgerproof.plans.oracles import BLOCKS
from ledgerproof.plans.registry import query

IDS = {
    "ids": """
SELECT run_id, txn_id, count(*) AS n, list_transform(regexp_extract_all(txn_id, '\\d+'), lambda r: r) AS runs, regexp_replace(txn_id, '\\d+', '#', 'g') AS pattern
FROM txn GROUP BY run_id, txn_id
""",
    "numbers": """
SELECT run_id, n, pattern, CAST(list_filter(runs, lambda r: length(r) = list_max(list_transform(runs, lambda q: length(q))))[1] AS HUGEINT) AS number FROM ids WHERE len(runs) > 0
""",
    "steps": """
SELECT run_id, number - lag(number) OVER (PARTITION BY run_id ORDER BY number) AS step FROM (SELECT DISTINCT run_id, number FROM numbers)
""",
}


@query("f1_repeated_ids", "SELECT run_id, txn_id, count(*) AS times FROM txn GROUP BY run_id, txn_id HAVING count(*) > 1")
def _(t):
    return forensic.repeated_ids(t.txn)


@query("f2_id_gaps", "SELECT run_id, coalesce(sum(greatest(step - 1, 0)), 0)::BIGINT AS gap_count FROM steps GROUP BY run_id", IDS)
def _(t):
    return forensic.id_integrity(t.txn).select("run_id", "gap_count")


@query(
    "f3_pattern_breaks",
    "SELECT run_id, (sum(k) - max(k))::BIGINT AS pattern_break_count FROM (SELECT run_id, pattern, sum(n) AS k FROM numbers GROUP BY run_id, pattern) GROUP BY run_id",
    IDS,
)
def _(t):
    return forensic.id_integrity(t.txn).select("run_id", "pattern_break_count")


JUMPS = {
    "jumps": """
SELECT run_id, row_number() OVER w - 1 AS position, CASE WHEN lag(balance) OVER w <> 0 THEN abs(balance::DOUBLE - (lag(balance) OVER w)::DOUBLE) / abs((lag(balance) OVER w)::DOUBLE) END AS ratio
FROM txn WINDOW w AS (PARTITION BY run_id ORDER BY txn_date, seq)
"""
}


@query(
    "f4_balance_jumps",
    "SELECT run_id, count(*) FILTER (WHERE ratio > 0.5) AS balance_jump_count, round(coalesce(max(ratio) FILTER (WHERE ratio > 0.5), 0), 6) AS max_jump_ratio FROM jumps GROUP BY run_id",
    JUMPS,
)
def _(t):
    return forensic.balance_jumps(t.txn, sizing=t.sizing)


@query("f4_jump_positions", "SELECT run_id, position, round(ratio, 6) AS jump_ratio FROM jumps WHERE ratio > 0.5", JUMPS)
def _(t):
    return forensic.jump_rows(t.txn, sizing=t.sizing)


@query(
    "f5_same_second_groups",
    "SELECT run_id, count(*) FILTER (WHERE n > 1) AS same_second_groups FROM (SELECT run_id, date_trunc('second', txn_date) AS s, count(*) AS n FROM txn GROUP BY 1, 2) GROUP BY run_id",
)
def _(t):
    return forensic.same_second_groups(t.txn)


@query(
    "f6_backward_steps",
    "SELECT run_id, count(*) FILTER (WHERE b > txn_date) AS non_chronological_count FROM (SELECT *, lag(txn_date) OVER (PARTITION BY run_id ORDER BY seq) AS b FROM txn) GROUP BY run_id",
)
def _(t):
    return forensic.backward_steps(t.txn, t.sizing)


_HOURS = """SELECT run_id, round(CASE WHEN count(*) < 2 THEN 0 ELSE count(*) FILTER (WHERE hour(txn_date) BETWEEN 8 AND 17)::DOUBLE / count(*) END, 6) AS business_hours_ratio,
   round(CASE WHEN count(*) < 2 THEN 0 ELSE count(*) FILTER (WHERE isodow(txn_date) >= 6)::DOUBLE / count(*) END, 6) AS weekend_ratio FROM txn GROUP BY run_id"""


@query("f7_hour_shares", _HOURS)
def _(t):
    return forensic.hour_shares(t.txn)


AMOUNTS = {
    "amount_counts": "SELECT run_id, amount, count(*) AS n, CASE WHEN amount >= 1 THEN substr(CAST(CAST(floor(amount) AS BIGINT) AS VARCHAR), 1, 1)::INT END AS digit FROM txn GROUP BY run_id, amount",
    "amount_sums": "SELECT run_id, sum(n) AS k, sum(n) FILTER (WHERE amount % 500 = 0) AS rounds, count(*) FILTER (WHERE n > 1) AS reps, coalesce(sum(n) FILTER (WHERE digit IS NOT NULL), 0) AS digits, "
    + ", ".join(f"coalesce(sum(n) FILTER (WHERE digit = {d}), 0)::DOUBLE AS d{d}" for d in range(1, 10))
    + " FROM amount_counts GROUP BY run_id",
}


@query("f8_round_numbers", "SELECT run_id, round(coalesce(rounds, 0)::DOUBLE / k, 6) AS round_number_ratio FROM amount_sums", AMOUNTS)
def _(t):
    return forensic.amount_patterns(t.txn).select("run_id", "round_number_ratio")


@query("f9_repeated_amounts", "SELECT run_id, round(reps::DOUBLE / k, 6) AS duplicate_amount_ratio FROM amount_sums", AMOUNTS)
def _(t):
    return forensic.amount_patterns(t.txn).select("run_id", "duplicate_amount_ratio")


_OFF = " + ".join(f"abs(d{d} / digits - {p})" for d, p in forensic.FIRST_DIGIT_SHARE.items())


@query("f10_first_digits", f"SELECT run_id, round(CASE WHEN digits < 10 THEN 0.5 ELSE 1.0 - ({_OFF}) / 2 END, 6)::DOUBLE AS benford_score FROM amount_sums", AMOUNTS)
def _(t):
    return forensic.amount_patterns(t.txn).select("run_id", "benford_score")


_KEYWORDS = " + ".join(f"(lower(line) LIKE '%{k}%')::INT" for k in forensic.PAGE_HEADER_TEXTS)
HEADERS = {
    "page_lines": "SELECT run_id, page_no, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM page_text",
    "line_marks": f"SELECT run_id, page_no, text, i, ({_KEYWORDS}) >= 2 AS is_header, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare, bare <> '' AND NOT regexp_full_match(bare, '\\+?0*[1-9][0-9]{{0,2}}') AS is_content FROM page_lines",
    "page_heads": """
SELECT run_id, page_no, any_value(text) AS text, count(*) FILTER (WHERE is_header) AS n, list(i ORDER BY i) FILTER (WHERE is_header) AS places, coalesce(min(i) FILTER (WHERE is_content), 0) AS expected
FROM line_marks GROUP BY run_id, page_no
""",
    "scanned": """
SELECT run_id, page_no, CASE WHEN text = '' THEN 0 ELSE n END AS header_rows,
       CASE WHEN text = '' THEN NULL WHEN n = 0 THEN 'No header row found' WHEN n > 1 THEN concat(n, ' headers (positions: [', array_to_string(places, ', '), '])')
            WHEN page_no > 1 AND places[1] > expected THEN concat('Header at line ', places[1], ' (expected at line ', expected, ')') END AS reason
FROM page_heads
""",
    "scanned_two": "SELECT * FROM scanned WHERE run_id IN (SELECT run_id FROM statement_meta WHERE acc_prvdr_code = 'UATL' AND format = 'format_2')",
}


@query("f11_header_scan", "SELECT run_id, page_no, header_rows, reason FROM scanned", HEADERS)
def _(t):
    return forensic.header_scan(t.pages)


@query(
    "f12_header_rollup",
    "SELECT run_id, bool_or(reason IS NOT NULL) AS is_manipulated, count(reason) AS flagged_pages, count(*) AS pages, sum(header_rows)::BIGINT AS header_rows FROM scanned_two GROUP BY run_id",
    HEADERS,
)
def _(t):
    return forensic.header_rollup(forensic.header_scan(forensic.scannable(t.pages, t.meta)))


@query(
    "f13_header_cross_tab",
    """SELECT is_manipulated, count(*) FILTER (WHERE balance_match = 'Success') AS matched, count(*) FILTER (WHERE balance_match = 'Failed') AS mismatched
       FROM (SELECT run_id, bool_or(reason IS NOT NULL) AS is_manipulated FROM scanned_two GROUP BY run_id) JOIN summary USING (run_id) GROUP BY is_manipulated""",
    HEADERS,
)
def _(t):
    return forensic.header_cross_tab(forensic.header_rollup(forensic.header_scan(forensic.scannable(t.pages, t.meta))), t.summary)


ALL = {
    **IDS,
    **JUMPS,
    **AMOUNTS,
    "m_ids": "SELECT run_id, count(*) FILTER (WHERE n > 1) AS duplicate_ids FROM ids GROUP BY run_id",
    "m_gaps": "SELECT run_id, coalesce(sum(greatest(step - 1, 0)), 0)::BIGINT AS gap_count FROM steps GROUP BY run_id",
    "m_breaks": "SELECT run_id, (sum(k) - max(k))::BIGINT AS pattern_break_count FROM (SELECT run_id, pattern, sum(n) AS k FROM numbers GROUP BY run_id, pattern) GROUP BY run_id",
    "m_jumps": "SELECT run_id, count(*) FILTER (WHERE ratio > 0.5) AS balance_jump_count, round(coalesce(max(ratio) FILTER (WHERE ratio > 0.5), 0), 6) AS max_jump_ratio FROM jumps GROUP BY run_id",
    "m_same": "SELECT run_id, count(*) FILTER (WHERE n > 1) AS same_second_groups FROM (SELECT run_id, date_trunc('second', txn_date) AS s, count(*) AS n FROM txn GROUP BY 1, 2) GROUP BY run_id",
    "m_back": "SELECT run_id, count(*) FILTER (WHERE b > txn_date) AS non_chronological_count FROM (SELECT *, lag(txn_date) OVER (PARTITION BY run_id ORDER BY seq) AS b FROM txn) GROUP BY run_id",
    "m_hours": _HOURS,
    "m_amounts": f"SELECT run_id, round(coalesce(rounds, 0)::DOUBLE / k, 6) AS round_number_ratio, round(reps::DOUBLE / k, 6) AS duplicate_amount_ratio, round(CASE WHEN digits < 10 THEN 0.5 ELSE 1.0 - ({_OFF}) / 2 END, 6)::DOUBLE AS benford_score FROM amount_sums",
}
_FINDINGS = """array_to_string(list_filter([CASE WHEN duplicate_ids > 0 THEN 'duplicate_ids' END, CASE WHEN gap_count > 10 THEN 'id_gaps' END,
   CASE WHEN balance_jump_count > 0 THEN 'balance_jumps' END, CASE WHEN non_chronological_count > 0 THEN 'non_chronological' END], lambda x: x IS NOT NULL), ',') AS findings"""
_ALL_FROM = "FROM m_ids JOIN m_gaps USING (run_id) JOIN m_breaks USING (run_id) JOIN m_jumps USING (run_id) JOIN m_same USING (run_id) JOIN m_back USING (run_id) JOIN m_hours USING (run_id) JOIN m_amounts USING (run_id)"


@query("f14_all_metrics", f"SELECT *, {_FINDINGS} {_ALL_FROM}", ALL)
def _(t):
    return forensic.flatten_metrics(forensic.all_metrics(t.txn, t.sizing))


@query("s19_flatten_metrics", f"SELECT run_id, duplicate_ids, gap_count, max_jump_ratio, weekend_ratio, benford_score {_ALL_FROM}", ALL)
def _(t):
    nested = forensic.all_metrics(t.txn, t.sizing)
    return nested.select(
        "run_id", "id_integrity.duplicate_ids", "id_integrity.gap_count", "balance_jumps.max_jump_ratio", "timestamps.weekend_ratio", "amounts.benford_score"
    )


@query(
    "s20_page_reasons",
    """SELECT run_id, band, string_agg(concat('P', page_no, ':', reason), '; ' ORDER BY page_no) AS reasons
       FROM (SELECT *, page_no // 100 AS band FROM scanned WHERE reason IS NOT NULL) GROUP BY run_id, band""",
    HEADERS,
)
def _(t):
    # One map per hundred pages: page numbers are unique, so no cell outgrows a hundred entries.
    flagged = forensic.header_scan(t.pages).filter("reason is not null").withColumn("band", F.floor(F.col("page_no") / 100))
    maps = flagged.groupBy("run_id", "band").agg(F.map_from_entries(F.collect_list(F.struct("page_no", "reason"))).alias("reasons"))
    return forensic.format_page_reasons(maps, "reasons")


# -- verdicts ------------------------------------------------------------------------------

_s = lambda text: "'" + text.replace("'", "''") + "'"
V = verdict
BLOCKS["classified"] = f"""
SELECT s.*, m.acc_number, m.rm_name, m.submitted_date, m.meta_producer, m.header_row_manipulation_count, coalesce(m.meta_title, 'N/A') AS ti, coalesce(m.meta_author, 'N/A') AS au, coalesce(m.meta_producer, 'N/A') AS pr,
  m.meta_created_at IS NOT NULL AS cr, m.meta_modified_at IS NOT NULL AS mo,
  CASE WHEN acc_prvdr_code <> 'UATL' THEN 0 WHEN format = 'format_1' THEN
    CASE WHEN balance_match = 'Success' THEN 1 WHEN ti = 'PDF Template' AND au = 'N/A' AND pr = 'Qt 4.8.7' AND cr AND mo THEN 2
         WHEN ti = 'PDF Template' AND au = 'N/A' AND pr = 'Qt 4.8.7' AND cr THEN 3
         WHEN ti = {_s(V.CSV_TITLE)} AND au = {_s(V.CSV_AUTHOR)} AND pr = 'CSV Export' AND NOT cr AND NOT mo THEN 4
         WHEN ti = 'N/A' AND au = 'N/A' AND pr = {_s(V.PHONE_PRODUCER)} AND NOT cr THEN 5
         WHEN ti = 'PDF Template' AND au = 'USER' AND (contains(pr, 'Microsoft') OR contains(pr, 'Word') OR contains(pr, 'Qt 4.8.7')) AND cr AND mo THEN 6
         WHEN ti = 'N/A' AND au = 'N/A' AND pr = 'PDFium' AND NOT cr AND NOT mo THEN 7 ELSE 0 END
   WHEN format = 'format_2' THEN
    CASE WHEN m.header_row_manipulation_count > 0 AND s.run_id <> {_s(V.ACCEPTED_RUN)} THEN 8 WHEN {" OR ".join(f"contains(pr, {_s(p)})" for p in V.OFFICE_PRODUCERS)} THEN 9
         WHEN balance_match = 'Success' THEN 10 ELSE 0 END ELSE 0 END AS rule,
  CASE WHEN rule IN (1, 3, 4, 10) THEN 'NO_ISSUES' WHEN rule IN (2, 6, 8, 9) THEN 'FATAL' WHEN rule = 5 THEN 'CRITICAL' WHEN rule = 7 THEN 'WARNING' END AS custom_verification,
  CASE rule WHEN 1 THEN {_s(V.REASON_MATCHED)} WHEN 2 THEN {_s(V.REASON_TEMPLATE_EDITED)} WHEN 3 THEN {_s(V.REASON_TEMPLATE)} WHEN 4 THEN {_s(V.REASON_CSV)}
    WHEN 5 THEN concat({_s(V.REASON_PHONE[0])}, CAST(CAST(balance_diff_change_ratio * 100 AS DECIMAL(18,2)) AS VARCHAR), '%', {_s(V.REASON_PHONE[1])})
    WHEN 6 THEN concat({_s(V.REASON_EDITOR)}, pr) WHEN 7 THEN {_s(V.REASON_VIEWER)} WHEN 8 THEN concat({_s(V.REASON_HEADER[0])}, m.header_row_manipulation_count, {_s(V.REASON_HEADER[1])})
    WHEN 9 THEN concat({_s(V.REASON_OFFICE)}, pr) WHEN 10 THEN {_s(V.REASON_VALID)} END AS custom_verification_reason
FROM summary s JOIN statement_meta m USING (run_id, acc_prvdr_code, format)
"""

BLOCKS["unified"] = f"""
SELECT m.*, c.* EXCLUDE (run_id, acc_prvdr_code, format, num_rows, custom_verification, custom_verification_reason, rule, acc_number, rm_name, submitted_date, meta_producer, header_row_manipulation_count, ti, au, pr, cr, mo),
  CASE WHEN m.parsing_status = 'FAILED' THEN 'IMPORT_FAILED' WHEN c.run_id IS NULL THEN 'IMPORTED' WHEN verification_status = 'FAIL' AND balance_match = 'Failed' THEN 'FLAGGED'
       WHEN verification_status = 'FAIL' THEN 'VERIFICATION_FAILED' WHEN verification_status = 'WARNING' THEN 'VERIFIED_WITH_WARNINGS' WHEN balance_match = 'Failed' THEN 'VERIFIED_WITH_WARNINGS' ELSE 'VERIFIED' END AS unified_status,
  CASE WHEN c.run_id IS NULL THEN 'IMPORTED' ELSE 'PROCESSED' END AS processing_status,
  CASE WHEN balance_match = 'Success' THEN 'NO_ISSUES' ELSE c.custom_verification END AS custom_verification,
  CASE WHEN balance_match = 'Success' THEN '{V.REASON_VIEW}' ELSE c.custom_verification_reason END AS custom_verification_reason
FROM statement_meta m LEFT JOIN classified c USING (run_id)
"""


@query("v1_document_rules_format1", "SELECT run_id, custom_verification, custom_verification_reason FROM classified WHERE format = 'format_1'")
def _(t):
    return t.classified.filter("format = 'format_1'").select("run_id", "custom_verification", "custom_verification_reason")


@query("v2_document_rules_format2", "SELECT run_id, custom_verification, custom_verification_reason FROM classified WHERE format = 'format_2'")
def _(t):
    return t.classified.filter("format = 'format_2'").select("run_id", "custom_verification", "custom_verification_reason")


@query(
    "v3_classification_stats",
    """SELECT format, custom_verification, count(*) AS statements, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY format), 2) AS percent
       FROM classified WHERE acc_prvdr_code = 'UATL' GROUP BY format, custom_verification""",
)
def _(t):
    return verdict.classification_stats(t.classified)


@query("v4_unified_status", "SELECT run_id, unified_status, processing_status FROM unified")
def _(t):
    return t.unified.select("run_id", "unified_status", "processing_status")


@query("v5_view_verdict", "SELECT run_id, custom_verification, custom_verification_reason FROM unified")
def _(t):
    return t.unified.select("run_id", "custom_verification", "custom_verification_reason")


BLOCKS["scores"] = """
SELECT run_id, CASE WHEN (balance_match = 'Failed' AND balance_diff_change_ratio > 0.5) OR header_row_manipulation_count > 10 OR balance_diff_changes > 500 OR (verification_status = 'FAIL' AND duplicate_count > 1000) THEN 'CRITICAL'
   WHEN (balance_match = 'Failed' AND duplicate_count > 500) OR balance_diff_change_ratio > 0.2 OR quality_issues_count > 50 OR gap_related_balance_changes > 5 OR verification_status = 'FAIL' THEN 'HIGH'
   WHEN duplicate_count > 200 OR (balance_match = 'Failed' AND duplicate_count > 100) OR (missing_days_detected AND gap_related_balance_changes > 0) OR verification_status = 'WARNING' OR quality_issues_count > 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier,
  (CASE WHEN balance_match = 'Failed' THEN 50 ELSE 0 END + CASE WHEN duplicate_count::DOUBLE / num_rows > 0.1 THEN 30 ELSE 0 END + CASE WHEN balance_diff_change_ratio > 0.1 THEN 40 ELSE 0 END
   + quality_issues_count * 5 + header_row_manipulation_count * 10 + CASE WHEN missing_days_detected THEN 20 ELSE 0 END + gap_related_balance_changes * 15)::BIGINT AS risk_score,
  (100 - quality_issues_count * 2 - header_row_manipulation_count * 5 - CASE WHEN parsing_status = 'FAILED' THEN 100 ELSE 0 END)::BIGINT AS integrity_score,
  CASE WHEN credits + debits <> 0 THEN round(credits::DOUBLE / (credits + debits)::DOUBLE, 6) END AS credit_share, credit_share > 0.95 OR credit_share < 0.05 AS extreme_share
FROM unified
"""


@query("v6_risk_tiers", "SELECT run_id, risk_tier FROM scores")
def _(t):
    return verdict.scores(t.unified).select("run_id", "risk_tier")


@query("v7_risk_score", "SELECT run_id, risk_score FROM scores")
def _(t):
    return verdict.scores(t.unified).select("run_id", "risk_score")


@query("v8_integrity_score", "SELECT run_id, integrity_score FROM scores")
def _(t):
    return verdict.scores(t.unified).select("run_id", "integrity_score")


@query("v9_credit_share", "SELECT run_id, credit_share, extreme_share FROM scores")
def _(t):
    return verdict.scores(t.unified).select("run_id", "credit_share", "extreme_share")
