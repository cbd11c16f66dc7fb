"""Verdict rules per statement, unified status, and the scores analysts derive from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEVELS = ("FATAL", "CRITICAL", "WARNING", "NO_ISSUES")

# Document facts, office producers, the accepted run, and the reasons.
TEMPLATE_TITLE = "PDF Template"
TEMPLATE_PRODUCER = "Qt 4.8.7"
CSV_TITLE, CSV_AUTHOR, CSV_PRODUCER = "Airtel Money CSV Statement", "Airtel", "CSV Export"
PHONE_PRODUCER = "Samsung Electronics"
EDITOR_AUTHOR = "USER"
EDITOR_PRODUCERS = ("Microsoft", "Word", "Qt 4.8.7")
VIEWER_PRODUCER = "PDFium"
OFFICE_PRODUCERS = (
    "Microsoft® Word for Microsoft 365",
    "Microsoft® Excel® 2010",
    "Microsoft® Excel® 2016",
    "Microsoft® Word 2013",
    "MicrosoftÂ® Word 2013",
    "Microsoft Word",
    "Microsoft Excel",
)
ACCEPTED_RUN = "678fbedd976c7"
REASON_MATCHED = "Balance match succeeded. This overrides all other metadata checks"
REASON_TEMPLATE_EDITED = (
    "PDF Template with Qt 4.8.7 but meta_modified_at is not NULL, indicating post-creation modification. Status: FLAGGED"
)
_MINIMAL = (
    "Some balance_match failed due to decimal values and the difference between stmt closing balance "
    "and calculated closing balance is very minimal"
)
REASON_TEMPLATE = f"Valid PDFs generated by Airtel. {_MINIMAL}"
REASON_CSV = f"Valid CSV generated by Airtel. {_MINIMAL}"
REASON_PHONE = (
    "Need to look at other fields to determine if fraud or not. Balance_diff_change_ratio is very high (",
    ") (not valid: 68b02336021d7, 68c167ff3fc15)",
)
REASON_EDITOR = (
    "Confirm fraud if balance_diff_change_ratio is high. For some statements with low ratio "
    "(689717b8a073e, 68933d714c75a) some rows are definitely edited. Producer: "
)
REASON_VIEWER = "PDFium producer but balance mismatch"
REASON_HEADER = ("This means that header was intentionally manipulated (", " times)")
REASON_OFFICE = "This means the statement was edited using microsoft word and later converted to PDF. Producer: "
REASON_VALID = (
    "Status: VERIFIED or VERIFIED_WITH_WARNINGS. Balance match succeeded. This means that the statement is valid"
)
REASON_VIEW = "Balance verification successful"


def _or_na(name: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("N/A"))


def _any_in(text: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | text.contains(needle)
    return out


def _percent(ratio: Column) -> Column:
    return F.concat((ratio * 100).cast("decimal(18,2)").cast("string"), F.lit("%"))


def _format1() -> list[tuple[Column, str, Column]]:
    """(condition, level, reason); the first that holds decides."""
    c, lit = F.col, F.lit
    title, author, producer = _or_na("meta_title"), _or_na("meta_author"), _or_na("meta_producer")
    created, modified = c("meta_created_at").isNotNull(), c("meta_modified_at").isNotNull()
    template = (title == TEMPLATE_TITLE) & (author == "N/A") & (producer == TEMPLATE_PRODUCER) & created
    nameless = (title == "N/A") & (author == "N/A")
    ratio = F.coalesce("balance_diff_change_ratio", lit(0.0))
    return [
        (c("balance_match") == "Success", "NO_ISSUES", lit(REASON_MATCHED)),
        (template & modified, "FATAL", lit(REASON_TEMPLATE_EDITED)),
        (template & ~modified, "NO_ISSUES", lit(REASON_TEMPLATE)),
        (
            (title == CSV_TITLE) & (author == CSV_AUTHOR) & (producer == CSV_PRODUCER) & ~created & ~modified,
            "NO_ISSUES",
            lit(REASON_CSV),
        ),
        # Matched statements were decided above, so the lenient arm of this rule never holds.
        (
            nameless & (producer == PHONE_PRODUCER) & ~created,
            "CRITICAL",
            F.concat(lit(REASON_PHONE[0]), _percent(ratio), lit(REASON_PHONE[1])),
        ),
        (
            (title == TEMPLATE_TITLE) & (author == EDITOR_AUTHOR) & _any_in(producer, EDITOR_PRODUCERS) & created & modified,
            "FATAL",
            F.concat(lit(REASON_EDITOR), producer),
        ),
        (nameless & (producer == VIEWER_PRODUCER) & ~created & ~modified, "WARNING", lit(REASON_VIEWER)),
    ]


def _format2() -> list[tuple[Column, str, Column]]:
    c, lit = F.col, F.lit
    headers = F.coalesce("header_row_manipulation_count", lit(0))
    producer = _or_na("meta_producer")
    return [
        (
            (headers > 0) & (c("run_id") != ACCEPTED_RUN),
            "FATAL",
            F.concat(lit(REASON_HEADER[0]), headers.cast("string"), lit(REASON_HEADER[1])),
        ),
        (_any_in(producer, OFFICE_PRODUCERS), "FATAL", F.concat(lit(REASON_OFFICE), producer)),
        (c("balance_match") == "Success", "NO_ISSUES", lit(REASON_VALID)),
    ]


def _first_of(rules: list[tuple[Column, str, Column]]) -> tuple[Column, Column]:
    level = reason = F
    for cond, name, why in rules:
        level, reason = level.when(cond, name), reason.when(cond, why)
    return level, reason


def classify(summary: DataFrame, meta: DataFrame) -> DataFrame:
    """Summary with `custom_verification` and its reason. Only the first provider has rules."""
    facts = meta.select(
        "run_id", "acc_number", "rm_name", "header_row_manipulation_count", "meta_title", "meta_author", "meta_producer",
        "meta_created_at", "meta_modified_at", "submitted_date",
    )
    both = summary.join(facts, "run_id")
    ruled = F.col("acc_prvdr_code") == "UATL"
    one, two = _first_of(_format1()), _first_of(_format2())
    f1, f2 = ruled & (F.col("format") == "format_1"), ruled & (F.col("format") == "format_2")
    return both.withColumn("custom_verification", F.when(f1, one[0]).when(f2, two[0])).withColumn(
        "custom_verification_reason", F.when(f1, one[1]).when(f2, two[1])
    )


def classification_stats(classified: DataFrame) -> DataFrame:
    """Count and share per format and level, over the statements that have rules."""
    ruled = classified.filter((F.col("acc_prvdr_code") == "UATL") & F.col("format").isin("format_1", "format_2"))
    counts = ruled.groupBy("format", "custom_verification").agg(F.count(F.lit(1)).alias("statements"))
    return counts.withColumn(
        "percent", F.round(F.col("statements") * 100 / F.sum("statements").over(W.partitionBy("format")), 2)
    )


def unified_status() -> Column:
    c = F.col
    failed, missed = c("verification_status") == "FAIL", c("balance_match") == "Failed"
    passed = c("verification_status") == "PASS"
    return (
        F.when(c("parsing_status") == "FAILED", "IMPORT_FAILED")
        .when(~c("_summarised"), "IMPORTED")
        .when(failed & missed, "FLAGGED")
        .when(failed, "VERIFICATION_FAILED")
        .when(c("verification_status") == "WARNING", "VERIFIED_WITH_WARNINGS")
        .when(passed & missed, "VERIFIED_WITH_WARNINGS")
        .when(passed, "VERIFIED")
        .otherwise("IMPORTED")
    )


SUMMARY_COLUMNS = (
    "first_balance", "last_balance", "calculated_closing_balance", "balance_diff_changes", "balance_diff_change_ratio",
    "duplicate_count", "gap_related_balance_changes", "missing_days_detected", "credits", "debits", "fees", "charges",
    "start_date", "end_date", "balance_match", "verification_status", "verification_reason",
    "uses_implicit_cashback", "uses_implicit_ind02_commission",
)


def unified(meta: DataFrame, classified: DataFrame) -> DataFrame:
    """Every imported statement with its summary, status, and the verdict as readers see it
    (a matching balance overrides the stored verdict)."""
    kept = classified.select(
        "run_id", *SUMMARY_COLUMNS, "custom_verification", "custom_verification_reason", F.lit(True).alias("_summarised")
    )
    both = meta.join(kept, "run_id", "left").withColumn("_summarised", F.col("_summarised").isNotNull())
    matched = F.col("balance_match") == "Success"
    return both.withColumns(
        {
            "unified_status": unified_status(),
            "processing_status": F.when(F.col("_summarised"), "PROCESSED").otherwise("IMPORTED"),
            "custom_verification": F.when(matched, "NO_ISSUES").otherwise(F.col("custom_verification")),
            "custom_verification_reason": F.when(matched, REASON_VIEW).otherwise(F.col("custom_verification_reason")),
        }
    ).drop("_summarised")


# -- scores ------------------------------------------------------------------------------


def risk_tier() -> Column:
    c = F.col
    missed, repeats, ratio = c("balance_match") == "Failed", c("duplicate_count"), c("balance_diff_change_ratio")
    status = c("verification_status")
    critical = (
        (missed & (ratio > 0.5))
        | (c("header_row_manipulation_count") > 10)
        | (c("balance_diff_changes") > 500)
        | ((status == "FAIL") & (repeats > 1000))
    )
    high = (
        (missed & (repeats > 500))
        | (ratio > 0.2)
        | (c("quality_issues_count") > 50)
        | (c("gap_related_balance_changes") > 5)
        | (status == "FAIL")
    )
    medium = (
        (missed & (repeats > 100))
        | (repeats > 200)
        | (c("missing_days_detected") & (c("gap_related_balance_changes") > 0))
        | (status == "WARNING")
        | (c("quality_issues_count") > 10)
    )
    return F.when(critical, "CRITICAL").when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW")


def risk_score() -> Column:
    c = F.col

    def points(cond: Column, n: int) -> Column:
        return F.when(cond, n).otherwise(0)

    return (
        points(c("balance_match") == "Failed", 50)
        + points(c("duplicate_count") / c("num_rows") > 0.1, 30)
        + points(c("balance_diff_change_ratio") > 0.1, 40)
        + c("quality_issues_count") * 5
        + c("header_row_manipulation_count") * 10
        + points(c("missing_days_detected"), 20)
        + c("gap_related_balance_changes") * 15
    ).cast("long")


def integrity_score() -> Column:
    c = F.col
    failed = F.when(c("parsing_status") == "FAILED", 100).otherwise(0)
    return (100 - c("quality_issues_count") * 2 - c("header_row_manipulation_count") * 5 - failed).cast("long")


def credit_share() -> Column:
    return F.round(F.try_divide(F.col("credits").cast("double"), (F.col("credits") + F.col("debits")).cast("double")), 6)


def scores(unified_statements: DataFrame) -> DataFrame:
    share = F.col("credit_share")
    return unified_statements.withColumns(
        {"risk_tier": risk_tier(), "risk_score": risk_score(), "integrity_score": integrity_score(), "credit_share": credit_share()}
    ).withColumn("extreme_share", (share > 0.95) | (share < 0.05))
