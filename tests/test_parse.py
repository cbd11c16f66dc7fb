"""Cleaning and parsing rules on hand-made values, one per branch."""

from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerproof.functions import parse as P
from ledgerproof.operators import detect, explore, forensic, verdict
from ledgerproof.sources import statements as S


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("fmt", "text", "want"),
    [
        ("format_2", "-+1500000", "-1500000"),
        ("format_1", "-+1500000", "1500000"),
        ("format_1", "+12.50 Cr", "12.50"),
        ("format_2", "+12.50 Cr", "+12.50"),
        ("format_2", "Cr 5", None),
        ("format_1", ".5", None),
    ],
)
def test_amount_text(spark, fmt, text, want):
    assert values(spark, lambda c: P.amount_text(c, F.lit(fmt)), [text]) == [want]


def test_number_text(spark):
    assert values(spark, P.number_text, ["1,234.5", " ", "nan", None, "None"]) == ["1234.5", "0", "0", "0", "0"]


def test_overlap_takes_the_trailing_number(spark):
    got = values(spark, lambda c: P.overlap_balance(F.lit("7301100400"), c), [".04163057.08"])
    assert got == ["04163057.08"]
    assert values(spark, lambda c: P.is_overlapped(c, F.lit(".5")), ["7301100400", "100", "x", ""]) == [True, False, False, False]


def test_overlap_alone_is_not_a_quality_issue(spark):
    raw = spark.createDataFrame(
        [("R", "format_1", " T1 ", "01-02-25 10:00 AM", "a\r\nb  c", " ok", "100", " Cr", "7301100400", ".04163057.08"),
         ("R", "format_1", "T2", "2025-02-01\n07:16:11", "x", "ok", "1,00", "Dr", "abc", "5-")],
        "run_id string, format string, txn_id string, txn_date string, description string, status string, amount string, "
        "txn_direction string, fee string, balance string",
    )
    one, two = S.clean_txn(raw).orderBy("txn_id").collect()
    assert (one.fee, one.balance, one.has_quality_issue, one.description) == (D(0), D("4163057.08"), True, "a b c")
    assert (two.amount, two.fee, two.balance, two.has_quality_issue) == (D(100), D(0), D(5), True)
    assert two.txn_date == datetime(2025, 2, 1, 7, 16, 11)


def test_timestamps(spark):
    texts = ["31-08-25 11:14 PM", "31-08-25 23:14", "2025-02-01\n07:16:11", "1-1-70 00:05", "never", None]
    want = [datetime(2025, 8, 31, 23, 14), datetime(2025, 8, 31, 23, 14), datetime(2025, 2, 1, 7, 16, 11), datetime(1970, 1, 1, 0, 5), None, None]
    assert values(spark, lambda c: P.parse_ts(c, P.TXN_FORMATS), texts) == want
    assert values(spark, lambda c: P.parse_ts(c, P.CSV_FORMATS), ["01-May-25 08:17 AM", "01/05/2025 08:17"]) == [datetime(2025, 5, 1, 8, 17)] * 2
    assert values(spark, lambda c: P.parse_ts(c, P.SHEET_FORMATS), ["2025-09-01 08:41", ""]) == [datetime(2025, 9, 1, 8, 41), None]


def test_request_dates(spark):
    texts = ["04-Nov-2024", "17 Jan, 2025", "04 November 2024", '"08 April, 2025"', "2024-11-04", "04/11/2024", "x"]
    want = [date(2024, 11, 4), date(2025, 1, 17), date(2024, 11, 4), date(2025, 4, 8), date(2024, 11, 4), date(2024, 11, 4), None]
    assert values(spark, P.request_date, texts) == want


def test_document_dates(spark):
    got = values(spark, P.document_date, ["D:20240807103154+03'00'", "2024-08-07 10:31:54", "N/A", None])
    assert got == [datetime(2024, 8, 7, 10, 31, 54), datetime(2024, 8, 7, 10, 31, 54), None, None]


def test_currency_and_csv_values(spark):
    assert values(spark, P.currency, ["Ugx 9,214.35", "USH15", "", "abc"]) == [D("9214.35"), D("15.00"), None, None]
    assert values(spark, P.csv_value, [' "08 Apr, 2025"', 'abc",', ""]) == ["08 Apr, 2025", "abc", ""]


def test_accounts(spark):
    page = "Mobile Number : 256706015809 and 752902485"
    assert values(spark, lambda c: P.account_number(c, F.lit("format_2")), [page]) == ["706015809"]
    assert values(spark, lambda c: P.account_number(c, F.lit("format_1")), [page, "x 123456789 y", "none"]) == ["752902485", "123456789", None]
    assert values(spark, lambda c: P.own_account(c, F.lit("256770000001@mm")), ["256700000001", "", "nan"]) == ["700000001", "770000001", "770000001"]


def test_header_rows(spark):
    rows = [["Transaction ID", "Transaction Date", "x"], ["a", " Balance ", "b"], ["Transaction ID", "b", "c"], ["Date", "b"]]
    assert values(spark, P.header_row, rows, "array<string>") == [True, True, False, False]


def test_special_precedence(spark):
    texts = [
        "Commission Disbursement - x", "Received From Commission Disbursement Wallet", "Deallocation of Transaction Reversal",
        "rollback of Transaction Reversal", "Send", None,
    ]
    want = ["Commission Disbursement", None, "Transaction Reversal", "Rollback", None, None]
    assert values(spark, detect.special_type, texts) == want


def test_longest_digits(spark):
    assert values(spark, forensic.longest_digits, ["TX12-345", "12A34", "none"]) == [D(345), D(12), None]


def test_page_headers(spark):
    pages = spark.createDataFrame(
        [("R", 1, "Transaction ID Description\nrow"), ("R", 2, "2\n\nTransaction ID Description\nrow"), ("R", 3, "row\nTransaction ID Description"),
         ("R", 4, "nothing"), ("R", 5, "Date/Time Description\nFrom Account To Account"), ("R", 6, "")],
        "run_id string, page_no int, text string",
    )
    got = {r.page_no: (r.header_rows, r.reason) for r in forensic.header_scan(pages).collect()}
    assert got == {
        1: (1, None),
        2: (1, None),
        3: (1, "Header at line 1 (expected at line 0)"),
        4: (0, "No header row found"),
        5: (2, "2 headers (positions: [0, 1])"),
        6: (0, None),
    }


def test_risk_tiers(spark):
    cols = (
        "balance_match string, duplicate_count long, balance_diff_change_ratio double, header_row_manipulation_count int, balance_diff_changes long, "
        "verification_status string, quality_issues_count int, gap_related_balance_changes long, missing_days_detected boolean"
    )
    rows = [
        ("Failed", 0, 0.6, 0, 1, "FAIL", 0, 0, False), ("Failed", 0, 0.1, 0, 1, "FAIL", 0, 0, False),
        ("Success", 201, 0.1, 0, 1, "WARNING", 0, 0, False), ("Success", 0, 0.0, 0, 0, "PASS", 0, 0, False),
        ("Success", 0, 0.0, 11, 0, "PASS", 0, 0, False),
    ]
    df = spark.createDataFrame(rows, cols)
    assert [r[0] for r in df.select(verdict.risk_tier()).collect()] == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "CRITICAL"]


def test_filters_ignore_case_and_quote_nothing(spark):
    df = spark.createDataFrame([("U'1", "700", "Ann"), ("M2", "701", "Bob")], "run_id string, acc_number string, rm_name string")
    assert [r.run_id for r in df.filter(explore.predicates(search="u'", rm_name="AN")).collect()] == ["U'1"]
    assert df.filter(explore.predicates()).count() == 2


def test_header_fields_are_those_of_format_1(spark):
    page = "Customer Name : Ines Q\nMobile Number : 555012\nOpening Balance : UGX 6,120.25"
    for fmt, want in (("format_1", ("Ines Q", D("6120.25"))), ("format_2", (None, None))):
        got = spark.range(1).select(F.lit(page).alias("page"), F.lit(fmt).alias("format"))
        fields = P.header_fields(F.col("page"), F.col("format"))
        assert tuple(got.select(fields["customer_name"], fields["opening_balance"]).first()) == want
