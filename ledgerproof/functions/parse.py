"""Column builders that clean the texts statements are made of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = "decimal(18,2)"

# Date patterns (short years are spelled out before parsing), patterns of header fields, header words of table rows.
TXN_FORMATS = ("d-M-yyyy h:m a", "d-M-yyyy H:m", "yyyy-M-d H:m:s")
CSV_FORMATS = ("d-M-yyyy h:m a", "d-MMM-yyyy h:m a", "yyyy-M-d H:m:s", "d/M/yyyy H:m")
SHEET_FORMATS = ("yyyy-M-d H:m", "yyyy-M-d H:m:s")
REQUEST_FORMATS = (
    "d-MMM-yyyy",
    "d MMM, yyyy",
    "d MMM yyyy",
    "d-M-yyyy",
    "yyyy-M-d",
    "d/M/yyyy",
    "d MMMM yyyy",
    "d MMMM, yyyy",
)
_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
HEADER_PATTERNS = {
    "email_address": (rf"(?i)Email\s+Address\s*:\s*({_EMAIL})", rf"\b({_EMAIL})\b"),
    "customer_name": (r"(?is)Customer\s+Name\s*:\s*(.+?)(?:\n|Mobile Number)",),
    "mobile_number": (r"(?i)Mobile\s+Number\s*:\s*(\d+)",),
    "statement_period": (r"(?is)Statement\s+Period\s*:\s*(.+?)(?:\n|Request Date)",),
    "request_date": (r"(?i)Request\s+Date\s*:\s*(.+?)(?:\n|$)",),
    "opening_balance": (r"(?i)Opening\s+Balance\s*:\s*UGX\s*([\d,]+\.?\d*)", r"(?i)Opening\s+Balance\s*:\s*([\d,]+\.?\d*)"),
    "closing_balance": (r"(?i)Closing\s+Balance\s*:\s*UGX\s*([\d,]+\.?\d*)", r"(?i)Closing\s+Balance\s*:\s*([\d,]+\.?\d*)"),
}
ROW_HEADER_WORDS = (
    "transaction id",
    "transation id",
    "transaction type",
    "transaction date",
    "credit/debit",
    "transaction amount",
)
ROW_HEADER_CELLS = (
    "date", "description", "status", "amount", "fee", "balance", "from", "to", "credit/debit", "transaction amount",
)
COUNTRY_CODE = "256"
OVERLAP_FEE = 1_000_000


def _matched(text: Column, pattern: str, group: int = 1) -> Column:
    """NULL instead of '' when the pattern is not found."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


# -- amounts -------------------------------------------------------------------------------


def number_text(raw: Column) -> Column:
    """Without thousands commas; missing values become '0'."""
    text = F.trim(F.replace(F.coalesce(raw, F.lit("None")), F.lit(","), F.lit("")))
    return F.when(text.isin("", "nan", "None"), "0").otherwise(text)


def amount_text(text: Column, fmt: Column) -> Column:
    """The number in an amount: unsigned in format 1, signed in format 2; NULL if none.
    Of doubled signs the first is kept."""
    one_sign = F.regexp_replace(text, r"^([+-])([+-]+)", "$1")
    unsigned = _matched(one_sign, r"^[+\-]?(\d+(?:\.\d+)?)")
    return F.when(fmt == "format_1", unsigned).otherwise(_matched(one_sign, r"^([+-]?\d+(?:\.\d+)?)"))


def balance_text(text: Column) -> Column:
    return _matched(text, r"^([+-]?\d+(?:\.\d+)?)")


def fee_text(raw: Column) -> Column:
    return F.trim(F.replace(F.coalesce(raw, F.lit("None")), F.lit(","), F.lit("")))


def is_overlapped(fee: Column, balance: Column) -> Column:
    """Fee and balance columns printed into each other."""
    return F.coalesce((fee.try_cast("double") > OVERLAP_FEE) & balance.startswith("."), F.lit(False))


def overlap_balance(fee: Column, balance: Column) -> Column:
    return _matched(F.concat(fee, balance), r"(\d{1,9}\.?\d{0,2})$")


def amount(text: Column) -> Column:
    return text.try_cast(AMOUNT)


def currency(text: Column) -> Column:
    """'Ugx 1,234.50' as a number."""
    bare = F.regexp_replace(F.upper(text), "UGX|USH|,", "")
    return F.trim(bare).try_cast(AMOUNT)


def csv_value(text: Column) -> Column:
    bare = F.trim(F.btrim(F.trim(text), F.lit('"')))
    return F.trim(F.regexp_replace(bare, r'[",]+$', ""))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def nan_to_null(number: Column) -> Column:
    return F.when(~F.isnan(number), number)


# -- texts ---------------------------------------------------------------------------------


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def msisdn(number: Column) -> Column:
    return F.regexp_replace(F.trim(number), f"^{COUNTRY_CODE}", "")


def own_account(from_acc: Column, to_acc: Column) -> Column:
    """The agent's number: the paying side, else the receiving side without its domain."""

    def given(col: Column) -> Column:
        return F.when((col != "") & (col != "nan"), col)

    return F.coalesce(msisdn(given(from_acc)), msisdn(F.split_part(given(to_acc), F.lit("@"), F.lit(1))))


def header_row(cells: Column) -> Column:
    """Table rows that repeat the column names."""
    joined = F.lower(F.array_join(F.filter(cells, lambda c: F.coalesce(c, F.lit("")) != ""), " "))
    words = sum((joined.contains(w).cast("int") for w in ROW_HEADER_WORDS), F.lit(0))
    names = F.array(*[F.lit(n) for n in ROW_HEADER_CELLS])
    exact = F.arrays_overlap(F.transform(cells, lambda c: F.lower(F.trim(F.coalesce(c, F.lit("none"))))), names)
    return (F.size(cells) >= 3) & ((words >= 2) | exact)


def statement_format(text: Column, header: Column) -> Column:
    """Format from the title, else from the cells of the first table row."""

    def has(name: str) -> Column:
        return F.coalesce(F.array_contains(header, name), F.lit(False))

    return (
        F.when(text.contains("USER STATEMENT"), "format_2")
        .when(text.contains("AIRTEL MONEY STATEMENT"), "format_1")
        .when(has("Transation ID") | has("Transaction Type"), "format_2")
        .otherwise("format_1")
    )


def account_number(text: Column, fmt: Column) -> Column:
    """Nine digits after the label, else any nine-digit word."""
    two = F.when(fmt == "format_2", _matched(text, r"(?i)Mobile Number\s*:\s*(?:256)?(\d{9})"))
    return F.coalesce(two, _matched(text, r"(?is)Mobile Number\s*:.*?(\b\d{9}\b)"), _matched(text, r"(\b\d{9}\b)"))


def header_fields(text: Column, fmt: Column | None = None) -> dict[str, Column]:
    """Labelled fields of a first page; the second pattern of a field is its fallback. Pages of format 2 have none."""
    if fmt is not None:
        text = F.when(~fmt.eqNullSafe(F.lit("format_2")), text)
    out = {name: F.coalesce(*[_matched(text, p) for p in patterns]) for name, patterns in HEADER_PATTERNS.items()}
    for name in ("customer_name", "statement_period"):
        out[name] = one_line(out[name])
    out["request_date"] = request_date(out["request_date"])
    for name in ("opening_balance", "closing_balance"):
        out[name] = currency(out[name])
    return out


# -- dates ---------------------------------------------------------------------------------


def parse_ts(text: Column, formats: tuple[str, ...]) -> Column:
    """First format that fits; NULL when none does. Newlines count as spaces.

    Two-digit years are spelled out first: from 69 on they belong to the last century.
    """
    flat = one_line(text)
    flat = F.regexp_replace(flat, r"^(\d{1,2}-\w{1,3}-)(69|[7-9]\d)( )", "$119$2$3")
    flat = F.regexp_replace(flat, r"^(\d{1,2}-\w{1,3}-)(\d\d)( )", "$120$2$3")
    return F.coalesce(*[F.try_to_timestamp(flat, F.lit(f)) for f in formats])


def request_date(text: Column) -> Column:
    flat = one_line(F.btrim(F.trim(text), F.lit('"')))
    return F.to_date(F.coalesce(*[F.try_to_timestamp(flat, F.lit(f)) for f in REQUEST_FORMATS]))


def document_date(text: Column) -> Column:
    """'D:yyyyMMddHHmmss…' or an ISO text; 'N/A' is NULL."""
    stamp = F.try_to_timestamp(F.substring(text, 3, 14), F.lit("yyyyMMddHHmmss"))
    return F.when(text.startswith("D:"), stamp).otherwise(F.try_to_timestamp(F.nullif(text, F.lit("N/A"))))
