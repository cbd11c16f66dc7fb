"""Statement files to transaction rows: wallet CSV, sheets, and cells of document tables.

A wallet file is a set of (path, line_no, line). Line numbers come from the block a line
was read from and its place in the task, so a huge plain file still splits into many tasks.

Statements come as one file each, or bundled: text files of many statements, each whole in one file, whose lines name
their statement and go on, after a tab, as they stand in its own file. A file per statement costs several file operations a
statement, so many small statements come bundled. A bundled statement is a wallet file too; its path begins with its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerproof.functions import parse as P
from ledgerproof.session import materialise
from ledgerproof.sources.records import whole_records

# Column titles (source spelling) and preamble keys.
HEADER_MARKS = ("Transaction ID", "Transaction Date")
PREAMBLE_KEYS = {
    "Customer Name": "customer_name",
    "Mobile Number": "mobile_number",
    "Email Address": "email_address",
    "Statement Period": "statement_period",
    "Request Date": "request_date",
    "Opening Balance": "opening_balance",
    "Closing Balance": "closing_balance",
}
SHEET_COLUMNS = {
    "Date / Time": "txn_date",
    "Transaction ID": "txn_id",
    "Transaction Type": "txn_type",
    "Amount": "amount",
    "From Account": "from_acc",
    "To Account": "to_acc",
    "Fee": "fee",
    "Commision Amount": "commission_amount",
    "TAX": "tax",
    "Commision Receiving No.": "commission_receiving_no",
    "Commision Balance": "commission_balance",
    "Float Balance": "float_balance",
}
MAPPER_SCHEMA = (
    "run_id string, acc_number string, rm_name string, acc_prvdr_code string, status string, lambda_status string, created_date date"
)
BOM = "\ufeff"
# In bundles: between a name and its line; between a name and the bundle's path. Names are written URL-encoded, so they hold neither.
NAME_END, IN_FILE = "\t", "@"
NO_HEADER = "Could not find transaction header in CSV"
# A quoted cell (doubled quotes inside) or one without commas, and the comma after it.
CELL = r'("(?:[^"]++|"")*+"|[^,]*+),'


# -- wallet CSV ------------------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """Lines of plain or gzip files with their order within the file."""
    file, line = F.col("_metadata.file_path"), F.col("value")
    if bundled:
        file = F.concat(F.substring_index("value", NAME_END, 1), F.lit(IN_FILE), file)
        line = F.expr(f"substr(value, instr(value, '{NAME_END}') + 1)")
    text = spark.read.text(path).select(
        file.alias("path"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line_no"),
        F.when(line.startswith(BOM), F.substr(line, F.lit(2))).otherwise(line).alias("line"),
    )
    return text


def write_bundles(lines: DataFrame, folder: str) -> None:
    """Statements (path, line_no, line) as bundles. A line that holds line ends is written as several lines, as it would be in a file
    of its own (a last carriage return goes with the end of the line)."""
    named = lines.withColumn("path", F.url_encode(F.coalesce("path", F.lit(""))))
    rows = named.repartition("path").sortWithinPartitions("path", "line_no")
    texts = F.explode(F.split(F.coalesce("line", F.lit("")), r"\r\n|\n|\r(?!\z)", -1)).alias("text")
    rows.select("path", texts).select(F.concat_ws(NAME_END, "path", "text").alias("value")).write.text(folder)


def statement_name(path: Column) -> Column:
    """The name that a bundled statement was written by."""
    return F.url_decode(F.substring_index(path, IN_FILE, 1))


def _is_header(line: Column) -> Column:
    return line.contains(HEADER_MARKS[0]) & line.contains(HEADER_MARKS[1])


WALLET_COLUMNS = {
    "Transaction ID": "id",
    "Transaction Date": "date",
    "Description": "text",
    "Status": "status",
    "Transaction Amount": "amount",
    "Credit/Debit": "direction",
    "Fee": "fee",
    "Balance": "balance",
}


def headers(lines: DataFrame) -> DataFrame:
    """One row per file: where its header stands, and the place of each column (NULL if absent)."""
    found = lines.filter(_is_header(F.col("line"))).groupBy("path").agg(
        F.min("line_no").alias("header_no"), F.min_by("line", "line_no").alias("_header")
    )
    names = F.transform(cells(F.col("_header")), lambda n: F.trim(F.btrim(n, F.lit('"\r '))))
    found = found.withColumn("_names", names)
    place = [
        F.nullif(F.array_position("_names", F.lit(title)).cast("int"), F.lit(0)).alias(name) for title, name in WALLET_COLUMNS.items()
    ]
    return found.select("path", "header_no", F.struct(*place).alias("_at"))


def with_headers(lines: DataFrame) -> DataFrame:
    return lines.join(headers(lines), "path", "left")


def cells(line: Column) -> Column:
    """Cells of a line of any width, as they are written (quotes stay)."""
    return F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(CELL), F.lit(1))


def _bare(raw: Column) -> Column:
    """The text of a cell; NULL if it is empty or the line is too short."""
    quoted = raw.startswith('"') & raw.endswith('"') & (raw != '"')
    return F.when(quoted, F.replace(F.substr(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))).when(raw != "", raw)


def _cell(name: str) -> Column:
    return F.get("_cells", F.lit([*WALLET_COLUMNS.values()].index(name)))


def _number(name: str) -> Column:
    return P.amount(F.replace(_cell(name), F.lit(","), F.lit("")))


def wallet_rows(lines: DataFrame) -> DataFrame:
    """Transaction rows below the header; format 1 has a direction column. Rows whose date
    fits no format keep a NULL date, and rows without a readable amount are left out (both
    are counted by `wallet_rejects`)."""
    # Kept an outer join on purpose: as an inner one it might broadcast the lines, not the headers.
    below = F.coalesce(F.col("line_no") > F.col("header_no"), F.lit(False))
    body = with_headers(lines).filter(below & (F.trim("line") != ""))
    # Generators, so that a line is split once and not once per field taken from it, and a cell is read once and not in each
    # of its field's steps: written out in every step, the code of a row is too long to be compiled.
    whole = F.when(F.col("line").contains("\r"), F.regexp_replace("line", "\r$", "")).otherwise(F.col("line"))
    rows = body.select("path", "line_no", "_at", F.explode(F.array(cells(F.rtrim(whole)))).alias("_split"))
    places = F.array(*[F.col(f"_at.{name}") for name in WALLET_COLUMNS.values()])
    raw = F.transform(places, lambda place: F.get("_split", place - 1))
    rows = rows.select("path", "line_no", "_at", F.explode(F.array(F.transform(raw, _bare))).alias("_cells"))
    one = F.col("_at.direction").isNotNull()
    signed = _number("amount")
    debit = F.upper(F.trim(_cell("direction"))) == "DEBIT"
    out = rows.select(
        "path",
        "line_no",
        F.when(one, "format_1").otherwise("format_2").alias("format"),
        _cell("id").alias("txn_id"),
        P.parse_ts(_cell("date"), P.CSV_FORMATS).alias("txn_date"),
        F.trim(_cell("text")).alias("description"),
        F.trim(_cell("status")).alias("status"),
        F.when(one, F.when(debit, -F.abs(signed)).otherwise(F.abs(signed))).otherwise(signed).alias("amount"),
        F.coalesce(_number("fee"), F.lit(0)).cast(P.AMOUNT).alias("fee"),
        _number("balance").alias("balance"),
    )
    return out.withColumn("txn_direction", F.when(F.col("amount") < 0, "DR").otherwise("CR"))


def parse_wallet(lines: DataFrame) -> DataFrame:
    return wallet_rows(lines).filter("txn_id is not null and txn_id <> '' and amount is not null")


def wallet_rejects(lines: DataFrame) -> DataFrame:
    rows = wallet_rows(lines).filter("txn_id is not null and txn_id <> ''")
    return rows.groupBy("path").agg(
        F.count_if(F.col("amount").isNull()).alias("bad_amounts"), F.count_if(F.col("txn_date").isNull()).alias("bad_dates")
    )


def wallet_outcomes(lines: DataFrame) -> DataFrame:
    """One row per file with any line: whether it could be read, why not, and what it holds."""
    rows = parse_wallet(lines).groupBy("path").agg(
        F.count(F.lit(1)).alias("num_rows"), F.min_by("balance", "line_no").alias("first_balance"), F.max_by("balance", "line_no").alias("last_balance")
    )
    form = F.when(F.col("_at.direction").isNotNull(), "format_1").otherwise("format_2")
    known = headers(lines).select("path", form.alias("format"))
    out = lines.select("path").distinct().join(known, "path", "left").join(rows, "path", "left")
    found = F.col("format").isNotNull()
    return out.select(
        "path",
        F.when(found, "SUCCESS").otherwise("FAILED").alias("parsing_status"),
        F.when(~found, NO_HEADER).alias("parsing_error"),
        "format",
        F.coalesce("num_rows", F.lit(0)).alias("num_rows"),
        "first_balance",
        "last_balance",
    )


def preamble(lines: DataFrame) -> DataFrame:
    """Key/value lines above the header, one row per file. The first value of a key wins."""
    above = with_headers(lines).filter(F.col("header_no").isNull() | (F.col("line_no") < F.col("header_no")))
    key = F.trim(F.split_part("line", F.lit(","), F.lit(1)))
    pairs = above.filter(F.col("line").contains(",")).select("path", "line_no", key.alias("key"), F.expr("substr(line, instr(line, ',') + 1)").alias("value"))
    known = pairs.filter(F.col("key").isin(*PREAMBLE_KEYS)).withColumn("value", P.csv_value(F.col("value")))
    wide = known.groupBy("path").pivot("key", list(PREAMBLE_KEYS)).agg(F.min_by("value", "line_no"))
    wide = wide.withColumnsRenamed(PREAMBLE_KEYS)
    return wide.withColumns(
        {
            "request_date": P.request_date(F.col("request_date")),
            "opening_balance": P.currency(F.col("opening_balance")),
            "closing_balance": P.currency(F.col("closing_balance")),
        }
    )


def read_wallet_csv(spark: SparkSession, path: str, bundled: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows and preambles of the files (or bundled statements) under a path; quoted cells may span lines."""
    lines = materialise(whole_records(read_lines(spark, path, bundled)), "whole_records")
    return parse_wallet(lines), preamble(lines)


# -- sheets and document tables ----------------------------------------------------------------


def map_sheet_rows(rows: DataFrame) -> DataFrame:
    """Rows of a sheet with the twelve source columns; rows without an id are dropped."""
    out = rows.withColumnsRenamed({k: v for k, v in SHEET_COLUMNS.items() if k in rows.columns})
    blank = F.lit("")
    c = F.col
    number = {n: P.amount(c(n)) for n in ("amount", "fee", "commission_amount", "tax", "commission_balance", "float_balance")}
    out = out.filter(F.trim(F.coalesce("txn_id", blank)) != "")
    out = out.withColumns({n: F.coalesce(n, blank) for n in ("from_acc", "to_acc", "txn_type")})
    zero = F.lit(0).cast(P.AMOUNT)
    return out.withColumns(
        {
            **number,
            "amount": F.coalesce(number["amount"], zero),
            "fee": F.coalesce(number["fee"], zero),
            "txn_date": P.parse_ts(c("txn_date"), P.SHEET_FORMATS),
            "description": F.concat(c("txn_type"), F.lit(" - "), c("from_acc"), F.lit(" to "), c("to_acc")),
            "status": F.lit("success"),
            "txn_direction": F.when(F.coalesce(number["amount"], zero) > 0, "Credit").otherwise("Debit"),
            "commission_receiving_no": F.nullif("commission_receiving_no", F.lit("None")),
        }
    )


def map_table_rows(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """Table cells to text columns, by `format`; repeated headers and undated rows go."""
    c, one = F.col(cells), F.col("format") == "format_1"

    def at(i: int) -> Column:
        return F.get(c, F.lit(i))

    def pick(first: Column, second: Column) -> Column:
        return F.when(one, first).otherwise(second)

    wide_enough = F.size(c) >= pick(F.lit(8), F.lit(10))
    date = pick(at(1), at(0))
    amount_title = ~one & (F.lower(F.trim(at(7))) == "amount")
    dated = P.parse_ts(F.trim(date), P.TXN_FORMATS).isNotNull()
    kept = rows.filter(~P.header_row(c) & wide_enough & ~F.coalesce(amount_title, F.lit(False)) & dated)
    sign = F.substring(F.trim(at(7)), 1, 1)
    direction = F.when(sign == "+", "Credit").when(sign == "-", "Debit").otherwise("Unknown")
    return kept.withColumns(
        {
            "txn_id": pick(at(0), at(1)),
            "txn_date": date,
            "description": pick(at(2), F.concat(at(2), F.lit(" - "), at(3))),
            "status": pick(at(3), at(6)),
            "amount": pick(at(4), F.trim(at(7))),
            "txn_direction": pick(at(5), direction),
            "fee": pick(at(6), at(8)),
            "balance": pick(at(7), at(9)),
        }
    ).drop(cells)


def header_rows_in(rows: DataFrame, cells: str = "cells") -> DataFrame:
    return rows.groupBy("run_id").agg(F.count_if(P.header_row(F.col(cells))).alias("header_rows"))


def clean_txn(raw: DataFrame) -> DataFrame:
    """Text columns of a table row to typed ones, keeping the raw texts and quality flags.

    An overlap repair alone does not flag a row: the flag is the OR of the two text changes.
    """
    c = F.col
    out = raw.withColumns(
        {
            "amount_raw": P.number_text(c("amount")),
            "fee_raw": P.fee_text(c("fee")),
            "balance_raw": P.number_text(c("balance")),
        }
    )
    mended = P.overlap_balance(c("fee_raw"), c("balance_raw"))
    overlapped = P.is_overlapped(c("fee_raw"), c("balance_raw")) & mended.isNotNull()
    out = out.withColumns(
        {
            "_amount": P.amount_text(c("amount_raw"), c("format")),
            "_fee": F.when(overlapped, F.lit("0")).otherwise(c("fee_raw")),
            "_balance": P.balance_text(F.when(overlapped, mended).otherwise(c("balance_raw"))),
        }
    )
    amount_changed = F.coalesce(c("amount_raw") != c("_amount"), F.lit(False))
    balance_changed = F.coalesce(c("balance_raw") != c("_balance"), F.lit(False))
    return out.withColumns(
        {
            "amount": P.amount(c("_amount")),
            "fee": F.coalesce(P.amount(c("_fee")), F.lit(0)).cast(P.AMOUNT),
            "balance": P.amount(c("_balance")),
            "has_quality_issue": amount_changed | balance_changed,
            "txn_date": P.parse_ts(c("txn_date"), P.TXN_FORMATS),
            "description": P.one_line(c("description")),
            "txn_direction": F.trim("txn_direction"),
            "status": F.trim("status"),
            "txn_id": F.trim("txn_id"),
        }
    ).drop("_amount", "_fee", "_balance")


def clean_failures(cleaned: DataFrame) -> DataFrame:
    """Rows whose amount could not be read; an importer refuses statements that have any."""
    return cleaned.filter("amount is null").groupBy("run_id").agg(F.count(F.lit(1)).alias("failed_amounts"))


# -- dimensions and files -------------------------------------------------------------------------


def read_mapper(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MAPPER_SCHEMA).csv(path, header=True)


def parse_mapper_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    return lines.select(F.from_csv(column, F.lit(MAPPER_SCHEMA)).alias("m")).select("m.*")


def run_id_of(name: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.regexp_extract(name, r"([^/]+)$", 1), r"(.)\.[^.]*$", "$1")


MIME_TYPES = (
    (".csv.gz", "application/gzip"),
    (".pdf", "application/pdf"),
    (".csv", "text/csv"),
    (".xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    (".xls", "application/vnd.ms-excel"),
)


def mime_of(path: Column) -> Column:
    out = F
    for ending, mime in MIME_TYPES:
        out = out.when(F.lower(path).endswith(ending), mime)
    return out.otherwise("application/octet-stream")


def format_tag(provider: Column, pdf_format: Column) -> Column:
    return (
        F.when((provider == "UATL") & (pdf_format == 1), "format_1")
        .when((provider == "UATL") & (pdf_format == 2), "format_2")
        .when(provider == "UMTN", "excel")
    )


def with_provider(files: DataFrame, mapper: DataFrame) -> DataFrame:
    """Provider of a file: the mapping (a run's earliest), else its extension, for CSV its content."""
    first = F.min_by("acc_prvdr_code", F.struct("created_date", "acc_prvdr_code"))
    known = mapper.groupBy("run_id").agg(first.alias("_mapped"))
    ext = F.lower(F.regexp_extract("name", r"([^.]*)$", 1))
    wallet = F.coalesce(F.col("content").contains("Airtel Money"), F.lit(False))
    guess = (
        F.when(ext == "pdf", "UATL").when((ext == "csv") & wallet, "UATL").when(ext.isin("csv", "xlsx", "xls"), "UMTN").otherwise("UATL")
    )
    return files.join(known, "run_id", "left").withColumn("acc_prvdr_code", F.coalesce("_mapped", guess)).drop("_mapped")


def actual_type(content: Column) -> Column:
    """Type by leading bytes, else text with a comma."""
    magic = F.hex(F.substring(content, 1, 4))
    # A cut inside a character is not a defect of the file, so up to three bytes may go.
    text = F.coalesce(*[F.try_validate_utf8(F.substring(content, 1, n).cast("string")) for n in (200, 199, 198, 197)])
    return (
        F.when(magic.startswith("25504446"), "pdf")
        .when(magic == "504B0304", "xlsx")
        .when(magic.startswith("1F8B"), "gzip")
        .when(text.contains(",") & ~text.contains("\x00"), "csv")
        .otherwise("unknown")
    )


def file_census(files: DataFrame) -> DataFrame:
    """Files by extension and real type. `files` has path and content (binaryFile)."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    typed = files.select(ext.alias("extension"), actual_type(F.col("content")).alias("actual_type"))
    return typed.groupBy("extension", "actual_type").agg(F.count(F.lit(1)).alias("files"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


# -- fingerprints -------------------------------------------------------------------------------------

FANOUT = 4096
LEVELS = 6  # 4096^6 exceeds any arrival number, so one node is left


def fingerprints(rows: DataFrame, columns: list[str]) -> DataFrame:
    """md5 per run over its rows in arrival order, as a tree: each level digests at most
    4096 neighbours (by arrival number), so no task sees a whole statement. Values are written with
    their length, and NULL as a dash, so a comma inside a value can't pass for one between values."""
    texts = [F.col(c).cast("string") for c in columns]
    line = F.concat_ws(",", *[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in texts])
    level = rows.select("run_id", F.col("seq").alias("_at"), F.md5(line).alias("_h"))
    for _ in range(LEVELS):
        level = level.withColumn("_up", F.floor(F.col("_at") / FANOUT))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_h"))), lambda e: e["_h"]), "\n")
        level = level.groupBy("run_id", "_up").agg(F.md5(joined).alias("_h")).withColumnRenamed("_up", "_at")
    return level.groupBy("run_id").agg(F.max("_h").alias("sheet_md5"))
