"""Forensic metrics per statement: ids, balance jumps, timing, amounts, page headers.

Per-run figures are aggregates with map-side combine; only balance jumps and arrival order
need an ordered scan. Lists whose length grows with a statement (repeated ids, jump
positions, flagged pages) are rows, not arrays, so no cell holds a whole statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerproof.operators.sequence import ARRIVAL, Ordered, Sizing, Sort, plain, scan, split_hot

RUN = ["run_id"]

# First-digit shares, header texts.
FIRST_DIGIT_SHARE = {1: 0.301, 2: 0.176, 3: 0.125, 4: 0.097, 5: 0.079, 6: 0.067, 7: 0.058, 8: 0.051, 9: 0.046}
PAGE_HEADER_TEXTS = (
    "transaction id",
    "transation id",
    "date transaction",
    "date/time",
    "transaction type",
    "description",
    "from account",
    "to account",
    "mobile number",
)
MIN_DIGITS = 10
ROUND_STEP = 500


# -- ids -----------------------------------------------------------------------------------


def repeated_ids(txn: DataFrame) -> DataFrame:
    return (
        txn.filter("txn_id <> ''").groupBy("run_id", "txn_id").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    )


def longest_digits(txn_id: Column) -> Column:
    """Longest run of digits, the first of equals, as a whole number; NULL beyond 38 digits."""
    runs = F.regexp_extract_all(txn_id, F.lit(r"(\d+)"), F.lit(1))
    ranked = F.transform(runs, lambda r, i: F.struct(F.length(r).alias("n"), (-i).alias("i"), r.alias("r")))
    return F.array_max(ranked)["r"].try_cast("decimal(38,0)")


def id_integrity(txn: DataFrame) -> DataFrame:
    """Repeated ids, missing numbers, and ids off the usual pattern, per run.

    Sorted numbers skip (max - min + 1 - distinct) values, so gaps need no sort.
    """
    ids = txn.filter("txn_id <> ''").groupBy("run_id", "txn_id").agg(F.count(F.lit(1)).alias("n"))
    ids = ids.withColumns(
        {"number": longest_digits(F.col("txn_id")), "pattern": F.regexp_replace("txn_id", r"\d+", "#")}
    )
    numbered = F.col("number").isNotNull()
    numbers = ids.filter(numbered).groupBy("run_id", "number").agg(F.lit(1).alias("one"))
    gaps = numbers.groupBy("run_id").agg(
        (F.max("number") - F.min("number") + 1 - F.count(F.lit(1))).cast("long").alias("gap_count")
    )
    patterns = ids.filter(numbered).groupBy("run_id", "pattern").agg(F.sum("n").alias("n"))
    breaks = patterns.groupBy("run_id").agg((F.sum("n") - F.max("n")).alias("pattern_break_count"))
    repeats = ids.groupBy("run_id").agg(F.count_if(F.col("n") > 1).alias("duplicate_ids"))
    out = repeats.join(gaps, "run_id", "left").join(breaks, "run_id", "left")
    return out.fillna(0, ["gap_count", "pattern_break_count"])


# -- balances --------------------------------------------------------------------------------


def _jumps(rows: Ordered, threshold: float) -> Ordered:
    seen = rows.lag(F.col("balance"), "_before").running_sum(F.lit(1), "_n")
    before, now = F.col("_before").cast("double"), F.col("balance").cast("double")
    ratio = F.when(F.col("_before").isNotNull() & (F.col("_before") != 0), F.abs(now - before) / F.abs(before))
    df = seen.df.withColumn("jump_ratio", F.when(ratio > threshold, ratio))
    return seen.over(df.withColumn("position", F.col("_n") - 1).drop("_before", "_n"))


def jump_rows(txn: DataFrame, threshold: float = 0.5, sizing: Sizing = Sizing()) -> DataFrame:
    """Every jump with its position in the statement."""
    slim = txn.select("run_id", "seq", "txn_date", "balance")
    out = scan(slim, RUN, ARRIVAL, lambda rows: _jumps(rows, threshold).df, sizing)
    return out.filter("jump_ratio is not null").select(
        "run_id", F.col("position").cast("long").alias("position"), F.round("jump_ratio", 6).alias("jump_ratio")
    )


def balance_jumps(txn: DataFrame, threshold: float = 0.5, sizing: Sizing = Sizing()) -> DataFrame:
    slim = txn.select("run_id", "seq", "txn_date", "balance")
    out = scan(slim, RUN, ARRIVAL, lambda rows: _jumps(rows, threshold).df, sizing)
    return out.groupBy("run_id").agg(
        F.count("jump_ratio").alias("balance_jump_count"),
        F.round(F.coalesce(F.max("jump_ratio"), F.lit(0.0)), 6).alias("max_jump_ratio"),
    )


# -- timing ----------------------------------------------------------------------------------


def same_second_groups(txn: DataFrame) -> DataFrame:
    seconds = txn.groupBy("run_id", F.date_trunc("second", "txn_date").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    shared = F.col("_s").isNotNull() & (F.col("_n") > 1)
    return seconds.groupBy("run_id").agg(F.count_if(shared).alias("same_second_groups"))


def backward_steps(txn: DataFrame, sizing: Sizing = Sizing()) -> DataFrame:
    """Rows dated before the row that arrived just ahead of them."""

    def step(rows: Ordered) -> DataFrame:
        return rows.lag(F.col("txn_date"), "_before").df

    out = scan(txn.select("run_id", "seq", "txn_date"), RUN, (Sort("seq"),), step, sizing)
    return out.groupBy("run_id").agg(F.count_if(F.col("_before") > F.col("txn_date")).alias("non_chronological_count"))


def hour_shares(txn: DataFrame) -> DataFrame:
    hour = F.hour("txn_date")
    dated = F.count("txn_date")
    office, weekend = F.count_if(hour.between(8, 17)), F.count_if(F.weekday("txn_date") >= 5)
    return txn.groupBy("run_id").agg(
        F.round(F.when(dated < 2, 0.0).otherwise(office / dated), 6).alias("business_hours_ratio"),
        F.round(F.when(dated < 2, 0.0).otherwise(weekend / dated), 6).alias("weekend_ratio"),
    )


def time_anomalies(txn: DataFrame, sizing: Sizing = Sizing()) -> DataFrame:
    return same_second_groups(txn).join(backward_steps(txn, sizing), "run_id").join(hour_shares(txn), "run_id")


# -- amounts ---------------------------------------------------------------------------------


def _amount_sums(n: Column) -> list[Column]:
    """Sums over (run, amount) counts; `n` is the count, NULL on rows without an amount."""
    digit = F.when(F.col("amount") >= 1, F.substring(F.floor("amount").cast("string"), 1, 1).cast("int"))
    return [
        F.sum(n).alias("rows"),
        F.sum(F.when(F.col("amount") % ROUND_STEP == 0, n).otherwise(0)).alias("round_rows"),
        F.count_if(n > 1).alias("repeated"),
        F.sum(F.when(digit.isNotNull(), n).otherwise(0)).alias("digits"),
        *[F.sum(F.when(digit == d, n).otherwise(0)).alias(f"d{d}") for d in FIRST_DIGIT_SHARE],
    ]


def _amount_ratios() -> list[Column]:
    """NULL for a run without amounts."""
    off = sum((F.abs(F.col(f"d{d}") / F.col("digits") - F.lit(p)) for d, p in FIRST_DIGIT_SHARE.items()), F.lit(0.0))
    score = F.when(F.col("digits") < MIN_DIGITS, 0.5).otherwise(1.0 - off / 2)
    some = F.col("rows") > 0
    return [
        F.when(some, F.round(F.col("round_rows") / F.col("rows"), 6)).alias("round_number_ratio"),
        F.when(some, F.round(F.col("repeated") / F.col("rows"), 6)).alias("duplicate_amount_ratio"),
        F.when(some, F.round(score, 6)).alias("benford_score"),
    ]


def amount_patterns(txn: DataFrame) -> DataFrame:
    """Round-number share, repeated-amount share and first-digit score from one pre-aggregate
    of (run, amount) counts."""
    counts = txn.filter("amount is not null").groupBy("run_id", "amount").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("run_id").agg(*_amount_sums(F.col("n"))).select("run_id", *_amount_ratios())


# -- page headers ----------------------------------------------------------------------------


def is_page_header(lowered: Column) -> Column:
    return sum((lowered.contains(t).cast("int") for t in PAGE_HEADER_TEXTS), F.lit(0)) >= 2


def _is_content(line: Column) -> Column:
    """Neither blank nor just a page number (1-999)."""
    bare = F.regexp_replace(line, r"^\s+|\s+$", "")
    return (bare != "") & ~bare.rlike(r"^\+?0*[1-9][0-9]{0,2}$")


def header_scan(pages: DataFrame) -> DataFrame:
    """Headers per page and, if the page is suspect, why. Row-local: lines never leave the
    row, and only the lines above a lone header are checked for content."""
    c = F.col
    out = pages.select("run_id", "page_no", (F.coalesce(c("text"), F.lit("")) == "").alias("_blank"), F.split(F.lower("text"), "\n").alias("_lines"))
    marks = F.transform("_lines", lambda x, i: F.when(is_page_header(x), i))
    out = out.withColumn("_at", F.when(~c("_blank"), F.filter(marks, lambda p: p.isNotNull())))
    n, first = F.coalesce(F.size("_at"), F.lit(0)), F.get("_at", F.lit(0))
    out = out.withColumn("_n", F.when(c("_blank"), 0).otherwise(n))
    lone = (c("_n") == 1) & (c("page_no") > 1)
    above = F.transform(F.slice("_lines", F.lit(1), first), _is_content)
    out = out.withColumn("_content", F.when(lone & (first > 0), F.array_position(above, True)).otherwise(0))
    shown = F.concat(F.lit("["), F.array_join(F.transform("_at", lambda p: p.cast("string")), ", "), F.lit("]"))
    reason = (
        F.when(c("_blank"), F.lit(None).cast("string"))
        .when(c("_n") == 0, "No header row found")
        .when(c("_n") > 1, F.concat(c("_n").cast("string"), F.lit(" headers (positions: "), shown, F.lit(")")))
        .when(
            c("_content") > 0,
            F.concat(
                F.lit("Header at line "), first.cast("string"), F.lit(" (expected at line "), (c("_content") - 1).cast("string"), F.lit(")")
            ),
        )
    )
    return out.select("run_id", "page_no", c("_n").cast("long").alias("header_rows"), reason.alias("reason"))


def scannable(pages: DataFrame, statements: DataFrame, provider: str = "UATL", fmt: str = "format_2") -> DataFrame:
    """Pages of the statements whose layout repeats its header row on each page."""
    chosen = statements.filter((F.col("acc_prvdr_code") == provider) & (F.col("format") == fmt))
    return pages.join(chosen.select("run_id").distinct(), "run_id", "left_semi")


def header_rollup(scanned: DataFrame) -> DataFrame:
    flagged = F.col("reason").isNotNull()
    return scanned.groupBy("run_id").agg(
        F.bool_or(flagged).alias("is_manipulated"),
        F.count_if(flagged).alias("flagged_pages"),
        F.count(F.lit(1)).alias("pages"),
        F.sum("header_rows").alias("header_rows"),
    )


def header_cross_tab(rollup: DataFrame, summary: DataFrame) -> DataFrame:
    both = rollup.join(summary.select("run_id", "balance_match"), "run_id")
    return both.groupBy("is_manipulated").agg(
        F.count_if(F.col("balance_match") == "Success").alias("matched"),
        F.count_if(F.col("balance_match") == "Failed").alias("mismatched"),
    )


# -- all metrics in one nested row -------------------------------------------------------------


def _counted_values(txn: DataFrame) -> DataFrame:
    """run_id, one of (txn_id, number, pattern, second, amount), n: how often each value stands in its run.

    One pass over the rows, one shuffle with map-side combine, on the value as well as the run: the
    rows of a large run spread over all tasks.
    """
    c, digits = F.col, longest_digits(F.col("txn_id"))
    values = {
        "txn_id": F.when(c("txn_id") != "", c("txn_id")),
        "number": F.when(c("txn_id") != "", digits),
        "pattern": F.when((c("txn_id") != "") & digits.isNotNull(), F.regexp_replace("txn_id", r"\d+", "#")),
        "second": F.date_trunc("second", "txn_date"),
        "amount": c("amount"),
    }
    types = txn.select(*[v.alias(name) for name, v in values.items()]).schema

    def alone(name: str) -> Column:
        return F.struct(*[(c(f"_{x.name}") if x.name == name else F.lit(None).cast(x.dataType)).alias(x.name) for x in types])

    rows = txn.select("run_id", *[v.alias(f"_{name}") for name, v in values.items()])
    each = F.array_compact(F.array(*[F.when(c(f"_{name}").isNotNull(), alone(name)) for name in values]))
    rows = rows.select("run_id", F.explode(each).alias("value")).select("run_id", "value.*")
    return rows.groupBy("run_id", *values).agg(F.count(F.lit(1)).alias("n"))


def _value_metrics(txn: DataFrame) -> DataFrame:
    """What `id_integrity`, `same_second_groups`, `hour_shares` and `amount_patterns` say, from one table of counts."""
    c, n = F.col, F.col("n")

    def of(name: str) -> Column:
        return F.when(c(name).isNotNull(), n)

    hour, day, zero = F.hour("second"), F.weekday("second"), F.lit(0)
    sums = _counted_values(txn).groupBy("run_id").agg(
        F.count_if(of("txn_id") > 1).alias("duplicate_ids"),
        (F.max("number") - F.min("number") + 1 - F.count("number")).cast("long").alias("gap_count"),
        (F.sum(of("pattern")) - F.max(of("pattern"))).alias("pattern_break_count"),
        F.count_if(of("second") > 1).alias("same_second_groups"),
        F.sum(of("second")).alias("dated"),
        F.sum(F.when(hour.between(8, 17), n).otherwise(zero)).alias("office"),
        F.sum(F.when(day >= 5, n).otherwise(zero)).alias("weekend"),
        *_amount_sums(of("amount")),
    )
    few = F.coalesce(c("dated"), zero) < 2
    return sums.select(
        "run_id", "duplicate_ids",
        F.coalesce("gap_count", zero).alias("gap_count"),
        F.coalesce("pattern_break_count", zero).alias("pattern_break_count"),
        "same_second_groups",
        F.round(F.when(few, 0.0).otherwise(c("office") / c("dated")), 6).alias("business_hours_ratio"),
        F.round(F.when(few, 0.0).otherwise(c("weekend") / c("dated")), 6).alias("weekend_ratio"),
        *_amount_ratios(),
    )


def _order_metrics(txn: DataFrame, threshold: float, sizing: Sizing) -> DataFrame:
    """What `balance_jumps` and `backward_steps` say. Ordinary runs: both orders over one shuffle on
    run_id. Hot runs: each order in blocks of its own."""
    slim = txn.select("run_id", "seq", "txn_date", "balance")
    cold, hot, _ = split_hot(slim, RUN, sizing.hot_rows, sizing.at_most)
    jumps = _jumps(plain(cold, RUN, ARRIVAL), threshold).df
    seen = plain(jumps, RUN, (Sort("seq"),)).lag(F.col("txn_date"), "_before").df
    out = seen.groupBy("run_id").agg(
        F.count("jump_ratio").alias("balance_jump_count"),
        F.round(F.coalesce(F.max("jump_ratio"), F.lit(0.0)), 6).alias("max_jump_ratio"),
        F.count_if(F.col("_before") > F.col("txn_date")).alias("non_chronological_count"),
    )
    if hot is None:
        return out
    # What is left is hot, so the test for it is not repeated with a bound.
    every = Sizing(sizing.hot_rows, sizing.block_rows)
    return out.unionByName(balance_jumps(hot, threshold, every).join(backward_steps(hot, every), "run_id"))


def all_metrics(txn: DataFrame, sizing: Sizing = Sizing()) -> DataFrame:
    """Nested metrics per statement with the findings worth a look.

    Two passes over the rows: values counted, and rows in order. A run without ids, dates or amounts is
    in the result too: its counts are zero, its shares of hours zero, its shares of amounts NULL.
    """
    c = F.col
    flat = _order_metrics(txn, 0.5, sizing).join(_value_metrics(txn), "run_id", "left")
    flat = flat.fillna(0, ["duplicate_ids", "gap_count", "pattern_break_count", "same_second_groups", "business_hours_ratio", "weekend_ratio"])
    out = flat.select(
        "run_id",
        F.struct("duplicate_ids", "gap_count", "pattern_break_count").alias("id_integrity"),
        F.struct("balance_jump_count", "max_jump_ratio").alias("balance_jumps"),
        F.struct("same_second_groups", "non_chronological_count", "business_hours_ratio", "weekend_ratio").alias("timestamps"),
        F.struct("round_number_ratio", "duplicate_amount_ratio", "benford_score").alias("amounts"),
    )
    findings = F.array_compact(
        F.array(
            F.when(c("id_integrity.duplicate_ids") > 0, "duplicate_ids"),
            F.when(c("id_integrity.gap_count") > 10, "id_gaps"),
            F.when(c("balance_jumps.balance_jump_count") > 0, "balance_jumps"),
            F.when(c("timestamps.non_chronological_count") > 0, "non_chronological"),
        )
    )
    return out.withColumn("findings", findings)


def flatten_metrics(metrics: DataFrame) -> DataFrame:
    """Struct paths to flat columns."""
    flat = ["run_id"]
    for field in metrics.schema.fields:
        if field.dataType.typeName() == "struct":
            flat += [f"{field.name}.{sub}" for sub in field.dataType.names]
    return metrics.select(*flat, F.array_join("findings", ",").alias("findings"))


def format_page_reasons(df: DataFrame, reasons: str) -> DataFrame:
    """Map page -> reason as `P3:reason; P7:reason`, pages in order."""
    entries = F.array_sort(F.map_entries(reasons))
    text = F.transform(entries, lambda e: F.concat(F.lit("P"), e["key"].cast("string"), F.lit(":"), e["value"]))
    return df.withColumn(reasons, F.array_join(text, "; "))
