"""Joins between statements, requests, leads, borrowers, people, loans and mappings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXCLUDED_LOAN_STATUSES = ("voided", "hold", "pending_approval", "rejected")  # Fixed values
EXCLUDED_PRODUCT_TYPE = "float_vending"


def full_name(prefix: str = "") -> Column:
    return F.concat_ws(" ", f"{prefix}first_name", f"{prefix}middle_name", f"{prefix}last_name")


def named(persons: DataFrame, name: str) -> DataFrame:
    """`persons` as an (id, full name) dimension under a role name."""
    return persons.select(F.col("id").alias(f"{name}_id"), full_name().alias(f"{name}_name"))


# -- statement request -> customer -----------------------------------------------------------


def final_entities(requests: DataFrame, statements: DataFrame, cutoff: str | None = None, max_id: int | None = None) -> DataFrame:
    """A request points at a lead or reassessment directly or through a customer statement."""
    if cutoff is not None:
        requests = requests.filter(F.col("created_at") >= F.lit(cutoff).cast("timestamp"))
    if max_id is not None:
        requests = requests.filter(F.col("id") <= max_id)
    cs = statements.select(
        F.col("id").alias("customer_statement_id"),
        F.col("entity").alias("cs_entity"),
        F.expr("try_cast(entity_id AS BIGINT)").alias("cs_entity_id"),
        F.col("status").alias("cs_status"),
    )
    indirect = F.col("entity") == "customer_statement"
    out = requests.join(cs, indirect & (F.col("customer_statement_id") == F.col("entity_id")), "left")
    return out.select(
        F.col("id").alias("stmt_request_id"),
        F.col("flow_req_id").alias("run_id"),
        "acc_number",
        "acc_prvdr_code",
        "lambda_status",
        F.to_date("created_at").alias("created_date"),
        "created_by",
        F.col("entity").alias("direct_entity"),
        F.col("entity_id").alias("direct_entity_id"),
        "customer_statement_id",
        "cs_entity",
        "cs_status",
        F.when(indirect, F.col("cs_entity")).otherwise(F.col("entity")).alias("final_entity_type"),
        F.when(indirect, F.col("cs_entity_id")).otherwise(F.col("entity_id")).alias("final_entity_id"),
    )


def lead_details(final: DataFrame, leads: DataFrame) -> DataFrame:
    of = leads.select(F.col("id").alias("lead_id"), F.col("cust_id").alias("lead_cust_id"), F.col("biz_name").alias("lead_biz_name"))
    at_lead = final.filter(F.col("final_entity_type") == "lead").select("stmt_request_id", "final_entity_id")
    return at_lead.join(of, F.col("lead_id") == F.col("final_entity_id")).drop("final_entity_id")


def reassessment_details(final: DataFrame, reassessments: DataFrame) -> DataFrame:
    of = reassessments.select(
        F.col("id").alias("reassessment_id"), F.col("cust_id").alias("rr_cust_id"), F.col("prev_limit").alias("rr_prev_limit")
    )
    at_rr = final.filter(F.col("final_entity_type") == "reassessment_result").select("stmt_request_id", "final_entity_id")
    return at_rr.join(of, F.col("reassessment_id") == F.col("final_entity_id")).drop("final_entity_id")


def with_entities(final: DataFrame, leads: DataFrame, reassessments: DataFrame) -> DataFrame:
    """Lead and reassessment facts and the customer key they agree on."""
    out = final.join(lead_details(final, leads), "stmt_request_id", "left")
    out = out.join(reassessment_details(final, reassessments), "stmt_request_id", "left")
    return out.withColumn("cust_id", F.coalesce("lead_cust_id", "rr_cust_id")).drop("lead_cust_id", "rr_cust_id")


def customer_lineage(
    requests: DataFrame,
    statements: DataFrame,
    leads: DataFrame,
    reassessments: DataFrame,
    borrowers: DataFrame,
    persons: DataFrame,
    cutoff: str | None = None,
    max_id: int | None = None,
) -> DataFrame:
    final = with_entities(final_entities(requests, statements, cutoff, max_id), leads, reassessments)
    b = borrowers.select(
        F.col("id").alias("borrower_id"),
        F.col("cust_id").alias("borrower_cust_id"),
        F.col("biz_name").alias("borrower_biz_name"),
        "reg_flow_rel_mgr_id",
        "flow_rel_mgr_id",
        "crnt_fa_limit",
    )
    c = F.col
    out = final.join(named(persons, "rm"), c("rm_id") == c("created_by"), "left")
    out = out.join(b, c("borrower_cust_id") == c("cust_id"), "left")
    out = out.join(named(persons, "reg_rm"), c("reg_rm_id") == c("reg_flow_rel_mgr_id"), "left")
    out = out.join(named(persons, "current_rm"), c("current_rm_id") == c("flow_rel_mgr_id"), "left")
    return out.drop("created_by", "reg_flow_rel_mgr_id", "flow_rel_mgr_id")


# -- filling and enriching metadata ------------------------------------------------------------


def latest_per_account(mapper: DataFrame) -> DataFrame:
    """The newest mapping of each account (ties: the largest run id)."""
    cols = [c for c in mapper.columns if c != "acc_number"]
    newest = mapper.groupBy("acc_number").agg(F.max_by(F.struct(*cols), F.struct("created_date", "run_id")).alias("m"))
    return newest.select("acc_number", "m.*")


MAPPED = ("rm_name", "acc_prvdr_code", "acc_number", "created_date")


def enrich(meta: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Mapping values override parsed ones. A run takes them from the customer table if it is there, else from
    the mapper file; of several rows of a run the earliest counts. What the source leaves open stays as parsed."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        # The date first: the least struct is the earliest row.
        names = [c for c in reversed(MAPPED) if c in df.columns]
        return df.groupBy("run_id").agg(F.min(F.struct(*names)).alias(tag))

    out = meta.join(side(primary, "_p"), "run_id", "left").join(side(fallback, "_f"), "run_id", "left")

    def pick(name: str, own: str) -> Column:
        p, f = (F.col(f"{tag}.{name}") if name in df.columns else F.lit(None) for tag, df in (("_p", primary), ("_f", fallback)))
        return F.coalesce(F.when(F.col("_p").isNotNull(), p).otherwise(f), F.col(own))

    return out.withColumns(
        {
            "rm_name": pick("rm_name", "rm_name"),
            "acc_prvdr_code": pick("acc_prvdr_code", "acc_prvdr_code"),
            "acc_number": pick("acc_number", "acc_number"),
            "submitted_date": pick("created_date", "submitted_date"),
        }
    ).drop("_p", "_f")


def fill_missing(meta: DataFrame, spans: DataFrame, mapper: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Fill NULLs only. `columns` maps a metadata column to 'raw' or 'mapper'."""
    raw = [c for c, src in columns.items() if src == "raw"]
    mapped = [c for c, src in columns.items() if src == "mapper"]
    out = meta.join(spans.select("run_id", *[F.col(c).alias(f"_raw_{c}") for c in raw]), "run_id", "left")
    out = out.join(mapper.select("run_id", *[F.col(c).alias(f"_mapper_{c}") for c in mapped]), "run_id", "left")
    for name, src in columns.items():
        out = out.withColumn(name, F.coalesce(name, f"_{src}_{name}"))
    return out.drop(*[f"_{src}_{c}" for c, src in columns.items()])


# -- loans ---------------------------------------------------------------------------------------


def loans_of(flagged: DataFrame, loans: DataFrame, users: DataFrame, persons: DataFrame, products: DataFrame, as_of: str) -> DataFrame:
    """Loans of customers with flagged statements, with applier and the latest flagged RM.

    `flagged` has cust_id, rm_name, submitted_date and run_id.
    """
    who = flagged.filter("cust_id is not null")
    rms = who.groupBy("cust_id").agg(
        F.max_by("rm_name", F.struct("submitted_date", "run_id")).alias("statement_rm_name")
    )
    vending = products.filter(F.col("product_type") == EXCLUDED_PRODUCT_TYPE).select(F.col("id").alias("product_id"))
    c = F.col
    # NOT IN drops rows whose own value is NULL.
    kept = (
        loans.filter(c("product_id").isNotNull() & c("status").isNotNull() & ~c("status").isin(*EXCLUDED_LOAN_STATUSES))
        .join(vending, "product_id", "left_anti")
        .join(rms.select("cust_id"), "cust_id", "left_semi")
    )
    u = users.select(c("id").alias("loan_applied_by"), "person_id", c("role_codes").alias("loan_applier_role"))
    p = persons.select(c("id").alias("person_id"), full_name().alias("loan_applier_name"))
    out = kept.join(u, "loan_applied_by", "left").join(p, "person_id", "left").join(rms, "cust_id", "left")
    end = F.coalesce("paid_date", F.lit(as_of).cast("date"))
    # CONCAT_WS over an unmatched person is an empty text, not NULL.
    out = out.withColumn("loan_applier_name", F.coalesce("loan_applier_name", F.lit("")))
    return out.withColumn("overdue_days_calc", F.datediff(end, "due_date"))


# -- set membership ---------------------------------------------------------------------------------


def unprocessed(meta: DataFrame, summary: DataFrame, provider: str | None = None, force: bool = False) -> DataFrame:
    rows = meta if provider is None else meta.filter(F.col("acc_prvdr_code") == provider)
    rows = rows.select("run_id")
    return rows if force else rows.join(summary.select("run_id"), "run_id", "left_anti")


def known_runs(*tables: DataFrame) -> DataFrame:
    """Run ids of any of the tables; each side is reduced before the union."""
    parts = [t.select("run_id").distinct() for t in tables]
    return reduce(DataFrame.unionByName, parts).distinct()


def not_imported(candidates: DataFrame, *tables: DataFrame) -> DataFrame:
    return candidates.join(known_runs(*tables), "run_id", "left_anti")


def without_details(meta: DataFrame, customers: DataFrame) -> DataFrame:
    return meta.select("run_id", "acc_number", "acc_prvdr_code").join(customers.select("run_id"), "run_id", "left_anti")


# -- run comparisons -----------------------------------------------------------------------------------


def compare_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Each new summary against the old one; worse in any respect counts as degraded."""
    c = F.col
    before = old.select(
        "run_id", c("balance_match").alias("old_match"), c("balance_diff_changes").alias("old_changes"), F.lit(True).alias("_old")
    )
    both = new.join(before, "run_id", "left")
    step = c("balance_diff_changes") - c("old_changes")
    lost = (c("old_match") == "Success") & (c("balance_match") == "Failed")
    won = (c("old_match") == "Failed") & (c("balance_match") == "Success")
    worse = F.array_compact(
        F.array(
            F.when(lost, "balance_match degraded from Success to Failed"),
            F.when(step > 0, F.concat(F.lit("balance_diff_changes increased by "), step.cast("string"))),
        )
    )
    better = F.array_compact(
        F.array(
            F.when(won, "balance_match improved from Failed to Success"),
            F.when(step < 0, F.concat(F.lit("balance_diff_changes decreased by "), (-step).cast("string"))),
        )
    )
    both = both.withColumns({"_worse": worse, "_better": better})
    outcome = (
        F.when(c("_old").isNull(), "NEW")
        .when(F.size("_worse") > 0, "DEGRADED")
        .when(F.size("_better") > 0, "IMPROVED")
        .otherwise("UNCHANGED")
    )
    reasons = F.when(c("outcome") == "DEGRADED", c("_worse")).when(c("outcome") == "IMPROVED", c("_better")).otherwise(F.array())
    return both.withColumn("outcome", outcome).withColumn("reasons", reasons).drop("_worse", "_better", "_old")


def import_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Runs whose row counts differ between two imports, or that only one of them has."""

    def sized(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))

    both = sized(left, "left_rows").join(sized(right, "right_rows"), "run_id", "full_outer")
    return both.filter(~F.col("left_rows").eqNullSafe(F.col("right_rows"))).select(
        "run_id", F.coalesce("left_rows", F.lit(0)).alias("left_rows"), F.coalesce("right_rows", F.lit(0)).alias("right_rows")
    )
