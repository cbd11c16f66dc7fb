"""Statements, customers, loans and page texts derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerproof.operators.sequence import ARRIVAL, Ordered, Sizing, scan

# A statement covers the orders of five customers; three statements in a row belong to one borrower.
BORROWER = "(num - num % 3) * 5"


def _numbered(letter: str, num: str) -> str:
    """`format_string('U%04d', num)`, which is slow; numbers of four digits and more need no filling."""
    return f"CASE WHEN {num} >= 1000 THEN concat('{letter}', CAST({num} AS STRING)) ELSE format_string('{letter}%04d', {num}) END"


def longest_run(orders: DataFrame, events: DataFrame) -> int:
    """Upper bound on the rows of the longest statement: an order is printed twice at most."""
    u = orders.groupBy(F.expr("o_custkey DIV 5").alias("num")).agg((2 * F.count(F.lit(1))).alias("n"))
    m = events.groupBy(F.col("user_id").alias("num")).agg(F.count(F.lit(1)).alias("n"))
    return u.select("n").unionByName(m.select("n")).agg(F.max("n")).first()[0] or 0


def _balances(start: int, rows: DataFrame, sizing: Sizing) -> DataFrame:
    def step(ordered: Ordered) -> DataFrame:
        summed = ordered.running_sum(F.col("delta"), "_moved").df
        return summed.withColumn("balance", (F.col("_moved") + start).cast("decimal(18,2)")).drop("_moved")

    return scan(rows, ["run_id"], ARRIVAL, step, sizing)


def uatl_txn(orders: DataFrame, sizing: Sizing = Sizing()) -> DataFrame:
    """Statements of the first provider: direction style, signed style and format 2."""
    o = orders.selectExpr(
        "CAST(o_custkey DIV 5 AS INT) AS num",
        f"{_numbered('U', 'o_custkey DIV 5')} AS run_id",
        "o_orderkey AS seq",
        "o_orderstatus",
        """CASE WHEN o_custkey DIV 5 % 20 = 0 THEN date_trunc('year', o_orderdate) WHEN o_custkey DIV 5 % 20 = 10 THEN date_trunc('quarter', o_orderdate)
           WHEN o_custkey DIV 5 % 2 = 1 THEN date_trunc('month', o_orderdate) ELSE date_trunc('day', o_orderdate) END AS txn_date""",
        "CAST(o_totalprice AS DECIMAL(18,2)) AS amt",
        "CAST((o_orderkey % 4) * 100 AS DECIMAL(18,2)) AS fee",
        """CASE o_orderkey % 40 WHEN 0 THEN 'Commission Disbursement - wallet' WHEN 1 THEN 'Deallocation Transfer'
           WHEN 2 THEN 'Transaction Reversal' WHEN 3 THEN 'RollBack of transfer' WHEN 4 THEN 'Merchant Payment Other Single Step'
           WHEN 5 THEN 'Received From IND02 agent' WHEN 6 THEN 'merchant payment other single step x'
           ELSE concat('Send Money ', o_orderpriority) END AS description""",
    )
    s = o.selectExpr(
        "*",
        "num % 3 AS style",
        "CASE WHEN o_orderstatus = 'O' THEN -amt ELSE amt END AS signed",
        """CASE WHEN num % 2 = 1 THEN 0 WHEN upper(description) LIKE '%MERCHANT PAYMENT OTHER SINGLE STEP%' THEN -0.04 * amt
           WHEN upper(description) LIKE '%IND02%' THEN 0.005 * amt ELSE 0 END AS x""",
    )
    d = s.selectExpr(
        "*",
        """CAST(round(CASE WHEN seq % 40 = 0 THEN -signed WHEN seq % 40 IN (1, 3) THEN 0
           ELSE signed - x - CASE WHEN style = 2 THEN 0 ELSE fee END END
           + CASE WHEN seq % 101 = 0 AND num % 4 = 1 THEN 777 ELSE 0 END, 2) AS DECIMAL(18,2)) AS delta""",
    )
    b = _balances(1_000_000, d, sizing)
    # Every fiftieth row is printed twice: one narrow pass instead of a second scan.
    arrivals = F.when(F.col("seq") % 50 == 7, F.array(F.col("seq"), F.col("seq") + 1_000_000_000)).otherwise(F.array(F.col("seq")))
    u = b.withColumn("arrival", F.explode(arrivals))
    return u.selectExpr(
        "run_id",
        "num",
        "'UATL' AS acc_prvdr_code",
        "CASE WHEN style = 2 THEN 'format_2' ELSE 'format_1' END AS format",
        "arrival AS seq",
        "concat('T', CAST(seq AS STRING)) AS txn_id",
        "CAST(txn_date AS TIMESTAMP) AS txn_date",
        "CAST(NULL AS STRING) AS txn_type",
        "description",
        "CASE WHEN seq % 211 = 0 THEN 'FAILED' ELSE 'Transaction Successful' END AS status",
        "CASE WHEN signed < 0 THEN 'Debit' ELSE 'Credit' END AS txn_direction",
        "CASE WHEN style = 0 THEN amt ELSE signed END AS amount",
        "fee",
        "balance",
    )


def umtn_txn(events: DataFrame, sizing: Sizing = Sizing()) -> DataFrame:
    """Statements of the second provider, with its float balance as `balance`."""
    e = events.selectExpr(
        "CAST(user_id AS INT) AS num",
        f"{_numbered('M', 'user_id')} AS run_id",
        "event_id AS seq",
        "date_trunc('hour', ts) AS txn_date",
        "CAST(value AS DECIMAL(18,2)) AS amount",
        "CAST(event_id % 3 AS DECIMAL(18,2)) AS fee",
        """CASE event_type WHEN 'purchase' THEN 'CASH_OUT' WHEN 'click' THEN 'CASH_IN' WHEN 'signup' THEN 'DEPOSIT'
           WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'TRANSFER' ELSE 'BILL PAYMENT' END
           ELSE CASE event_id % 4 WHEN 0 THEN 'LOAN_REPAYMENT' WHEN 1 THEN 'ADJUSTMENT' WHEN 2 THEN 'REVERSAL' ELSE 'REFUND' END END AS txn_type""",
    )
    a = e.selectExpr("*", "CASE WHEN txn_type = 'TRANSFER' AND seq % 3 = 0 THEN -amount ELSE amount END AS printed")
    d = a.selectExpr(
        "*",
        """CAST(CASE WHEN txn_type IN ('CASH_IN', 'BILL PAYMENT', 'LOAN_REPAYMENT') OR (txn_type = 'ADJUSTMENT' AND seq % 8 = 1)
           THEN -printed ELSE printed END - fee + CASE WHEN seq % 97 = 0 AND num % 3 = 1 THEN 25 ELSE 0 END AS DECIMAL(18,2)) AS delta""",
    )
    return _balances(10_000, d, sizing).selectExpr(
        "run_id",
        "num",
        "'UMTN' AS acc_prvdr_code",
        "'excel' AS format",
        "seq",
        "concat('MP', CAST(5000000 + seq * 2 AS STRING)) AS txn_id",
        "CAST(txn_date AS TIMESTAMP) AS txn_date",
        "txn_type",
        "concat(txn_type, ' - 256', CAST(700000000 + num AS STRING), ' to agent@mm') AS description",
        "'success' AS status",
        "CASE WHEN printed > 0 THEN 'Credit' ELSE 'Debit' END AS txn_direction",
        "printed AS amount",
        "fee",
        "balance",
    )


def statement_meta(txn: DataFrame, nation: DataFrame) -> DataFrame:
    r = txn.groupBy("run_id", "num", "acc_prvdr_code", "format").agg(F.count(F.lit(1)).alias("num_rows"))
    return r.join(nation, F.col("n_nationkey") == F.col("num") % 25).selectExpr(
        "run_id",
        "num",
        "acc_prvdr_code",
        "CAST(700000000 + num % 40 AS STRING) AS acc_number",
        "format",
        "num_rows",
        "n_name AS rm_name",
        "CASE WHEN num % 23 = 5 THEN 'FAILED' ELSE 'SUCCESS' END AS parsing_status",
        "CASE WHEN num % 9 = 0 THEN num % 12 ELSE 0 END AS quality_issues_count",
        "CASE WHEN num % 13 = 2 THEN num % 11 + 1 ELSE 0 END AS header_row_manipulation_count",
        """CASE num % 7 WHEN 0 THEN 'PDF Template' WHEN 1 THEN 'PDF Template' WHEN 2 THEN 'Airtel Money CSV Statement'
           WHEN 3 THEN 'PDF Template' ELSE CAST(NULL AS STRING) END AS meta_title""",
        "CASE num % 7 WHEN 2 THEN 'Airtel' WHEN 3 THEN 'USER' ELSE CAST(NULL AS STRING) END AS meta_author",
        """CASE num % 7 WHEN 0 THEN 'Qt 4.8.7' WHEN 1 THEN 'Qt 4.8.7' WHEN 2 THEN 'CSV Export' WHEN 3 THEN 'Microsoft Word'
           WHEN 4 THEN 'Samsung Electronics' WHEN 5 THEN 'PDFium' ELSE CAST(NULL AS STRING) END AS meta_producer""",
        "CASE WHEN num % 7 IN (0, 1, 3) THEN TIMESTAMP '2025-06-01 10:00:00' END AS meta_created_at",
        "CASE WHEN num % 7 IN (1, 3) THEN TIMESTAMP '2025-06-02 11:30:00' END AS meta_modified_at",
        "concat('/data/', run_id, CASE num % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.csv' WHEN 2 THEN '.xlsx' ELSE '.csv.gz' END) AS pdf_path",
        "DATE '2025-03-01' + CAST(num % 3650 AS INT) AS submitted_date",
    )


def customer_details(meta: DataFrame, customer: DataFrame, supplier: DataFrame) -> DataFrame:
    def rm(name: str) -> DataFrame:
        return supplier.select(F.col("s_suppkey").alias(f"{name}_id"), F.col("s_name").alias(name))

    c = customer.withColumnRenamed("c_custkey", "_cust")
    return (
        meta.join(c, F.col("_cust") == F.expr(BORROWER))
        .join(rm("reg_rm_name"), F.col("reg_rm_name_id") == F.col("num") % 9, "left")
        .join(rm("current_rm_name"), F.col("current_rm_name_id") == F.col("num") % 14, "left")
        .selectExpr(
            "run_id",
            "rm_name",
            f"CASE WHEN num % 31 = 0 THEN NULL ELSE CAST({BORROWER} AS STRING) END AS cust_id",
            "c_name AS borrower_biz_name",
            "CASE WHEN num % 2 = 0 THEN 'lead' ELSE 'reassessment_result' END AS final_entity_type",
            "reg_rm_name",
            "current_rm_name",
            "CAST(c_acctbal AS DECIMAL(18,2)) AS crnt_fa_limit",
            "CASE WHEN c_mktsegment = 'BUILDING' THEN 'high' ELSE 'low' END AS risk_category",
        )
    )


def loans(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "CAST(o_custkey AS STRING) AS cust_id",
        "concat('L', CAST(o_orderkey AS STRING)) AS loan_doc_id",
        "CAST(o_orderkey % 6 AS INT) AS product_id",
        """CAST(CASE o_orderkey % 12 WHEN 0 THEN 250000 WHEN 1 THEN 500000 WHEN 2 THEN 750000 WHEN 3 THEN 1000000 WHEN 4 THEN 1500000
           WHEN 5 THEN 2000000 WHEN 6 THEN 2500000 WHEN 7 THEN 3000000 WHEN 8 THEN 4000000 WHEN 9 THEN 5000000 ELSE 123456 END
           AS DECIMAL(18,2)) AS loan_principal""",
        "CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 0.01, 2) AS DECIMAL(18,2)) AS flow_fee",
        "CAST(o_orderdate AS DATE) AS disbursal_date",
        "CAST(o_orderdate AS DATE) + 30 AS due_date",
        "CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + CAST(28 + o_orderkey % 15 AS INT) END AS paid_date",
        """CASE WHEN o_orderkey % 77 = 0 THEN 'voided' WHEN o_orderstatus = 'F' THEN 'settled' WHEN o_orderstatus = 'P' THEN 'overdue'
           WHEN o_orderkey % 2 = 0 THEN 'due' ELSE 'ongoing' END AS status""",
        "CASE WHEN o_orderstatus = 'F' THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS os_amount",
        "CAST(o_orderkey % 97 AS INT) AS loan_applied_by",
    )


def page_text(documents: DataFrame) -> DataFrame:
    return documents.selectExpr(
        "format_string('U%04d', doc_id DIV 10) AS run_id",
        "CAST(doc_id % 10 AS INT) + 1 AS page_no",
        """CASE WHEN doc_id % 17 = 0 THEN text
           WHEN doc_id % 19 = 0 THEN concat(text, chr(10), 'Transaction ID Transaction Type Description')
           WHEN doc_id % 23 = 0 THEN concat('Transation ID Description', chr(10), text, chr(10), 'Transaction ID From Account')
           ELSE concat(CAST(doc_id % 30 + 1 AS STRING), chr(10), 'Date/Time Transaction ID Description', chr(10), text) END AS text""",
    )


# -- lineage sources ----------------------------------------------------------------------


def stmt_requests(meta: DataFrame) -> DataFrame:
    """Request ids number the statements in run order; `num` is unique within a provider,
    so the id needs no global sort."""
    return meta.selectExpr(
        "CAST(CASE acc_prvdr_code WHEN 'UMTN' THEN num ELSE num + 1000000000 END AS BIGINT) AS id",
        "run_id AS flow_req_id",
        "acc_number",
        "acc_prvdr_code",
        "CASE num % 3 WHEN 0 THEN 'customer_statement' WHEN 1 THEN 'lead' ELSE 'reassessment_result' END AS entity",
        "CAST(num AS BIGINT) AS entity_id",
        "CAST(num % 40 AS BIGINT) AS created_by",
        "'score_calc_success' AS lambda_status",
        "CAST(submitted_date AS TIMESTAMP) AS created_at",
    )


def customer_statements(meta: DataFrame) -> DataFrame:
    return meta.filter("num % 3 = 0").selectExpr(
        "CAST(num AS BIGINT) AS id",
        "CASE WHEN num % 2 = 0 THEN 'lead' ELSE 'reassessment_result' END AS entity",
        "CAST(num AS STRING) AS entity_id",
        "'approved' AS status",
    ).distinct()


def leads(meta: DataFrame) -> DataFrame:
    return meta.selectExpr(
        "CAST(num AS BIGINT) AS id",
        f"CASE WHEN num % 31 = 0 THEN NULL ELSE CAST({BORROWER} AS STRING) END AS cust_id",
        "concat('Lead ', CAST(num AS STRING)) AS biz_name",
    ).distinct()


def reassessments(meta: DataFrame) -> DataFrame:
    return meta.selectExpr(
        "CAST(num AS BIGINT) AS id", f"CAST({BORROWER} AS STRING) AS cust_id", "CAST(num * 1000 AS DECIMAL(18,2)) AS prev_limit"
    ).distinct()


def borrowers(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(
        "c_custkey AS id", "CAST(c_custkey AS STRING) AS cust_id", "c_name AS biz_name",
        "CAST(c_custkey % 9 AS BIGINT) AS reg_flow_rel_mgr_id", "CAST(c_custkey % 14 AS BIGINT) AS flow_rel_mgr_id",
        "CAST(c_acctbal AS DECIMAL(18,2)) AS crnt_fa_limit",
    )


def persons(supplier: DataFrame) -> DataFrame:
    return supplier.selectExpr(
        "s_suppkey AS id", "'Supplier' AS first_name", "CAST(NULL AS STRING) AS middle_name", "substr(s_name, 10) AS last_name"
    )


def app_users(loan: DataFrame) -> DataFrame:
    return loan.selectExpr(
        "loan_applied_by AS id", "CAST(loan_applied_by % 40 AS BIGINT) AS person_id",
        "CASE WHEN loan_applied_by % 4 = 0 THEN 'rm' ELSE 'cs' END AS role_codes",
    ).distinct()


def loan_products(loan: DataFrame) -> DataFrame:
    return loan.selectExpr("product_id AS id", "CASE WHEN product_id = 5 THEN 'float_vending' ELSE 'regular' END AS product_type").distinct()
