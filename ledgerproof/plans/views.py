"""SQL views the DuckDB checks start from (the same derivations as `sources.fixtures`)."""

VIEWS: dict[str, str] = {
    "uatl_txn": """
WITH o AS (
  SELECT CAST(o_custkey // 5 AS INT) AS num, o_orderkey AS seq, o_orderstatus, o_orderpriority,
         CASE WHEN o_custkey // 5 % 20 = 0 THEN date_trunc('year', o_orderdate) WHEN o_custkey // 5 % 20 = 10 THEN date_trunc('quarter', o_orderdate)
              WHEN o_custkey // 5 % 2 = 1 THEN date_trunc('month', o_orderdate) ELSE date_trunc('day', o_orderdate) END AS txn_date,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amt, CAST((o_orderkey % 4) * 100 AS DECIMAL(18,2)) AS fee,
         CASE o_orderkey % 40 WHEN 0 THEN 'Commission Disbursement - wallet' WHEN 1 THEN 'Deallocation Transfer' WHEN 2 THEN 'Transaction Reversal'
              WHEN 3 THEN 'RollBack of transfer' WHEN 4 THEN 'Merchant Payment Other Single Step' WHEN 5 THEN 'Received From IND02 agent'
              WHEN 6 THEN 'merchant payment other single step x' ELSE concat('Send Money ', o_orderpriority) END AS description
  FROM orders),
s AS (
  SELECT o.*, num % 3 AS style, CASE WHEN o_orderstatus = 'O' THEN -amt ELSE amt END AS signed,
         CASE WHEN num % 2 = 1 THEN 0 WHEN upper(description) LIKE '%MERCHANT PAYMENT OTHER SINGLE STEP%' THEN -0.04 * amt
              WHEN upper(description) LIKE '%IND02%' THEN 0.005 * amt ELSE 0 END AS x FROM o),
d AS (
  SELECT s.*, CAST(round(CASE WHEN seq % 40 = 0 THEN -signed WHEN seq % 40 IN (1, 3) THEN 0
         ELSE signed - x - CASE WHEN style = 2 THEN 0 ELSE fee END END + CASE WHEN seq % 101 = 0 AND num % 4 = 1 THEN 777 ELSE 0 END, 2) AS DECIMAL(18,2)) AS delta FROM s),
b AS (
  SELECT d.*, CAST(1000000 + sum(delta) OVER (PARTITION BY num ORDER BY txn_date, seq ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS balance FROM d),
u AS (
  SELECT b.*, seq AS arrival FROM b UNION ALL SELECT b.*, seq + 1000000000 AS arrival FROM b WHERE seq % 50 = 7)
SELECT printf('U%04d', num) AS run_id, num, 'UATL' AS acc_prvdr_code,
       CASE WHEN style = 2 THEN 'format_2' ELSE 'format_1' END AS format, arrival AS seq, concat('T', CAST(seq AS VARCHAR(20))) AS txn_id,
       CAST(txn_date AS TIMESTAMP) AS txn_date, CAST(NULL AS VARCHAR(10)) AS txn_type, description,
       CASE WHEN seq % 211 = 0 THEN 'FAILED' ELSE 'Transaction Successful' END AS status,
       CASE WHEN signed < 0 THEN 'Debit' ELSE 'Credit' END AS txn_direction,
       CASE WHEN style = 0 THEN amt ELSE signed END AS amount, fee, balance
FROM u
""",
    "umtn_txn": """
WITH e AS (
  SELECT CAST(user_id AS INT) AS num, event_id AS seq, date_trunc('hour', ts) AS txn_date, CAST(value AS DECIMAL(18,2)) AS amount,
         CAST(event_id % 3 AS DECIMAL(18,2)) AS fee,
         CASE event_type WHEN 'purchase' THEN 'CASH_OUT' WHEN 'click' THEN 'CASH_IN' WHEN 'signup' THEN 'DEPOSIT'
              WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'TRANSFER' ELSE 'BILL PAYMENT' END
              ELSE CASE event_id % 4 WHEN 0 THEN 'LOAN_REPAYMENT' WHEN 1 THEN 'ADJUSTMENT' WHEN 2 THEN 'REVERSAL' ELSE 'REFUND' END END AS txn_type
  FROM events),
a AS (SELECT e.*, CASE WHEN txn_type = 'TRANSFER' AND seq % 3 = 0 THEN -amount ELSE amount END AS printed FROM e),
d AS (
  SELECT a.*, CAST(CASE WHEN txn_type IN ('CASH_IN', 'BILL PAYMENT', 'LOAN_REPAYMENT') OR (txn_type = 'ADJUSTMENT' AND seq % 8 = 1) THEN -printed ELSE printed END
         - fee + CASE WHEN seq % 97 = 0 AND num % 3 = 1 THEN 25 ELSE 0 END AS DECIMAL(18,2)) AS delta FROM a)
SELECT printf('M%04d', num) AS run_id, num, 'UMTN' AS acc_prvdr_code, 'excel' AS format, seq,
       concat('MP', CAST(5000000 + seq * 2 AS VARCHAR(20))) AS txn_id, CAST(txn_date AS TIMESTAMP) AS txn_date, txn_type,
       concat(txn_type, ' - 256', CAST(700000000 + num AS VARCHAR(12)), ' to agent@mm') AS description, 'success' AS status,
       CASE WHEN printed > 0 THEN 'Credit' ELSE 'Debit' END AS txn_direction, printed AS amount, fee,
       CAST(10000 + sum(delta) OVER (PARTITION BY num ORDER BY txn_date, seq ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS float_balance
FROM d
""",
    "statement_meta": """
WITH r AS (SELECT run_id, num, acc_prvdr_code, format, count(*) AS num_rows FROM uatl_txn GROUP BY run_id, num, acc_prvdr_code, format
           UNION ALL SELECT run_id, num, acc_prvdr_code, format, count(*) FROM umtn_txn GROUP BY run_id, num, acc_prvdr_code, format)
SELECT run_id, num, acc_prvdr_code, CAST(700000000 + num % 40 AS VARCHAR(12)) AS acc_number, format, num_rows, n_name AS rm_name,
       CASE WHEN num % 23 = 5 THEN 'FAILED' ELSE 'SUCCESS' END AS parsing_status,
       CASE WHEN num % 9 = 0 THEN num % 12 ELSE 0 END AS quality_issues_count,
       CASE WHEN num % 13 = 2 THEN num % 11 + 1 ELSE 0 END AS header_row_manipulation_count,
       CASE num % 7 WHEN 0 THEN 'PDF Template' WHEN 1 THEN 'PDF Template' WHEN 2 THEN 'Airtel Money CSV Statement' WHEN 3 THEN 'PDF Template' ELSE CAST(NULL AS VARCHAR(10)) END AS meta_title,
       CASE num % 7 WHEN 2 THEN 'Airtel' WHEN 3 THEN 'USER' ELSE CAST(NULL AS VARCHAR(10)) END AS meta_author,
       CASE num % 7 WHEN 0 THEN 'Qt 4.8.7' WHEN 1 THEN 'Qt 4.8.7' WHEN 2 THEN 'CSV Export' WHEN 3 THEN 'Microsoft Word' WHEN 4 THEN 'Samsung Electronics' WHEN 5 THEN 'PDFium' ELSE CAST(NULL AS VARCHAR(10)) END AS meta_producer,
       CASE WHEN num % 7 IN (0, 1, 3) THEN TIMESTAMP '2025-06-01 10:00:00' END AS meta_created_at,
       CASE WHEN num % 7 IN (1, 3) THEN TIMESTAMP '2025-06-02 11:30:00' END AS meta_modified_at,
       concat('/data/', run_id, CASE num % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.csv' WHEN 2 THEN '.xlsx' ELSE '.csv.gz' END) AS pdf_path,
       DATE '2025-03-01' + CAST(num % 3650 AS INT) AS submitted_date
FROM r JOIN nation ON n_nationkey = num % 25
""",
    "customer_details": """
SELECT m.run_id, m.rm_name, CASE WHEN m.num % 31 = 0 THEN NULL ELSE CAST((m.num - m.num % 3) * 5 AS VARCHAR(10)) END AS cust_id, c.c_name AS borrower_biz_name,
       CASE WHEN m.num % 2 = 0 THEN 'lead' ELSE 'reassessment_result' END AS final_entity_type,
       r1.s_name AS reg_rm_name, r2.s_name AS current_rm_name, CAST(c.c_acctbal AS DECIMAL(18,2)) AS crnt_fa_limit,
       CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'high' ELSE 'low' END AS risk_category
FROM statement_meta m JOIN customer c ON c.c_custkey = (m.num - m.num % 3) * 5
LEFT JOIN supplier r1 ON r1.s_suppkey = m.num % 9 LEFT JOIN supplier r2 ON r2.s_suppkey = m.num % 14
""",
    "loans": """
SELECT CAST(o_custkey AS VARCHAR(10)) AS cust_id, concat('L', CAST(o_orderkey AS VARCHAR(20))) AS loan_doc_id, CAST(o_orderkey % 6 AS INT) AS product_id,
       CAST(CASE o_orderkey % 12 WHEN 0 THEN 250000 WHEN 1 THEN 500000 WHEN 2 THEN 750000 WHEN 3 THEN 1000000 WHEN 4 THEN 1500000 WHEN 5 THEN 2000000
            WHEN 6 THEN 2500000 WHEN 7 THEN 3000000 WHEN 8 THEN 4000000 WHEN 9 THEN 5000000 ELSE 123456 END AS DECIMAL(18,2)) AS loan_principal,
       CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 0.01, 2) AS DECIMAL(18,2)) AS flow_fee, CAST(o_orderdate AS DATE) AS disbursal_date,
       CAST(o_orderdate AS DATE) + 30 AS due_date,
       CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + CAST(28 + o_orderkey % 15 AS INT) END AS paid_date,
       CASE WHEN o_orderkey % 77 = 0 THEN 'voided' WHEN o_orderstatus = 'F' THEN 'settled' WHEN o_orderstatus = 'P' THEN 'overdue' WHEN o_orderkey % 2 = 0 THEN 'due' ELSE 'ongoing' END AS status,
       CASE WHEN o_orderstatus = 'F' THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS os_amount,
       CAST(o_orderkey % 97 AS INT) AS loan_applied_by
FROM orders
""",
    "page_text": """
SELECT printf('U%04d', doc_id // 10) AS run_id, CAST(doc_id % 10 AS INT) + 1 AS page_no,
       CASE WHEN doc_id % 17 = 0 THEN text
            WHEN doc_id % 19 = 0 THEN concat(text, chr(10), 'Transaction ID Transaction Type Description')
            WHEN doc_id % 23 = 0 THEN concat('Transation ID Description', chr(10), text, chr(10), 'Transaction ID From Account')
            ELSE concat(CAST(doc_id % 30 + 1 AS VARCHAR(5)), chr(10), 'Date/Time Transaction ID Description', chr(10), text) END AS text
FROM documents
""",
    "stmt_requests": """
SELECT CAST(CASE acc_prvdr_code WHEN 'UMTN' THEN num ELSE num + 1000000000 END AS BIGINT) AS id, run_id AS flow_req_id, acc_number, acc_prvdr_code,
       CASE num % 3 WHEN 0 THEN 'customer_statement' WHEN 1 THEN 'lead' ELSE 'reassessment_result' END AS entity, CAST(num AS BIGINT) AS entity_id,
       CAST(num % 40 AS BIGINT) AS created_by, 'score_calc_success' AS lambda_status, CAST(submitted_date AS TIMESTAMP) AS created_at
FROM statement_meta
""",
    "customer_statements": """
SELECT DISTINCT CAST(num AS BIGINT) AS id, CASE WHEN num % 2 = 0 THEN 'lead' ELSE 'reassessment_result' END AS entity, CAST(num AS VARCHAR(20)) AS entity_id, 'approved' AS status
FROM statement_meta WHERE num % 3 = 0
""",
    "leads": """
SELECT DISTINCT CAST(num AS BIGINT) AS id, CASE WHEN num % 31 = 0 THEN NULL ELSE CAST((num - num % 3) * 5 AS VARCHAR(10)) END AS cust_id, concat('Lead ', CAST(num AS VARCHAR(10))) AS biz_name FROM statement_meta
""",
    "reassessments": """
SELECT DISTINCT CAST(num AS BIGINT) AS id, CAST((num - num % 3) * 5 AS VARCHAR(10)) AS cust_id, CAST(num * 1000 AS DECIMAL(18,2)) AS prev_limit FROM statement_meta
""",
    "borrowers": """
SELECT c_custkey AS id, CAST(c_custkey AS VARCHAR(10)) AS cust_id, c_name AS biz_name, CAST(c_custkey % 9 AS BIGINT) AS reg_flow_rel_mgr_id, CAST(c_custkey % 14 AS BIGINT) AS flow_rel_mgr_id,
       CAST(c_acctbal AS DECIMAL(18,2)) AS crnt_fa_limit FROM customer
""",
    "persons": """
SELECT s_suppkey AS id, 'Supplier' AS first_name, CAST(NULL AS VARCHAR(10)) AS middle_name, substr(s_name, 10) AS last_name FROM supplier
""",
    "app_users": """
SELECT DISTINCT loan_applied_by AS id, CAST(loan_applied_by % 40 AS BIGINT) AS person_id, CASE WHEN loan_applied_by % 4 = 0 THEN 'rm' ELSE 'cs' END AS role_codes FROM loans
""",
    "loan_products": """
SELECT DISTINCT product_id AS id, CASE WHEN product_id = 5 THEN 'float_vending' ELSE 'regular' END AS product_type FROM loans
""",
}
