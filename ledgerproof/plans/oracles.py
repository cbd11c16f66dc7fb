"""DuckDB SQL for the checks: named building blocks and how they are put together."""

from __future__ import annotations

import re

from ledgerproof.plans.views import VIEWS

BLOCKS: dict[str, str] = dict(VIEWS)

BLOCKS["txn"] = """
SELECT run_id, num, acc_prvdr_code, format, seq, txn_id, txn_date, txn_type, description, status, txn_direction, amount, fee, balance FROM uatl_txn
UNION ALL
SELECT run_id, num, acc_prvdr_code, format, seq, txn_id, txn_date, txn_type, description, status, txn_direction, amount, fee, float_balance FROM umtn_txn
"""

BLOCKS["earlier"] = """
SELECT t.*, arg_max(balance, epoch_us(txn_date)::HUGEINT * 10000000000 + seq) OVER (
         PARTITION BY run_id ORDER BY epoch_us(txn_date) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
FROM txn t
"""

BLOCKS["normal"] = """
SELECT * EXCLUDE (before) REPLACE (CASE
    WHEN acc_prvdr_code = 'UMTN' AND txn_type = 'LOAN_REPAYMENT' AND amount > 0 THEN -amount
    WHEN acc_prvdr_code = 'UMTN' AND txn_type = 'ADJUSTMENT' AND balance < before AND amount > 0 THEN -amount
    WHEN acc_prvdr_code = 'UMTN' AND txn_type = 'ADJUSTMENT' AND balance > before AND amount < 0 THEN -amount
    ELSE amount END AS amount) FROM earlier
"""

BLOCKS["flagged"] = """
SELECT n.*, row_number() OVER (PARTITION BY run_id, txn_id, txn_date, amount, description ORDER BY seq) > 1 AS is_duplicate,
       CASE WHEN lower(description) LIKE '%rollback%' THEN 'Rollback' WHEN lower(description) LIKE '%transaction reversal%' THEN 'Transaction Reversal'
            WHEN lower(description) LIKE '%deallocation%' THEN 'Deallocation Transfer'
            WHEN lower(description) LIKE 'commission disbursement%' THEN 'Commission Disbursement' END AS special_txn_type
FROM normal n
"""

_VOTE = """
SELECT run_id, seq, upper(description) LIKE '%MERCHANT PAYMENT OTHER SINGLE STEP%' AS cash,
       upper(description) LIKE '%IND02%' AND upper(description) NOT LIKE '%IND01%' AS ind,
       abs(balance - (p + amount + 0.04 * abs(amount))) AS c_with, abs(balance - (p + amount)) AS plain, abs(balance - (p + amount - 0.005 * abs(amount))) AS i_with, p
FROM (SELECT *, lag(balance) OVER (PARTITION BY run_id ORDER BY txn_date, seq) AS p FROM {src})
"""
BLOCKS["votes"] = f"""
SELECT run_id, count(*) FILTER (WHERE cash AND c_with < plain - 0.01) AS cashback_for, count(*) FILTER (WHERE cash AND plain < c_with - 0.01) AS cashback_against,
       count(*) FILTER (WHERE ind AND i_with < plain - 0.01) AS ind02_for, count(*) FILTER (WHERE ind AND plain < i_with - 0.01) AS ind02_against
FROM ({_VOTE.format(src="normal")}) GROUP BY run_id
"""

BLOCKS["facts"] = """
SELECT f.*, acc_prvdr_code <> 'UATL' OR cashback_for > cashback_against AS cb, acc_prvdr_code <> 'UATL' OR ind02_for > ind02_against AS ind,
       format = 'format_1' AND bool_or(amount < 0) OVER (PARTITION BY run_id) AS signed
FROM flagged f JOIN votes v USING (run_id)
"""

BLOCKS["moved"] = """
SELECT *, CASE WHEN acc_prvdr_code = 'UMTN' THEN CASE WHEN txn_type IN ('CASH_IN', 'BILL PAYMENT', 'DEBIT') THEN -amount ELSE amount END
               WHEN format = 'format_1' AND NOT signed THEN CASE WHEN lower(txn_direction) IN ('credit', 'cr') THEN amount ELSE -amount END ELSE amount END AS s,
       CASE WHEN format = 'format_2' THEN 0 ELSE fee END AS f,
       CASE WHEN acc_prvdr_code <> 'UMTN' AND upper(description) LIKE '%IND02%' AND upper(description) NOT LIKE '%IND01%' THEN 0.005 * abs(amount) ELSE 0 END AS x_ind,
       CASE WHEN acc_prvdr_code <> 'UMTN' AND upper(description) LIKE '%MERCHANT PAYMENT OTHER SINGLE STEP%' THEN 0.04 * abs(amount) ELSE 0 END AS x_cash,
       CAST(CASE WHEN ind THEN x_ind ELSE 0 END - CASE WHEN cb THEN x_cash ELSE 0 END AS DECIMAL(22,5)) AS x,
       CAST(s - f - x_ind + x_cash AS DECIMAL(22,5)) AS tie_delta
FROM facts WHERE format = 'format_2' OR txn_date IS NOT NULL
"""

BLOCKS["based"] = """
SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY txn_date NULLS LAST, balance DESC NULLS LAST, seq) AS brn,
       dense_rank() OVER (PARTITION BY run_id ORDER BY txn_date NULLS LAST) AS g FROM moved
"""

BLOCKS["tied"] = """
SELECT run_id, g, count(*) AS n, list(balance ORDER BY brn) AS bals, list(tie_delta ORDER BY brn) AS ds, min(brn) AS b0,
       any_value(format) <> 'format_2' AND count(*) BETWEEN 2 AND 6 AND g > 1 AS open FROM based GROUP BY run_id, g
"""

BLOCKS["perms"] = """
WITH RECURSIVE p(n, arr) AS (
  SELECT n, CAST([] AS BIGINT[]) FROM range(2, 7) r(n)
  UNION ALL SELECT p.n, list_append(arr, i) FROM p, range(0, 6) q(i) WHERE len(arr) < p.n AND i < p.n AND NOT list_contains(arr, i))
SELECT n, arr, row_number() OVER (PARTITION BY n ORDER BY arr) AS pidx FROM p WHERE len(arr) = n
"""

BLOCKS["scored"] = """
SELECT t.run_id, t.g, p.arr, p.pidx, t.bals[arr[1] + 1] AS b1, t.ds[arr[1] + 1] AS d1, t.bals[arr[t.n] + 1] AS last_bal,
       list_sum(list_transform(range(1, t.n), lambda k: CASE WHEN abs(t.bals[arr[k] + 1] + t.ds[arr[k + 1] + 1] - t.bals[arr[k + 1] + 1]) < 0.01 THEN 1 ELSE 0 END)) AS inner_score
FROM tied t JOIN perms p ON p.n = t.n WHERE t.open
"""

# Recursive: one step per group along a chain of open groups.
BLOCKS["walk"] = """
  SELECT s.run_id, s.g, arg_max(s.arr, k) AS arr, arg_max(s.last_bal, k) AS last_bal
  FROM (SELECT c.*, (inner_score + CASE WHEN abs(h.bals[h.n] + d1 - b1) < 0.01 THEN 1 ELSE 0 END) * 1000 - pidx AS k
        FROM scored c JOIN tied h ON h.run_id = c.run_id AND h.g = c.g - 1 AND NOT h.open) s GROUP BY s.run_id, s.g
  UNION ALL
  SELECT s.run_id, s.g, arg_max(s.arr, k), arg_max(s.last_bal, k)
  FROM (SELECT c.*, (inner_score + CASE WHEN abs(w.last_bal + d1 - b1) < 0.01 THEN 1 ELSE 0 END) * 1000 - pidx AS k
        FROM walk w JOIN scored c ON c.run_id = w.run_id AND c.g = w.g + 1) s GROUP BY s.run_id, s.g
"""

BLOCKS["placed"] = """
SELECT b.*, CASE WHEN t.open THEN list_position(w.arr, b.brn - t.b0) ELSE 0 END AS tie
FROM based b JOIN tied t USING (run_id, g) LEFT JOIN walk w USING (run_id, g)
"""


def replay_steps(source: str, prefix: str = "", key: str = "run_id") -> dict[str, str]:
    """Running balance over `source` (which has s, f, x, tie); names get `prefix`."""
    return {
        f"{prefix}r1": f"""
SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY txn_date NULLS LAST, tie, balance DESC NULLS LAST, seq) AS pos,
       is_duplicate OR coalesce(special_txn_type IN ('Commission Disbursement', 'Deallocation Transfer', 'Rollback'), false) AS carried,
       CAST(CASE WHEN is_duplicate THEN 0 WHEN special_txn_type = 'Commission Disbursement' THEN -amount
            WHEN special_txn_type IN ('Deallocation Transfer', 'Rollback') THEN 0 ELSE s - f - x END AS DECIMAL(22,5)) AS delta,
       CAST(CASE WHEN acc_prvdr_code = 'UMTN' THEN balance - s + f WHEN format = 'format_2' THEN balance - s - x
            WHEN signed OR lower(txn_direction) IN ('credit', 'cr') THEN balance - s - f + x ELSE balance - s + f + x END AS DECIMAL(22,5)) AS opening
FROM {source}
""",
        f"{prefix}r2": f"""
SELECT *, first_value(opening) OVER (PARTITION BY {key} ORDER BY pos) + sum(delta) OVER (PARTITION BY {key} ORDER BY pos) AS calc FROM {prefix}r1
""",
        f"{prefix}r3": f"""
SELECT *, coalesce(last_value(CASE WHEN NOT carried THEN calc - balance END IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY pos), 0) AS diff FROM {prefix}r2
""",
        f"{prefix}r4": f"""
SELECT *, coalesce(abs(diff - lag(diff) OVER w) > 0.01, false) AS changed,
       coalesce(epoch_us(txn_date) - epoch_us(lag(txn_date) OVER w) > 86400000000, false) AS waited
FROM {prefix}r3 WINDOW w AS (PARTITION BY {key} ORDER BY pos)
""",
        f"{prefix}processed": f"""
SELECT *, count(*) FILTER (WHERE changed) OVER (PARTITION BY {key} ORDER BY pos) AS changes, changed AND waited AS gap FROM {prefix}r4
""",
    }


BLOCKS.update(replay_steps("placed"))

BLOCKS["sums"] = """
SELECT run_id, any_value(acc_prvdr_code) AS acc_prvdr_code, any_value(format) AS format, count(*) AS num_rows,
       arg_min(balance, pos) AS first_balance, arg_max(balance, pos) AS last_balance, CAST(arg_max(calc, pos) AS DECIMAL(22,5)) AS calculated_closing_balance,
       max(changes) AS balance_diff_changes, count(*) FILTER (WHERE is_duplicate) AS duplicate_count, count(*) FILTER (WHERE gap) AS gap_related_balance_changes,
       coalesce(sum(amount) FILTER (WHERE CASE WHEN format = 'format_1' AND NOT signed THEN lower(txn_direction) IN ('credit', 'cr') ELSE amount > 0 END), 0) AS credits,
       abs(coalesce(sum(amount) FILTER (WHERE CASE WHEN format = 'format_1' AND NOT signed THEN lower(txn_direction) IN ('debit', 'dr') ELSE amount < 0 END), 0)) AS debits,
       sum(fee) AS fees, min(CAST(txn_date AS DATE)) AS start_date, max(CAST(txn_date AS DATE)) AS end_date,
       bool_or(cb) AS uses_implicit_cashback, bool_or(ind) AS uses_implicit_ind02_commission
FROM processed GROUP BY run_id
"""

BLOCKS["summary"] = """
SELECT *, CASE WHEN abs(calculated_closing_balance - last_balance) < 0.01 THEN 'Success' ELSE 'Failed' END AS balance_match,
       gap_related_balance_changes > 0 AS missing_days_detected, round(CAST(balance_diff_changes AS DOUBLE) / num_rows, 6) AS balance_diff_change_ratio,
       CASE WHEN balance_match = 'Failed' THEN 'FAIL' WHEN duplicate_count > 0 THEN 'WARNING' ELSE 'PASS' END AS verification_status,
       CASE WHEN balance_match = 'Failed' THEN concat('Balance mismatch: calculated=', CAST(CAST(calculated_closing_balance AS DECIMAL(38,2)) AS VARCHAR), ', statement=', CAST(last_balance AS VARCHAR))
            WHEN duplicate_count > 0 THEN concat('Found ', CAST(duplicate_count AS VARCHAR), ' duplicate transactions')
            ELSE 'Balance matches and no duplicates detected' END AS verification_reason
FROM sums
"""

_DEPS: dict[str, list[str]] = {}


def _deps(name: str, blocks: dict[str, str]) -> list[str]:
    words = set(re.findall(r"\b[a-z_0-9]+\b", re.sub(r"'[^']*'", "", blocks[name])))
    return [b for b in blocks if b in words and b != name]


def assemble(sql: str, extra: dict[str, str] | None = None) -> str:
    """`WITH` every building block that `sql` needs, in dependency order."""
    blocks = {**BLOCKS, **(extra or {}), "__main__": sql}
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in _deps(name, blocks):
            if dep not in order:
                visit(dep)
        if name not in order:
            order.append(name)

    visit("__main__")
    parts = []
    for name in order[:-1]:
        kind = "" if name == "walk" else "MATERIALIZED "
        parts.append(f"{name} AS {kind}({blocks[name].strip()})")
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + sql.strip()
