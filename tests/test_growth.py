"""What must not grow with the input: blocks, broadcast tables, passes over the rows; all on hand-made rows."""

from types import SimpleNamespace

from ledgerproof.operators import ledger
from ledgerproof.operators.sequence import ARRIVAL, BLOCK_ROWS, Sizing, blocked, split_hot
from ledgerproof.plans import q_blocked
from ledgerproof.session import BROADCAST_ROWS
from ledgerproof.sources import fixtures

ROWS = "run_id string, acc_prvdr_code string, format string, seq long, txn_id string, txn_date timestamp, txn_type string, description string, status string, txn_direction string, amount decimal(18,2), fee decimal(18,2), balance decimal(18,2)"


def test_blocks_do_not_grow_with_the_input():
    assert q_blocked.small(SimpleNamespace(rows=400_000)).block_rows == 50_000
    assert q_blocked.small(SimpleNamespace(rows=180_000_000)).block_rows == BLOCK_ROWS


def test_tables_of_many_hot_keys_are_not_taken_as_small(spark):
    df = spark.range(200).selectExpr("concat('R', id % 20) AS run_id", "timestamp_seconds(id) AS txn_date", "id AS seq")
    _, hot, n = split_hot(df, ["run_id"], hot_rows=5)
    rows = blocked(hot, ["run_id"], ARRIVAL, n, 100)
    assert (n, n.keys, rows.pieces) == (200, 20, 22)
    assert blocked(hot, ["run_id"], ARRIVAL, 200, 100).pieces > BROADCAST_ROWS  # keys not counted: no hint


def test_signs_and_votes_share_a_sort(spark):
    """Arrival, copies, printed order, final order: signs and votes read the rows in the first."""
    plan = ledger.verify(spark.createDataFrame([], ROWS), Sizing(at_most=1), keep=())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("- Sort [") == 4


def test_longest_run_bounds_every_statement(spark):
    orders = spark.range(40).selectExpr("id AS o_orderkey", "CASE WHEN id < 30 THEN id % 5 ELSE id END AS o_custkey")
    events = spark.range(50).selectExpr("id % 2 AS user_id")
    assert fixtures.longest_run(orders, events) == 60
    assert fixtures.longest_run(orders.limit(0), events.limit(0)) == 0


def test_run_names(spark):
    nums = spark.createDataFrame([(n,) for n in (0, 7, 999, 1000, 123456, -5, -12345, None)], "n long")
    got = nums.selectExpr(f"{fixtures._numbered('U', 'n')} AS a", "format_string('U%04d', n) AS b").collect()
    assert all(r.a == r.b for r in got)
