"""Replay and tie ordering against plain loops, for ordinary and for hot runs."""

import random
from datetime import datetime, timedelta
from decimal import Decimal as D

import loops
import pytest

from ledgerproof.operators import detect, explore, forensic, ledger
from ledgerproof.operators.sequence import ARRIVAL, Sizing, plain, scan, split_hot
from ledgerproof.sources import fixtures
from pyspark.sql import functions as F

SCHEMA = (
    "run_id string, acc_prvdr_code string, format string, seq long, txn_id string, txn_date timestamp, txn_type string, "
    "description string, status string, txn_direction string, amount decimal(18,2), fee decimal(18,2), balance decimal(18,2)"
)
TEXTS = [
    "Send Money", "Send Money", "Send Money", "Commission Disbursement - x", "Deallocation Transfer", "Transaction Reversal",
    "RollBack of y", "Merchant Payment Other Single Step", "Received IND02 a", "IND02 via IND01",
]


def statement(rng, run, style, n, tie_rate, start=0):
    """Random rows whose printed balances mostly follow from their amounts."""
    rows, balance, when = [], D(50000), datetime(2025, 1, 1, 8)
    for i in range(n):
        if not rows or rng.random() > tie_rate:
            when += timedelta(hours=rng.choice([1, 2, 40]))
        amount = D(rng.randrange(100, 5000)) / (D(4) if rng.random() < 0.3 else D(1))
        amount = amount.quantize(D("0.01"))
        row = {
            "run_id": run, "acc_prvdr_code": "UMTN" if style == "sheet" else "UATL",
            "format": {"sheet": "excel", "two": "format_2"}.get(style, "format_1"),
            "seq": start + i, "txn_id": f"T{start + i}", "txn_date": when, "description": rng.choice(TEXTS), "status": "ok",
            "txn_type": rng.choice(["CASH_IN", "CASH_OUT", "TRANSFER", "BILL PAYMENT"]) if style == "sheet" else None,
            "txn_direction": rng.choice(["Credit", "Debit"]), "fee": D(rng.choice([0, 0, 50])), "amount": amount, "balance": balance,
        }
        if style in ("signed", "two") or (style == "sheet" and row["txn_type"] == "TRANSFER"):
            row["amount"] = amount if row["txn_direction"] == "Credit" else -amount
        balance += loops.delta(row, style == "signed", True, True).quantize(D("0.01"))
        if rng.random() < 0.05:
            balance += 7
        row["balance"] = balance
        rows.append(row)
        if rng.random() < 0.05 and style != "sheet":
            rows.append({**row, "seq": start + 10_000_000 + i})
    # Printed order within a tie is not the order of the payments.
    return rows


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for k, style in enumerate(["direction", "signed", "two", "sheet"] * 2):
        out += statement(rng, f"R{k:02d}", style, 60 if k < 4 else rng.choice([1, 2, 40]), rng.choice([0.2, 0.5, 0.75]), k * 1000)
    return out


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)


def replayed(df, sizing):
    out = ledger.verify(df, sizing, keep=()).select(
        "run_id", "pos", "seq", "calculated_running_balance", "balance_diff", "balance_diff_change_count", "gap_related"
    )
    runs = {}
    for r in sorted(out.collect()):
        runs.setdefault(r[0], []).append(tuple(r[2:]))
    return runs


def expected(rows):
    runs = {}
    for r in rows:
        runs.setdefault(r["run_id"], []).append(dict(r))
    return {k: [(s, b, d, c, g) for s, b, d, c, g in loops.replay(v)] for k, v in runs.items()}


def same(got, want):
    assert got.keys() == want.keys()
    for run in want:
        assert got[run] == want[run], run


def test_ordinary_runs(spark, rows):
    same(replayed(frame(spark, rows), Sizing()), expected(rows))


@pytest.mark.parametrize("block_rows", [13, 40])
def test_hot_runs_in_blocks(spark, rows, block_rows):
    """Every run above 30 rows is spread over blocks; chains and groups cross their borders."""
    same(replayed(frame(spark, rows), Sizing(hot_rows=30, block_rows=block_rows)), expected(rows))


@pytest.mark.parametrize("style", ["direction", "sheet"])
def test_one_run_of_long_chains(spark, style):
    """Nearly all groups are tied, so one chain runs through many blocks."""
    rng = random.Random(3)
    data = statement(rng, "H", style, 250, 0.6)
    for i in range(len(data) - 1):  # few single rows left
        if rng.random() < 0.5:
            data[i + 1]["txn_date"] = max(data[i + 1]["txn_date"], data[i]["txn_date"])
    data.sort(key=lambda r: (r["txn_date"], r["seq"]))
    same(replayed(frame(spark, data), Sizing(hot_rows=50, block_rows=25)), expected(data))


def test_large_tie_keeps_printed_order(spark):
    rng = random.Random(5)
    data = statement(rng, "L", "direction", 120, 0.0)
    for r in data[20:100]:
        r["txn_date"] = data[20]["txn_date"]
    data = [r for r in data if r["seq"] < 10_000_000]
    for sizing in (Sizing(), Sizing(hot_rows=30, block_rows=16)):
        same(replayed(frame(spark, data), sizing), expected(data))


def test_row_order_does_not_matter(spark, rows):
    shuffled = list(rows)
    random.Random(1).shuffle(shuffled)
    same(replayed(frame(spark, shuffled).repartition(5), Sizing()), expected(rows))


def test_dropping_duplicates_keeps_the_closing_balance(spark, rows):
    two = frame(spark, [r for r in rows if r["format"] == "format_2"])
    close = lambda df: {r[0]: r[1] for r in ledger.summarise(ledger.verify(df, keep=())).select("run_id", "calculated_closing_balance").collect()}
    kept = detect.flag_duplicates(two).filter("not is_duplicate").select(two.columns)
    assert close(two) == close(kept)


def test_strategies_in_blocks(spark, rows):
    wallet = frame(spark, [r for r in rows if r["acc_prvdr_code"] == "UATL"])
    cols = ["strategy", "run_id", "balance_diff_changes", "calculated_closing_balance", "balance_match"]
    one = ledger.run_strategies(wallet).select(cols)
    two = ledger.run_strategies(wallet, Sizing(hot_rows=30, block_rows=25)).select(cols)
    assert sorted(one.collect()) == sorted(two.collect())
    assert one.filter("strategy = 'voting'").count() == wallet.select("run_id").distinct().count()


def test_ordered_scans_in_blocks(spark, rows):
    df = frame(spark, rows)

    def step(r):
        r = r.lag(F.col("balance"), "before").running_sum(F.col("amount"), "total")
        r = r.last_known(F.when(F.col("fee") > 0, F.col("fee")), "fee_seen").strictly_earlier(F.col("balance"), "earlier")
        return r.per_key(most=F.max("amount")).df

    cols = ["run_id", "seq", "before", "total", "fee_seen", "earlier", "most"]
    one = scan(df, ["run_id"], ARRIVAL, step).select(cols)
    two = scan(df, ["run_id"], ARRIVAL, step, Sizing(hot_rows=30, block_rows=17)).select(cols)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_other_scans_in_blocks(spark, rows):
    df, small = frame(spark, rows), Sizing(hot_rows=30, block_rows=30)
    for f in (forensic.backward_steps, detect.fee_votes, ledger.normalise_signs, explore.movement_patterns, detect.flag_duplicates):
        one, two = f(df, sizing=Sizing()), f(df, sizing=small)
        assert sorted(map(str, one.collect())) == sorted(map(str, two.select(one.columns).collect())), f.__name__
    one, two = forensic.jump_rows(df, 0.01), forensic.jump_rows(df, 0.01, small)
    assert one.count() > 0 and sorted(one.collect()) == sorted(two.collect())


def test_statement_balances_in_blocks(spark):
    """The derived statements' own running balance survives a hot statement too."""
    day = datetime(2025, 1, 1)
    orders = spark.createDataFrame(
        [(i, 7 if i % 3 else i, "OFP"[i % 3], 100.0 + i, day + timedelta(days=i % 11), "1-URGENT") for i in range(150)],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    )
    one, two = fixtures.uatl_txn(orders), fixtures.uatl_txn(orders, Sizing(hot_rows=20, block_rows=15))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.select(one.columns).collect()))


def test_mismatch_context_in_blocks(spark, rows):
    done = ledger.verify(frame(spark, rows), keep=())
    cols = ["run_id", "pos", "before_mismatch", "seq"]
    one, two = explore.mismatch_context(done).select(cols), explore.mismatch_context(done, sizing=Sizing(hot_rows=30)).select(cols)
    assert one.count() > 0 and sorted(one.collect()) == sorted(two.collect())


def test_split_hot_finds_the_large_run(spark, rows):
    df = frame(spark, rows)
    cold, hot, n = split_hot(df, ["run_id"], hot_rows=50)
    assert hot is not None and n == hot.count() and n + cold.count() == df.count()
    assert split_hot(df, ["run_id"], hot_rows=10_000)[1] is None
    assert plain(df, ["run_id"], ARRIVAL).part == ["run_id"]


def test_undated_rows(spark):
    rng = random.Random(2)
    one, two = statement(rng, "A", "direction", 10, 0.0), statement(rng, "B", "two", 10, 0.0, 100)
    one[4]["txn_date"] = two[4]["txn_date"] = None
    df = frame(spark, one + two)
    assert [tuple(r) for r in ledger.undated_rows(df).collect()] == [("A", 1)]
    assert ledger.verify(df, keep=()).count() == df.count() - 1


def test_vote_examples(spark):
    """The printed balance is explained without the 4 %: off. IND02 with its 0.5 %: on."""
    base = {"acc_prvdr_code": "UATL", "format": "format_2", "txn_type": None, "status": "ok", "txn_direction": "Debit"}
    day = datetime(2025, 5, 1)

    def row(run, seq, text, amount, fee, balance):
        return {**base, "run_id": run, "seq": seq, "txn_id": f"T{seq}", "txn_date": day + timedelta(days=seq), "description": text,
                "amount": D(amount), "fee": D(fee), "balance": D(balance)}

    data = [
        row("cash", 1, "Send Money", -10, 0, 10000),
        row("cash", 2, "Merchant Payment Other Single Step", -1000, 55, 9000),
        row("ind", 3, "Send Money", -10, 0, 200000),
        row("ind", 4, "Received IND02", 155000, 330, 354225),
    ]
    got = {r.run_id: (r.uses_implicit_cashback, r.uses_implicit_ind02_commission) for r in detect.fee_votes(frame(spark, data)).collect()}
    assert got == {"cash": (False, False), "ind": (False, True)}


def test_left_in_printed_order(spark):
    rng = random.Random(9)
    one, two = statement(rng, "A", "direction", 30, 0.0), statement(rng, "B", "two", 30, 0.0, 100)
    for r in (*one[10:17], *two[10:17]):
        r["txn_date"] = one[10]["txn_date"]
    one[4]["txn_date"] = two[4]["txn_date"] = None
    got = ledger.left_in_printed_order(frame(spark, one + two)).collect()
    assert [(r.run_id, r.undated_rows, r.large_groups) for r in got] == [("A", 1, 1)]
