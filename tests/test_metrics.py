"""All metrics of a statement in two passes, against the metrics one by one."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerproof.operators import forensic
from ledgerproof.operators.sequence import Sizing

SCHEMA = "run_id string, seq long, txn_id string, txn_date timestamp, amount decimal(18,5), balance decimal(18,5)"


def rows_of(spark):
    rnd, rows = random.Random(3), []
    for run, size in (("a", 40), ("b", 7), ("hot", 300), ("one", 1)):
        for seq in range(size):
            ident = rnd.choice([None, "", f"TX{rnd.randrange(200)}", f"{rnd.randrange(50)}-A{rnd.randrange(90)}", "no digits"])
            date = rnd.choice([None, 0, 1, 1]) if rnd.random() < 0.2 else seq + rnd.randrange(3)
            date = None if date is None else f"2025-0{1 + rnd.randrange(2)}-11 07:{date // 60:02d}:{date % 60:02d}.5"
            amount = rnd.choice([None, Decimal(500), Decimal(-20), Decimal("0.5"), Decimal(rnd.randrange(9000))])
            rows.append((run, seq, ident, date, amount, rnd.choice([None, Decimal(0), Decimal(rnd.randrange(1, 99))])))
    rows += [("bare", i, None, None, None, None) for i in range(3)]
    text = SCHEMA.replace("timestamp", "string")
    return spark.createDataFrame(rows, text).withColumn("txn_date", F.col("txn_date").cast("timestamp")).repartition(4)


@pytest.mark.parametrize("sizing", [Sizing(), Sizing(hot_rows=100, block_rows=40)])
def test_two_passes_say_what_the_metrics_say(spark, sizing):
    txn = rows_of(spark).cache()
    got = {r.run_id: r for r in forensic.all_metrics(txn, sizing).collect()}
    assert set(got) == {"a", "b", "hot", "one", "bare"}
    parts = {"id_integrity": forensic.id_integrity(txn), "balance_jumps": forensic.balance_jumps(txn), "timestamps": forensic.time_anomalies(txn), "amounts": forensic.amount_patterns(txn)}
    for name, df in parts.items():
        want = {r.run_id: r.asDict() for r in df.collect()}
        for run, row in got.items():
            if run in want:
                assert {"run_id": run, **row[name].asDict()} == want[run], (name, run)
            else:
                assert not any(row[name].asDict().values()), (name, run)
    assert got["bare"].amounts.benford_score is None and got["hot"].id_integrity.duplicate_ids > 0
    assert forensic.all_metrics(txn.limit(0), sizing).count() == 0


def test_two_scans_are_left(spark, tmp_path):
    rows_of(spark).write.parquet(str(tmp_path / "txn"))
    plan = forensic.all_metrics(spark.read.parquet(str(tmp_path / "txn")), Sizing(at_most=400))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2
