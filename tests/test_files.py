"""Readers, writers and the landing stream on real files."""

import gzip
import hashlib
import re
from collections import Counter
from pathlib import Path

from ledgerproof.operators import explore, lineage
from ledgerproof.plans import QUERIES
from ledgerproof.session import shared_dir
from pyspark.sql import functions as F

from ledgerproof.sources import sinks
from ledgerproof.sources import statements as S
from ledgerproof.streaming import landing

FILE = (
    "Wallet\r\nOverview\r\nCustomer Name,Ines Q\r\nMobile Number,555012\r\nEmail Address,q@example.org\r\n"
    'Statement Period,02-Jan-24 to 09-Feb-24\r\nRequest Date,"11 Mar, 2024"\r\nOpening Balance,"Ugx 6,120.25"\r\nClosing Balance,Ugx 44.75\r\n'
    "Transaction Details\r\nTransaction ID,Transaction Date,Description,Status,Transaction Amount,Credit/Debit,Fee,Balance\r\n"
    '1001,01-05-25 08:17 AM,"Sent, to ""Bob""",Transaction Successful,"1,500.00",Debit,10,"2,377.80"\r\n'
    "1002,01-May-25 09:00 AM,Received,Transaction Successful,20,Credit,,2397.80\r\n"
    ",,,,,,,\r\n1003,sometime,Odd,Transaction Successful,5,Credit,0,\r\n"
)


def test_wallet_csv_plain_and_gzip(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿".encode() + FILE.encode())
    with gzip.open(tmp_path / "b.csv.gz", "wb") as f:
        f.write(FILE.encode())
    txn, meta = S.read_wallet_csv(spark, str(tmp_path))
    assert txn.count() == 6
    one = {r.txn_id: r for r in txn.filter("path like '%a.csv'").collect()}
    assert (float(one["1001"].amount), one["1001"].description, float(one["1001"].balance)) == (-1500.0, 'Sent, to "Bob"', 2377.8)
    assert (one["1001"].txn_direction, one["1002"].txn_direction, float(one["1002"].fee)) == ("DR", "CR", 0.0)
    assert one["1003"].txn_date is None and one["1003"].balance is None and one["1003"].format == "format_1"
    for row in meta.collect():
        assert (row.customer_name, row.mobile_number, float(row.opening_balance), str(row.request_date)) == ("Ines Q", "555012", 6120.25, "2024-03-11")
    rejects = S.wallet_rejects(S.read_lines(spark, str(tmp_path)))
    assert {(r.bad_amounts, r.bad_dates) for r in rejects.collect()} == {(0, 1)}


def test_file_census(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"PK\x03\x04rest")
    (tmp_path / "b.csv").write_bytes("a,é".encode())
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "d.xlsx").write_bytes(b"\x1f\x8b\x08")
    got = {(r.extension, r.actual_type): r.files for r in S.file_census(S.read_files(spark, str(tmp_path))).collect()}
    assert got == {("csv", "xlsx"): 1, ("csv", "csv"): 1, ("pdf", "pdf"): 1, ("xlsx", "gzip"): 1}


def test_mapper_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text("run_id,acc_number,rm_name,acc_prvdr_code,status,lambda_status,created_date\nr1,7,Ann,UATL,s,ok,2025-05-01\nr2,7,Bob,UATL,s,ok,2025-06-01\n")
    mapper = S.read_mapper(spark, str(tmp_path / "m.csv"))
    assert [tuple(r)[:2] for r in lineage.latest_per_account(mapper).select("acc_number", "run_id").collect()] == [("7", "r2")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 2)], "run_id string, n int")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    sinks.write_tabs({"one": df, "two": df.limit(1)}, str(tmp_path / "tabs"))
    assert spark.read.parquet(str(tmp_path / "tabs" / "two")).count() == 1
    sinks.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    new = spark.createDataFrame([("a", 9), ("c", 3)], "run_id string, n int")
    assert sorted(map(tuple, sinks.upsert(df, new).collect())) == [("a", 9), ("b", 1), ("c", 3)]


def test_landing_takes_each_run_once(spark, tmp_path):
    inbox, table, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    inbox.mkdir()
    (inbox / "r1.csv").write_text("a\nb\n")
    landing.land(spark, str(inbox), table, marks).awaitTermination()
    (inbox / "r2.csv").write_text("c\n")
    (inbox / "again").mkdir()
    (inbox / "again" / "r1.csv").write_text("a\nb\n")
    landing.land(spark, str(inbox), table, marks).awaitTermination()
    got = landing.landed(spark, table).groupBy("run_id").count().collect()
    assert {r["run_id"]: r["count"] for r in got} == {"r1": 2, "r2": 1}


def test_landing_takes_runs_of_bundles(spark, tmp_path):
    """Many runs to a file: few files for many runs, line breaks stay inside their line, later offers of a run are left out."""
    inbox, table, marks = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "marks")
    lines = spark.range(600).selectExpr("concat('R', id % 200) AS run_id", "concat('x', id, chr(10), 'y') AS line").repartition(5)
    landing.write_bundles(lines.filter("run_id like '%1'"), f"{inbox}/a")
    landing.land(spark, inbox, table, marks, bundled=True).awaitTermination()
    landing.write_bundles(lines, f"{inbox}/b")
    landing.land(spark, inbox, table, marks, bundled=True).awaitTermination()
    got = landing.landed(spark, table).groupBy("run_id", "batch_id").count().collect()
    assert {r["run_id"]: (r["batch_id"], r["count"]) for r in got} == {f"R{i}": (int(i % 10 != 1), 3) for i in range(200)}
    assert len(list((tmp_path / "in").rglob("*.json"))) < 40


def test_landing_query_writes_few_files(spark):
    before = set(Path(shared_dir(spark)).glob("landing-*"))
    runs = QUERIES["t1_incremental_landing"](spark, "/root/testdata/sf0.001").count()
    (made,) = set(Path(shared_dir(spark)).glob("landing-*")) - before
    assert runs > len([f for f in (made / "in").rglob("part-*")])


def test_wallet_files_query_writes_few_files(spark, tmp_path):
    """Statements are written many to a file, and all their rows come back."""
    orders = spark.range(900).selectExpr(
        "id AS o_orderkey", "id % 450 AS o_custkey", "CASE WHEN id % 3 = 0 THEN 'O' ELSE 'F' END AS o_orderstatus", "1000.25D + id AS o_totalprice",
        "TIMESTAMP '2024-05-01 00:00:00' + make_interval(0, 0, 0, CAST(id % 200 AS INT)) AS o_orderdate", "'2-HIGH' AS o_orderpriority")
    events = spark.range(10).selectExpr("id AS event_id", "TIMESTAMP '2024-05-01 00:00:00' AS ts", "id % 2 AS user_id", "'click' AS event_type", "5.0D AS value", "'{}' AS props")
    nation = spark.range(25).selectExpr("id AS n_nationkey", "concat('N', id) AS n_name")
    for name, df in {"orders": orders, "events": events, "nation": nation}.items():
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    before = set(Path(shared_dir(spark)).glob("wallet-*"))
    rows = QUERIES["s1_wallet_files"](spark, str(tmp_path)).collect()
    (made,) = set(Path(shared_dir(spark)).glob("wallet-*")) - before
    assert len({r.run_id for r in rows}) == 90 > 8 >= len([f for f in made.rglob("part-*")])
    assert all(",\nsaid" in r.description for r in rows)
    expected = {r.path: r.n for r in QUERIES["s1_wallet_csv"](spark, str(tmp_path)).groupBy("path").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert Counter(r.run_id for r in rows) == expected


def test_parser_code_is_short_enough_to_be_compiled(spark, tmp_path):
    """Above 8,000 bytes a method is interpreted for good."""
    (tmp_path / "a.csv").write_bytes(FILE.encode())
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = S.parse_wallet(S.read_lines(spark, str(tmp_path)))._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenString(plan))
    assert sizes and max(map(int, sizes)) < 8000


def test_fingerprint_keeps_values_apart(spark):
    rows = [("A", 1, "x,y", "z"), ("B", 1, "x", "y,z"), ("C", 1, None, "z"), ("D", 1, "", "z"), ("E", 1, "-", "z")]
    df = spark.createDataFrame(rows, "run_id string, seq long, t string, u string")
    assert S.fingerprints(df, ["t", "u"]).select("sheet_md5").distinct().count() == len(rows)


def test_fingerprint_depends_on_rows_and_order(spark):
    rows = [("A", i, f"x{i}") for i in range(5000)]
    swapped = [("B", i, t) for _, i, t in rows]
    swapped[0], swapped[1] = ("B", 0, "x1"), ("B", 1, "x0")
    same = [("C", i, t) for _, i, t in rows]
    df = spark.createDataFrame(rows + swapped + same, "run_id string, seq long, t string").repartition(7)
    got = {r.run_id: r.sheet_md5 for r in S.fingerprints(df, ["t"]).collect()}
    assert got["A"] == got["C"] != got["B"]
    leaves = [hashlib.md5("\n".join(hashlib.md5(f"{len(t)}:{t}".encode()).hexdigest() for _, _, t in part).encode()).hexdigest() for part in (rows[:4096], rows[4096:])]
    top = hashlib.md5("\n".join(leaves).encode()).hexdigest()
    for _ in range(S.LEVELS - 2):
        top = hashlib.md5(top.encode()).hexdigest()
    assert got["A"] == top


def test_retract(spark):
    raw = spark.createDataFrame([("a",), ("a",), ("b",)], "run_id string")
    tables, gone = {"raw": raw, "processed": raw, "summary": raw.distinct()}, spark.createDataFrame([("a",)], "run_id string")
    assert {k: v.count() for k, v in explore.retract(tables, gone).items()} == {"raw": 3, "processed": 1, "summary": 1}
    assert {k: v.count() for k, v in explore.retract(tables, gone, everything=True).items()} == {"raw": 1, "processed": 1, "summary": 1}
    assert {r.table_name: r.removed for r in explore.retract_counts(tables, gone).collect()} == {"raw": 2, "processed": 2, "summary": 1}


def test_upsert_keeps_the_last_new_row(spark):
    old = spark.createDataFrame([("a", 1, 0)], "run_id string, n long, at long")
    new = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("b", 4, 1)], "run_id string, n long, at long")
    assert sorted(map(tuple, sinks.upsert(old, new, order="at").collect())) == [("a", 3, 2), ("b", 4, 1)]


def test_two_files_of_a_run_in_one_batch_land_once(spark, tmp_path):
    for name in ("x", "y"):
        folder = tmp_path / "in" / name / "run_id=r1"
        folder.mkdir(parents=True)
        (folder / f"{name}.csv").write_text("one\ntwo\n")
    landing.land(spark, str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_ids_over_38_digits_do_not_abort(spark):
    from ledgerproof.operators import forensic

    row = spark.createDataFrame([("9" * 39,), ("a12",)], "t string").select(forensic.longest_digits(F.col("t")).alias("n")).collect()
    assert [r.n and int(r.n) for r in row] == [None, 12]


def test_wide_and_headerless_files(spark, tmp_path):
    extra = [f"x{i}" for i in range(17)]
    head = [*extra, "Transaction ID", "Transaction Date", "Transaction Amount", "Balance"]
    row = ['"a, ""b"""', *extra[1:], "7", "01-05-25 08:17 AM", '"-1,250.50"', "9"]
    (tmp_path / "wide.csv").write_text(",".join(head) + "\n" + ",".join(row) + "\n")
    (tmp_path / "none.csv").write_text("Customer Name,Z\n")
    lines = S.read_lines(spark, str(tmp_path))
    assert [(r.txn_id, float(r.amount), float(r.balance), r.format) for r in S.parse_wallet(lines).collect()] == [("7", -1250.5, 9.0, "format_2")]
    got = {r.path.split("/")[-1]: (r.parsing_status, r.parsing_error, r.num_rows) for r in S.wallet_outcomes(lines).collect()}
    assert got == {"wide.csv": ("SUCCESS", None, 1), "none.csv": ("FAILED", S.NO_HEADER, 0)}


def test_landed_lines_can_be_parsed(spark, tmp_path):
    inbox, table = tmp_path / "in", str(tmp_path / "table")
    for name in ("a", "b"):
        (inbox / name).mkdir(parents=True)
        (inbox / name / "r1.csv").write_bytes(FILE.encode())
    landing.land(spark, str(inbox), table, str(tmp_path / "marks")).awaitTermination()
    lines = landing.landed(spark, table)
    assert sorted(r.txn_id for r in S.parse_wallet(lines).collect()) == ["1001", "1002", "1003"]
    assert [r.num_rows for r in S.wallet_outcomes(lines).collect()] == [3]


def test_upsert_leaves_one_row_of_a_key(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, n int")
    new = spark.createDataFrame([("b", 5), ("b", 6), ("c", 7), ("c", 7)], "run_id string, n int")
    first, again = (sorted(tuple(r) for r in sinks.upsert(old, x).collect()) for x in (new, new.orderBy("n")))
    assert [r[0] for r in first] == ["a", "b", "c"] and first == again and first[1][1] in (5, 6)
    assert ("b", 6) in {tuple(r) for r in sinks.upsert(old, new, order="n").collect()}
