"""Records that span lines, on real files and across split edges, against two other CSV readers."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from ledgerproof.sources import records as records_module
from ledgerproof.sources import statements as S
from ledgerproof.sources.records import whole_records

HEAD = "Transaction ID,Transaction Date,Description,Status,Transaction Amount,Credit/Debit,Fee,Balance"


def cell(rnd):
    kind = rnd.randrange(6)
    if kind == 0:
        return rnd.choice(['', 'plain', 'in"side', '5" pipe', "é中"])
    inner = "".join(rnd.choice(["a", ",", "\n", '""', "\n\n", "x y", '"",""', "\r\n"]) for _ in range(rnd.randrange(6)))
    return f'"{inner}"'


@pytest.fixture()
def tiny_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def read(spark, folder):
    rows = whole_records(S.read_lines(spark, str(folder))).orderBy("path", "line_no").select(F.regexp_extract("path", "([^/]+)$", 1), "line").collect()
    out = {}
    for name, line in rows:
        out.setdefault(name, []).append(line)
    return out


def test_records_across_split_edges(spark, tmp_path, tiny_splits):
    rnd, want = random.Random(3), {}
    for i in range(6):
        records = [",".join(cell(rnd) for _ in range(rnd.randrange(1, 5))) for _ in range(30)] if i else ["plain,line", "other"]
        (tmp_path / f"f{i}.csv").write_bytes("\n".join(records).encode())
        # A line end inside a cell reads as a line feed, whatever it was.
        text = "\n".join(records).replace("\r\n", "\n")
        want[f"f{i}.csv"] = [row for row in csv.reader(io.StringIO(text, newline="")) if row]
    lines = S.read_lines(spark, str(tmp_path))
    assert lines.select("path", "line_no.block").distinct().count() > 20  # many splits
    got = read(spark, tmp_path)
    for name, records in want.items():
        mine = [next(csv.reader(io.StringIO(r, newline=""))) for r in got[name] if r]
        assert mine == records, name


def test_unclosed_cell_leaves_lines(spark, tmp_path, tiny_splits):
    body = [f'"a\nb {i}",{i}' for i in range(20)] + ['x,"never closed', "one", "two,2"]
    (tmp_path / "f.csv").write_text("\n".join(body))
    assert read(spark, tmp_path)["f.csv"] == body


def test_records_of_whole_files(spark, tmp_path):
    """Files that lie within one split: as the csv module reads them, and as the way across splits does."""
    rnd = random.Random(5)
    for i in range(30):
        records = [",".join(cell(rnd) for _ in range(rnd.randrange(1, 5))) for _ in range(12)]
        (tmp_path / f"f{i}.csv").write_bytes("\n".join(records + (['x,"never closed', "one", "", "two,2"] if i % 5 == 0 else [])).encode())
    lines = S.read_lines(spark, str(tmp_path))
    assert lines.select("path", "line_no.block").distinct().count() == 30
    got = read(spark, tmp_path)
    for i in (i for i in range(30) if i % 5):
        text = (tmp_path / f"f{i}.csv").read_bytes().decode().replace("\r\n", "\n")
        assert [next(csv.reader(io.StringIO(r, newline=""))) for r in got[f"f{i}.csv"] if r] == [row for row in csv.reader(io.StringIO(text, newline="")) if row], i
    assert all(got[f"f{i}.csv"][-4:] == ['x,"never closed', "one", "", "two,2"] for i in range(0, 30, 5))
    plain = lambda df: sorted((r.path, r.line_no.block, r.line_no.row, r.line) for r in df.collect())
    assert plain(records_module._within_splits(lines)) == plain(records_module._stitched(lines))


@pytest.mark.parametrize("edges", [False, True])
def test_bundled_statements_read_like_files(spark, tmp_path, request, edges):
    """Many statements to a file give the records that a file per statement gives, also across split edges."""
    if edges:
        request.getfixturevalue("tiny_splits")
    rnd, rows = random.Random(11), []
    odd = ["\ufeffstart", "a\tb,@", "ends\r", "", "x\r\ny", "one\rtwo", None]
    for i, name in enumerate(["plain", "a b", "50%", "t\tab@x", "é"] + [f"R{k}" for k in range(40)]):
        texts = [",".join(cell(rnd) for _ in range(rnd.randrange(1, 4))) for _ in range(8)] if i else ["no,quotes", "here"]
        texts = texts + odd + (['x,"never closed', "one"] if i % 7 == 3 else [])
        rows += [(name, n, text) for n, text in enumerate(texts)]
        # The same statement as a file of its own.
        (tmp_path / "files").mkdir(exist_ok=True)
        (tmp_path / "files" / f"{i}.csv").write_bytes("".join(f"{text or ''}\n" for text in texts).encode())
    df = spark.createDataFrame(rows, "path string, line_no long, line string").repartition(6)
    S.write_bundles(df, str(tmp_path / "bundles"))
    names = list(dict.fromkeys(r[0] for r in rows))
    assert len(list((tmp_path / "bundles").glob("part-*"))) <= 8 < len(names)
    own = read(spark, tmp_path / "files")
    bundled = whole_records(S.read_lines(spark, str(tmp_path / "bundles"), bundled=True)).orderBy("path", "line_no")
    got = {}
    for name, line in bundled.select(S.statement_name(F.col("path")), "line").collect():
        got.setdefault(name, []).append(line)
    assert got == {name: own[f"{i}.csv"] for i, name in enumerate(names)}


def test_wallet_rows_like_duckdb(spark, tmp_path, tiny_splits):
    duckdb = pytest.importorskip("duckdb")
    rnd = random.Random(9)
    rows = [f'{i},01-05-25 08:{i % 60:02d} AM,"Sent,\nto ""{"B" * rnd.randrange(60)}""\n{i}",Successful,"1,{i % 1000:03d}.50",{rnd.choice(["Debit", "Credit"])},1,{i}.25' for i in range(300)]
    (tmp_path / "s.csv").write_text("Wallet\nCustomer Name,Ines\n" + HEAD + "\n" + "\n".join(rows) + "\n")
    txn, meta = S.read_wallet_csv(spark, str(tmp_path))
    got = sorted((r.txn_id, r.description, float(r.amount), float(r.balance)) for r in txn.collect())
    want = duckdb.sql(
        f"""SELECT "Transaction ID" AS id, Description AS d, CASE WHEN "Credit/Debit" = 'Debit' THEN -1 ELSE 1 END * replace("Transaction Amount", ',', '')::DOUBLE AS a, Balance::DOUBLE AS b
            FROM read_csv('{tmp_path}/s.csv', skip = 2, header = true, quote = '"', escape = '"', all_varchar = true, parallel = false, delim = ',')"""
    ).fetchall()
    assert got == sorted(want) and len(got) == 300
    assert meta.collect()[0].customer_name == "Ines"
