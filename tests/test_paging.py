"""Pages of written listings and pages by key, against plain sorting."""

import pytest

from ledgerproof.operators import paging
from ledgerproof.operators.sequence import Sort

ORDER = (Sort("day", desc=True), Sort("name"), Sort("id"))
ROWS = [((i * 7919) % 23 or None, None if i % 31 == 0 else f"n{i * 31 % 17}", i) for i in range(2000)]
# A third of all rows share their first keys.
ROWS += [(5, "n1", i) for i in range(2000, 3000)]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, r[1] or "", r[2]))


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "day int, name string, id int")


@pytest.fixture(scope="module")
def listed(table):
    return paging.listing(table, ORDER, range_rows=100)


def test_pages_are_those_of_plain_sorting(listed):
    want = in_order(ROWS)
    assert listed.total() == len(want)
    for number, size in ((1, 50), (2, 7), (31, 50), (60, 50), (2, 1700), (430, 7)):
        got = [tuple(r) for r in listed.page(number, size).collect()]
        first = (number - 1) * size
        assert got == [(*r, first + i) for i, r in enumerate(want[first : first + size])], (number, size)


def test_a_page_reads_its_ranges_only(listed):
    assert listed.index.count() > 20
    files = listed.page(50, 10).inputFiles()
    assert 1 <= len({f.split(f"{paging.RANGE}=")[1].split("/")[0] for f in files}) <= 2
    assert "CollectLimit" not in listed.page(50, 10)._jdf.queryExecution().executedPlan().toString()


def test_ranges_stay_bounded_though_first_keys_repeat(listed):
    assert listed.index.agg({paging.ROWS: "max"}).first()[0] <= 400


def test_beyond_the_end_empty_and_wrong(spark, listed, table):
    assert listed.page(1000, 50).collect() == []
    empty = paging.listing(table.limit(0), ORDER)
    assert empty.total() == 0 and empty.page(1).collect() == [] and empty.page(1).columns == ["day", "name", "id", "rank"]
    with pytest.raises(ValueError):
        listed.page(0)
    with pytest.raises(ValueError):
        paging.listing(table.withColumnRenamed("name", "rank"), (Sort("id"),))


@pytest.mark.parametrize("order", [ORDER, (Sort("name", nulls_first=True), Sort("day"), Sort("id"))])
def test_pages_by_key(table, order):
    want = [tuple(r) for r in table.orderBy(*[s.order() for s in order]).collect()]
    got, last = [], None
    while True:
        rows = paging.after(table, order, last, 700).collect()
        if not rows:
            break
        got += map(tuple, rows)
        last = rows[-1].asDict()
    assert got == want


def test_the_first_key_reaches_the_scan(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    plan = paging.after(stored, ORDER, {"day": 5, "name": "n1", "id": 2500}, 10)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(day,5)" in plan and "TakeOrderedAndProject" in plan
