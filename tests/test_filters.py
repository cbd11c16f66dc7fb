"""Filters on months."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerproof.operators import explore

TIMES = ["2024-11-30 23:59:59", "2024-12-01 00:00:00", "2024-12-31 23:59:59", "2025-01-01 00:00:00", "2025-02-28 12:00:00", None]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
@pytest.mark.parametrize("month", ["2024-11", "2024-12", "2025-01", "2025-02", "2023-02"])
def test_months_as_the_text_of_the_date_says(spark, kind, month):
    rows = spark.createDataFrame([(t,) for t in TIMES], "at string").withColumn("at", F.col("at").cast(kind))
    want = rows.filter(F.date_format("at", "yyyy-MM") == month).collect()
    assert rows.filter(explore.in_month("at", month)).collect() == want


def test_the_month_reaches_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([(f"r{i}", "UATL", "done", datetime(2024, i % 12 + 1, 5)) for i in range(48)], "run_id string, acc_prvdr_code string, lambda_status string, created_date timestamp")
    rows.write.parquet(str(tmp_path / "mapper"))
    out = explore.candidates(spark.read.parquet(str(tmp_path / "mapper")), "UATL", "done", "2024-12")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(created_date" in plan and "LessThan(created_date" in plan
    assert [r.run_id for r in out.collect()] == ["r11", "r23", "r35", "r47"]


def test_no_month(spark):
    with pytest.raises(ValueError):
        explore.in_month("created_date", "December")
