"""Incremental landing of statement files: each run once, however often files are offered.

Beside the table of lines stands one of runs (`<table>-runs`, one row per run), so a batch is
compared with the runs landed so far and not with their lines. `line_no` orders a file's lines.

Runs arrive as one file each, or bundled: files of JSON lines with `run_id` and `line`, many runs to a file and
each run whole in one file. A file per run costs several file operations a run, so many small runs come bundled.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerproof.sources.statements import run_id_of


def offered_lines(spark: SparkSession, folder: str, bundled: bool = False) -> DataFrame:
    """Lines of arriving files with the run they belong to: the one a bundled line names, a `run_id=` folder or the file name."""
    path = F.col("_metadata.file_path")
    by_folder = F.nullif(F.regexp_extract(path, "run_id=([^/]+)/", 1), F.lit(""))
    run, block = F.coalesce(by_folder, run_id_of(path)), F.col("_metadata.file_block_start").alias("block")
    arriving = spark.readStream.option("recursiveFileLookup", True)
    if bundled:
        text = arriving.schema("run_id string, line string").json(folder)
        return text.select(F.coalesce("run_id", run).alias("run_id"), path.alias("path"), block, "line")
    return arriving.text(folder).select(run.alias("run_id"), path.alias("path"), block, F.col("value").alias("line"))


def write_bundles(lines: DataFrame, folder: str) -> None:
    """`run_id` and `line` as bundles; all lines of a run go to one file, as `land` takes one file of a run."""
    lines.select("run_id", "line").repartition("run_id").write.json(folder)


def landed(spark: SparkSession, table: str) -> DataFrame | None:
    try:
        return spark.read.parquet(table)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _append_new(table: str):
    runs_table = f"{table}-runs"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Numbered before any join, while lines still come in the order of their file.
        row = F.monotonically_increasing_id().alias("row")
        lines = batch.withColumn("line_no", F.struct("block", row)).drop("block")
        # Of several files of one run in a batch the first path lands.
        runs = batch.groupBy("run_id").agg(F.min("path").alias("path"))
        known = landed(spark, runs_table)
        if known is not None:
            # A replayed batch must not see its own earlier attempt as already landed.
            runs = runs.join(known.filter(F.col("batch_id") < batch_id), "run_id", "left_anti")
        # One folder per batch, overwritten on replay: the write is idempotent.
        chosen = f"{runs_table}/batch_id={batch_id}"
        runs.write.mode("overwrite").parquet(chosen)
        fresh = lines.join(spark.read.schema(runs.schema).parquet(chosen), ["run_id", "path"], "left_semi")
        fresh.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return write


def land(spark: SparkSession, folder: str, table: str, checkpoint: str, bundled: bool = False) -> StreamingQuery:
    """Process what is there and stop. A statement arrives whole, so no watermark is needed."""
    return (
        offered_lines(spark, folder, bundled)
        .writeStream.foreachBatch(_append_new(table))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
