"""Python functions in tasks: the executors need this package to import them from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each Spark context.

    They fetch the archive from the driver. Modules are imported, not pickled with every task, so what a
    worker has loaded (a tokenizer, its cache of words) lasts as long as the worker.
    """
    context = spark.sparkContext
    if getattr(context, "_ledgerproof_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="ship-"))
    archive = folder / "ledgerproof_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    context._ledgerproof_shipped = True
