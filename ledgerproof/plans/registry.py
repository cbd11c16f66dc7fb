"""Registered queries: a DataFrame builder and, where SQL can say it, the SQL to match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerproof.plans.oracles import assemble
from ledgerproof.plans.tables import Tables, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def in_doubles(df: DataFrame) -> DataFrame:
    """Money leaves as DOUBLE, so both engines hand over the same type."""
    return df.select(*[F.col(f.name).cast("double") if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in df.schema])


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: in_doubles(build(tables(spark, folder)))
        if sql is not None:
            ORACLES[name] = assemble(sql, extra)
        return build

    return register
