"""The tables a query may ask for, built lazily once per session and data folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ledgerproof.operators import ledger, verdict
from ledgerproof.operators.sequence import HOT_ROWS, Sizing
from ledgerproof.session import tune
from ledgerproof.sources import fixtures as X

# Rows that one partition of a shuffle is planned for.
TASK_ROWS = 500_000


class Tables:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = tune(spark), folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def sizing(self) -> Sizing:
        """Row counts come from the Parquet footers; they bound what any one run can hold, so small
        inputs skip the hot test. For others one pass over the numbers of the runs finds the longest, in place of
        a pass over the rows for each ordered operator."""
        if self.rows <= HOT_ROWS:
            return Sizing(at_most=self.rows)
        return Sizing(at_most=X.longest_run(self.read("orders"), self.read("events")))

    @cached_property
    def rows(self) -> int:
        """Upper bound on the rows of all statements: a fiftieth of the order rows is printed twice. Shuffles are
        dealt so finely that no task grows with it; adaptive execution joins small partitions."""
        found = 2 * (self.read("orders").count() + self.read("events").count())
        conf, wanted = self.spark.conf, found // TASK_ROWS
        if wanted > int(conf.get("spark.sql.shuffle.partitions")):
            conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", wanted)
        return found

    @cached_property
    def uatl(self) -> DataFrame:
        return X.uatl_txn(self.read("orders"), self.sizing)

    @cached_property
    def umtn(self) -> DataFrame:
        return X.umtn_txn(self.read("events"), self.sizing)

    @cached_property
    def txn(self) -> DataFrame:
        return self.uatl.unionByName(self.umtn)

    @cached_property
    def processed(self) -> DataFrame:
        return ledger.verify(self.txn, self.sizing)

    @cached_property
    def replay(self) -> DataFrame:
        """`processed` without the columns a replay does not read (texts stay behind early)."""
        return ledger.verify(self.txn, self.sizing, keep=())

    @cached_property
    def summary(self) -> DataFrame:
        """One row per statement. Kept, as every report starts from it; so are `meta` and
        `strategies`. Row-level tables are not."""
        return ledger.summarise(self.replay).persist()

    @cached_property
    def meta(self) -> DataFrame:
        return X.statement_meta(self.txn, self.read("nation")).persist()

    @cached_property
    def strategies(self) -> DataFrame:
        """Summaries of the first provider's statements under the three fee strategies."""
        return ledger.run_strategies(self.uatl, self.sizing).persist()

    @cached_property
    def customers(self) -> DataFrame:
        return X.customer_details(self.meta, self.read("customer"), self.read("supplier"))

    @cached_property
    def loans(self) -> DataFrame:
        return X.loans(self.read("orders"))

    @cached_property
    def pages(self) -> DataFrame:
        return X.page_text(self.read("documents"))

    @cached_property
    def requests(self) -> DataFrame:
        return X.stmt_requests(self.meta)

    @cached_property
    def customer_statements(self) -> DataFrame:
        return X.customer_statements(self.meta)

    @cached_property
    def leads(self) -> DataFrame:
        return X.leads(self.meta)

    @cached_property
    def reassessments(self) -> DataFrame:
        return X.reassessments(self.meta)

    @cached_property
    def borrowers(self) -> DataFrame:
        return X.borrowers(self.read("customer"))

    @cached_property
    def persons(self) -> DataFrame:
        return X.persons(self.read("supplier"))

    @cached_property
    def app_users(self) -> DataFrame:
        return X.app_users(self.loans)

    @cached_property
    def products(self) -> DataFrame:
        return X.loan_products(self.loans)

    @cached_property
    def classified(self) -> DataFrame:
        return verdict.classify(self.summary, self.meta)

    @cached_property
    def unified(self) -> DataFrame:
        return verdict.unified(self.meta, self.classified)


_KNOWN: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, folder: str) -> Tables:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _KNOWN:
        _KNOWN[key] = Tables(spark, folder)
    return _KNOWN[key]
