"""Stored layers: full-refresh writes, ordered mart reads, cache tables that are replaced as a whole."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ledgerspark.operators.ordering import sort_columns
from ledgerspark.sources.days import local_path, write_days
from ledgerspark.sources.files import file_system

# Display order of each mart.
MART_ORDER: dict[str, list[tuple[str, str]]] = {
    "fct_transactions": [("transaction_date", "desc")],
    "mart_monthly_spend": [("month", "asc")],
    "mart_anomalies": [("severity_score", "desc")],
    "mart_recurring_spend": [("estimated_monthly_cost", "desc")],
    "mart_merchant_review": [("needs_review", "desc"), ("review_priority_score", "desc")],
    "mart_spend_kpis": [],
    "mart_monthly_kpis": [("month", "asc")],
    "mart_category_metrics": [("total_spend", "desc")],
    "mart_data_quality": [("total_spend", "desc")],
    "mart_metric_summary": [("metric_group", "asc"), ("metric_label", "asc")],
    "mart_daily_metric_values": [("metric_date", "asc"), ("metric_group", "asc"), ("metric_name", "asc")],
}


def frame_writer(df: DataFrame, partition_by: Sequence[str]):
    writer = df.write.mode("errorifexists")
    return writer.partitionBy(*partition_by) if partition_by else writer


class Warehouse:
    """A folder of parquet tables that a refresh replaces as a whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def full_refresh_write(self, df: DataFrame, table: str, partition_by: Sequence[str] = ()) -> DataFrame:
        """Replace a table by a frame; returns the stored table.

        The frame is written beside the table, and the two are swapped when it is complete. A write that fails leaves the
        table as it was, and a frame may read the table that it replaces.
        """
        fresh = f"{self.path(table)}.next-{uuid.uuid4().hex}"
        frame_writer(df, partition_by).parquet(fresh)
        self.swap(fresh, self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def full_refresh_days(self, steady: DataFrame, table: str, day: str) -> DataFrame:
        """As ``full_refresh_write`` for rows that hold on the days from ``begins`` to ``ends``: the table has each of them once for
        every day, with the date as column ``day`` in the place of ``begins``. Folders that tasks cannot open take Spark's writer."""
        fresh = f"{self.path(table)}.next-{uuid.uuid4().hex}"
        days = F.explode(F.sequence("begins", "ends", F.expr("interval 1 day")))
        dense = steady.where("begins <= ends").withColumn("begins", days).withColumnRenamed("begins", day).drop("ends")
        folder = local_path(fresh)
        if folder:
            write_days(steady, folder, day)
        else:
            frame_writer(dense, ()).parquet(fresh)
        self.swap(fresh, self.path(table))
        return self.spark.read.schema(dense.schema).parquet(self.path(table))

    def append(self, df: DataFrame, table: str, partition_by: Sequence[str] = ()) -> DataFrame:
        """Add rows to a table as new files; what is there stays untouched. Returns the stored table."""
        frame_writer(df, partition_by).mode("append").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def replace_partitions(self, df: DataFrame, table: str, partition_by: Sequence[str]) -> DataFrame:
        """Replace the partitions that a frame has rows for; the files of all others keep their names. The frame may not
        read the table. Returns the stored table."""
        writer = frame_writer(df, partition_by).mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def declared(self, table: str, schema: StructType) -> DataFrame:
        """A table under a given schema; an empty frame where there is no table."""
        try:
            return self.spark.read.schema(schema).parquet(self.path(table))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def swap(self, fresh: str, current: str) -> None:
        """Put a complete folder in the place of another one, which goes when the new one is there."""
        new, system = file_system(self.spark, fresh)
        old, aside = (file_system(self.spark, name)[0] for name in (current, fresh.replace(".next-", ".old-")))
        held = system.exists(old)
        if held and not system.rename(old, aside):
            raise OSError(f"cannot move {current} aside")
        done = False
        try:
            done = system.rename(new, old)
        finally:
            if held and not done:
                system.rename(aside, old)
        if not done:
            raise OSError(f"cannot put {fresh} in the place of {current}")
        if held:
            system.delete(aside, True)

    def table(self, table: str, empty: StructType | None = None) -> DataFrame:
        """A table, or an empty frame of the given schema where there is none."""
        try:
            return self.spark.read.parquet(self.path(table))
        except AnalysisException as error:
            if empty is None or error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], empty)

    def mart_scan(self, table: str, empty: StructType | None = None) -> DataFrame:
        """A mart in its display order; one that was never written is an empty frame of the given schema."""
        frame = self.table(table, empty)
        order = [key for key in MART_ORDER.get(table, []) if key[0] in frame.columns]
        return frame.orderBy(*sort_columns(order)) if order else frame


def lenient_datetime(df: DataFrame, columns: Sequence[str], pattern: str | None = None) -> DataFrame:
    """Date-like text to timestamps; text that is no date becomes NULL instead of an error."""
    form = [F.lit(pattern)] if pattern else []
    return df.withColumns({name: F.try_to_timestamp(F.col(name), *form) for name in columns})
