"""What the registered queries share: the derived frames of one data folder, each stored at most once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerspark import testbed
from ledgerspark.constants import REQUIRED_COLUMNS
from ledgerspark.functions.amounts import parse_us_date, rounded
from ledgerspark.plans.marts import mart_merchant_review, mart_recurring_spend
from ledgerspark.plans.cube import write_cube
from ledgerspark.plans.daily import mart_daily_metric_values
from ledgerspark.plans.incremental import Stored, marts_of_states, refresh_changed, refresh_whole
from ledgerspark.plans.pipeline import Layers, build_layers
from ledgerspark.plans.search import attach_embeddings, build_search_documents, profile_lookup
from ledgerspark.session import prepare, scratch_path, stored
from ledgerspark.sources.warehouse import Warehouse


class Context:
    """Lazily built inputs over ``sf_dir``; the warehouse layers are written on first use, as in a refresh."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return testbed.table(self.spark, self.dir, name)

    @property
    def raw(self) -> DataFrame:
        return testbed.raw_export(self.spark, self.dir)

    @property
    def rules(self) -> DataFrame:
        return testbed.merchant_rules(self.spark)

    @property
    def enrichment_cache(self) -> DataFrame:
        return testbed.enrichment_cache(self.spark, self.dir)

    @cached_property
    def layers(self) -> Layers:
        return build_layers(self.raw, self.rules, self.enrichment_cache)

    @property
    def staged(self) -> DataFrame:
        return self.layers.staged

    @property
    def fact(self) -> DataFrame:
        return self.layers.fact

    @cached_property
    def cube(self) -> DataFrame:
        return write_cube(self.fact, Warehouse(self.spark, scratch_path(self.spark, "cube")))

    @property
    def recurring_mart(self) -> DataFrame:
        return mart_recurring_spend(self.layers.recurring)

    @property
    def review(self) -> DataFrame:
        return mart_merchant_review(self.fact)

    @property
    def daily(self) -> DataFrame:
        return mart_daily_metric_values(self.fact)

    @cached_property
    def export_path(self) -> str:
        """The transactions as a folder of card-export CSV files."""
        path = scratch_path(self.spark, "export")
        self.raw.select(*[F.col(f"`{name}`") for name in REQUIRED_COLUMNS]).write.option("header", True).csv(path)
        return path

    @cached_property
    def loaded(self) -> Stored:
        """The transactions in two loads: the second one repeats a year of the first and brings late rows of another."""
        warehouse = Warehouse(self.spark, scratch_path(self.spark, "loads"))
        year = F.year(parse_us_date(F.col("Transaction Date")))
        late = (year == 1997) & F.col("Category").eqNullSafe("5-LOW")
        refresh_whole(self.raw.filter((year <= 1998) & ~late), self.rules, self.enrichment_cache, warehouse)
        return refresh_changed(self.raw.filter((year >= 1998) | late), self.rules, self.enrichment_cache, warehouse)

    @cached_property
    def loaded_marts(self) -> dict[str, DataFrame]:
        return marts_of_states(self.loaded)

    @cached_property
    def profiles(self) -> DataFrame:
        """The cache of profiles as the stored table it is: a row per mapped merchant, whose size Catalyst knows."""
        return stored(testbed.profile_cache(self.fact), "profiles")

    @cached_property
    def documents(self) -> DataFrame:
        return stored(build_search_documents(self.fact, profile_lookup(self.profiles, testbed.MODEL)), "documents")

    @cached_property
    def embedding_cache(self) -> DataFrame:
        """Vectors of all transactions under the current texts, as the stored cache table they are."""
        cache = testbed.with_vectors(self.documents.select("transaction_id", "search_text"), self.spark, self.dir).select(
            "transaction_id",
            F.lit(testbed.EMBED_MODEL).alias("embedding_model"),
            "search_text",
            "embedding",
            F.lit(testbed.CACHE_TIME).cast("timestamp").alias("created_at"),
        )
        return stored(cache, "embedding-cache")

    @property
    def queries(self) -> DataFrame:
        return testbed.search_queries(self.spark, self.dir)

    @property
    def searchable(self) -> DataFrame:
        return attach_embeddings(self.documents, self.embedding_cache, testbed.EMBED_MODEL)


_contexts: dict[tuple[str, str], Context] = {}


def context(spark: SparkSession, sf_dir: str) -> Context:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _contexts:
        _contexts[key] = Context(spark, sf_dir)
    return _contexts[key]


def present(df: DataFrame) -> DataFrame:
    """Values in forms every engine shares: numbers rounded to six digits, dates and lists as text."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.DecimalType, T.DoubleType, T.FloatType)):
            column = rounded(column, 6)
        elif isinstance(kind, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            column = F.array_join(column, "|")
        elif isinstance(kind, T.ArrayType):
            column = F.array_join(F.transform(column, lambda x: F.round(x.cast("double"), 3).cast("string")), "|")
        elif isinstance(kind, (T.IntegerType, T.ShortType)):
            column = column.cast("long")
        columns.append(column.alias(field.name))
    return df.select(*columns)
