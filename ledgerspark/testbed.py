"""Card transactions derived from the order tables, so that every job runs on the given data.

Each order becomes one transaction of its customer's segment and nation. Household orders are constant small
charges of a club, which lets recurrence fire; among the others every 211th order is an outlier; some pending
orders are credits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerspark.schemas import ENRICHMENT_CACHE
from ledgerspark.sources.files import rules_frame

MODEL = "profile-model"
EMBED_MODEL = "embed-model"
CACHE_TIME = "2024-01-01 00:00:00"

RULES = [
    ("BUILDING", "Builder", "Construction", "Shopping"),
    ("BUILDING NATION_1", "Builder One", "Construction", "Home"),
    ("MACHINERY", "Machines", "Industrial", "Professional Services"),
]
RULE_COLUMNS = ["pattern", "normalized_merchant", "merchant_group", "default_category"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_with_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )


def raw_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw card-export rows, all source columns as text, with lineage and key."""
    joined = orders_with_customer(spark, sf_dir)
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    household = F.col("c_mktsegment") == "HOUSEHOLD"
    club = F.concat(F.lit("Household Club "), F.floor(F.col("o_custkey") / 8).cast("string"))
    price = F.col("o_totalprice").cast("decimal(18,2)")
    outlier = F.when(key % 211 == 0, (price * 15).cast("decimal(18,2)")).otherwise(price)
    size = F.when(household, F.lit("19.99").cast("decimal(18,2)")).otherwise(outlier)
    credit = (F.col("o_orderstatus") == "P") & (key % 5 == 0)
    return joined.select(
        F.date_format(day, "MM/dd/yyyy").alias("Transaction Date"),
        F.date_format(F.date_add(day, 1), "MM/dd/yyyy").alias("Post Date"),
        F.when(household, club).otherwise(F.concat_ws(" ", "c_mktsegment", "n_name")).alias("Description"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("Category"),
        F.when(credit, "Payment").otherwise("Sale").alias("Type"),
        F.when(credit, size).otherwise(-size).cast("string").alias("Amount"),
        F.lit("").alias("Memo"),
        key.alias("source_row_number"),
        F.lit("orders.parquet").alias("source_file"),
        F.lit("test").alias("source_mode"),
        F.lit(CACHE_TIME).alias("ingested_at"),
        key.cast("string").alias("row_hash"),
    )


def merchant_rules(spark: SparkSession) -> DataFrame:
    rules = ", ".join(str(rule) for rule in RULES)
    return rules_frame(spark.sql(f"select * from values {rules} as t({', '.join(RULE_COLUMNS)})"))


def enrichment_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cached suggestion for the automobile description of every nation, with varied confidence."""
    nation, number = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    confidence = (
        F.when(number % 4 == 0, F.lit(0.95)).when(number % 4 == 1, F.lit(0.70)).when(number % 4 == 2, F.lit(0.65))
    )
    frame = nation.select(
        F.concat(F.lit("AUTOMOBILE "), "n_name").alias("raw_description"),
        F.concat(F.lit("Motors "), "n_name").alias("suggested_merchant"),
        F.when(number % 5 != 0, "Travel").alias("suggested_category"),
        F.lit("Automotive").alias("suggested_merchant_group"),
        confidence.alias("confidence"),
        F.concat(F.lit("Looks like a garage in "), "n_name").alias("reasoning"),
        F.lit(MODEL).alias("model"),
        F.lit(CACHE_TIME).cast("timestamp").alias("created_at"),
    )
    return frame.select(*ENRICHMENT_CACHE.fieldNames())


# Query texts; the last one is too short to be searched. Each takes the vector of the same number.
QUERIES = [
    (0, "building construction"),
    (1, "  Streaming "),
    (2, "household club"),
    (3, "travel motors and anomaly"),
    (4, "the Professional Services of machines"),
    (5, "ab"),
]


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ", ".join(f"({number}L, '{query}')" for number, query in QUERIES)
    queries = spark.sql(f"select * from values {texts} as t(query_id, query_text)")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return queries.join(vectors, on="query_id", how="left")


def conversation_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the conversations as a query."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query_text"), "role")


def with_vectors(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by ``transaction_id`` with the vector of each: customers share the given vectors in turn. Rows first meet the number
    of their vector and then the vector, so that vectors are not moved by transaction."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    number = vectors.agg(F.count("*").alias("n")).scalar()
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("transaction_id"), F.pmod("o_custkey", number).alias("vec_id")
    )
    return rows.join(orders, on="transaction_id").join(vectors, on="vec_id").drop("vec_id")


def profile_cache(fact: DataFrame) -> DataFrame:
    """Cached profiles of the mapped merchants."""
    mapped = fact.filter("merchant_group <> 'Unmapped'").groupBy("normalized_merchant").agg(
        F.min("merchant_group").alias("merchant_group"), F.min("final_category").alias("final_category")
    )
    return mapped.select(
        "normalized_merchant",
        "merchant_group",
        "final_category",
        F.concat(F.lit("Known for "), "merchant_group").alias("merchant_summary"),
        F.array(F.lit("shopping"), F.lower("final_category")).alias("semantic_tags"),
        F.lit("").alias("reasoning"),
        F.lit(MODEL).alias("model"),
        F.lit(CACHE_TIME).cast("timestamp").alias("created_at"),
    )


def shared_letters(query: str, texts: list[str]) -> list[float]:
    """Stand-in for a rerank model: how much longer than the query a text is."""
    return [float(len(text) - len(query)) for text in texts]


def letter_counts(texts: list[str]) -> list[list[float]]:
    """Stand-in for an embedding model: text length and vowel counts."""
    return [[float(len(text)), *[float(text.count(vowel)) for vowel in "aeiou"]] for text in texts]
