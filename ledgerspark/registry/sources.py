"""Scans, sources, sinks and caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark import testbed
from ledgerspark.operators.caches import cache_lookup, cache_upsert
from ledgerspark.constants import REQUIRED_COLUMNS
from ledgerspark.oracle.base import ALL_MARTS, LAYERS, WITH_DAILY, out
from ledgerspark.plans.daily import mart_daily_metric_runs, write_daily_mart
from ledgerspark.plans.marts import mart_monthly_spend
from ledgerspark.plans.pipeline import build_marts
from ledgerspark.registry.context import Context
from ledgerspark.session import scratch_path, stored
from ledgerspark.sources import files
from ledgerspark.sources.bucketed import BucketedCache
from ledgerspark.sources.warehouse import Warehouse, lenient_datetime

SNAKE = {
    "Transaction Date": "transaction_date_text",
    "Post Date": "post_date_text",
    "Description": "description",
    "Category": "category",
    "Type": "type",
    "Amount": "amount",
    "Memo": "memo",
}


def csv_scan(c: Context):
    return files.csv_scan(c.spark, c.export_path).drop("_metadata").withColumnsRenamed(SNAKE)


def latest_file_scan(c: Context):
    """The newer of two exports, each a folder of part files; the older one holds all other rows."""
    path = scratch_path(c.spark, "drop")
    urgent = F.col("Category").eqNullSafe(F.lit("1-URGENT"))
    names = [F.col(f"`{name}`") for name in REQUIRED_COLUMNS]
    for name, part in (("older.csv", ~urgent), ("newer.csv", urgent)):
        c.raw.filter(part).select(*names).write.option("header", True).csv(f"{path}/{name}")
    scan = files.latest_file_scan(c.spark, path)
    return scan.drop("_metadata").withColumnsRenamed(SNAKE)


def lineage_columns(c: Context):
    """The number of every row of an export whose files hold the transactions in the order of their keys."""
    path = scratch_path(c.spark, "ordered-export")
    names = [F.col(f"`{name}`") for name in REQUIRED_COLUMNS]
    c.raw.orderBy("source_row_number").select(*names).write.option("header", True).csv(path)
    rows = files.lineage_columns(files.csv_scan(c.spark, path), "test")
    return rows.withColumnsRenamed(SNAKE).select(
        "source_row_number", "source_mode", "transaction_date_text", "description", "amount"
    )


def row_hash_key(c: Context):
    return files.row_hash_key(c.raw).select(F.col("source_row_number").alias("row_number"), "row_hash")


def full_refresh_write(c: Context):
    house = Warehouse(c.spark, scratch_path(c.spark, "refresh"))
    names = ["transaction_id", "transaction_date", "raw_description", "amount"]
    first = house.full_refresh_write(c.staged.select(*names), "staged")
    house.full_refresh_write(first.withColumn("amount", -F.col("amount")), "staged")
    return house.table("staged")


def seed_scan(c: Context):
    """Rules for every segment and nation in use, written as a seed file and read back."""
    path = scratch_path(c.spark, "seed")
    joined = testbed.orders_with_customer(c.spark, c.dir)
    joined.select(
        F.concat_ws(" ", "c_mktsegment", "n_name").alias("pattern"),
        F.concat(F.lit("Shop "), "n_name").alias("normalized_merchant"),
        F.col("c_mktsegment").alias("merchant_group"),
        F.lit("Shopping").alias("default_category"),
    ).distinct().write.option("header", True).csv(path)
    return files.seed_scan(c.spark, path)


def mart_scan(c: Context):
    house = Warehouse(c.spark, scratch_path(c.spark, "marts"))
    house.full_refresh_write(mart_monthly_spend(c.fact), "mart_monthly_spend")
    return house.mart_scan("mart_monthly_spend")


def _versions(c: Context, new: bool, key: str = "c_mktsegment"):
    """Orders as versions of cache rows by description and priority; finished orders are the old cache."""
    day = F.col("o_orderdate").cast("date").cast("timestamp")
    finished = F.col("o_orderstatus") == "F"
    joined = testbed.orders_with_customer(c.spark, c.dir)
    return joined.filter(~finished if new else finished).select(
        key,
        F.col("o_orderpriority").alias("model"),
        F.col("o_orderkey").alias("version"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        day.alias("created_at"),
    )


def upsert(c: Context):
    keys, old = ["c_mktsegment", "model"], _versions(c, False)
    cache = cache_upsert(old.limit(0), old, keys)
    return cache_upsert(cache, _versions(c, True), keys)


def bucketed_upsert(c: Context):
    """The same versions by customer, in a stored cache of buckets."""
    old, new = (stored(_versions(c, fresh, "o_custkey"), "versions") for fresh in (False, True))
    tasks = int(c.spark.conf.get("spark.sql.shuffle.partitions"))
    cache = BucketedCache(c.spark, scratch_path(c.spark, "bucketed"), old.schema, ["o_custkey", "model"], buckets=tasks)
    cache.upsert(old)
    return cache.upsert(new)


def lookup(c: Context):
    ids = c.staged.select("raw_description")
    return cache_lookup(ids, c.enrichment_cache, "raw_description", "model", testbed.MODEL).drop("created_at")


def lenient(c: Context):
    mixed = F.when(F.col("o_orderstatus") == "P", F.lit("not a date")).otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    )
    rows = c.table("orders").select("o_orderkey", mixed.alias("order_date"), F.col("o_orderpriority").alias("due_date"))
    return lenient_datetime(rows, ["order_date", "due_date"])


def materialise_layers(c: Context):
    """Row counts of every mart after writing all of them."""
    house = Warehouse(c.spark, scratch_path(c.spark, "warehouse"))
    counts = None
    for name, frame in build_marts(c.layers).items():
        if name == "mart_daily_metric_values":
            written = write_daily_mart(mart_daily_metric_runs(c.fact), house, name)
        else:
            written = house.full_refresh_write(frame, name)
        line = written.agg(F.lit(name).alias("mart"), F.count("*").alias("row_count"))
        counts = line if counts is None else counts.unionByName(line)
    return counts


MART_CTES = {
    "fct_transactions": "fact",
    "mart_anomalies": "(select * from fact where is_anomaly)",
    "mart_recurring_spend": "recurring_mart",
    "mart_monthly_spend": "monthly_spend",
    "mart_monthly_kpis": "monthly_kpis",
    "mart_category_metrics": "category_metrics",
    "mart_spend_kpis": "spend_totals",
    "mart_data_quality": "source_quality",
    "mart_merchant_review": "review",
    "mart_metric_summary": "period_pairs",
    "mart_daily_metric_values": "dense",
}

ENTRIES = {
    "csv_scan": (
        csv_scan,
        LAYERS + "select transaction_date_text, post_date_text, description, category, type, amount, "
        "null::varchar as memo from raw_export",
    ),
    "latest_file_scan": (
        latest_file_scan,
        LAYERS + "select transaction_date_text, post_date_text, description, category, type, amount, "
        "null::varchar as memo from raw_export where category = '1-URGENT'",
    ),
    "lineage_columns": (
        lineage_columns,
        LAYERS + "select row_number() over (order by source_row_number) as source_row_number, 'test' as source_mode, "
        "transaction_date_text, description, amount from raw_export",
    ),
    "row_hash_key": (
        row_hash_key,
        LAYERS + "select source_row_number as row_number, sha256(concat_ws('|', source_row_number::varchar, "
        "transaction_date_text, post_date_text, description, coalesce(category, ''), type, amount, '')) as row_hash "
        "from raw_export",
    ),
    "full_refresh_write": (
        full_refresh_write,
        LAYERS + "select " + out("s:transaction_id;d:transaction_date;s:raw_description;n:amount=-amount")
        + " from staged",
    ),
    "seed_scan": (
        seed_scan,
        "select distinct c_mktsegment || ' ' || n_name as pattern, 'Shop ' || n_name as normalized_merchant, "
        "c_mktsegment as merchant_group, 'Shopping' as default_category, "
        "upper(c_mktsegment || ' ' || n_name) as match_text "
        "from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey",
    ),
    "mart_scan": (
        mart_scan,
        ALL_MARTS + "select "
        + out("d:month;s:final_category;n:total_spend;i:transaction_count;n:avg_transaction_amount;"
              "n:mom_change_amount;n:mom_change_pct") + " from monthly_spend",
    ),
    "cache_upsert": (
        upsert,
        "with versions as (select c_mktsegment, o_orderpriority as model, o_orderkey as version, "
        "o_totalprice::decimal(18,2) as amount, o_orderdate::date as day, o_orderstatus <> 'F' as fresh "
        "from orders join customer on c_custkey = o_custkey) "
        "select c_mktsegment, model, version, " + out("n:amount")
        + ", strftime(day, '%Y-%m-%d 00:00:00') as created_at from ("
        "select *, row_number() over (partition by c_mktsegment, model order by day desc, fresh desc, version desc) "
        "as place from versions) where place = 1",
    ),
    "bucketed_cache_upsert": (
        bucketed_upsert,
        "with versions as (select o_custkey, o_orderpriority as model, o_orderkey as version, "
        "o_totalprice::decimal(18,2) as amount, o_orderdate::date as day, o_orderstatus <> 'F' as fresh "
        "from orders) "
        "select o_custkey, model, version, " + out("n:amount")
        + ", strftime(day, '%Y-%m-%d 00:00:00') as created_at from ("
        "select *, row_number() over (partition by o_custkey, model order by day desc, fresh desc, version desc) "
        "as place from versions) where place = 1",
    ),
    "cache_lookup": (
        lookup,
        LAYERS + "select raw_description, suggested_merchant, suggested_category, suggested_merchant_group, "
        + out("n:confidence") + ", reasoning, model from enrichments "
        "where raw_description in (select raw_description from staged)",
    ),
    "lenient_datetime": (
        lenient,
        "select o_orderkey, case when o_orderstatus <> 'P' then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end "
        "as order_date, null::varchar as due_date from orders",
    ),
    "materialise_layers": (
        materialise_layers,
        WITH_DAILY
        + " union all ".join(
            f"select '{mart}' as mart, (select count(*) from {cte}) as row_count" for mart, cte in MART_CTES.items()
        ),
    ),
}
