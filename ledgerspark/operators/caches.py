"""Keyed caches as tables: look-up, upsert, staleness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def cache_lookup(ids: DataFrame, cache: DataFrame, key: str, model_column: str, model: str) -> DataFrame:
    """Cached rows of one model for a set of ids, as a join rather than a literal list."""
    return cache.filter(F.col(model_column) == model).join(ids.select(key).distinct(), on=key, how="left_semi")


def cache_upsert(
    cache: DataFrame, new: DataFrame, keys: Sequence[str], order: str = "created_at"
) -> DataFrame:
    """Insert or replace by key: the latest version of each key, a new row winning over an old one of equal age.

    ``cache`` holds one row per key. New versions of one key combine before their shuffle, remaining ties are
    broken by the other columns, and one outer join with the cache then reads either input once.
    """
    keys, columns = list(keys), cache.columns
    rest = [name for name in columns if name not in (*keys, order)]
    latest = new.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("__new"))
    held = cache.select(*keys, F.struct(order, *rest).alias("__old"))
    newer = F.col("__new").isNotNull() & F.coalesce(F.col(f"__new.{order}") >= F.col(f"__old.{order}"), F.lit(True))
    merged = held.join(latest, on=keys, how="full").withColumn("__row", F.when(newer, F.col("__new")).otherwise(F.col("__old")))
    return merged.select(*[name if name in keys else F.col(f"__row.{name}").alias(name) for name in columns])


def stale_cache_split(docs: DataFrame, cache: DataFrame, key: str, text: str, model: str) -> DataFrame:
    """Each document with its cache state: hit (same text), stale (text changed) or new."""
    held = cache.filter(F.col("embedding_model") == model).select(
        key, F.col(text).alias("__cached_text"), F.lit(True).alias("__cached")
    )
    status: Column = (
        F.when(F.col("__cached").isNull(), "new")
        .when(F.col("__cached_text").eqNullSafe(F.col(text)), "hit")
        .otherwise("stale")
    )
    return docs.join(held, on=key, how="left").withColumn("status", status).drop("__cached_text", "__cached")


def backfill_stats(split: DataFrame) -> DataFrame:
    """Counts a back-fill reports: documents, cache hits, rows to embed, of which stale."""
    status = F.col("status")
    return split.agg(
        F.count(F.lit(1)).alias("document_count"),
        F.count_if(status == "hit").alias("cache_hits"),
        F.count_if(status != "hit").alias("embedded_now"),
        F.count_if(status == "stale").alias("stale_rows"),
    )
