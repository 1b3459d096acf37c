"""Sorts and limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerspark.constants import DISPLAY_ORDER, UNLISTED_POSITION


def sort_columns(keys: Sequence[tuple[str, str]]) -> list[Column]:
    """(column, direction) pairs as sort columns; missing values always come last."""
    return [F.desc_nulls_last(name) if way == "desc" else F.asc_nulls_last(name) for name, way in keys]


def multi_key_sort(df: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    return df.orderBy(*sort_columns(keys))


def top_k_limit(df: DataFrame, keys: Sequence[tuple[str, str]], k: int) -> DataFrame:
    """The first ``k`` rows in an order. Sort and limit stay adjacent, so each task keeps only ``k`` rows."""
    return df.orderBy(*sort_columns(keys)).limit(k)


def top_one(df: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    return top_k_limit(df, keys, 1)


def display_position(key: Column, listed: Sequence[str] = DISPLAY_ORDER) -> Column:
    """Place of a key in a fixed list; keys outside it come after all listed ones."""
    place = F.array_position(F.array(*[F.lit(name) for name in listed]), key)
    return F.when(place > 0, place - 1).otherwise(F.lit(UNLISTED_POSITION)).cast("int")


def display_order_sort(df: DataFrame, key: str, then: Sequence[str] = ()) -> DataFrame:
    positioned = df.withColumn("sort_order", display_position(F.col(key)))
    return positioned.orderBy("sort_order", *[F.asc_nulls_last(name) for name in then])
