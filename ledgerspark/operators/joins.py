"""Join shapes. Equi-joins carry no hint: Catalyst and AQE broadcast a side only when its size allows it and
split hot keys otherwise. One-row inputs become scalar subqueries, so they need no join at all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def scalar_struct(one_row: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The only row of ``one_row`` as a struct value; NULL where it has no row.

    Catalyst runs it once as a subquery. More than one row is an error at run time, never a fan-out.
    """
    names = list(columns or one_row.columns)
    return one_row.select(F.struct(*names).alias("row")).scalar()


def scalar_cross_join(df: DataFrame, *one_rows: DataFrame) -> DataFrame:
    """Attach the values of one-row aggregates to every row."""
    held = df.withColumns({f"__row{place}": scalar_struct(row) for place, row in enumerate(one_rows)})
    values = [F.col(f"__row{place}.{name}").alias(name) for place, row in enumerate(one_rows) for name in row.columns]
    return held.select(*df.columns, *values)


# An optional row attaches the same way: without a row the struct, and so each value, is NULL.
left_join_on_true = scalar_cross_join


def using_left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, on=key, how="left")


def null_safe_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which a missing key matches a missing key, as window partitions do.

    The join hashes its own form of the keys, so both sides are shuffled for it even where ``right`` was just
    grouped by them. AQE splits a hot key only below such a shuffle.
    """
    renamed = right.withColumnsRenamed({key: f"__right_{key}" for key in keys})
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"__right_{key}"))
    return left.join(renamed, same, "left").drop(*[f"__right_{key}" for key in keys])


def composite_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on all grain columns of ``right``, where a shorter key would multiply rows; missing keys match
    nothing. A hot key on the left is split, also where ``right`` is a fresh aggregate."""
    return null_safe_left_join(left, right.dropna(subset=list(keys)), keys)


def conditional_left_join(left: DataFrame, right: DataFrame, key: str, right_predicate: Column) -> DataFrame:
    """Left join where only some right rows may match; filtering them first keeps the unmatched left rows."""
    return left.join(right.filter(right_predicate), on=key, how="left")


def null_safe_outer_join(
    left: DataFrame, right: DataFrame, key: str, left_value: str, right_value: str
) -> DataFrame:
    """Totals of two frames side by side, a missing side as 0 and a NULL key matching a NULL key.

    Grouping the union does what a null-safe full join would, with map-side combining for hot keys.
    """
    kind = left.schema[left_value].dataType
    gap = F.lit(None).cast(kind)
    both = left.select(key, F.col(left_value), gap.alias(right_value)).unionByName(
        right.select(key, gap.alias(left_value), F.col(right_value).cast(kind).alias(right_value))
    )
    zero = F.lit(0)
    return both.groupBy(key).agg(
        F.coalesce(F.sum(left_value), zero).alias(left_value),
        F.coalesce(F.sum(right_value), zero).alias(right_value),
    )


def visible_semi_join(mart: DataFrame, visible: DataFrame, key: str) -> DataFrame:
    """Mart rows whose key occurs among the visible rows. Keys are made distinct first, which combines a hot
    key map-side before anything moves."""
    return mart.join(visible.select(key).distinct(), on=key, how="left_semi")


def lookup_map_join(df: DataFrame, lookup: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Attach look-up columns by key, with a default where the key is unknown; a hot key on the left is split."""
    joined = composite_left_join(df, lookup.select(key, *defaults), [key])
    return joined.withColumns({name: F.coalesce(F.col(name), value) for name, value in defaults.items()})


def period_self_join(metrics: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """Current value beside comparison value per key, from one pass; keys without a current row drop out."""
    current = F.col(period) == "current"
    return (
        metrics.groupBy(key)
        .agg(
            F.max(F.when(current, F.col(value))).alias("current_value"),
            F.max(F.when(F.col(period) == "comparison", F.col(value))).alias("comparison_value"),
            F.bool_or(current).alias("__present"),
        )
        .filter("__present")
        .drop("__present")
    )


def anti_join(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key).distinct(), on=key, how="left_anti")
