"""Data-quality tests that return their findings as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def dq_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of missing values per column, in one pass over the frame."""
    counts = df.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in columns])
    return counts.unpivot([], list(columns), "column_name", "failures")


def dq_unique(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their number of rows."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
    return counted.agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def missing_columns(present: Sequence[str], required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(present))


def dq_required_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """``df`` unchanged, or an error that names every missing column."""
    missing = missing_columns(df.columns, required)
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def dq_grain_report(frames: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows against distinct keys per layer; a difference shows a fan-out.

    Keys are counted by grouping, so a repeated key combines before the shuffle.
    """
    report = None
    for layer, (df, keys) in frames.items():
        grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
        line = grouped.agg(
            F.lit(layer).alias("layer"),
            F.coalesce(F.sum("__rows"), F.lit(0)).alias("row_count"),
            F.count(F.lit(1)).alias("key_count"),
        )
        report = line if report is None else report.unionByName(line)
    if report is None:
        raise ValueError("no frames given")
    return report


def dq_columns(df: DataFrame, not_null: Sequence[str] = (), unique: Sequence[str] = ()) -> DataFrame:
    """Failures by column and test, from one scan and one exchange however many columns are tested.

    A row is expanded by what is tested in it: every value of a unique column, and a missing value of any other. Equal values
    of a column combine before the shuffle, so a hot one stays small. Values are compared as text, which is exact.
    """
    entries = []
    for name in dict.fromkeys([*not_null, *unique]):
        entry = F.struct(F.lit(name).alias("column_name"), F.col(name).cast("string").alias("value"))
        entries.append(entry if name in unique else F.when(F.col(name).isNull(), entry))
    if not unique and not_null:
        # Only rows that lack something have entries; the others are dropped before anything is built for them.
        df = df.where(reduce(Column.__or__, [F.col(name).isNull() for name in not_null]))
    counted = df.select(F.inline(F.array_compact(F.array(*entries)))).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    own, missing = F.col("column_name"), F.col("value").isNull()
    tests = {f"{name} not_null": F.sum(F.when((own == name) & missing, F.col("n"))) for name in not_null}
    tests |= {f"{name} unique": F.count_if((own == name) & ~missing & (F.col("n") > 1)) for name in unique}
    line = counted.agg(*[F.coalesce(value, F.lit(0)).cast("long").alias(name) for name, value in tests.items()])
    parts = F.split("finding", " (?=[a-z_]+$)")
    found = line.unpivot([], list(tests), "finding", "failures")
    return found.select(parts[0].alias("column_name"), parts[1].alias("test"), "failures")


def dq_declared(tables: Mapping[str, DataFrame], declared: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """Findings of declared tests, a row per table, column and test with its number of failures. One scan a table."""
    findings = []
    for name, tests in declared.items():
        found = dq_columns(tables[name], tests["not_null"], tests.get("unique", ()))
        findings.append(found.select(F.lit(name).alias("model"), "column_name", "test", "failures"))
    return reduce(DataFrame.unionByName, findings)


def require_declared(tables: Mapping[str, DataFrame], declared: Mapping[str, Mapping[str, Sequence[str]]]) -> None:
    """An error that names every failed test; its rows are few, one per failed test."""
    failed = dq_declared(tables, declared).filter("failures > 0").collect()
    if failed:
        raise ValueError("failed data tests: " + ", ".join(f"{r['model']}.{r['column_name']} {r['test']} ({r['failures']})" for r in failed))


def dq_missing_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row for each required column that a frame lacks."""
    missing = missing_columns(df.columns, required)
    return df.sparkSession.createDataFrame([(name,) for name in missing], "missing_column string")
