"""Registered queries: a callable per operator, and the SQL an independent engine answers it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.registry import expressions, marts, relational, search, sources
from ledgerspark.registry.context import Context, context, present

ENTRIES: dict[str, tuple[Callable[[Context], DataFrame], str | None]] = {
    **sources.ENTRIES,
    **expressions.ENTRIES,
    **relational.ENTRIES,
    **marts.ENTRIES,
    **search.ENTRIES,
}


def _runner(build: Callable[[Context], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(build(context(spark, sf_dir)))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(build) for name, (build, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}
