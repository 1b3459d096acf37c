"""Ordered windows over one series of any length, in many tasks.

A window without a partition key puts all rows into one task. Here the rows get their positions in the order first, and
consecutive positions form blocks of a fixed size. Frames of bounded width see the last rows of the block before, which are sent
along as its border; running totals add what the blocks before carry. Blocks are the only thing that is ordered globally.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ledgerspark.operators.windows import global_row_number

BLOCK_ROWS = 1 << 16
#: A value of each row, given the window that its order is in.
Frame = Callable[[WindowSpec], Column]


def with_positions(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Rows with their place in a total order from 0. The order must decide between any two rows."""
    return global_row_number(df, order, name).withColumn(name, F.col(name) - 1)


def bounded_frames(
    df: DataFrame, position: str, width: int, frames: Mapping[str, Frame], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Window values that look back at most ``width`` rows, over a series numbered without gaps from 0.

    Every row is read by its own block, and the last ``width`` rows of a block by the next one too.
    """
    if width > block_rows:
        raise ValueError(f"a frame of {width} rows does not fit a block of {block_rows}")
    block = F.floor(F.col(position) / block_rows).cast("long")
    border = F.pmod(F.col(position), F.lit(block_rows)) >= block_rows - width
    here, later = F.struct(block.alias("block"), F.lit(True).alias("own")), F.struct((block + 1).alias("block"), F.lit(False).alias("own"))
    seen = df.withColumn("__seen", F.explode(F.when(border, F.array(here, later)).otherwise(F.array(here))))
    window = Window.partitionBy("__seen.block").orderBy(position)
    valued = seen.withColumns({name: frame(window) for name, frame in frames.items()})
    return valued.filter("__seen.own").drop("__seen")


def rolling_sum_series(df: DataFrame, position: str, value: str, name: str, rows: int = 30, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sum of a row and the ``rows`` - 1 before it."""
    frame = {name: lambda window: F.sum(value).over(window.rowsBetween(1 - rows, Window.currentRow))}
    return bounded_frames(df, position, rows - 1, frame, block_rows)


def lag_series(df: DataFrame, position: str, value: str, name: str, offset: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Value ``offset`` rows earlier; NULL before that."""
    return bounded_frames(df, position, offset, {name: lambda window: F.lag(value, offset).over(window)}, block_rows)


def running_total(df: DataFrame, position: str, value: str, name: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sum of all rows up to a row: NULL until the first value. Exact for whole numbers and decimals; doubles are added block by block."""
    block = F.floor(F.col(position) / block_rows).cast("long")
    placed = df.withColumn("__block", block)
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        placed.groupBy("__block").agg(F.sum(value).alias("__sum"))
        .select("__block", F.sum("__sum").over(before).alias("__carried"))
    )
    local = F.sum(value).over(Window.partitionBy("__block").orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = placed.withColumn("__local", local).join(carried, on="__block", how="left")
    either = F.coalesce("__carried", "__local").isNotNull()
    zero = F.lit(0)
    total = F.when(either, F.coalesce("__carried", zero) + F.coalesce("__local", zero))
    return both.withColumn(name, total).drop("__block", "__local", "__carried")
