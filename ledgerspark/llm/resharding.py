"""Operator 13: resharding by minimum-cost flow.

Rows lie in old shards of uneven size. Each old shard is seen as ``BLOCKS`` blocks of whole rows, whose sizes are all that
reaches the driver. A minimum-cost flow from the old sizes to the new capacities, free where bytes stay and
at a price where they move, gives the bytes to transfer between each two shards with the fewest bytes moved. Blocks are
then chosen to make up each transfer, the largest that fit first, and exchanged with blocks that stay while this comes closer.
Only rows of moved blocks change their shard; in a written layout only the files of moved blocks are written again.

The driver holds ``BLOCKS`` rows an old shard and the plan, whatever the corpus; looked up, the plan is as small. Rows
are dealt to blocks by their number in the written old shards, so equal rows and missing ids are spread like any others.

Rows do move: the old shards are written as folders of whole rows, rows of moved blocks are written again below their new
shard, and what is returned is read from the shards as they then are, so that sizes and checksums are those of texts that arrived.

Defined results: a null text has no bytes, and every row counts one byte more than its text; rows without an old shard, or
from one that is given up, all move; repeated rows are placed each; an empty table gives an empty result; all columns of a
row move with it.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerspark.session import scratch_path, stored

BLOCKS = 1024
SHARDS = 8
#: The old shard of rows that have none.
NOWHERE = -1
#: Exchanges tried to bring one transfer closer to its flow.
EXCHANGES = 16


class Block(NamedTuple):
    old: int
    block: int
    size: int
    rows: int


def capacities(total: int, shards: int) -> list[int]:
    """Sizes as equal as they can be."""
    return [total // shards + (shard < total % shards) for shard in range(shards)]


def minimum_cost_flow(supply: Sequence[int], demand: Sequence[int], cost: Sequence[Sequence[int]]) -> np.ndarray:
    """Units from each supply to each demand, all of them, at the least total cost, by successive cheapest paths.

    The sums of supply and demand are equal. The network has a node for each shard, so its size does not grow with the data.
    """
    flow = np.zeros((len(supply), len(demand)), dtype=np.int64)
    left, open_ = list(supply), list(demand)
    while any(left):
        # Cheapest path from any supply that has units left, over units already sent that may be sent elsewhere.
        far = [0 if units else None for units in left], [None] * len(demand)
        came: tuple[list, list] = [None] * len(supply), [None] * len(demand)
        waiting = deque(i for i, units in enumerate(left) if units)
        while waiting:
            i = waiting.popleft()
            for j in range(len(demand)):
                length = far[0][i] + cost[i][j]
                if far[1][j] is None or length < far[1][j]:
                    far[1][j], came[1][j] = length, i
                    for k in np.flatnonzero(flow[:, j]).tolist():
                        back = length - cost[k][j]
                        if far[0][k] is None or back < far[0][k]:
                            far[0][k], came[0][k] = back, j
                            waiting.append(k)
        j = min((j for j, units in enumerate(open_) if units), key=lambda j: far[1][j])
        path, units, end = [], open_[j], j
        while j is not None:
            i = came[1][j]
            path.append((i, j))
            j = came[0][i]
            units = min(units, flow[i, j]) if j is not None else min(units, left[i])
        for step, (i, j) in enumerate(path):
            flow[i, j] += units
            if step + 1 < len(path):
                flow[i, path[step + 1][1]] -= units
        left[path[-1][0]] -= units
        open_[end] -= units
    return flow


def chosen(sizes: np.ndarray, amount: int) -> np.ndarray:
    """Marks of sizes whose sum comes close to ``amount``."""
    picked = np.zeros(len(sizes), dtype=bool)
    open_ = amount
    for at in np.argsort(-sizes, kind="stable"):
        if 0 < sizes[at] <= open_:
            picked[at] = True
            open_ -= int(sizes[at])
    for _ in range(EXCHANGES):
        out, into = np.flatnonzero(picked), np.flatnonzero(~picked)
        if not open_ or not len(out) or not len(into):
            break
        into = into[np.argsort(sizes[into], kind="stable")]
        right = np.searchsorted(sizes[into], sizes[out] + open_)
        pairs = [(np.abs(sizes[into[at]] - sizes[out] - open_), at) for at in (np.clip(right - 1, 0, None), np.clip(right, None, len(into) - 1))]
        gap, at = min(pairs, key=lambda pair: pair[0].min())
        best = int(gap.argmin())
        if gap[best] >= abs(open_):
            break
        gone, come = out[best], into[at[best]]
        picked[gone], picked[come] = False, True
        open_ += int(sizes[gone] - sizes[come])
    return picked


def transfers(blocks: Sequence[Block], shards: int, cost: Sequence[Sequence[int]] | None = None) -> dict[tuple[int, int], int]:
    """The new shard of each (old shard, block). By default a byte that stays costs nothing and one that moves costs 1."""
    olds = sorted({block.old for block in blocks})
    supply = [sum(block.size for block in blocks if block.old == old) for old in olds]
    prices = cost or [[int(old != shard) for shard in range(shards)] for old in olds]
    flow = minimum_cost_flow(supply, capacities(sum(supply), shards), prices)
    goes: dict[tuple[int, int], int] = {}
    for row, old in zip(flow, olds):
        open_ = [block for block in blocks if block.old == old]
        targets = sorted((shard for shard in range(shards) if row[shard]), key=lambda shard: (shard != old, -row[shard]))
        rest = targets[0] if targets else 0
        for shard in targets[:0:-1]:
            picked = chosen(np.array([block.size for block in open_], dtype=np.int64), int(row[shard]))
            goes.update({(block.old, block.block): shard for block, is_picked in zip(open_, picked) if is_picked})
            open_ = [block for block, is_picked in zip(open_, picked) if not is_picked]
        goes.update({(block.old, block.block): rest for block in open_})
    return goes


def block_sizes(sized: DataFrame) -> list[Block]:
    """At most ``BLOCKS`` rows an old shard."""
    found = sized.groupBy("old", "block").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    return sorted(Block(row.old, row.block, row.size, row.rows) for row in found.collect())


def size_of(text: str) -> Column:
    return (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + 1).cast("bigint")


class Shards(NamedTuple):
    """Old shards that are written, and what of them moved. ``stayed`` and ``moved`` (record: the whole row, number, old, block,
    shard, start: the rows of the shard in blocks before) are together all rows, read from where they now lie."""

    stayed: DataFrame
    moved: DataFrame
    old_path: str
    new_path: str


def written(rows: DataFrame, path: str, shard: str) -> DataFrame:
    """The rows as they are read again, from a folder for each value of ``shard``. Nothing is shuffled."""
    rows.write.mode("errorifexists").partitionBy(shard).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def move_rows(documents: DataFrame, old_shard: Column, shards: int = SHARDS, blocks: int = BLOCKS, text_column: str = "text") -> Shards:
    """Write the old shards, plan, and write the rows of the blocks that move below their new shard; the others stay in their
    files."""
    spark = documents.sparkSession
    old_path, new_path = scratch_path(spark, "old-shards"), scratch_path(spark, "new-shards")
    rows = documents.select(
        F.struct("*").alias("record"),
        size_of(text_column).alias("size"),
        F.monotonically_increasing_id().alias("number"),
        F.coalesce(old_shard.cast("int"), F.lit(NOWHERE)).alias("old"),
    )
    numbered = written(rows, old_path, "old").withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int"))
    found = block_sizes(numbered)
    goes = transfers(found, shards)
    plan, used = [], [0] * shards
    for block in found:
        shard = goes[block.old, block.block]
        plan.append((block.old, block.block, shard, used[shard]))
        used[shard] += block.rows
    # As many rows as blocks, which are bounded.
    placed = F.broadcast(spark.createDataFrame(plan, "old int, block int, shard int, start bigint"))
    lies = numbered.drop("size").join(placed, ["old", "block"])
    moved = written(lies.where("shard <> old"), new_path, "shard")
    return Shards(lies.where("shard = old"), moved, old_path, new_path)


def reshard(
    documents: DataFrame, old_shard: Column, shards: int = SHARDS, blocks: int = BLOCKS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Move the documents; the new shard of every one and its number there, with its size, checksum and old shard, as they
    are read from the new shards.

    ``old_shard`` is a whole number or null. How many old shards there are must not grow with the data.
    """
    lies = move_rows(documents, old_shard, shards, blocks, text_column)
    content = F.coalesce(F.col(f"record.`{text_column}`"), F.lit("")).cast("binary")
    slim = lies.stayed.unionByName(lies.moved).select(
        F.col(f"record.`{id_column}`").alias("doc_id"),
        size_of(f"record`.`{text_column}").alias("size"),
        F.crc32(content).alias("text_crc32"),
        "old",
        "block",
        "shard",
        "start",
        "number",
    )
    order = Window.partitionBy("old", "block").orderBy("number")
    return slim.withColumn("rank", F.row_number().over(order) - 1).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("rank")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.when(F.col("old") != NOWHERE, F.col("old")).alias("old_shard"),
    )


def by_source(source: str = "source", shards: int = SHARDS) -> Column:
    """The layout that ``documents`` is taken to come in: a source is whole in one shard, so that shards are uneven."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{source}`"), F.lit("")).cast("binary")), F.lit(shards)).cast("int")


# --- written layouts ---------------------------------------------------------------------------------------------------


def write_layout(documents: DataFrame, old_shard: Column, folder: str, blocks: int = BLOCKS) -> DataFrame:
    """Write documents as one folder for each block of a shard; the manifest of them: shard, part, path.

    Blocks follow from whole rows, so that a part can be written again by itself.
    """
    home = F.coalesce(old_shard.cast("int"), F.lit(NOWHERE))
    place = F.pmod(F.xxhash64(*(F.col(f"`{name}`") for name in documents.columns)), F.lit(blocks)).cast("int")
    path = f"{folder}/write-{uuid.uuid4().hex}"
    parts = documents.select(F.struct("*").alias("row"), home.alias("shard"), F.concat_ws("-", home, place).alias("part"))
    parts.repartition("shard", "part").write.mode("errorifexists").partitionBy("shard", "part").parquet(path)
    return manifest_of(documents.sparkSession, path)


def manifest_of(spark: SparkSession, path: str) -> DataFrame:
    written = spark.read.option("basePath", path).schema("shard int, part string").parquet(path)
    return stored(written.distinct().withColumn("path", F.lit(path)), "manifest")


def read_layout(manifest: DataFrame) -> DataFrame:
    """All rows of a layout with their ``shard`` and ``part``. A path is a write, of which there are few."""
    spark = manifest.sparkSession
    paths = [row.path for row in manifest.select("path").distinct().orderBy("path").collect()]
    found = None
    for path in paths:
        held = manifest.where(F.col("path") == path).select("shard", "part")
        rows = spark.read.option("basePath", path).parquet(path).join(held, ["shard", "part"], "left_semi")
        found = rows if found is None else found.unionByName(rows)
    return found


def rewrite(manifest: DataFrame, folder: str, shards: int = SHARDS, text_column: str = "text") -> DataFrame:
    """Bring a layout to ``shards`` even shards: the parts that move are written below ``folder``, all others keep their
    files, and the new manifest is returned. Until it is used, the old one stays valid."""
    rows = read_layout(manifest)
    measured = rows.withColumn("size", size_of(f"row`.`{text_column}"))
    found = measured.groupBy("shard", "part").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    names = [row.part for row in sorted(found, key=lambda row: (row.shard, row.part))]
    number = {part: at for at, part in enumerate(names)}
    goes = transfers(sorted(Block(row.shard, number[row.part], row["size"], row["rows"]) for row in found), shards)
    plan = [(old, names[at], new) for (old, at), new in goes.items() if old != new]
    spark = manifest.sparkSession
    if not plan:
        return manifest
    moves = F.broadcast(spark.createDataFrame(plan, "shard int, part string, new int"))
    path = f"{folder}/write-{uuid.uuid4().hex}"
    moved = rows.join(moves, ["shard", "part"]).select("row", F.col("new").alias("shard"), "part")
    moved.repartition("shard", "part").write.mode("errorifexists").partitionBy("shard", "part").parquet(path)
    kept = manifest.join(moves, ["shard", "part"], "left_anti")
    return stored(kept.unionByName(manifest_of(spark, path)), "manifest")
