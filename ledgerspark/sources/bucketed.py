"""Caches stored in buckets by key: an upsert reads and writes only the slots that its keys fall in."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ledgerspark.operators.caches import cache_upsert
from ledgerspark.sources.files import file_system

SLOT = "key_slot"


class BucketedCache:
    """A cache with one row per key, on a shared path.

    Its folders are slots by a hash of the key, which an upsert prunes by, and the files of a slot are Spark buckets of the key.
    The scan therefore arrives at the join in its place: only the new rows move. ``slots`` is the share of the cache that a
    single new key rewrites, ``buckets`` the number of tasks that read it; below ``spark.sql.shuffle.partitions`` Spark would
    rather move the cache to get more tasks. Both belong to the stored files: open a cache with the numbers it was made with. An upsert that fails leaves each slot either old or new, and running it again
    gives the same cache, since the later version of a key wins.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], order: str = "created_at",
        slots: int = 16, buckets: int = 200,
    ):
        self.spark, self.keys, self.order, self.slots = spark, list(keys), order, slots
        self.columns = schema.fieldNames()
        self.name = "cache_" + hashlib.sha256(path.encode()).hexdigest()[:24]
        typed = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)
        listed = ", ".join(f"`{key}`" for key in self.keys)
        place = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"create table if not exists {self.name} ({typed}, {SLOT} int) using parquet "
            f"options (partitionOverwriteMode 'dynamic') partitioned by ({SLOT}) "
            f"clustered by ({listed}) into {buckets} buckets location '{place}'"
        )
        folder, system = file_system(spark, path)
        if system.exists(folder):
            spark.sql(f"alter table {self.name} recover partitions")

    def stored(self) -> DataFrame:
        return self.spark.table(self.name)

    def frame(self) -> DataFrame:
        return self.stored().select(*self.columns)

    def slotted(self, rows: DataFrame) -> DataFrame:
        slot = F.pmod(F.xxhash64(*self.keys), F.lit(self.slots)).cast("int")
        return rows.select(*self.columns, slot.alias(SLOT))

    def merged(self, new: DataFrame, slots: Sequence[int]) -> DataFrame:
        """The rows of some slots after an upsert of ``new``, whose keys lie in these slots."""
        held = self.stored().filter(F.col(SLOT).isin(list(slots)))
        return cache_upsert(held, self.slotted(new), self.keys, self.order)

    def upsert(self, new: DataFrame) -> DataFrame:
        """Insert or replace by key, the latest version winning; returns the whole cache.

        ``new`` is read twice and should be a table. The driver sees the numbers of its slots.
        """
        slots = [row[SLOT] for row in self.slotted(new).select(SLOT).distinct().collect()]
        if slots:
            self.merged(new, slots).write.insertInto(self.name, overwrite=True)
        return self.frame()

    def lookup(self, ids: DataFrame) -> DataFrame:
        """Cached rows of a set of keys; the cache is read in place."""
        return self.frame().join(ids.select(*self.keys).distinct(), on=self.keys, how="left_semi")
