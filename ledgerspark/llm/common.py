"""Small helpers the operators share: Arrow tasks, words, text units, bounded caches and labelled samples."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)

_BESIDE_SPACE = re.compile(r" \s|\s ")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")

#: Entries a per-process cache of words may hold; a full cache is emptied, which changes no result.
CACHE_ENTRIES = 600_000

#: Bytes of a batch that goes to a Python worker, about. Spark bounds rows, and ten thousand whole texts are a lot of memory
#: on both sides. Batches of short rows stay as they are.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


class BoundedCache(dict):
    """``cache[key]`` computes a missing value with ``make`` and remembers at most ``limit`` of them."""

    def __init__(self, make: Callable, limit: int = CACHE_ENTRIES) -> None:
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


class RecentCache(dict):
    """As ``BoundedCache``, but when ``limit`` entries are full they become the older generation, out of which what is
    asked for again is taken over; at most twice ``limit`` entries are held."""

    def __init__(self, make: Callable, limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def units(text: str) -> list[str]:
    """``text`` cut at every single space between two characters that are not white space.

    The space belongs to the unit after it and is left out of the result, so every unit but the first stands for
    a space and itself. No token of a vocabulary that splits before a space crosses such a cut.
    """
    if not _BESIDE_SPACE.search(text) and text[:1] != " " and text[-1:] != " ":
        return text.split(" ")
    return _LONE_SPACE.split(text)


def importable(df: DataFrame) -> DataFrame:
    """Let Python workers on this machine, and on others with the same layout, import this library.

    Elsewhere install the package on the executors or ship it with ``--py-files``. Sessions whose user has not set the size of
    batches get ``BATCH_BYTES``.
    """
    if not df.sparkSession.sparkContext.getConf().contains(_BATCH_SETTING):
        df.sparkSession.conf.set(_BATCH_SETTING, BATCH_BYTES)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = df.sparkSession.sparkContext.environment
    paths = [path for path in environment.get("PYTHONPATH", "").split(os.pathsep) if path]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return df


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores in front as make it a new column name, whatever the case."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fields(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under fixed names, so other columns of the input can clash with nothing."""
    return importable(df).select(*(F.col(f"`{given}`").alias(name) for name, given in columns.items()))


def arrow_rows(df: DataFrame, schema: StructType | str, work: Callable[[dict[str, list]], dict[str, object]]) -> DataFrame:
    """Apply ``work`` to each Arrow batch of ``df``: lists of column values in, lists or arrays out."""
    target = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work({name: column.to_pylist() for name, column in zip(batch.schema.names, batch.columns)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return importable(df).mapInArrow(run, target)


def fold(id_column, folds: int):
    """crc32 of an id written as text, modulo ``folds``; an id that is null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A to Z in lower case. Bytes split at exactly the white space of ``WORD``."""
    return text.encode().lower().split() if text else []


def first_ids(rows: DataFrame, bound: int, *extra) -> DataFrame:
    """The ``bound`` distinct doc_ids that come first by hash, with aggregates ``extra`` over their rows."""
    picked = rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"), *extra).drop("n")
    return picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, bound: int, used=None) -> DataFrame:
    """Documents with a known 0/1 ``label``: those of the ``bound`` ids that come first by hash, among the ids ``used``.

    Null ids and labels are left out; an id labelled twice counts as 1 if any label is 1. The labels side of the join
    has at most ``bound`` rows of two numbers, which is the proof that it may be broadcast.
    """
    known = labels.select("doc_id", F.col(f"`{label}`").cast("int").alias("label")).dropna()
    if used is not None:
        known = known.where(used(F.col("doc_id")))
    return documents.join(F.broadcast(first_ids(known, bound, F.max("label").alias("label"))), "doc_id")
