"""Operator 11: ranked lexical search over impact vectors in norm buckets.

A document is a sparse vector of impacts, a query one of term weights, and the score their inner product, all in whole
numbers. Only coordinates that some query uses matter, so vectors are kept in these. For the bounds, a term's weight is
shared out evenly: impacts and query are both multiplied by its square root, which leaves the product as it is. The vectors
are stored in order of their length (Euclidean norm) so measured, the longest first, and read in buckets of ``BUCKET``
neighbours:

* A first look at the longest vectors gives each query a score that its k-th best document has at least.
* Cauchy-Schwarz: a bucket whose longest vector times the query's length stays below that score is skipped. What no
  query of the block needs is not even read, as the norm is a sorted column of the stored table.
* Coordinate bounds inside a bucket: the product over the query's heaviest coordinates, a share ``FOCUS`` of all, plus
  Cauchy-Schwarz on the others must reach the score. Bounds are doubles with a margin; equal scores are never pruned.
* Survivors are scored again exactly, in 64-bit integers, over all terms of the query.

Each task keeps the k best documents of a query, so at most k rows a query and task are shuffled.

Queries are met in blocks of whole items with at most ``BLOCK_TERMS`` distinct terms an item summed up (an item with more
is a block of its own). Only one block, and one partition of items, is in the driver at a time, and that block is all
that is broadcast. Per block the texts are read once, into a stored table of term counts.

Defined results: a null or empty text has no terms, is no document and as an item finds nothing; repeated items are
answered each; repeated documents are ranked each; equal scores rank by ascending id, null ids last; an empty table gives
an empty result; only the id and text columns are read, whatever else the tables hold.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerspark.session import stored

from .common import arrow_rows, fields

BLOCK_TERMS = 100_000
BUCKET = 2048
FOCUS = 0.75
#: The share of vectors, the longest, that the first look takes.
HEAD = 1 / 32
#: Doubles of some thousand summands are right to far more digits than this.
MARGIN = 1 + 1e-9

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TO_TERMS = bytes(b if b >= 0x80 or b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


class Item(NamedTuple):
    number: int
    item_id: object
    terms: list[bytes]


class Query(NamedTuple):
    """A query's coordinates, heaviest first, how many of them are the focus, and the length of all and of the others."""

    terms: np.ndarray
    focus: int
    length: float
    rest: float


def query_of(terms: np.ndarray, weights: np.ndarray) -> Query:
    ordered = terms[np.argsort(-weights[terms], kind="stable")]
    focus = math.ceil(FOCUS * len(ordered))
    square = weights[ordered]
    return Query(ordered, focus, math.sqrt(square.sum()), math.sqrt(square[focus:].sum()))


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8: runs of ASCII letters and digits and of all other characters, A to Z in lower case."""
    return bytes(text).translate(_TO_TERMS).split() if text else []


def item_blocks(items: DataFrame, item_id: str, text: str, most: int = BLOCK_TERMS) -> Iterator[list[Item]]:
    """Items with their distinct terms, in blocks."""
    kind = items.schema[item_id].dataType.simpleString()

    def work(rows: dict[str, list]) -> dict[str, list]:
        return {**rows, "text": [sorted(set(terms_of(one))) for one in rows["text"]]}

    source = fields(items, item_id=item_id, text=text).select("item_id", F.col("text").cast("binary"), F.monotonically_increasing_id().alias("number"))
    block: list[Item] = []
    total = 0
    for row in arrow_rows(source, f"item_id {kind}, text array<binary>, number bigint", work).where("size(text) > 0").toLocalIterator():
        if block and total + len(row.text) > most:
            yield block
            block, total = [], 0
        block.append(Item(row.number, row.item_id, [bytes(term) for term in row.text]))
        total += len(row.text)
    if block:
        yield block


def lists(values: np.ndarray, lengths: list[int] | np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind.value_type), type=kind)


def term_counts(documents: DataFrame, vocabulary: dict[bytes, int], document_id: str, text: str) -> DataFrame:
    """doc_id, n (all terms) and, for the terms in ``vocabulary``, their numbers and counts. No shuffle."""
    kind = documents.schema[document_id].dataType.simpleString()
    schema = to_arrow_schema(StructType.fromDDL(f"doc_id {kind}, n bigint, terms array<int>, counts array<int>"))
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            n, sizes, terms, counts = [], [], [], []
            for one in batch.column("text"):
                words = terms_of(one.as_buffer()) if one.is_valid else []
                found = Counter(map(number, words))
                found.pop(None, None)
                n.append(len(words))
                sizes.append(len(found))
                terms.extend(found.keys())
                counts.extend(found.values())
            kinds = schema.field("terms").type, schema.field("counts").type
            columns = [batch.column("doc_id").cast(schema.field("doc_id").type), pa.array(n, pa.int64())]
            columns += [lists(np.array(values, np.int32), sizes, kind) for values, kind in zip((terms, counts), kinds)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    source = fields(documents, doc_id=document_id, text=text).withColumn("text", F.col("text").cast("binary"))
    return source.mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, counts array<int>")


def impact_vectors(counts: DataFrame, shared, documents: int, terms: int) -> DataFrame:
    """Vectors with at least one coordinate, with their norm, in order of it."""

    kind = counts.schema["doc_id"].dataType.simpleString()
    target = f"doc_id {kind}, norm double, terms array<int>, impacts array<int>"
    schema = to_arrow_schema(StructType.fromDDL(target))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets, numbers = flat(batch.column("terms"))
            _, often = flat(batch.column("counts"))
            often = often.astype(np.int64)
            n = batch.column("n").to_numpy()
            length = 100 - 50 + np.array([50 * int(one) * documents // terms for one in n], dtype=np.int64)
            impact = 1_000_000_000 * often // (1000 * often + 20 * np.repeat(length, np.diff(offsets)))
            norms = np.sqrt(np.add.reduceat(shared.value[0][numbers] * impact.astype(np.float64) ** 2, offsets[:-1]))
            kinds = schema.field("terms").type, schema.field("impacts").type
            columns = [batch.column("doc_id").cast(schema.field("doc_id").type), pa.array(norms)]
            columns += [lists(values, np.diff(offsets), kind) for values, kind in zip((numbers, impact), kinds)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    vectors = counts.where("size(terms) > 0").mapInArrow(run, target)
    # The hash keeps a large group of copies, which share a norm, from being one partition.
    return vectors.repartitionByRange(F.desc("norm"), F.xxhash64("doc_id")).sortWithinPartitions(F.desc("norm"))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and values of a list column."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]


class Bucket:
    """Some vectors of neighbouring norms, by row and by coordinate."""

    def __init__(self, norms: np.ndarray, offsets: np.ndarray, terms: np.ndarray, impacts: np.ndarray, weights: np.ndarray) -> None:
        self.norms, self.offsets, self.terms = norms, offsets, terms
        self.products = weights[terms] * impacts.astype(np.int64)
        order = np.argsort(terms, kind="stable")
        self.rows = np.repeat(np.arange(len(norms)), np.diff(offsets))[order]
        self.parts = self.products[order].astype(np.float64)
        self.squares = self.parts * impacts[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(weights)))])

    def survivors(self, query: Query, least: float) -> np.ndarray:
        """Rows that may score ``least`` or more."""
        reach = int(np.searchsorted(-self.norms, -least / (query.length * MARGIN), side="right"))
        if not reach:
            return np.zeros(0, np.int64)
        partial, covered = np.zeros(len(self.norms)), np.zeros(len(self.norms))
        for term in query.terms[: query.focus]:
            at = slice(self.starts[term], self.starts[term + 1])
            partial[self.rows[at]] += self.parts[at]
            covered[self.rows[at]] += self.squares[at]
        beside = np.sqrt(np.maximum(self.norms[:reach] ** 2 * MARGIN - covered[:reach], 0))
        return np.flatnonzero((partial[:reach] + query.rest * beside) * MARGIN >= least)

    def scores(self, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Exact scores of the rows, for marks 0 and 1 by coordinate."""
        sizes = self.offsets[rows + 1] - self.offsets[rows]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(self.offsets[rows] - ends + sizes, sizes)
        return np.add.reduceat(asked[self.terms[places]] * self.products[places], ends - sizes)


def buckets(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[tuple[pa.Array, Bucket]]:
    for whole in batches:
        for start in range(0, whole.num_rows, BUCKET):
            batch = whole.slice(start, BUCKET)
            offsets, terms = flat(batch.column("terms"))
            _, impacts = flat(batch.column("impacts"))
            yield batch.column("doc_id"), Bucket(batch.column("norm").to_numpy(), offsets, terms, impacts, weights)


def leaders(found: list[tuple[int, object]], k: int) -> list[tuple[int, object]]:
    """The k best of (score, id): high scores first, equal ones by ascending id."""
    return sorted(found, key=lambda one: (-one[0], one[1] is None, 0 if one[1] is None else one[1]))[:k]


def best_in_task(vectors: DataFrame, shared, least: dict[int, int], block: list[Item], k: int, item_type: str) -> DataFrame:
    """For each item, the best k vectors of every task that reach the item's least score."""
    kind = vectors.schema["doc_id"].dataType.simpleString()
    target = f"number bigint, item_id {item_type}, doc_id {kind}, score bigint"
    schema = to_arrow_schema(StructType.fromDDL(target))
    known = {item.number: item.item_id for item in block}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries = shared.value
        floors = {number: max(1, least.get(number, 1)) for number in queries}
        held: dict[int, list[tuple[int, object]]] = {number: [] for number in queries}
        asked = np.zeros(len(weights), np.int64)
        for ids, bucket in buckets(batches, weights):
            for number, query in queries.items():
                if query.length * bucket.norms[0] * MARGIN < floors[number]:
                    continue
                rows = bucket.survivors(query, floors[number])
                if not len(rows):
                    continue
                asked[query.terms] = 1
                scores = bucket.scores(rows, asked)
                asked[query.terms] = 0
                rows, scores = rows[scores >= floors[number]], scores[scores >= floors[number]]
                if len(rows):
                    listed = ids.take(pa.array(rows)).to_pylist()
                    held[number] = leaders([*held[number], *zip(scores.tolist(), listed)], k)
                    if len(held[number]) == k:
                        floors[number] = held[number][-1][0]
        found = [(number, known[number], doc, score) for number, best in held.items() for score, doc in best]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    return vectors.mapInArrow(run, target)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def block_results(documents: DataFrame, block: list[Item], k: int, item_type: str, document_id: str, text: str) -> DataFrame | None:
    vocabulary = {term: number for number, term in enumerate(sorted({term for item in block for term in item.terms}))}
    counts = stored(term_counts(documents, vocabulary, document_id, text), "term-counts")
    total = counts.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
    if not total.documents:
        return None
    held = np.zeros(len(vocabulary), np.int64)
    for row in counts.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        held[row.term] = row["count"]
    weights = np.array([math.floor(1000 * math.log((2 * total.documents + 2) / (2 * int(df) + 1))) for df in held], np.int64)
    asked = {item.number: query_of(np.array([vocabulary[term] for term in item.terms]), weights) for item in block}
    queries = {number: query for number, query in asked.items() if query.length > 0}
    shared = documents.sparkSession.sparkContext.broadcast((weights, queries))
    vectors = stored(impact_vectors(counts, shared, total.documents, total.terms), "impact-vectors")
    cut = vectors.approxQuantile("norm", [1 - HEAD], 0.005)
    if not cut or not queries:
        return None
    first = ranked(best_in_task(vectors.where(F.col("norm") >= cut[0]), shared, {}, block, k, item_type), k)
    least = {row.number: row.score for row in first.where(F.col("rank") == k).select("number", "score").collect()}
    shortest = min(least.get(number, 1) / (query.length * MARGIN) for number, query in queries.items())
    return ranked(best_in_task(vectors.where(F.col("norm") >= shortest), shared, least, block, k, item_type), k)


def search(
    documents: DataFrame,
    items: DataFrame,
    k: int = 50,
    document_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """The ``k`` documents of the highest score above 0 for each item: item_id, rank, doc_id, score."""
    item_type = items.schema[item_id].dataType.simpleString()
    id_type = documents.schema[document_id].dataType.simpleString()
    results = []
    for block in item_blocks(items, item_id, text):
        found = block_results(documents, block, k, item_type, document_id, text)
        if found is not None:
            results.append(found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not results:
        return documents.sparkSession.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score bigint")
    if len(results) > 1:
        results = [stored(found, "ranked") for found in results]
    return reduce(DataFrame.unionByName, results)
