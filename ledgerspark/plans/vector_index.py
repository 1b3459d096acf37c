"""Partitioned vector index: nearest vectors by cosine from a few cells, scored exactly.

Directions are grouped into cells around centres, which are fitted on a sample of bounded size; every vector is then put
into the cell of its nearest centre. A query probes its nearest cells only. The index holds a cell of any size in slices of
about ``SLICE_ROWS`` vectors. Blocks of queries meet tiles of about as many vectors, dealt by id, so that equal vectors,
however many, are not one task's work. What is met is scored by the exact cosine. With ``probes=None`` every cell is probed, which is
exact. How many cells a query looks into by default is measured on the sample: few where directions form groups, most of
them where they do not. Vectors that are missing or without length have similarity 0 to everything and are not indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ledgerspark import constants as K
from ledgerspark.functions.vectors import norm
from ledgerspark.operators.windows import top_k_per_group
from ledgerspark.session import stored

#: Vectors, the first by hash, that centres are fitted on; the most centres; rounds of fitting.
SAMPLE, CELLS, ROUNDS = 20_000, 1024, 12
SLICE_ROWS = 20_000
#: Queries of a block; of these, the queries that meet a tile at a time.
BLOCK_ROWS, ROWS_AT_ONCE = 2_000, 256
#: How far a product of matrices may lie from the score of a pair; scores are 1 at most.
MARGIN = 1e-9
#: The number of probes is the least that finds this share of the ``NEIGHBOURS`` nearest of ``TRIED`` sampled vectors.
RECALL, NEIGHBOURS, TRIED = 0.95, 60, 512


class VectorIndex(NamedTuple):
    """``vectors`` (cell, slice, slices, id, embedding, length), the ``centres``, at most ``CELLS`` of them, and the number
    of ``probes`` that the recall asked for takes."""

    vectors: DataFrame
    centres: np.ndarray
    probes: int
    document_id: str


def unit_rows(rows: list) -> np.ndarray:
    """Vectors as rows of length 1; shorter ones are padded with zeros, as the similarity does."""
    width = max(map(len, rows))
    matrix = np.zeros((len(rows), width))
    for at, row in enumerate(rows):
        matrix[at, : len(row)] = [value or 0.0 for value in row]
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(lengths == 0, 1, lengths)


def fitted_centres(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centres of directions: each round, every vector goes to the centre of the largest product, and centres move to the
    mean of theirs. A centre left without vectors takes the vector that is farthest from its own."""
    draw = np.random.default_rng(seed)
    centres = sample[draw.choice(len(sample), cells, replace=False)]
    for _ in range(ROUNDS):
        products = sample @ centres.T
        nearest, close = products.argmax(axis=1), products.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        empty = np.flatnonzero(np.bincount(nearest, minlength=cells) == 0)
        sums[empty] = sample[np.argsort(close, kind="stable")[: len(empty)]]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    return centres


def needed_probes(sample: np.ndarray, centres: np.ndarray, recall: float) -> int:
    """The least number of nearest cells that hold a share ``recall`` of the nearest neighbours of sampled vectors.

    The neighbours are those in the sample. In all vectors they are nearer, and so rather found.
    """
    asked = sample[:TRIED]
    home = (sample @ centres.T).argmax(axis=1)
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :].repeat(len(asked), axis=0), axis=1)
    near = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, :NEIGHBOURS]
    places = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]) + 1


def fitted(matrix: np.ndarray, width: int) -> np.ndarray:
    """The matrix with ``width`` columns, cut or padded."""
    return matrix[:, :width] if matrix.shape[1] >= width else np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def with_cells(rows: DataFrame, centres: np.ndarray, vector: str, count: int) -> DataFrame:
    """Add ``cells``, the ``count`` nearest of each row's vector, the nearest first. No shuffle."""
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    schema = StructType([*rows.schema.fields, StructField("cells", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            products = fitted(unit_rows(batch.column(vector).to_pylist()), centres.shape[1]) @ centres.T
            nearest = np.argsort(-products, axis=1, kind="stable")[:, :count]
            cells = pa.array(nearest.astype(np.int32).tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, "cells"])

    return rows.mapInArrow(run, schema)


def build_vector_index(docs: DataFrame, document_id: str, vector: str = "embedding", cells: int | None = None, recall: float = RECALL) -> VectorIndex:
    """Index every vector. By default there are as many cells as the root of the number of vectors, ``CELLS`` at most."""
    given = docs.select(document_id, F.col(vector).alias("embedding")).where("embedding is not null")
    measured = given.withColumn("length", norm(F.col("embedding"))).where("length > 0")
    sample = [row.embedding for row in measured.orderBy(F.xxhash64(document_id), document_id).limit(SAMPLE).select("embedding").collect()]
    if not sample:
        empty = measured.select(F.lit(0).alias("cell"), F.lit(0).alias("slice"), F.lit(1).alias("slices"), document_id, "embedding", "length")
        return VectorIndex(stored(empty, "vectors"), np.ones((1, 1)), 1, document_id)
    total = cells or int(measured.count() ** 0.5)
    matrix = unit_rows(sample)
    centres = fitted_centres(matrix, max(1, min(total, CELLS, len(matrix))))
    placed = stored(with_cells(measured, centres, "embedding", 1).withColumn("cell", F.col("cells")[0]).drop("cells"), "placed-vectors")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / SLICE_ROWS).cast("int").alias("slices"))
    # One row a cell, of which there are CELLS at most.
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("slice", F.pmod(F.xxhash64(document_id), F.col("slices")).cast("int"))
    ordered = dealt.repartition("cell", "slice").sortWithinPartitions("cell", "slice")
    vectors = stored(ordered.select("cell", "slice", "slices", document_id, "embedding", "length"), "vectors")
    return VectorIndex(vectors, centres, needed_probes(matrix, centres, recall), document_id)


def matrix_of(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of doubles, padded with zeros; a missing value counts as 0, as in the similarity."""
    flat = pc.list_flatten(column)
    if not flat.null_count and pc.all(pc.equal(pc.list_value_length(column), width)).as_py():
        return flat.to_numpy().astype(np.float64).reshape(len(column), width)
    matrix = np.zeros((len(column), width))
    for at, row in enumerate(column.to_pylist()):
        matrix[at, : len(row)] = [0.0 if value is None else value for value in row]
    return matrix


def numbers_of(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.float64)


def best_pairs(asked: np.ndarray, asked_length: np.ndarray, vectors: np.ndarray, length: np.ndarray, place: np.ndarray, look: np.ndarray | None, k: int):
    """Rows of ``asked`` and ``vectors`` of the ``k`` best pairs of each asked row, and their scores, ties by ``place``.

    A product of matrices finds what may be among the best. Those pairs are scored again, value by value in the order of
    ``dot``, so that scores and ties are those of the expression. ``look`` marks the vectors an asked row may meet.
    """
    with np.errstate(all="ignore"):
        near = (asked / asked_length[:, None]) @ (vectors / length[:, None]).T
    near[np.isnan(near)] = np.inf
    if look is not None:
        near[~look] = -np.inf
    least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -np.inf)
    row, at = np.nonzero((near >= least[:, None] - MARGIN) & (near > -np.inf))
    score = np.zeros(len(row))
    with np.errstate(all="ignore"):
        for axis in range(asked.shape[1]):
            score += asked[row, axis] * vectors[at, axis]
        score /= asked_length[row] * length[at]
    order = np.lexsort((place[at], np.where(np.isnan(score), -np.inf, -score), row))
    row, at, score = row[order], at[order], score[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], at[kept], score[kept]


def tile_scores(asked: pa.Table, vectors: pa.Table, document_id: str, k: int) -> pa.Table:
    """The ``k`` best vectors of a tile for each of a block of queries, a bounded part of the pairs at a time."""
    names = ["query_id", document_id, "semantic_score"]
    if not asked.num_rows or not vectors.num_rows:
        empty = [asked["query_id"][:0], vectors[document_id][:0], pa.chunked_array([pa.array([], pa.float64())])]
        return pa.table(empty, names=names)
    width = max(pc.max(pc.list_value_length(column)).as_py() for column in (asked["asked"], vectors["embedding"]))
    left, right = matrix_of(asked["asked"], width), matrix_of(vectors["embedding"], width)
    left_length, length = numbers_of(asked["asked_length"]), numbers_of(vectors["length"])
    place = np.empty(vectors.num_rows, np.int64)
    place[pc.sort_indices(vectors[document_id]).to_numpy()] = np.arange(vectors.num_rows)
    cell, probed = vectors["cell"].to_numpy(), asked["cells"].to_pylist()
    found = []
    for start in range(0, len(left), ROWS_AT_ONCE):
        part = slice(start, start + ROWS_AT_ONCE)
        look = None
        if probed[start] is not None:
            marks = np.zeros((len(left[part]), int(cell.max()) + 1), dtype=bool)
            for at, cells in enumerate(probed[part]):
                cells = np.array(cells)
                marks[at, cells[cells < marks.shape[1]]] = True
            look = marks[:, cell]
        row, at, score = best_pairs(left[part], left_length[part], right, length, place, look, k)
        found.append((row + start, at, score))
    row, at, score = (np.concatenate(parts) for parts in zip(*found))
    return pa.table([asked["query_id"].take(pa.array(row)), vectors[document_id].take(pa.array(at)), pa.array(score)], names=names)


def vector_search(queries: DataFrame, index: VectorIndex, k: int = K.CANDIDATE_COUNT, probes: int | None = 0) -> DataFrame:
    """The ``k`` nearest vectors of each query (query_id, embedding): id, semantic_score and rank, ties by id.

    ``probes`` is the number of cells a query looks into: 0 for that of the index, None for all, which is exact. Vectors are
    dealt into tiles and queries into blocks. Each block meets each tile once, with the cells to look into, and leaves the
    ``k`` best of a tile, so that what is ranked grows with queries times tiles and not with pairs.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    key = index.document_id
    count = len(index.centres) if probes is None else min(len(index.centres), probes or index.probes)
    given = queries.select("query_id", F.col("embedding").alias("asked")).where("asked is not null")
    measured = given.withColumn("asked_length", norm(F.col("asked"))).where("asked_length > 0")
    # Both counts are single numbers.
    tiles = max(1, -(-index.vectors.count() // SLICE_ROWS))
    blocks = max(1, -(-measured.count() // BLOCK_ROWS))
    if count < len(index.centres):
        probing = with_cells(measured, index.centres, "asked", count)
    else:
        probing = measured.withColumn("cells", F.lit(None).cast("array<int>"))
    asked = probing.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn(
        "tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    )
    dealt = index.vectors.select("cell", key, "embedding", "length").withColumn("tile", F.pmod(F.xxhash64(key), F.lit(tiles)).cast("int"))
    vectors = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = StructType([queries.schema["query_id"], index.vectors.schema[key], StructField("semantic_score", DoubleType())])
    met = asked.groupBy("tile", "block").cogroup(vectors.groupBy("tile", "block"))
    scored = met.applyInArrow(lambda left, right: tile_scores(left, right, key, k), schema)
    return top_k_per_group(scored, ["query_id"], [F.desc("semantic_score"), F.asc(key)], k, key, "rank")
