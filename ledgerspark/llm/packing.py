"""Operator 2: vector best-fit packing of tokenised documents into sequences.

Every sequence is a bin with three capacities: tokens, documents and attention cost (the squared length of each
piece in it). Pieces are placed from the longest to the shortest. Of the open bins that fit under every capacity, the
one is taken whose residual is smallest after the placement (``rule="norm"``) or whose residual points most in the
direction of the piece (``rule="dot"``), each capacity weighted.

All three demands follow from a piece's length, so pieces of one length are alike and bins with one residual
are alike. The plan is therefore made for the whole corpus at once from the histogram of lengths, which has at most
``tokens`` entries however large the corpus is. Spark numbers the pieces of each length and looks up where a number
goes. No row passes through the driver.

Defined results: a null text is an empty text; an empty text is the closing id alone; repeated rows are packed each;
an empty table gives an empty result; only the id and text columns are read, whatever else the table holds.
"""

from __future__ import annotations

import json
import zlib
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.session import stored

from .bpe_counts import BYTE_LEVEL_SPLIT, byte_symbols
from .common import BoundedCache, arrow_rows, fields, importable, units

#: Pieces of one length are numbered in blocks of at least so many rows.
BLOCK_ROWS = 256


class ByteEncoder:
    """Token ids of a byte-level vocabulary stored as JSON, a unit of text at a time."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, symbols = spec["model"]["vocab"], byte_symbols()
        merged = ["".join(pair.split(" ") if isinstance(pair, str) else pair) for pair in spec["model"]["merges"]]
        made = [vocabulary[piece] for piece in merged]
        if made != sorted(made):
            raise ValueError("the ids of this vocabulary do not follow its merges")
        special = {token["content"]: token["id"] for token in spec.get("added_tokens", [])}
        ranks = {bytes(symbols[c] for c in piece): i for piece, i in vocabulary.items() if piece not in special}
        self.encoding = tiktoken.Encoding("own", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.after_space = BoundedCache(lambda unit: self.unit_ids(" " + unit), 400_000)

    def unit_ids(self, unit: str) -> bytes:
        return array("I", self.encoding.encode(unit, allowed_special="all")).tobytes()

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if not text:
            return b""
        parts = units(text)
        return self.unit_ids(parts[0]) + b"".join(map(self.after_space.__getitem__, islice(parts, 1, None)))


@lru_cache(maxsize=4)
def encoder(path: str) -> ByteEncoder:
    """One encoder per worker process and vocabulary."""
    return ByteEncoder(path)


def tokenized_pieces(
    documents: DataFrame,
    tokenizer: str,
    tokens: int = 1024,
    closing_id: int = 2,
    with_ids: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Each document's ids and ``closing_id``, cut into pieces of ``tokens`` ids of which the first may be shorter."""
    closing = array("I", [closing_id]).tobytes()

    def work(rows: dict[str, list]) -> dict[str, list]:
        encode = encoder(tokenizer).ids
        out: dict[str, list] = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc_id, text in zip(rows["doc_id"], rows["text"]):
            data = memoryview(encode(text) + closing)
            total = len(data) // 4
            first = total % tokens or tokens
            edges = [0, *range(first, total + 1, tokens)]
            for piece, (start, end) in enumerate(zip(edges, edges[1:])):
                part = data[4 * start : 4 * end]
                out["doc_id"].append(doc_id)
                out["piece"].append(piece)
                out["start"].append(start)
                out["length"].append(end - start)
                out["ids_crc32"].append(zlib.crc32(part))
                if with_ids:
                    out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
        return out

    kind = documents.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return arrow_rows(fields(documents, doc_id=id_column, text=text_column), schema + ", ids array<int>" * with_ids, work)


class Plan:
    """Where the r-th piece of each length goes: sorted starts of runs, and the sequence and offset of each run."""

    def __init__(self, runs: list[tuple[int, int, int, int, int]], sequences: int) -> None:
        table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
        self.length, self.first, self.sequence, self.per_bin, self.offset = table.T
        self.sequences = sequences

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (self.length << 48) + self.first
        run = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
        within = rank - self.first[run]
        turn = self.per_bin[run]
        return self.sequence[run] + within // turn, self.offset[run] + within % turn * length


def plan_bins(
    histogram: dict[int, int],
    tokens: int,
    documents: int,
    attention: int,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
    rule: str = "norm",
) -> Plan:
    """Vector best-fit decreasing over the numbers of pieces of each length."""
    capacity = np.array([tokens, documents, attention], dtype=np.int64)
    scale = np.sqrt(np.array(weights)) / capacity
    if any(length > tokens or length * length > attention for length in histogram) or documents < 1:
        raise ValueError("a piece does not fit into an empty sequence")
    residuals = np.zeros((64, 3), dtype=np.int64)  # open kinds of bins; a free row is all zero
    bins: list[list[tuple[int, int]]] = [[] for _ in range(64)]  # runs of sequence numbers of each kind
    row_of: dict[tuple[int, int, int], int] = {}
    free = list(range(63, -1, -1))
    runs: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def add(residual: tuple[int, int, int], first: int, count: int) -> None:
        nonlocal residuals
        if count == 0 or min(residual) == 0:
            return
        if residual not in row_of:
            if not free:
                size = len(bins)
                free.extend(range(2 * size - 1, size - 1, -1))
                bins.extend([] for _ in range(size))
                residuals = np.vstack([residuals, np.zeros_like(residuals)])
            row_of[residual] = free.pop()
            residuals[row_of[residual]] = residual
        bins[row_of[residual]].append((first, count))

    for length in sorted(histogram, reverse=True):
        demand = np.array([length, 1, length * length], dtype=np.int64)
        rank, left = 0, histogram[length]
        while left:
            fits = np.flatnonzero((residuals >= demand).all(axis=1))
            if len(fits):
                if rule == "norm":
                    score = (((residuals[fits] - demand) * scale) ** 2).sum(axis=1)
                else:
                    shape = residuals[fits] * scale
                    score = -(shape @ (demand * scale)) / np.maximum(np.linalg.norm(shape, axis=1), 1e-300)
                row = int(fits[np.lexsort((*residuals[fits].T, score))[0]])
                residual = tuple(int(x) for x in residuals[row])
                first, count = bins[row].pop()
            else:
                row, residual, first, count = -1, tuple(int(x) for x in capacity), opened, left
            most = min(residual[0] // length, residual[1], residual[2] // (length * length))
            each = most if left >= most else left
            used = min(count, left // each)
            runs.append((length, rank, first, each, tokens - residual[0]))
            rank, left = rank + used * each, left - used * each
            if row < 0:
                opened += used
            else:
                if count > used:
                    bins[row].append((first + used, count - used))
                if not bins[row]:
                    del row_of[residual]
                    residuals[row] = 0
                    free.append(row)
            add((residual[0] - each * length, residual[1] - each, residual[2] - each * length * length), first, used)
    return Plan(runs, opened)


def pack(
    pieces: DataFrame,
    tokens: int = 1024,
    documents: int | None = None,
    attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
    rule: str = "norm",
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with doc_id, piece, start, length and ids_crc32.

    By default only the token capacity can bind: ``documents`` is ``tokens`` and ``attention`` its square.
    ``pieces`` should be a stored table, since it is read twice.
    """
    histogram = {row.length: row.n for row in importable(pieces).groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_bins(histogram, tokens, documents or tokens, attention or tokens * tokens, weights, rule)
    # Looked up by Spark: a function in Python would run twice in one task, each time with workers of its own.
    counts = (histogram.get(length, 1) for length in range(1, max(histogram, default=1) + 1))
    blocks = F.split(F.lit(",".join(str(-(-n // max(BLOCK_ROWS, int(n**0.5)))) for n in counts)), ",").cast("array<bigint>")

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = plan.place(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    spread = F.shiftrightunsigned(F.xxhash64("doc_id", "piece"), 1)
    dealt = pieces.withColumn("block", spread % F.get(blocks, F.col("length").cast("int") - 1))
    sizes = dealt.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(starts, ["length", "block"])
    placed = ranked.withColumn("place", place(F.col("length"), F.col("rank") + F.col("before")))
    return placed.select(*pieces.columns, "place.sequence_id", "place.offset")


def packed_documents(
    documents: DataFrame, tokenizer: str, tokens: int = 1024, closing_id: int = 2, id_column: str = "doc_id", text_column: str = "text", **limits
) -> DataFrame:
    """Tokenise, cut and pack whole documents: one row per piece with its sequence and offset."""
    pieces = tokenized_pieces(documents, tokenizer, tokens, closing_id, False, id_column, text_column)
    return pack(stored(pieces, "pieces"), tokens, **limits)
