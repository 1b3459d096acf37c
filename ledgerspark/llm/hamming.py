"""Operator 4: SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into ``SEGMENTS`` segments. Two fingerprints that differ in at most ``DISTANCE`` bits differ
in at most DISTANCE // SEGMENTS bits in some segment. Each segment has a table of the values that occur; a fingerprint
looks up every value in the small Hamming ball around its own, and whole distances of what it finds are verified.

Equal fingerprints are one node, so copies are never paired. The links are few: a fingerprint has at most 2,080 others
within two bits. Components come from the smallest label of the neighbours and of the label's own label, taken in
turns until nothing changes; every round is a stored table.

Defined results: a null text is an empty text; texts without words have fingerprint zero and are linked like any
other; repeated rows share a fingerprint; a null id counts as larger than any other; an empty table gives an
empty result; of the documents only the id and text columns are read, except by ``one_of_each_group``, which keeps all.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.session import stored

from .common import arrow_rows, fields, free_name, words_of

SEGMENTS, SEGMENT_BITS = 2, 32
DISTANCE = 2
SHINGLE_WORDS = 3
#: Shingles hashed at a time, so that a very long text needs little memory.
CHUNK = 65_536


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = 42) -> int:
    """Signed 64-bit SimHash: a bit is set if it is set in over half the shingle hashes, repeats included."""
    found = words_of(text)
    if not found:
        return 0
    span = min(words, len(found))
    line = b" ".join(found)
    ends = np.cumsum([len(word) + 1 for word in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[: len(found) - span + 1].tolist(), ends[span - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), CHUNK):
        hashes = [digest(line[s:e], seed) for s, e in zip(first[at : at + CHUNK], last[at : at + CHUNK])]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(first)).view(">i8")[0])


def fingerprints(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, a hash of the whole text, and the fingerprint of each document. No shuffle."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        return {
            "doc_id": rows["doc_id"],
            "text_hash": rows["text_hash"],
            "fingerprint": [fingerprint(text) for text in rows["text"]],
        }

    kind = documents.schema[id_column].dataType.simpleString()
    source = fields(documents, doc_id=id_column, text=text_column).withColumn("text_hash", F.xxhash64("text"))
    return arrow_rows(source, f"doc_id {kind}, text_hash bigint, fingerprint bigint", work)


def segment(value: str, number: int) -> Column:
    return F.shiftrightunsigned(value, number * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def ball(value: Column) -> Column:
    """A segment value and those that differ from it in as many bits as some segment of a linked pair may."""
    if DISTANCE // SEGMENTS != 1:
        raise ValueError("the ball is enumerated for one differing bit")
    flips = [value.bitwiseXOR(F.lit(1 << bit)) for bit in range(SEGMENT_BITS)]
    return F.array(value, *flips)


def links(nodes: DataFrame) -> DataFrame:
    """Pairs (left < right) of distinct fingerprints of at most ``DISTANCE`` differing bits, each once."""
    entries = nodes.select("fingerprint", F.posexplode(F.array(*(segment("fingerprint", n) for n in range(SEGMENTS)))).alias("segment", "value"))
    probes = nodes.select("fingerprint", F.posexplode(F.array(*(segment("fingerprint", n) for n in range(SEGMENTS)))).alias("segment", "own"))
    probes = probes.select(F.col("fingerprint").alias("left"), "segment", F.explode(ball(F.col("own"))).alias("value"))
    found = probes.join(entries.withColumnRenamed("fingerprint", "right"), ["segment", "value"])
    near = found.where((F.col("left") < F.col("right")) & (F.bit_count(F.col("left").bitwiseXOR(F.col("right"))) <= DISTANCE))
    return near.select("left", "right").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """For each fingerprint in a stored table of pairs, ``root``, the smallest fingerprint of its component."""
    both = pairs.select("left", "right").union(pairs.select("right", "left")).toDF("node", "other")
    labels = stored(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("root")), "labels")
    while True:
        # A node has few links, so a neighbour's label is fetched by an even join; the join on the label may be hot and is split.
        offered = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("root").alias("low"))
        lower = labels.join(offered, "node").select("node", F.col("root").alias("was"), F.least("root", "low").alias("mid"))
        above = labels.select(F.col("node").alias("mid"), F.col("root").alias("next"))
        moved = stored(lower.join(above, "mid").select("node", "was", F.least("mid", "next").alias("root")), "labels")
        labels = moved.select("node", "root")
        if moved.where("was <> root").isEmpty():
            return labels


def near_groups(prints: DataFrame, link: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """For each distinct fingerprint of a stored table: root, component_id and keeper, the row that may stay.

    ``link`` gives the pairs (left < right) of linked fingerprints of the table of distinct ones.
    ``component_id`` is the smallest id of the component, ``keeper`` the smallest (id, text hash) of it.
    """
    last = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    nodes = stored(prints.groupBy("fingerprint").agg(F.min(last).alias("first")), "nodes")
    labels = components(stored(link(nodes), "links"))
    linked = nodes.join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint")
    firsts = linked.groupBy("root").agg(F.min("first").alias("least"))
    grouped = stored(linked.select("fingerprint", "root").join(stored(firsts, "firsts"), "root"), "grouped")
    every = nodes.join(grouped, "fingerprint", "left")
    return every.select(
        "fingerprint",
        F.coalesce("root", "fingerprint").alias("root"),
        F.coalesce("least", "first").alias("keeper"),
        F.coalesce("least", "first")["id"].alias("component_id"),
    )


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its fingerprint in hexadecimal digits and the component it belongs to."""
    prints = stored(fingerprints(documents, id_column, text_column), "fingerprints")
    groups = stored(near_groups(prints).select("fingerprint", "component_id"), "groups")
    return prints.join(groups, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each_group(documents: DataFrame) -> DataFrame:
    """One document of each component, all columns kept: the one with the smallest id, and of its rows the first by text."""
    prints = stored(fingerprints(documents), "fingerprints")
    kept = near_groups(prints).select("keeper.id", "keeper.hash").distinct()
    mark = free_name(documents, "text_hash")
    rows = documents.withColumn(mark, F.xxhash64("text"))
    match = rows["doc_id"].eqNullSafe(kept["id"]) & (rows[mark] == kept["hash"])
    return rows.join(kept, match, "left_semi").dropDuplicates(["doc_id", mark]).drop(mark)
