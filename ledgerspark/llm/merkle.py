"""Operator 12: Merkle manifest of a table with a proof for every row, by a butterfly exchange.

A leaf is the SHA-256 of a row's columns, each as its length in bytes and its text. Within a group (a language) leaves are
ordered, every ``FANOUT`` consecutive nodes become the hash of their hexadecimal digests, and so on up to the group's
root; the roots of the groups, in order, form the upper part of the tree in the same way. Leaves are hashed in place;
only digests are shuffled.

Leaves are dealt into blocks of ``FANOUT ** LEVELS`` places, aligned to the tree, and each block hashes its own subtree. Then the
blocks exchange roots round by round: in round r a block meets one block of each other subtree in its aligned run of
``FANOUT`` subtrees of ``FANOUT ** r`` blocks, the one at its own place there, notes the roots as the next siblings of
its proof, and hashes the parent itself, as every other block of the run does. After the last round each block holds the
upper proof and the root, and nothing has to be handed down. A last subtree with fewer blocks answers in turn for the
places it lacks. The groups meet in the same rounds, one level further up. Every round is a stored table of one row a block.

Defined results: rows with equal order values follow the digest of their leaves, null order values come last; a null group is
a group, the first; a null column is ``-``, an empty one ``0:``; a group with one row is that leaf; repeated rows are
leaves each; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.session import stored

from .common import importable

FANOUT = 2
LEVELS = 12
#: The columns of a leaf of ``documents``.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

Proof = list[tuple[bytes, bytes]]


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    """SHA-256 of the values, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(encoded, values)).cast("binary"), 256))


def placed(rows: DataFrame, group: str, order: Sequence[Column], name: str) -> DataFrame:
    """Add ``place``, from 0 in each group by ``order``, and ``total``, the rows of the group. Sorted by ranges, so that a
    group may be any part of the table; what is counted has one row for each group of a range."""
    ranged = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    ordered = stored(ranged.withColumn("row", F.monotonically_increasing_id()), name)
    ordered = ordered.withColumn("range", F.shiftright("row", 33))
    counts = ordered.groupBy(group, "range").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        group,
        "range",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy(group)).alias("total"),
    )
    joined = ordered.join(starts, [group, "range"])
    return joined.withColumn("place", F.col("row") + F.col("shift")).drop("row", "range", "shift")


def parent(nodes: Sequence[bytes]) -> bytes:
    return sha256(b"".join(nodes)).hexdigest().encode()


def tree(nodes: list[bytes], fanout: int, levels: int | None) -> list[list[bytes]]:
    """The nodes and all levels above them: as many as given, or up to a single node."""
    found = [nodes]
    while len(found) <= levels if levels is not None else len(found[-1]) > 1:
        last = found[-1]
        found.append([parent(last[at : at + fanout]) for at in range(0, len(last), fanout)])
    return found


def siblings(levels: list[list[bytes]], at: int, fanout: int) -> Proof:
    """For each level below the top, the nodes before and after the one at ``at`` in its run."""
    proof: Proof = []
    for nodes in levels[:-1]:
        start = at - at % fanout
        proof.append((b"".join(nodes[start:at]), b"".join(nodes[at + 1 : start + fanout])))
        at //= fanout
    return proof


def folded(node: bytes, proof: Proof) -> bytes:
    for before, after in proof:
        node = sha256(before + node + after).hexdigest().encode()
    return node


def block_tree(table: pa.Table, fanout: int, levels: int) -> tuple[pa.Table, list[list[bytes]]]:
    """The rows of one block in order, and their tree; the block of a larger group is hashed to its full height."""
    table = table.sort_by("place")
    alone = table.column("total")[0].as_py() <= fanout**levels
    return table, tree([one.as_py().hex().encode() for one in table.column("leaf")], fanout, None if alone else levels)


def block_roots(leaves: DataFrame, fanout: int, levels: int) -> DataFrame:
    """group, place (of the block among those of its group), total (of blocks) and root, one row a block."""

    def root(key: tuple, table: pa.Table) -> pa.Table:
        _, found = block_tree(table, fanout, levels)
        blocks = -(-table.column("total")[0].as_py() // fanout**levels)
        columns = {"group": [key[0].as_py()], "place": [key[1].as_py()], "total": [blocks], "root": [found[-1][0].decode()]}
        return pa.table(columns, schema=pa.schema({"group": pa.string(), "place": pa.int64(), "total": pa.int64(), "root": pa.string()}))

    return importable(leaves).groupBy("group", "block").applyInArrow(root, "group string, place bigint, total bigint, root string")


def butterfly(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """For nodes with group, place, total and root: the siblings up to the root of the group (``proof``, an array of the
    digests before and after, level by level) and that root. Every node has them at the end of the last round."""
    empty = F.array().cast("array<struct<before:string,after:string>>")
    state = stored(nodes.select("group", "place", "total", "root", empty.alias("proof")), "round")
    most = state.agg(F.max("total")).first()[0] or 0
    span = 1
    while span < most:
        run = F.col("place") - F.col("place") % (span * fanout)
        heads = F.transform(F.sequence(F.lit(0), F.lit(fanout - 1)), lambda digit: run + digit * span)
        # Heads of the other subtrees of the run; one with fewer blocks answers in turn for the places it lacks.
        other = F.filter(heads, lambda head: (head < F.col("total")) & (head != F.col("place") - F.col("place") % span))
        asked = F.transform(other, lambda head: head + (F.col("place") % span) % F.least(F.lit(span), F.col("total") - head))
        requests = state.select("group", "place", F.explode(asked).alias("partner"))
        offers = state.select("group", F.col("place").alias("partner"), F.col("root").alias("received"))
        answers = requests.join(offers, ["group", "partner"]).groupBy("group", "place").agg(
            F.array_sort(F.collect_list(F.struct("partner", "received"))).alias("met")
        )
        joined = state.join(answers, ["group", "place"], "left")
        met = F.coalesce(F.col("met"), F.array().cast("array<struct<partner:bigint,received:string>>"))
        before = F.array_join(F.filter(met, lambda one: one["partner"] < F.col("place"))["received"], "")
        after = F.array_join(F.filter(met, lambda one: one["partner"] > F.col("place"))["received"], "")
        noted = joined.select("group", "place", "total", "root", "proof", before.alias("before"), after.alias("after"))
        ended = F.col("total") <= span
        hashed = F.sha2(F.concat("before", "root", "after").cast("binary"), 256)
        step = F.array(F.struct("before", "after"))
        state = stored(
            noted.select(
                "group",
                "place",
                "total",
                F.when(ended, F.col("root")).otherwise(hashed).alias("root"),
                F.when(ended, F.col("proof")).otherwise(F.concat("proof", step)).alias("proof"),
            ),
            "round",
        )
        span *= fanout
    return state


def manifest(
    documents: DataFrame,
    columns: Sequence[str] = COLUMNS,
    group: str = "lang",
    order: str = "doc_id",
    received: Mapping[str, Column] | None = None,
    fanout: int = FANOUT,
    levels: int = LEVELS,
) -> DataFrame:
    """For each row its id, leaf, the roots of its group and of the table, the digest of its proof, and the root that the
    row as ``received`` (columns that replace those of the same names) folds to with the proof: a changed row does not verify."""
    given = [F.col(f"`{name}`") for name in columns]
    copies = [(received or {}).get(name, F.col(f"`{name}`")) for name in columns]
    # The prefix sets the null group apart and keeps the order of the others, bytewise.
    key = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")), F.lit(""))
    rows = documents.select(F.col(f"`{order}`").alias("doc_id"), key.alias("group"), leaf(given).alias("leaf"), leaf(copies).alias("copy"))
    # Stored, as sorting by ranges reads its input twice, and texts need to be read and hashed only once.
    slim = stored(rows.withColumn("copy", F.when(F.col("copy") != F.col("leaf"), F.col("copy"))), "digests")
    ordered = placed(slim, "group", [F.asc_nulls_last("doc_id"), F.asc("leaf")], "leaves")
    leaves = ordered.withColumn("block", F.floor(F.col("place") / fanout**levels).cast("bigint"))

    lower = butterfly(block_roots(leaves, fanout, levels), fanout)
    subroots = lower.where("place = 0").select(F.lit("").alias("group"), F.col("group").alias("member"), "root")
    members = placed(subroots, "group", [F.asc("member")], "subroots")
    upper = butterfly(members, fanout).join(members.select("place", "member"), "place")
    upper = upper.select(F.col("member").alias("group"), F.col("root").alias("table_root"), F.col("proof").alias("last"))
    proofs = stored(
        lower.join(upper, "group").select(
            "group", F.col("place").alias("block"), F.col("root").alias("subroot"), F.col("table_root").alias("root"), F.concat("proof", "last").alias("proof")
        ),
        "proofs",
    )

    kind = documents.schema[order].dataType.simpleString()
    target = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def prove(table: pa.Table, above: pa.Table) -> pa.Table:
        table, found = block_tree(table, fanout, levels)
        top = above.to_pylist()[0]
        high = [(step["before"].encode(), step["after"].encode()) for step in top["proof"]]
        size = table.num_rows
        leaves, digests, ends = [one.decode() for one in found[0]], [], []
        for at, copy in enumerate(table.column("copy").to_pylist()):
            proof = siblings(found, at, fanout) + high
            digests.append(sha256(b"".join(before + after for before, after in proof)).hexdigest())
            ends.append(folded(copy.hex().encode() if copy is not None else found[0][at], proof).decode())
        values = [leaves, [top["subroot"]] * size, [top["root"]] * size, digests, ends, [end == top["root"] for end in ends]]
        names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        return pa.table([table.column("doc_id"), *map(pa.array, values)], names=["doc_id", *names])

    grouped = importable(leaves).groupBy("group", "block")
    return grouped.cogroup(proofs.groupBy("group", "block")).applyInArrow(prove, target)


def tampered_documents(documents: DataFrame) -> DataFrame:
    """The manifest of ``documents``, each row folded as received: where 7 divides the crc32 of the id, n_chars is one more."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return manifest(documents, received={"n_chars": n_chars})
