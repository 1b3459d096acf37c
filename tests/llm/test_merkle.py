"""Operator 12 against a plain tree, for several fanouts and block sizes."""

from __future__ import annotations

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import merkle


def H(text):
    return sha256(text.encode()).hexdigest()


def plain_leaf(row):
    parts = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]]
    return H("".join("-" if part is None else f"{len(str(part).encode())}:{part}" for part in parts))


def climb(nodes, fanout):
    """Root of the nodes, and for each its list of (before, after)."""
    proofs, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for at, members in enumerate(owners):
            start = at - at % fanout
            for member in members:
                proofs[member].append((nodes[start:at], nodes[at + 1 : start + fanout]))
        runs = range(0, len(nodes), fanout)
        owners = [sum(owners[at : at + fanout], []) for at in runs]
        nodes = [H("".join(nodes[at : at + fanout])) for at in runs]
    return nodes[0], proofs


def plain_manifest(rows, fanout):
    """For each row: id, leaf, subroot, root, proof digest and the siblings."""
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    names = sorted(groups, key=lambda name: (name is not None, (name or "").encode()))
    trees = {}
    for name in names:
        listed = sorted(groups[name], key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, plain_leaf(r)))
        trees[name] = listed, *climb([plain_leaf(row) for row in listed], fanout)
    if not names:
        return []
    root, tops = climb([trees[name][1] for name in names], fanout)
    found = []
    for name, top in zip(names, tops):
        listed, subroot, proofs = trees[name]
        for row, proof in zip(listed, proofs):
            steps = proof + top
            found.append((row["doc_id"], plain_leaf(row), subroot, root, H("".join("".join(b + a) for b, a in steps)), steps))
    return found


def key(row):
    return tuple((value is None, value or 0) for value in row[:5])


def compare(rows, result, fanout):
    mine = sorted((tuple(row) for row in result.select("doc_id", "leaf", "subroot", "root", "proof_sha256").collect()), key=key)
    assert mine == sorted((row[:5] for row in plain_manifest(rows, fanout)), key=key)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, place long, total long, root string"


def made(sizes):
    rows = []
    for name, size in sizes.items():
        for i in range(size):
            rows.append({"doc_id": len(rows) * 7 % 1009, "source": "s", "lang": name, "n_chars": i, "text": f"té {i}", "place": 1, "total": 2, "root": "x"})
    return rows


@pytest.mark.parametrize("fanout, levels", [(2, 1), (2, 3), (3, 1), (4, 2), (2, 12)])
def test_equals_plain_tree(spark, fanout, levels):
    rows = made({"en": 77, "de": 8, None: 9, "": 1, "fr": 2, "ß": 33, "z": 64})
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    compare(rows, merkle.manifest(table, fanout=fanout, levels=levels), fanout)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 2}, {"en": 9}, {"en": 1, "de": 1, "fr": 1}])
def test_small_tables(spark, sizes):
    rows = made(sizes)
    compare(rows, merkle.manifest(spark.createDataFrame(rows, SCHEMA), levels=1), 2)


def test_a_changed_row_does_not_verify(spark):
    rows = made({"en": 21, "de": 5})
    table = spark.createDataFrame(rows, SCHEMA)
    changed = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    result = merkle.manifest(table, received={"text": changed}, levels=2).collect()
    for row in result:
        assert row.verified == (row.doc_id % 3 != 0) == (row.folded_root == row.root)
    plain = {row[0]: row for row in plain_manifest(rows, 2)}
    for row in result:
        own = next(r for r in rows if r["doc_id"] == row.doc_id)
        node = plain_leaf(own if row.doc_id % 3 else {**own, "text": own["text"] + "!"})
        for before, after in plain[row.doc_id][5]:
            node = H("".join(before) + node + "".join(after))
        assert node == row.folded_root


def test_odd_rows(spark, odd):
    rows = [row.asDict() for row in odd.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    compare(rows, merkle.tampered_documents(odd), 2)
    nulls = odd.withColumn("n_chars", F.lit(None).cast("long")).withColumn("lang", F.lit(None).cast("string"))
    result = merkle.tampered_documents(nulls)
    compare([{**row, "n_chars": None, "lang": None} for row in rows], result, 2)
    assert all(row.verified for row in result.collect())
    assert merkle.tampered_documents(odd.limit(0)).collect() == []
