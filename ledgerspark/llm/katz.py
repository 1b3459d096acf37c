"""Operator 6: Katz backoff scoring with Good-Turing discounts.

P(w | u) is d(c(u,w)) c(u,w) / c(u) for a pair seen in training, and alpha(u) P(w) otherwise; P(w) is d(c(w)) c(w) / N for a
known word, and all that the discounts of the words leave for an unknown one. alpha(u) makes the probabilities after u sum
to one exactly. d(r) is Katz's Good-Turing discount for counts up to ``RELIABLE``; larger counts keep ``KEPT`` of themselves, so
that every context has something left for words it was never seen with.

How the work is dealt:

1. Documents are dealt to blocks by hash. A block sends its distinct words and pairs, as sorted 64-bit keys with their counts in
   training, to tables partitioned by ranges of the key. A key comes from a block once, so a frequent word or pair is a row a block.
2. A partition adds up its counts and answers every block, in key order. For each key one block owns it.
3. A block reads its documents again, now with global counts, and writes for each document the sums its score is linear in, for the
   context of each owned pair the numbers of pairs by count class, and the contexts of unseen pairs.
4. The classes of owned keys give counts of counts, hence the discounts; contexts are added up in tables partitioned by key,
   where each unseen pair reads its alpha; the logarithms are added up by document.

Defined results: a null text is an empty text; its one token is the end. Repeated rows are learnt and scored each. Without training
rows every count is zero and a token has probability 1. An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.session import stored

from .common import fields, fold, words_of

RELIABLE = 5
KEPT = 0.999
#: Documents in a block, and blocks for each partition of the tables of keys.
BLOCK_DOCUMENTS, BLOCKS_A_PARTITION = 2048, 1
FOLDS, HELD_OUT = 7, 2

# No word holds a space, so these two cannot be words.
START, END = (np.uint64(xxhash.xxh64_intdigest(text)) for text in (b"  ", b" "))
CLASSES = RELIABLE + 1


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One 64-bit key for a pair of keys."""
    with np.errstate(over="ignore"):
        value = left * np.uint64(0x9E3779B97F4A7C15) + right
        value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def packed(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte by byte of all, which leaves the shuffle's compression the leading zeros."""
    steps = np.diff(keys, prepend=np.uint64(0)) if len(keys) else keys
    return np.ascontiguousarray(steps.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(">u8").ravel().astype(np.uint64), dtype=np.uint64)


def packed_numbers(values: np.ndarray) -> bytes:
    """Small numbers byte by byte of all, for the same reason."""
    return np.ascontiguousarray(values.astype(">u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(">u4").ravel().astype(np.int64)


class Block:
    """Distinct words and pairs of some documents, ascending by key, and where each token finds its own."""

    def __init__(self, texts: list[str | None], held_out: np.ndarray) -> None:
        documents = [words_of(text) for text in texts]
        self.lengths = np.array([len(words) + 1 for words in documents], dtype=np.int64)
        names: dict[bytes, int] = {}
        local = np.fromiter(
            (names.setdefault(word, len(names)) for word in chain.from_iterable(documents)), np.int64, int(self.lengths.sum()) - len(documents)
        )
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
        ends = np.cumsum(self.lengths) - 1
        token = np.full(int(self.lengths.sum()), END, dtype=np.uint64)
        inside = np.ones(len(token), dtype=bool)
        inside[ends] = False
        token[inside] = hashes[local]
        before = np.concatenate([[START], token[:-1]]).astype(np.uint64)
        before[np.concatenate([[0], ends[:-1] + 1])] = START
        self.before = before
        self.document = np.repeat(np.arange(len(documents)), self.lengths)
        taught = ~held_out[self.document]
        self.words, self.word_of = np.unique(token, return_inverse=True)
        self.pairs, first, self.pair_of = np.unique(mixed(before, token), return_index=True, return_inverse=True)
        self.pair_before, self.pair_word = before[first], self.word_of[first]
        self.word_counts = np.bincount(self.word_of[taught], minlength=len(self.words))
        self.pair_counts = np.bincount(self.pair_of[taught], minlength=len(self.pairs))


def cuts(keys: np.ndarray, partitions: int) -> np.ndarray:
    """Where ascending keys pass from one partition to the next; partitions are equal ranges of the key's upper half."""
    lowest = [-(-(part << 32) // partitions) << 32 for part in range(partitions)]
    return np.append(np.searchsorted(keys, np.array(lowest, dtype=np.uint64)), len(keys))


def block_of(table: pa.Table) -> Block:
    return Block(table.column("text").to_pylist(), table.column("held_out").to_numpy())


def sent_keys(table: pa.Table, partitions: int) -> pa.Table:
    """Step 1: a block's keys and training counts, a row for each partition."""
    block = block_of(table)
    word_cuts, pair_cuts = cuts(block.words, partitions), cuts(block.pairs, partitions)
    rows = [
        (
            part,
            packed(block.words[word_cuts[part] : word_cuts[part + 1]]),
            packed_numbers(block.word_counts[word_cuts[part] : word_cuts[part + 1]]),
            packed(block.pairs[pair_cuts[part] : pair_cuts[part + 1]]),
            packed_numbers(block.pair_counts[pair_cuts[part] : pair_cuts[part + 1]]),
        )
        for part in range(partitions)
        if word_cuts[part] < word_cuts[part + 1] or pair_cuts[part] < pair_cuts[part + 1]
    ]
    columns = list(zip(*rows))
    return pa.table(
        {
            "part": pa.array(columns[0], pa.int32()),
            "block": pa.array([table.column("block")[0].as_py()] * len(rows), pa.int64()),
            **{name: pa.array(column, pa.binary()) for name, column in zip(("words", "word_counts", "pairs", "pair_counts"), columns[1:])},
        }
    )


def added_up(keys: list[bytes], counts: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Global counts for the keys of each block, and whether the block owns the key: the first block that sent it."""
    each = [unpacked(data) for data in keys]
    _, first, place = np.unique(np.concatenate(each), return_index=True, return_inverse=True)
    totals = np.bincount(place, np.concatenate([numbers(data) for data in counts])).astype(np.int64)
    owned = np.zeros(len(place), dtype=bool)
    owned[first] = True
    edges = np.cumsum([len(one) for one in each])[:-1]
    return [packed_numbers(part) for part in np.split(totals[place], edges)], [np.packbits(part).tobytes() for part in np.split(owned, edges)]


def answers(table: pa.Table) -> pa.Table:
    """Step 2: a partition's counts, back to the blocks that sent its keys."""
    table = table.sort_by("block")  # so that owners do not depend on the order of arrival
    word_counts, word_owned = added_up(table.column("words").to_pylist(), table.column("word_counts").to_pylist())
    pair_counts, pair_owned = added_up(table.column("pairs").to_pylist(), table.column("pair_counts").to_pylist())
    made = {"word_counts": word_counts, "word_owned": word_owned, "pair_counts": pair_counts, "pair_owned": pair_owned}
    return pa.table({"block": table.column("block"), "part": table.column("part"), **{k: pa.array(v, pa.binary()) for k, v in made.items()}})


def by_class(counts: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """For each group, how many counts are 0, 1, ... RELIABLE, and the sum of the larger ones."""
    found = np.zeros((groups, CLASSES + 1))
    small = counts <= RELIABLE
    found[:, :CLASSES] = np.bincount(group[small] * CLASSES + counts[small], minlength=groups * CLASSES).reshape(groups, CLASSES)
    found[:, CLASSES] = np.bincount(group[~small], counts[~small], groups)
    return found


def logs_by_class(counts: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """As ``by_class``, but for the larger counts how many there are, and the sum of their logarithms."""
    found = np.zeros((groups, CLASSES + 2))
    small = counts <= RELIABLE
    found[:, :CLASSES] = np.bincount(group[small] * CLASSES + counts[small], minlength=groups * CLASSES).reshape(groups, CLASSES)
    found[:, CLASSES] = np.bincount(group[~small], minlength=groups)
    found[:, CLASSES + 1] = np.bincount(group[~small], np.log10(counts[~small]), groups)
    return found


SCORED = (
    "kind string, block bigint, doc_id {id}, row int, held_out boolean, n_tokens bigint, n_known bigint, sums array<double>,"
    " part int, keys binary, numbers binary"
)


def scored_block(key, documents: pa.Table, answered: pa.Table, partitions: int, schema: pa.Schema) -> pa.Table:
    """Step 3: rows of kind doc, context, unseen and class for one block."""
    documents = documents.sort_by([("text_hash", "ascending")])
    number, block = documents.column("block")[0].as_py(), block_of(documents)
    answered = answered.sort_by("part")

    def whole(name: str, size: int, bits: bool = False) -> np.ndarray:
        parts = answered.column(name).to_pylist()
        if not bits:
            values = np.concatenate([numbers(part) for part in parts])
        else:
            sizes = [len(part) // 4 for part in answered.column(name.replace("owned", "counts")).to_pylist()]
            values = np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p, n in zip(parts, sizes)]).astype(bool)
        if len(values) != size:
            raise RuntimeError("the documents changed while they were scored")
        return values

    word_count, word_owned = whole("word_counts", len(block.words)), whole("word_owned", len(block.words), True)
    pair_count, pair_owned = whole("pair_counts", len(block.pairs)), whole("pair_owned", len(block.pairs), True)
    known = dict(zip(("word", "pair"), (word_owned & (word_count > 0), pair_owned & (pair_count > 0))))
    size, document = len(block.lengths), block.document
    word, pair = word_count[block.word_of], pair_count[block.pair_of]
    # How often a context was followed: its own count, and for the start the number of taught documents, that is of ends.
    end_count = word_count[np.searchsorted(block.words, END)]
    before = np.concatenate([[0], word[:-1]])
    before[block.before == START] = end_count
    seen, followed = pair > 0, before > 0
    backed = ~seen & followed
    sums = np.concatenate(
        [
            np.bincount(document, np.log10(word + 1.0), size)[:, None],
            logs_by_class(pair[seen], document[seen], size),
            np.bincount(document[seen], np.log10(before[seen]), size)[:, None],
            logs_by_class(word[~seen], document[~seen], size),
        ],
        axis=1,
    )
    rows: list[dict] = [
        {"kind": "doc", "block": number, "doc_id": doc_id, "row": i, "held_out": held, "n_tokens": int(n), "n_known": int(k), "sums": s}
        for i, (doc_id, held, n, k, s) in enumerate(
            zip(documents.column("doc_id").to_pylist(), documents.column("held_out").to_pylist(), block.lengths, np.bincount(document, word > 0, size), sums)
        )
    ]
    total = word_count[known["word"]]
    classes = np.concatenate(
        [
            [total.sum(), len(total)],
            *(np.bincount(np.minimum(c, CLASSES + 1), minlength=CLASSES + 2)[1:-1] for c in (total, pair_count[known["pair"]])),
        ]
    )
    rows.append({"kind": "class", "block": number, "sums": classes.astype(float)})
    own = np.flatnonzero(known["pair"])
    contexts, group = np.unique(block.pair_before[own], return_inverse=True)
    after = by_class(pair_count[own], group, len(contexts))[:, 1:]
    lower = by_class(word_count[block.pair_word[own]], group, len(contexts))[:, 1:]
    table = np.concatenate([after, lower], axis=1).astype(np.int64)
    asked, place = np.unique(block.before[backed], return_inverse=True)
    order = np.argsort(place, kind="stable")
    # For each asked context, how many tokens ask, then who: the rows of their documents.
    asking = np.bincount(place, minlength=len(asked))
    who, ends = document[backed][order], np.concatenate([[0], np.cumsum(asking, dtype=np.int64)]).astype(np.int64)
    context_cuts, asked_cuts = cuts(contexts, partitions), cuts(asked, partitions)
    for part in range(partitions):
        low, high = context_cuts[part], context_cuts[part + 1]
        if low < high:
            data = packed_numbers(table[low:high].T.ravel())
            rows.append({"kind": "context", "block": number, "part": part, "keys": packed(contexts[low:high]), "numbers": data})
        low, high = asked_cuts[part], asked_cuts[part + 1]
        if low < high:
            data = packed_numbers(np.concatenate([asking[low:high], who[ends[low] : ends[high]]]))
            rows.append({"kind": "unseen", "block": number, "part": part, "keys": packed(asked[low:high]), "numbers": data})
    return pa.Table.from_pylist(rows, schema=schema)


class Discounts:
    """Discounts of words and pairs from counts of counts, and the totals of training."""

    def __init__(self, classes: np.ndarray) -> None:
        self.tokens, self.types = float(classes[0]), float(classes[1])
        self.word, self.pair = good_turing(classes[2 : 2 + CLASSES]), good_turing(classes[2 + CLASSES : 2 + 2 * CLASSES])
        # What known words keep: counts are discounted by class, so the sum over larger counts is what the classes leave.
        small = classes[2 : 2 + RELIABLE] * np.arange(1, CLASSES)
        kept = (small * self.word).sum() + KEPT * (self.tokens - small.sum())
        self.unknown = 1.0 - kept / self.tokens if self.tokens else 1.0

    def log_alpha(self, table: np.ndarray) -> np.ndarray:
        """Logarithm of the backoff weight of contexts given as rows of pair and word classes."""
        counts = np.arange(1, CLASSES)
        after, lower = table[:, :CLASSES].astype(float), table[:, CLASSES:].astype(float)
        followed = after[:, :RELIABLE] @ counts + after[:, RELIABLE]
        left = (after[:, :RELIABLE] @ (counts * (1 - self.pair)) + (1 - KEPT) * after[:, RELIABLE]) / followed
        covered = (lower[:, :RELIABLE] @ (counts * self.word) + KEPT * lower[:, RELIABLE]) / self.tokens
        return np.log10(left) - np.log10(1 - covered)

    def scores(self, sums: np.ndarray, n_tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Base scores, and model scores without the backoff weights, from the sums of documents."""
        if not self.tokens:
            return np.zeros(len(sums)), np.zeros(len(sums))
        base = sums[:, 0] - n_tokens * np.log10(self.tokens + self.types + 1)
        pair, context, word = sums[:, 1 : 3 + CLASSES], sums[:, 3 + CLASSES], sums[:, 4 + CLASSES :]

        def logs(classes: np.ndarray, discount: np.ndarray) -> np.ndarray:
            small = np.log10(np.arange(1, CLASSES) * discount)
            return classes[:, 1:CLASSES] @ small + classes[:, CLASSES] * np.log10(KEPT) + classes[:, CLASSES + 1]

        known = word[:, 1 : CLASSES + 1].sum(axis=1)
        lower = logs(word, self.word) - known * np.log10(self.tokens) + word[:, 0] * np.log10(self.unknown)
        return base, logs(pair, self.pair) - context + lower


def good_turing(found: np.ndarray) -> np.ndarray:
    """Katz's discounts for counts 1 to RELIABLE from the numbers of types seen 1 to RELIABLE + 1 times.

    The limit comes down until all discounts lie between 0 and 1. If none does, as on very small corpora, half a count
    is taken off. Counts between the limit and RELIABLE keep KEPT of themselves.
    """
    for limit in range(RELIABLE, 0, -1):
        n = found[: limit + 1].astype(float)
        if (n <= 0).any():
            continue
        r = np.arange(1, limit + 1)
        excess = (limit + 1) * n[limit] / n[0]
        if excess >= 1:
            continue
        discounts = ((r + 1) * n[1:] / (n[:-1] * r) - excess) / (1 - excess)
        if (discounts > 0).all() and (discounts < 1).all():
            return np.concatenate([discounts, np.full(RELIABLE - limit, KEPT)])
    return 1 - 0.5 / np.arange(1, CLASSES)


def backoff_sums(table: pa.Table, discounts: Discounts) -> pa.Table:
    """Step 4: a partition's contexts added up; for each block, rows of documents and their sums of logarithms of alpha."""
    kinds = np.array(table.column("kind").to_pylist())
    keys, data = table.column("keys").to_pylist(), table.column("numbers").to_pylist()
    blocks = table.column("block").to_numpy()
    given = np.flatnonzero(kinds == "context")
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    if len(given):
        each = [unpacked(keys[i]) for i in given]
        contexts, place = np.unique(np.concatenate(each), return_inverse=True)
        rows = np.concatenate([numbers(data[i]).reshape(2 * CLASSES, -1).T for i in given])
        summed = np.stack([np.bincount(place, column, len(contexts)) for column in rows.T], axis=1)
        weights = discounts.log_alpha(summed)
    for i in np.flatnonzero(kinds == "unseen"):
        asked = unpacked(keys[i])
        values = numbers(data[i])
        asking, who = values[: len(asked)], values[len(asked) :]
        alpha = weights[np.searchsorted(contexts, asked)]
        rows_of, where = np.unique(who, return_inverse=True)
        out.append((int(blocks[i]), rows_of.astype(np.int32), np.bincount(where, np.repeat(alpha, asking))))
    columns = list(zip(*out)) or [[], [], []]
    kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()))
    return pa.table([pa.array(column, kind) for column, kind in zip(columns, kinds)], names=["block", "rows", "backoff"])


def finished_block(rows: pa.Table, sums: pa.Table, discounts: Discounts) -> pa.Table:
    """Scores of the documents of a block, the parts of their backoff weights added in the order of their values."""
    rows = rows.sort_by("row")
    n_tokens = rows.column("n_tokens").to_numpy()
    base, model = discounts.scores(np.stack(rows.column("sums").to_pylist()), n_tokens)
    if sums.num_rows:
        places, parts = (np.concatenate([value.values.to_numpy() for value in sums.column(name)]) for name in ("rows", "backoff"))
        order = np.lexsort((parts, places))
        model = model + np.bincount(places[order], parts[order], len(model))
    made = {"train_tokens": np.full(len(model), int(discounts.tokens)), "base_score": base, "score": model}
    return pa.table({name: rows.column(name) for name in ("doc_id", "held_out", "n_tokens", "n_known")} | made)


def score(documents: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, block_documents: int = BLOCK_DOCUMENTS) -> DataFrame:
    """Score every document with a pair model learnt from all but one fold: base_score, score and counts.

    ``documents`` is read twice by one plan, which deals it out once.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    source = fields(documents, doc_id="doc_id", text="text")
    blocks = max(1, -(-source.count() // block_documents))
    partitions = max(1, -(-blocks // BLOCKS_A_PARTITION))
    spread = F.xxhash64("doc_id", "text")
    dealt = source.select(
        F.pmod(spread, F.lit(blocks)).alias("block"),
        spread.alias("text_hash"),
        "doc_id",
        (fold(F.col("doc_id"), folds) == held_out).alias("held_out"),
        "text",
    )
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = StructType.fromDDL(SCORED.format(id=kind))
    arrow = to_arrow_schema(schema)

    def send(table: pa.Table) -> pa.Table:
        return sent_keys(table, partitions)

    def describe(key, rows: pa.Table, answered: pa.Table) -> pa.Table:
        return scored_block(key, rows, answered, partitions, arrow)

    sent = dealt.groupBy("block").applyInArrow(send, "part int, block bigint, words binary, word_counts binary, pairs binary, pair_counts binary")
    replies = sent.groupBy("part").applyInArrow(
        answers, "block bigint, part int, word_counts binary, word_owned binary, pair_counts binary, pair_owned binary"
    )
    described = stored(dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(describe, schema), "katz")
    sizes = 2 + 2 * CLASSES
    totals = described.where("kind = 'class'").agg(*(F.sum(F.col("sums")[i]) for i in range(sizes))).first()
    discounts = Discounts(np.array([value or 0.0 for value in totals]))

    def weigh(table: pa.Table) -> pa.Table:
        return backoff_sums(table, discounts)

    asked = described.where("kind in ('context', 'unseen')").select("part", "kind", "block", "keys", "numbers")
    backoff = asked.groupBy("part").applyInArrow(weigh, "block bigint, rows array<int>, backoff array<double>")

    def finish(key, rows: pa.Table, sums: pa.Table) -> pa.Table:
        return finished_block(rows, sums, discounts)

    rows = described.where("kind = 'doc'").select("block", "row", "doc_id", "held_out", "n_tokens", "n_known", "sums")
    made = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return rows.groupBy("block").cogroup(backoff.groupBy("block")).applyInArrow(finish, made)
