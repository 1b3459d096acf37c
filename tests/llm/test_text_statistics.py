"""Sketches, fingerprints, rules, scores and spans against plain loops."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from ledgerspark.llm import hamming, katz, ngram_rules, sketch, skip_chain

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {code: code + 32 for code in range(65, 91)}


# --- near-duplicates -------------------------------------------------------------------------------------------


def plain_fingerprint(text: str) -> int:
    words = WORD.findall(text.translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(shingle.encode(), 42) for shingle in shingles]
    return sum((sum(h >> bit & 1 for h in hashes) * 2 > len(hashes)) << bit for bit in range(64))


def plain_components(prints: dict[int, int], distance: int = 2) -> dict[int, int]:
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= distance:
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: find(i) for i in ids}


def test_near_duplicates(documents, texts):
    prints = {i: plain_fingerprint(text) for i, text in texts.items()}
    groups = plain_components(prints)
    found = {row.doc_id: (row.fingerprint, row.component_id) for row in hamming.near_duplicates(documents).collect()}
    assert found == {i: (f"{prints[i]:016x}", groups[i]) for i in texts}


def test_links_and_long_chains(spark):
    draw = random.Random(5)
    value, chain = draw.getrandbits(64), []
    for _ in range(60):  # neighbours two bits apart, in an order that is not the order of values
        chain.append(value)
        for bit in draw.sample(range(64), 2):
            value ^= 1 << bit
    values = [*chain, *(draw.getrandbits(64) for _ in range(200)), *(chain[3] ^ (1 << b) for b in range(0, 64, 5))]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    nodes = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    pairs = hamming.links(nodes)
    expected = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) % (1 << 64)).count("1") <= 2}
    assert {(row.left, row.right) for row in pairs.collect()} == expected
    roots = {row.node: row.root for row in hamming.components(pairs).collect()}
    linked = {v for pair in expected for v in pair}
    parts = plain_components({v: v % (1 << 64) for v in linked})
    assert roots == parts


# --- sketches --------------------------------------------------------------------------------------------------


def test_sketch_keeps_every_hash_below_the_fraction():
    text = " ".join(f"w{i * i % 311}" for i in range(2000))
    every = np.unique(sketch.shingle_hashes(text) >> np.uint64(16))
    kept = sketch.sketch(text, 0.25)
    assert np.array_equal(kept, every[every < 2**46])
    name, parsed = sketch.parsed(sketch.as_text(text, kept))
    assert np.array_equal(parsed, kept) and name == xxhash.xxh64_hexdigest(text)


def test_sketches_merge_and_estimate_containment():
    draw = random.Random(6)
    words = [f"w{draw.randrange(10**6)}" for _ in range(12_000)]
    whole, part = " ".join(words), " ".join(words[:600])
    half = [" ".join(words[:7000]), " ".join(words[6996:])]
    assert np.array_equal(sketch.merged(*map(sketch.sketch, half)), sketch.sketch(whole))
    assert sketch.containment(sketch.sketch(part), sketch.sketch(whole)) == 1.0
    mixed = " ".join(words[:300] + [f"x{i}" for i in range(300)])
    assert abs(sketch.containment(sketch.sketch(mixed), sketch.sketch(whole)) - 0.5) < 0.12


def test_comparison_with_the_next_document(documents, texts):
    ids = sorted(texts)
    following = dict(zip(ids, [*ids[1:], ids[0]]))
    rows = {row.doc_id: row for row in sketch.compare_with_edits(documents).collect()}
    assert set(rows) == set(texts)
    prints = {row.doc_id: row.fingerprint for row in sketch.fingerprints(documents).collect()}
    for i, row in rows.items():
        text, other = texts[i], texts[following[i]]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + other[:cut]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == prints[i]
        assert row.edited_fingerprint == sketch.as_text(edited, sketch.sketch(edited))
        assert row.near_edited == sketch.likeness(row.fingerprint, row.edited_fingerprint)
        assert row.near_next == sketch.likeness(row.fingerprint, prints[following[i]])


def test_ranges_cover_many_documents(spark):
    rows = [(i * 7 % 4001, f"text {i}") for i in range(4001)]
    found = {row.doc_id: row for row in sketch.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    by_id = dict(rows)
    assert len(found) == 4001
    for i in range(4001):
        edited = sketch.edited_text(by_id[i], by_id[(i + 1) % 4001])
        assert found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


# --- quality rules ---------------------------------------------------------------------------------------------


def plain_rules(text: str) -> tuple:
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if often[window] > 1:
            covered.update(range(i, i + 5))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def plain_grams(text: str) -> list[int]:
    words = WORD.findall(text)
    return [zlib.crc32(w.encode()) % ngram_rules.BUCKETS for w in [*words, *map(" ".join, zip(words, words[1:]))]]


def test_rules_and_ratios(documents, labels, texts):
    good = {row.doc_id for row in labels.collect() if row.quality == 1}
    raw, target = Counter(), Counter()
    for i, text in texts.items():
        raw.update(plain_grams(text))
        if i in good:
            target.update(plain_grams(text))
    prior, raw_sum, target_sum = ngram_rules.SMOOTHING * ngram_rules.BUCKETS, raw.total(), target.total()
    ratio = {}
    for bucket, n in raw.items():
        share = n / raw_sum
        ratio[bucket] = round(1_000_000 * math.log((target[bucket] + prior * share) / (target_sum + prior) / share))
    for row in ngram_rules.quality_rules(documents, labels).collect():
        rules = plain_rules(texts[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed) == rules
        grams = plain_grams(texts[row.doc_id])
        llr = sum(ratio[g] for g in grams) / 1e6 / len(grams) if grams else 0.0
        assert row.llr == pytest.approx(llr, abs=2e-6)
        assert row.kept == (not rules[-1] and row.llr >= ngram_rules.THRESHOLD)


def test_no_python_in_the_rules(documents, labels):
    plan = ngram_rules.quality_rules(documents, labels)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_verdicts_can_be_filtered(documents, labels):
    rows = ngram_rules.quality_rules(documents, labels)
    assert rows.where("kept").count() == sum(row.kept for row in rows.collect())


# --- language model --------------------------------------------------------------------------------------------


def test_scores_and_normalisation(documents, texts):
    rows = katz.score(documents, block_documents=32).collect()
    tokens = {i: [*WORD.findall(text.translate(LOWER)), "</s> "] for i, text in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    words, pairs, contexts, after = Counter(), Counter(), Counter(), defaultdict(set)
    for i, found in tokens.items():
        if not held[i]:
            before = ["<s> ", *found[:-1]]
            words.update(found)
            pairs.update(zip(before, found))
            contexts.update(before)
    for u, w in pairs:
        after[u].add(w)
    total, types = words.total(), len(words)

    def discounts(counter):
        often = Counter(counter.values())
        return dict(enumerate(katz.good_turing(np.array([often[r] for r in range(1, katz.CLASSES + 1)])), 1))

    word_discount, pair_discount = discounts(words), discounts(pairs)
    unknown = 1 - sum(c * word_discount.get(c, katz.KEPT) for c in words.values()) / total

    def lower(w):
        return words[w] * word_discount.get(words[w], katz.KEPT) / total if w in words else unknown

    def seen(u, w):
        return pairs[u, w] * pair_discount.get(pairs[u, w], katz.KEPT) / contexts[u]

    def alpha(u):
        return (1 - sum(seen(u, w) for w in after[u])) / (1 - sum(map(lower, after[u])))

    def chance(u, w):
        if w in after[u]:
            return seen(u, w)
        return alpha(u) * lower(w) if u in contexts else lower(w)

    for u in ["<s> ", *list(after)[:40]]:
        assert sum(chance(u, w) for w in words) + chance(u, "never seen ") == pytest.approx(1, abs=1e-9)
    for row in rows:
        found = tokens[row.doc_id]
        assert (row.held_out, row.n_tokens, row.train_tokens) == (held[row.doc_id], len(found), total)
        assert row.n_known == sum(w in words for w in found)
        assert row.base_score == pytest.approx(sum(math.log10((words[w] + 1) / (total + types + 1)) for w in found))
        assert row.score == pytest.approx(sum(math.log10(chance(u, w)) for u, w in zip(["<s> ", *found[:-1]], found)))


def test_keys_survive_packing():
    keys = np.sort(np.random.default_rng(8).integers(0, 2**64, 1000, dtype=np.uint64))
    assert np.array_equal(katz.unpacked(katz.packed(keys)), keys)
    edges = katz.cuts(keys, 7)
    assert edges[0] == 0 and edges[-1] == len(keys) and (np.diff(edges) >= 0).all()


def test_discounts_on_thin_counts():
    for counts in ([0] * 6, [5, 0, 0, 0, 0, 0], [1, 9, 9, 9, 9, 9], [100, 40, 20, 12, 8, 6]):
        assert ((katz.good_turing(np.array(counts)) > 0) & (katz.good_turing(np.array(counts)) < 1)).all()


# --- personal data ---------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text: str) -> list:
    found = []
    for kind, pattern in PATTERNS.items():
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match.group())
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            fits = {
                "email": True,
                "ip": kind != "ip" or all(int(part) <= 255 for part in match.group().split(".")),
                "card": 14 <= len(digits) <= 19 and sum(n - 9 * (n > 9) for n in doubled) % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if fits:
                found.append((kind, *match.span()))
    return sorted(found, key=lambda span: (span[1], list(PATTERNS).index(span[0])))


def test_pattern_spans(texts):
    draw = random.Random(9)
    made = ["".join(draw.choices("0123456789.@+- ()ab1%é\n", k=draw.randint(1, 70))) for _ in range(20_000)]
    for text in [*made, *texts.values()]:
        assert skip_chain.pattern_spans(text) == plain_spans(text), text


def test_pattern_spans_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "+" * 300_000, "1." * 150_000, "@" * 300_000):
        skip_chain.pattern_spans(text)


@pytest.fixture(scope="module")
def field(documents):
    return skip_chain.train(documents)


def test_links_carry_labels(field):
    text = "Call +1 (297) 555-8151 now, or later (297) 555-8151. Card 4035501000000008, written 4035.5010.0000.0008, not 12345678."
    base, spans = field.spans(text)
    assert set(base) <= set(spans)
    assert [text[s:e] for kind, s, e in spans if (kind, s, e) not in base] == ["(297) 555-8151", "4035.5010.0000.0008"]
    assert "555" not in skip_chain.mask_text(text, spans)


def test_nothing_is_added_without_support(field):
    for text in ("555-8151 and (297) 555-8151", "card 4035501000000009", "mail a.b@c.example and 99 others"):
        base, spans = field.spans(text)
        assert base == spans


def test_marginals_equal_enumeration_on_a_tree(field):
    text = "+1 (297) 555-8151 x 12345 6789"
    tokens = skip_chain.Tokens(text, [])
    tokens.links = tokens.links[:0]
    size, labels = len(tokens.texts), skip_chain.LABELS
    local = np.array([field.unary[f].sum(axis=0) for f in tokens.features])
    total = np.zeros((size, labels))
    for state in np.ndindex(*[labels] * size):
        score = sum(local[i, k] for i, k in enumerate(state)) + sum(field.chain[state[i], state[i + 1]] for i in tokens.chain)
        for i, k in enumerate(state):
            total[i, k] += math.exp(score)
    exact = total / total.sum(axis=1, keepdims=True)
    assert np.allclose(field.marginals(tokens), exact, atol=0.02)


def test_sql_counterpart_of_the_rules(documents, labels):
    import duckdb

    from ledgerspark.llm.oracles import NGRAM_QUALITY_RULES
    from tests.llm.conftest import SMALL

    connection = duckdb.connect()
    for name in ("documents", "labels"):
        connection.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    expected = connection.execute(NGRAM_QUALITY_RULES).fetchall()
    names = [column[0] for column in connection.description]
    rows = ngram_rules.quality_rules(documents, labels).select(*names).collect()
    assert sorted(map(tuple, rows)) == sorted(expected)
