"""Operator 9: quality rules, and a verdict by the log-likelihood ratio of hashed n-grams.

A word or a pair of words falls into one of ``BUCKETS`` hash buckets. Two multinomials over the buckets are counted:
a trusted target, documents labelled good, and the raw corpus, all documents. A document's ratio is the mean over its
n-grams of log(target share / raw share), so it does not depend on the length. Documents at or above ``THRESHOLD``
are kept, unless the plain rules reject them. Target shares are smoothed with ``SMOOTHING`` raw-distributed n-grams a
bucket. Ratios are whole millionths, so that sums are exact in any order.

Both counts cover all rows: the target is every document with a good label, found by an even join on the ids.
Everything is a DataFrame or SQL expression. The counts are aggregated map-side to at most ``BUCKETS`` rows a task and
come back as one array of that fixed size.

Defined results: a null text is an empty text; a document without n-grams has ratio 0; without good labels every
ratio is that of an untrained target, 0; repeated rows are judged each; an empty table gives an empty result; of the
documents only the id and text columns are read, except by ``kept_documents``, which keeps all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fields

BUCKETS = 1 << 18
SMOOTHING = 3.0
THRESHOLD = -0.15
SCALE = 1_000_000
#: The plain rules: fewest words, words of a window that may repeat, and the per cent of repeated words allowed.
LEAST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20


def words(text: str = "text") -> Column:
    """The words of a text. Splitting at a single character is much cheaper than at an expression."""
    spaced = F.coalesce(F.col(text), F.lit(""))
    for space in "\t\n\v\f\r":
        spaced = F.replace(spaced, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def bucket_of(gram: Column) -> Column:
    return (F.crc32(gram.cast("binary")) % BUCKETS).cast("int")


def grams(words_column: str = "words") -> Column:
    """Buckets of the words and of the pairs of adjacent words."""
    single = F.transform(words_column, bucket_of)
    pairs = F.expr(
        f"transform(sequence(0, size({words_column}) - 2), i -> cast(crc32(cast(concat({words_column}[i], ' ',"
        f" {words_column}[i + 1]) as binary)) % {BUCKETS} as int))"
    )
    return F.when(F.size(words_column) >= 2, F.concat(single, pairs)).otherwise(single)


def adjacent() -> Column:
    """Each of ``words`` with the one after it, null after the last."""
    return F.arrays_zip(F.col("words").alias("own"), F.expr("slice(words, 2, size(words))").alias("next"))


def pair_buckets() -> list[Column]:
    """Buckets of the word and of the two words of a ``pair`` from ``adjacent``."""
    return [bucket_of(F.col("pair.own")), bucket_of(F.concat("pair.own", F.lit(" "), "pair.next"))]


def bucket_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """For each bucket, its n-grams in all documents and in the trusted ones.

    The join is the same at every size. Words and pairs are made as rows, which compiles, where functions on arrays
    would be interpreted.
    """
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct().withColumn("good", F.lit(True))
    flagged = fields(documents, doc_id="doc_id", text="text").join(good.hint("shuffle_hash"), "doc_id", "left")
    listed = flagged.select(F.col("good").isNotNull().alias("good"), words().alias("words"))
    pairs = listed.select("good", F.explode(adjacent()).alias("pair"))
    found = pairs.select("good", F.explode(F.array(*pair_buckets())).alias("bucket")).where("bucket is not null")
    return found.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("good").alias("target"))


def bucket_ratios(counts: DataFrame) -> DataFrame:
    """One row, one array: for each bucket the log ratio of its target and raw shares in whole millionths.

    The array has ``BUCKETS`` entries whatever the corpus. A bucket that no document fills is never looked up.
    """
    prior = SMOOTHING * BUCKETS
    every = counts.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    listed = every.agg(
        F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("found"),
        F.sum("raw").alias("raw_sum"),
        F.sum("target").alias("target_sum"),
    )
    return listed.select(
        F.expr(
            f"transform(found, b -> if(b.raw is null, 0, cast(round({SCALE} * ln((b.target + {prior}D * b.raw / raw_sum)"
            f" / (target_sum + {prior}D) / (b.raw / raw_sum))) as int)))"
        ).alias("ratios")
    )


def rule_columns(documents: DataFrame) -> DataFrame:
    """Add the columns of the plain rules and ``words`` to documents with a column ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = documents.withColumn("words", words()).withColumn("lines", lines)
    counted = counted.select(
        *[name for name in counted.columns if name != "lines"],
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
    )
    return with_repeated_words(counted).withColumn(
        "base_failed",
        (F.col("n_words") < LEAST_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MOST_REPEATED) * F.col("n_words")),
    )


def with_repeated_words(counted: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``, the words inside windows that occur at least twice in their text.

    Windows are compared by 64-bit hashes. Only texts with equal hashes go on to sort them; the places of repeated
    windows then give the words they cover, each counted once.
    """
    window = ", ".join(f"words[i + {place}]" for place in range(WINDOW))
    hashed = counted.withColumn(
        "windows",
        F.expr(f"if(size(words) >= {WINDOW}, transform(sequence(0, size(words) - {WINDOW}), i -> xxhash64({window})), array())"),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = hashed.withColumn("ordered", F.when(repeats, F.expr("sort_array(transform(windows, (h, i) -> struct(h, i)))")))
    placed = ordered.withColumn(
        "places",
        F.expr(
            "sort_array(filter(transform(ordered, (w, j) -> if((j > 0 and w.h = ordered[j - 1].h)"
            " or (j + 1 < size(ordered) and w.h = ordered[j + 1].h), w.i, -1)), place -> place >= 0))"
        ),
    )
    covered = placed.withColumn(
        "n_repeat_words",
        F.expr(
            f"coalesce(aggregate(transform(places, (place, k) -> if(k + 1 < size(places), least({WINDOW},"
            f" places[k + 1] - place), {WINDOW})), 0L, (sum, n) -> sum + n), 0L)"
        ),
    )
    return covered.drop("windows", "ordered", "places")


def judged(documents: DataFrame, ratios: DataFrame) -> DataFrame:
    """Add the plain rules, ``llr`` (the mean ratio of a document's n-grams) and ``kept``."""
    listed = rule_columns(documents).withColumn("grams", grams()).withColumn("ratios", ratios.scalar())
    scored = listed.withColumn("sum", F.expr("aggregate(grams, 0L, (sum, gram) -> sum + ratios[gram])"))
    llr = F.when(F.size("grams") > 0, F.col("sum") / SCALE / F.size("grams")).otherwise(0.0)
    # The always-true test of a row number keeps Catalyst from copying all this into a filter, once for each use.
    kept = (~F.col("base_failed")) & (F.col("llr") >= THRESHOLD) & (F.monotonically_increasing_id() >= 0)
    return scored.withColumn("llr", llr).withColumn("kept", kept).drop("words", "grams", "ratios", "sum")


def quality_rules(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The plain rules and the verdict for every document. The texts are read twice and shuffled once, to meet the labels.

    Ratios are looked up and summed over words and pairs as rows, which compiles, where ``judged`` runs functions on arrays. The
    rows of a document lie together, so a task sends on one short row a document.
    """
    ratios = bucket_ratios(bucket_counts(documents, labels))
    ruled = rule_columns(fields(documents, doc_id="doc_id", text="text")).withColumn("row", F.monotonically_increasing_id())
    rules = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    # A document without words keeps a row, and its missing n-grams add nothing.
    pairs = ruled.select("row", "doc_id", *rules, F.explode_outer(adjacent()).alias("pair")).withColumn("ratios", ratios.scalar())
    ratio = [F.coalesce(F.col("ratios")[bucket], F.lit(0)).cast("bigint") for bucket in pair_buckets()]
    summed = pairs.groupBy("row", "doc_id").agg(*[F.first(rule).alias(rule) for rule in rules], F.sum(ratio[0] + ratio[1]).alias("sum"))
    n_grams = F.col("n_words") + F.greatest(F.col("n_words") - 1, F.lit(0))
    judged_rows = summed.withColumn("llr", F.when(n_grams > 0, F.col("sum") / SCALE / n_grams).otherwise(0.0))
    return judged_rows.select("doc_id", *rules, "llr", ((~F.col("base_failed")) & (F.col("llr") >= THRESHOLD)).alias("kept"))


def kept_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns kept, that pass the rules and the verdict."""
    ratios = bucket_ratios(bucket_counts(documents, labels))
    whole = documents.select(F.struct("*").alias("row"), F.col("text"))
    return judged(whole, ratios).where("kept").select("row.*")
