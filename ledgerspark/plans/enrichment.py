"""Enrichment and profile cycles over tables of model replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerspark import constants as K
from ledgerspark.functions.text import extract_json_object, json_slice, normalise_tags, or_default, strip
from ledgerspark.operators.aggregates import description_samples, total
from ledgerspark.operators.caches import cache_upsert
from ledgerspark.operators.joins import anti_join
from ledgerspark.operators.ordering import multi_key_sort, sort_columns, top_k_limit
from ledgerspark.schemas import CACHE_KEYS, ENRICHMENT_CACHE, ENRICHMENT_REPLY, PROFILE_CACHE, PROFILE_REPLY

# --- enrichment of raw descriptions -----------------------------------------------------------------------------


def uncached_candidates(review: DataFrame, cache: DataFrame, n: int) -> DataFrame:
    """The ``n`` most urgent review rows that have no cached enrichment."""
    waiting = anti_join(review.filter("needs_review"), cache, "raw_description")
    order = [("review_priority_score", "desc"), ("total_spend", "desc"), ("raw_description", "asc"),
             ("raw_category", "asc")]
    return top_k_limit(waiting, order, n).select(
        "raw_description", "raw_category", "transaction_count", "total_spend", "review_priority_score"
    )


def parse_replies(replies: DataFrame, candidates: DataFrame) -> DataFrame:
    """Replies of the asked descriptions, parsed; ``accepted`` tells usable replies from rejects."""
    asked = candidates.groupBy("raw_description").agg(F.min("raw_category").alias("raw_category"))
    parsed = replies.join(asked, on="raw_description").withColumns(
        {
            "__reply": extract_json_object(F.col("reply"), ENRICHMENT_REPLY),
            "__found": json_slice(F.col("reply")).isNotNull(),
        }
    )
    stated = F.col("__reply.confidence")
    confidence = F.coalesce(F.nullif(stated, F.lit("")).try_cast("double"), F.lit(0.0))
    readable = stated.isNull() | (stated == "") | stated.try_cast("double").isNotNull()
    usable = F.col("__found") & F.col("__reply._malformed").isNull() & readable
    return parsed.withColumns({"__confidence": confidence, "accepted": usable})


def validate_enrichment(replies: DataFrame, candidates: DataFrame) -> DataFrame:
    """Cache rows from usable replies, with defaults for what a reply leaves out."""
    rows = parse_replies(replies, candidates).filter("accepted")
    raw = F.col("raw_description")
    category = F.coalesce(
        F.nullif(F.col("__reply.suggested_category"), F.lit("")),
        F.nullif(F.col("raw_category"), F.lit("")),
        F.lit(K.OTHER_CATEGORY),
    )
    return rows.select(
        "raw_description",
        F.coalesce(F.nullif(F.col("__reply.suggested_merchant"), F.lit("")), raw).alias("suggested_merchant"),
        F.when(category.isin(K.ALLOWED_CATEGORIES), category)
        .otherwise(K.OTHER_CATEGORY)
        .alias("suggested_category"),
        or_default(F.col("__reply.suggested_merchant_group"), K.DEFAULT_ENRICHED_GROUP).alias(
            "suggested_merchant_group"
        ),
        F.col("__confidence").alias("confidence"),
        F.coalesce(F.col("__reply.reasoning"), F.lit("")).alias("reasoning"),
        "model",
        "created_at",
    )


def rejected_replies(replies: DataFrame, candidates: DataFrame) -> DataFrame:
    return parse_replies(replies, candidates).filter("not accepted").select("raw_description", "reply")


def enrichment_cycle(review: DataFrame, cache: DataFrame, replies: DataFrame, n: int = 25) -> DataFrame:
    """The enrichment cache after one cycle: pick candidates, validate their replies, upsert."""
    candidates = uncached_candidates(review, cache, n)
    names = ENRICHMENT_CACHE.fieldNames()
    fresh = validate_enrichment(replies, candidates)
    return cache_upsert(cache.select(*names), fresh, CACHE_KEYS["merchant_enrichment_cache"])


# --- merchant profiles ----------------------------------------------------------------------------------------------


def merchant_candidates(fact: DataFrame) -> DataFrame:
    """Merchants with group, category, volume and their first few descriptions, busiest first.

    A request shows no more than these, so no merchant's descriptions are gathered whole.
    """
    key = "normalized_merchant"
    rolled = fact.groupBy(key).agg(
        F.min("merchant_group").alias("merchant_group"),
        F.min("final_category").alias("final_category"),
        F.count(F.lit(1)).alias("transaction_count"),
        total("amount_abs", F.col("is_debit")).alias("debit_spend"),
    )
    texts = description_samples(fact, key, "raw_description").select(
        key, F.array_join("samples", " || ").alias("raw_descriptions")
    )
    return multi_key_sort(
        rolled.join(texts, on=key, how="left"),
        [("transaction_count", "desc"), ("debit_spend", "desc"), (key, "asc")],
    )


def profile_uncached(candidates: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    return anti_join(candidates, cache.filter(F.col("model") == model), "normalized_merchant")


def profile_requests(candidates: DataFrame, cache: DataFrame, model: str, n: int, batch: int = K.PROFILE_BATCH) -> DataFrame:
    """The next ``n`` merchants to ask for, busiest first, in numbered batches of ``batch``.

    Only these ``n`` rows are numbered in one place.
    """
    order = [("transaction_count", "desc"), ("debit_spend", "desc"), ("normalized_merchant", "asc")]
    following = top_k_limit(profile_uncached(candidates, cache, model), order, n)
    place = F.row_number().over(Window.orderBy(*sort_columns(order)))
    return following.withColumn("place", place).withColumn("batch", F.ceil(F.col("place") / batch))


def profile_batch_match(replies: DataFrame, batch: DataFrame) -> DataFrame:
    """Profiles inside batched replies, for merchants that were asked for; the last reply of a merchant wins.

    ``replies`` has ``reply_id`` (their order) and ``reply``.
    """
    items = replies.select(
        "reply_id", F.posexplode(extract_json_object(F.col("reply"), PROFILE_REPLY)["profiles"]).alias("__at", "item")
    )
    named = items.filter(F.col("item").isNotNull()).withColumn(
        "normalized_merchant", strip(F.col("item.normalized_merchant"))
    )
    asked = batch.groupBy("normalized_merchant").agg(
        F.min("merchant_group").alias("merchant_group"), F.min("final_category").alias("final_category")
    )
    matched = named.join(asked, on="normalized_merchant")
    last = matched.groupBy("normalized_merchant", "merchant_group", "final_category").agg(
        F.max(F.struct("reply_id", "__at", "item")).alias("__last")
    )
    item = F.col("__last.item")
    return last.select(
        "normalized_merchant",
        "merchant_group",
        "final_category",
        F.coalesce(strip(item["merchant_summary"]), F.lit("")).alias("merchant_summary"),
        normalise_tags(item["semantic_tags"], F.col("final_category")).alias("semantic_tags"),
        F.coalesce(strip(item["reasoning"]), F.lit("")).alias("reasoning"),
    )


def rejected_profiles(replies: DataFrame, batch: DataFrame) -> DataFrame:
    """What ``profile_batch_match`` cannot use, with the reason: whole replies without a readable object or without
    profiles, and items (``place`` in their reply) that name no merchant or one that was not asked for."""
    parsed = replies.select("reply_id", "reply", json_slice(F.col("reply")).alias("__slice"))
    parsed = parsed.withColumn("__profiles", extract_json_object(F.col("reply"), PROFILE_REPLY)["profiles"])
    readable = F.try_parse_json("__slice").isNotNull()
    reason = (
        F.when(F.col("__slice").isNull(), "no object")
        .when(~readable, "unreadable")
        .when(F.coalesce(F.size("__profiles"), F.lit(0)) <= 0, "no profiles")
    )
    whole = parsed.withColumn("reason", reason).filter("reason is not null")
    items = parsed.filter(readable).select("reply_id", F.posexplode("__profiles").alias("place", "item"))
    named = items.withColumn("normalized_merchant", F.nullif(strip(F.col("item.normalized_merchant")), F.lit("")))
    asked = batch.select("normalized_merchant").distinct()
    nameless = named.filter("normalized_merchant is null").withColumn("reason", F.lit("no merchant"))
    strangers = anti_join(named.filter("normalized_merchant is not null"), asked, "normalized_merchant").withColumn("reason", F.lit("not asked for"))
    found = nameless.unionByName(strangers).select(
        "reply_id", "place", "normalized_merchant", "reason", F.to_json("item").alias("content")
    )
    nothing = F.lit(None).cast("string")
    return found.unionByName(
        whole.select("reply_id", F.lit(None).cast("int").alias("place"), nothing.alias("normalized_merchant"), "reason", F.col("reply").alias("content"))
    )


def profile_backfill(
    candidates: DataFrame, cache: DataFrame, replies: DataFrame, model: str, created_at
) -> DataFrame:
    """The profile cache after a back-fill of the merchants it does not know for this model."""
    waiting = profile_uncached(candidates, cache, model)
    fresh = profile_batch_match(replies, waiting).withColumns(
        {"model": F.lit(model), "created_at": F.lit(created_at).cast("timestamp")}
    )
    return cache_upsert(cache.select(*PROFILE_CACHE.fieldNames()), fresh, CACHE_KEYS["merchant_profile_cache"])


def profile_backfill_stats(
    candidates: DataFrame, cache: DataFrame, replies: DataFrame, model: str
) -> DataFrame:
    """Candidates by outcome of a back-fill: inserted, skipped (cached before) or failed (no usable reply)."""
    known = cache.filter(F.col("model") == model).select("normalized_merchant").distinct()
    answered = profile_batch_match(replies, candidates).select("normalized_merchant")
    marked = (
        candidates.select("normalized_merchant")
        .join(known.withColumn("__known", F.lit(True)), on="normalized_merchant", how="left")
        .join(answered.withColumn("__answered", F.lit(True)), on="normalized_merchant", how="left")
    )
    status = F.when(F.col("__known"), "skipped").when(F.col("__answered"), "inserted").otherwise("failed")
    return marked.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("merchants"))
