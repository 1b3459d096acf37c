"""Search documents, embedding back-fill, batch hybrid search, reranking and gating."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerspark import constants as K
from ledgerspark.functions.text import (
    content_key,
    expanded_terms,
    profile_text,
    search_text,
    strip,
    synonym_map,
)
from ledgerspark.functions.vectors import confidence_label, cosine_prepared, hybrid_score, is_confident, norm
from ledgerspark.operators.caches import cache_upsert, stale_cache_split
from ledgerspark.operators.joins import anti_join, lookup_map_join
from ledgerspark.operators.ordering import top_k_limit
from ledgerspark.operators.windows import top_k_per_group
from ledgerspark.schemas import CACHE_KEYS, EMBEDDING_CACHE, QUERY_CACHE, RERANK_CACHE
from ledgerspark.session import stored

DOCUMENT_COLUMNS = [
    "transaction_id",
    "transaction_date",
    "normalized_merchant",
    "merchant_group",
    "final_category",
    "amount_abs",
    "raw_description",
    "merchant_source",
    "is_recurring",
    "is_anomaly",
]

# Queries that meet a document at a time, on average, and slices that spread the documents of one block of queries.
BLOCK_QUERIES = 64
SLICES = 64


def profile_lookup(profiles: DataFrame, model: str | None = None) -> DataFrame:
    """Profile sentence per merchant, for one model where the cache holds several."""
    kept = profiles.filter(F.col("model") == model) if model else profiles
    text = profile_text(F.col("merchant_summary"), F.col("semantic_tags"))
    return kept.select("normalized_merchant", text.alias("merchant_profile_text"))


def build_search_documents(fact: DataFrame, profile_texts: DataFrame) -> DataFrame:
    """Searchable transactions: a labelled sentence followed by the merchant's profile sentence, if any."""
    joined = lookup_map_join(fact, profile_texts, "normalized_merchant", {"merchant_profile_text": F.lit("")})
    text = F.concat(search_text(), F.lit(" "), F.col("merchant_profile_text"))
    return joined.select(*DOCUMENT_COLUMNS, text.alias("search_text"))


def newest_first(fact: DataFrame, limit: int = 0) -> DataFrame:
    """Transactions for a back-fill run: all of them, or the newest ``limit``."""
    order = [("transaction_date", "desc"), ("transaction_id", "asc")]
    return top_k_limit(fact, order, limit) if limit > 0 else fact


# --- embedding back-fill ---------------------------------------------------------------------------------------

EmbedFunction = Callable[[list[str]], list[list[float]]]


def embed_documents(docs: DataFrame, embed: EmbedFunction, model: str, batch: int = K.EMBED_BATCH) -> DataFrame:
    """New cache rows for documents, calling ``embed`` with at most ``batch`` texts at a time on the executors."""
    schema = "transaction_id string, search_text string, embedding array<float>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                yield part.assign(embedding=embed(part["search_text"].tolist()))

    vectors = docs.select(F.col("transaction_id").cast("string"), "search_text").mapInPandas(run, schema)
    return vectors.select(
        "transaction_id",
        F.lit(model).alias("embedding_model"),
        "search_text",
        "embedding",
        F.current_timestamp().alias("created_at"),
    )


def embedding_backfill(
    docs: DataFrame, cache: DataFrame, embed: EmbedFunction, model: str, batch: int = K.EMBED_BATCH
) -> DataFrame:
    """The cache after embedding every document that is new or whose text changed.

    The new vectors are written before they are merged: each text is sent to the model once, and a later failure
    does not send it again.
    """
    split = stale_cache_split(docs, cache, "transaction_id", "search_text", model)
    fresh = stored(embed_documents(split.filter("status <> 'hit'"), embed, model, batch), "embedded")
    names = EMBEDDING_CACHE.fieldNames()
    return cache_upsert(cache.select(*names), fresh, ["transaction_id", "embedding_model"])


def query_vector_cache(
    queries: DataFrame, cache: DataFrame, embed: EmbedFunction, model: str, batch: int = K.EMBED_BATCH
) -> DataFrame:
    """The query cache after embedding every searchable query it does not hold; equal texts are embedded once."""
    asked = query_guard(queries).select("query_text").distinct()
    key = content_key(embedding_model=F.lit(model), query_text=F.col("query_text"))
    waiting = anti_join(asked.withColumn("query_key", key), cache, "query_key")
    schema = "query_key string, query_text string, embedding array<float>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                yield part.assign(embedding=embed(part["query_text"].tolist()))

    made = stored(waiting.select("query_key", "query_text").mapInPandas(run, schema), "query-vectors")
    fresh = made.withColumns({"embedding_model": F.lit(model), "created_at": F.current_timestamp()})
    names = QUERY_CACHE.fieldNames()
    return cache_upsert(cache.select(*names), fresh.select(*names), CACHE_KEYS["search_query_cache"])


RerankFunction = Callable[[str, list[str]], list[float]]


def rerank_requests(candidates: DataFrame, model: str) -> DataFrame:
    """One request per query: its few candidates' texts in their order, and the key of the cached answer."""
    listed = F.array_sort(F.collect_list(F.struct("candidate_index", "search_text")))
    asked = candidates.groupBy("query_id", "query_text").agg(listed["search_text"].alias("documents"))
    key = content_key(model=F.lit(model), query_text=F.col("query_text"), documents=F.col("documents"))
    return asked.withColumn("rerank_key", key)


def rerank_cache(candidates: DataFrame, cache: DataFrame, rerank: RerankFunction, model: str) -> DataFrame:
    """The rerank cache after asking for every list of candidates it does not hold; equal requests are made once."""
    waiting = anti_join(rerank_requests(candidates, model), cache, "rerank_key").drop("query_id")
    schema = "rerank_key string, query_text string, documents array<string>, scores array<double>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = [rerank(text, list(texts)) for text, texts in zip(frame["query_text"], frame["documents"], strict=True)]
            yield frame.assign(scores=scores)

    asked = waiting.dropDuplicates(["rerank_key"]).select("rerank_key", "query_text", "documents")
    made = stored(asked.mapInPandas(run, schema), "rerank-scores")
    result = F.transform("scores", lambda score, place: F.struct(place.alias("index"), score.alias("relevance_score")))
    fresh = made.withColumns({"results": result, "model": F.lit(model), "created_at": F.current_timestamp()})
    names = RERANK_CACHE.fieldNames()
    return cache_upsert(cache.select(*names), fresh.select(*names), CACHE_KEYS["search_rerank_cache"])


def cached_rerank_scores(candidates: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Scores by query and place from the cache, as ``rerank_merge`` takes them."""
    held = rerank_requests(candidates, model).join(cache.select("rerank_key", "results"), on="rerank_key")
    item = held.select("query_id", F.explode("results").alias("item"))
    return item.select(
        "query_id", F.col("item.index").alias("candidate_index"), F.col("item.relevance_score").alias("rerank_score")
    )


def attach_embeddings(docs: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    vectors = cache.filter(F.col("embedding_model") == model).select("transaction_id", "embedding")
    return docs.join(vectors, on="transaction_id", how="left")


# --- batch search ------------------------------------------------------------------------------------------------


def query_guard(queries: DataFrame, min_length: int = K.MIN_QUERY_LENGTH) -> DataFrame:
    """Queries long enough to search for, with surrounding white space removed."""
    cleaned = queries.withColumn("query_text", strip(F.col("query_text")))
    return cleaned.filter(F.length("query_text") >= min_length)


def expand_query(queries: DataFrame) -> DataFrame:
    return queries.withColumn("terms", expanded_terms(F.col("query_text"), synonym_map()))


def prepared_query(vector: Column) -> Column:
    """What the scores need of a query with its expanded terms."""
    term = F.transform("terms", lambda t: F.struct(
        t.alias("term"), F.concat(F.lit(" "), t, F.lit(" ")).alias("word"), F.contains(t, F.lit(" ")).alias("phrase")
    ))
    return F.struct(
        "query_id", "query_text", F.lower("query_text").alias("cleaned"), term.alias("terms"),
        vector.alias("vector"), norm(vector).alias("length"),
    )


def query_blocks(queries: DataFrame) -> tuple[DataFrame, Column]:
    """The searchable queries, about ``BLOCK_QUERIES`` to a block and every block once for each slice, and the
    number of blocks. However many queries there are, they stay a table."""
    asked = expand_query(query_guard(queries))
    vector = F.col("embedding") if "embedding" in queries.columns else F.lit(None).cast("array<float>")
    prepared = asked.select(prepared_query(vector).alias("query"), F.xxhash64("query_id", "query_text").alias("__spread"))
    count = F.greatest(query_guard(queries).agg(F.ceil(F.count("*") / BLOCK_QUERIES)).scalar(), F.lit(1)).cast("int")
    blocks = prepared.groupBy(F.pmod("__spread", count).cast("int").alias("__block"))
    listed = blocks.agg(F.collect_list("query").alias("__queries"))
    return listed.withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))), count


def prepare_text(docs: DataFrame, text: str) -> DataFrame:
    """Add what all lexical tests of a document share: its lowered text, and its tokens between blanks."""
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    words = F.concat(F.lit(" "), F.regexp_replace("__lowered", "[^a-z0-9]+", " "), F.lit(" "))
    return docs.withColumn("__lowered", lowered).withColumn("__words", words)


def with_queries(queries: DataFrame, docs: DataFrame, text: str, document_id: str) -> DataFrame:
    """Documents with ``__query``, once for each searchable query, by an equi-join on block and slice.

    A document is prepared once and then meets every block of queries. The queries are broadcast only if Catalyst
    finds them small; otherwise slices keep the documents of a block apart.
    """
    blocks, count = query_blocks(queries)
    dealt = prepare_text(docs, text).withColumn(
        "__slice", F.pmod(F.xxhash64(document_id), F.lit(SLICES)).cast("int")
    )
    met = dealt.withColumn("__block", F.explode(F.sequence(F.lit(0), count - 1))).join(blocks, ["__block", "__slice"])
    return met.withColumn("__query", F.explode("__queries")).drop("__queries", "__block", "__slice")


def prepared_lexical_score() -> Column:
    """Lexical score of a document for ``__query``, from ``__lowered`` and ``__words``."""
    lowered, words, query = F.col("__lowered"), F.col("__words"), F.col("__query")
    whole = F.when(F.contains(lowered, query["cleaned"]), K.WHOLE_QUERY_SCORE).otherwise(0.0)

    def weight(term: Column) -> Column:
        inside = F.contains(lowered, term["term"])
        phrase = F.when(inside, K.PHRASE_SCORE).otherwise(0.0)
        word = F.when(F.contains(words, term["word"]), K.TOKEN_SCORE).when(inside, K.PART_SCORE).otherwise(0.0)
        return F.when(term["phrase"], phrase).otherwise(word)

    return F.aggregate(query["terms"], whole, lambda total, term: total + weight(term))


def lexical_search(queries: DataFrame, docs: DataFrame, text: str, document_id: str = "doc_id") -> DataFrame:
    """Documents with a positive lexical score for a query; the document's text stays behind."""
    names = [name for name in docs.columns if name != text]
    met = with_queries(queries, docs, text, document_id)
    scored = met.select(*names, F.col("__query.query_id"), prepared_lexical_score().alias("lexical_score"))
    return scored.filter("lexical_score > 0")


def score_documents(
    queries: DataFrame, docs: DataFrame, text: str = "search_text", document_id: str = "transaction_id"
) -> DataFrame:
    """Every document with its semantic, lexical and hybrid score for every query, lazily; keep the best of them."""
    names = [name for name in docs.columns if name != "embedding"]
    measured = docs.withColumn("__length", norm(F.col("embedding")))
    query = F.col("__query")
    semantic = cosine_prepared(F.col("embedding"), F.col("__length"), query["vector"], query["length"])
    return (
        with_queries(queries, measured, text, document_id)
        .select(
            F.col("__query.query_id"),
            F.col("__query.query_text"),
            *names,
            semantic.alias("semantic_score"),
            prepared_lexical_score().alias("lexical_score"),
        )
        .withColumn("hybrid_score", hybrid_score(F.col("semantic_score"), F.col("lexical_score")))
    )


def hybrid_search(
    queries: DataFrame,
    docs: DataFrame,
    result_limit: int = K.RESULT_LIMIT,
    candidate_count: int = K.CANDIDATE_COUNT,
    text: str = "search_text",
    document_id: str = "transaction_id",
    recency: str = "transaction_date",
) -> DataFrame:
    """Best candidates per query by hybrid score, then semantic score, then newest, with their 0-based place."""
    k = max(result_limit, candidate_count)
    order = [F.desc("hybrid_score"), F.desc("semantic_score"), F.desc_nulls_last(recency), F.asc(document_id)]
    scored = score_documents(queries, docs, text, document_id)
    ranked = top_k_per_group(scored, ["query_id"], order, k, document_id, "candidate_index")
    return ranked.withColumn("candidate_index", F.col("candidate_index") - 1)


def rerank_merge(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates with external rerank scores by place; a query without any score keeps its hybrid order."""
    scored_queries = scores.select("query_id").distinct().withColumn("__scored", F.lit(True))
    merged = candidates.join(scores, on=["query_id", "candidate_index"], how="left")
    source = F.when(F.col("__scored"), "cohere_rerank").otherwise("hybrid_semantic")
    return merged.join(scored_queries, on="query_id", how="left").withColumn("rank_source", source).drop("__scored")


def confidence_gate(df: DataFrame) -> DataFrame:
    return df.filter(is_confident(F.col("rerank_score"), F.col("semantic_score"), F.col("lexical_score")))


def rerank_and_gate(candidates: DataFrame, scores: DataFrame, k: int = K.RESULT_LIMIT) -> DataFrame:
    """Final results per query: reranked, labelled, gated by confidence, limited, ranked from 1."""
    label = confidence_label(F.col("rerank_score"), F.col("semantic_score"), F.col("lexical_score"))
    kept = confidence_gate(rerank_merge(candidates, scores).withColumn("match_confidence", label))
    order = Window.partitionBy("query_id").orderBy(
        F.desc_nulls_last("rerank_score"),
        F.desc_nulls_last("hybrid_score"),
        F.desc_nulls_last("semantic_score"),
        "candidate_index",
    )
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_diagnostics(candidates: DataFrame, n: int = 5) -> DataFrame:
    """The first candidates of each query with their scores, and how many candidates there were."""
    counted = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidate_count"))
    first = candidates.filter(F.col("candidate_index") < n).select(
        "query_id",
        "candidate_index",
        "hybrid_score",
        "semantic_score",
        "lexical_score",
        "normalized_merchant",
        "raw_description",
    )
    return first.join(counted, on="query_id", how="left")
