"""Declared schemas. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    names = {
        "string": T.StringType(),
        "long": T.LongType(),
        "int": T.IntegerType(),
        "double": T.DoubleType(),
        "timestamp": T.TimestampType(),
        "floats": T.ArrayType(T.FloatType()),
        "strings": T.ArrayType(T.StringType()),
    }
    fields = (part.split(":") for part in spec.split())
    return T.StructType([T.StructField(name, names[kind]) for name, kind in fields])


MERCHANT_RULES = _struct(
    "pattern:string normalized_merchant:string merchant_group:string default_category:string"
)

ENRICHMENT_CACHE = _struct(
    "raw_description:string suggested_merchant:string suggested_category:string suggested_merchant_group:string "
    "confidence:double reasoning:string model:string created_at:timestamp"
)
SUMMARY_CACHE = _struct(
    "summary_key:string model:string filters_json:string context_text:string response_text:string "
    "created_at:timestamp"
)
EMBEDDING_CACHE = _struct(
    "transaction_id:string embedding_model:string search_text:string embedding:floats created_at:timestamp"
)
QUERY_CACHE = _struct(
    "query_key:string query_text:string embedding_model:string embedding:floats created_at:timestamp"
)
RERANK_CACHE = T.StructType(
    [
        T.StructField("rerank_key", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("query_text", T.StringType()),
        T.StructField("documents", T.ArrayType(T.StringType())),
        T.StructField("results", T.ArrayType(_struct("index:int relevance_score:double"))),
        T.StructField("created_at", T.TimestampType()),
    ]
)
PROFILE_CACHE = _struct(
    "normalized_merchant:string merchant_group:string final_category:string merchant_summary:string "
    "semantic_tags:strings reasoning:string model:string created_at:timestamp"
)

# Key columns of each cache. The profile cache is keyed by merchant and model, because look-ups filter on both.
CACHE_KEYS = {
    "merchant_enrichment_cache": ["raw_description"],
    "spend_summary_cache": ["summary_key"],
    "transaction_embedding_cache": ["transaction_id", "embedding_model"],
    "search_query_cache": ["query_key"],
    "search_rerank_cache": ["rerank_key"],
    "merchant_profile_cache": ["normalized_merchant", "model"],
}
CACHE_SCHEMAS = {
    "merchant_enrichment_cache": ENRICHMENT_CACHE,
    "spend_summary_cache": SUMMARY_CACHE,
    "transaction_embedding_cache": EMBEDDING_CACHE,
    "search_query_cache": QUERY_CACHE,
    "search_rerank_cache": RERANK_CACHE,
    "merchant_profile_cache": PROFILE_CACHE,
}

# Replies of an external model. Confidence stays text so that a malformed number can be told apart from none.
ENRICHMENT_REPLY = _struct(
    "suggested_merchant:string suggested_category:string suggested_merchant_group:string confidence:string "
    "reasoning:string _malformed:string"
)
PROFILE_REPLY_ITEM = _struct(
    "normalized_merchant:string merchant_summary:string semantic_tags:strings reasoning:string"
)
PROFILE_REPLY = T.StructType(
    [
        T.StructField("profiles", T.ArrayType(PROFILE_REPLY_ITEM)),
        T.StructField("_malformed", T.StringType()),
    ]
)
