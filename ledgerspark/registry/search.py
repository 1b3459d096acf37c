"""Search, enrichment cycles and data-quality tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark import testbed
from ledgerspark.constants import DECLARED_TESTS, REQUIRED_COLUMNS
from ledgerspark.operators import caches, quality
from ledgerspark.functions.text import content_key
from ledgerspark.oracle.base import ALL_MARTS, LAYERS, WITH_DAILY, WITH_SEARCH, out
from ledgerspark.plans import enrichment, search, vector_index
from ledgerspark.plans.pipeline import build_marts, tested_tables
from ledgerspark.registry.context import Context
from ledgerspark.registry.expressions import REPLIES_SQL, enrichment_replies, profile_replies
from ledgerspark.registry.relational import embedding_states
from ledgerspark.schemas import RERANK_CACHE
from ledgerspark.session import stored

ID = "transaction_id"


def documents(c: Context):
    return search.build_search_documents(c.fact, search.profile_lookup(c.profiles, testbed.MODEL))


def backfill(c: Context):
    cache = caches_with_floats(c)
    filled = search.embedding_backfill(c.documents, cache, testbed.letter_counts, testbed.EMBED_MODEL)
    return filled.select(ID, "search_text", "embedding")


def caches_with_floats(c: Context):
    """Cached vectors of the stand-in model: right for hits, outdated for stale rows, none for new ones."""
    text = F.col("search_text")
    counts = [F.length(text) - F.length(F.replace(text, F.lit(vowel), F.lit(""))) for vowel in "aeiou"]
    vector = F.array(F.length(text), *counts).cast("array<float>")
    return embedding_states(c).withColumn("embedding", vector)


def stats(c: Context):
    split = caches.stale_cache_split(c.documents, embedding_states(c), ID, "search_text", testbed.EMBED_MODEL)
    return caches.backfill_stats(split)


def query_vectors(c: Context):
    """Every user turn as a query; the cache already holds those of even turns, with outdated vectors."""
    turns = testbed.conversation_queries(c.spark, c.dir).filter("role = 'user'")
    guarded = search.query_guard(turns).filter("query_id % 2 = 0").select("query_text").distinct()
    key = content_key(embedding_model=F.lit(testbed.EMBED_MODEL), query_text=F.col("query_text"))
    held = guarded.select(
        key.alias("query_key"), "query_text", F.lit(testbed.EMBED_MODEL).alias("embedding_model"),
        F.array(F.lit(0.0)).cast("array<float>").alias("embedding"),
        F.lit(testbed.CACHE_TIME).cast("timestamp").alias("created_at"),
    )
    filled = search.query_vector_cache(turns, held, testbed.letter_counts, testbed.EMBED_MODEL)
    return filled.select("query_key", "query_text", "embedding_model", "embedding")


def reranked(c: Context):
    """Scores of the candidates of every query, asked for once and then read from the cache."""
    found = stored_candidates(c)
    empty = c.spark.createDataFrame([], RERANK_CACHE)
    cache = search.rerank_cache(found, empty, testbed.shared_letters, testbed.EMBED_MODEL)
    again = search.rerank_cache(found, stored(cache, "rerank-cache"), testbed.shared_letters, testbed.EMBED_MODEL)
    return search.cached_rerank_scores(found, again, testbed.EMBED_MODEL)


def candidates(c: Context):
    return search.hybrid_search(c.queries, c.searchable)


def nearest_vectors(c: Context, probes: int | None = 0):
    """Every vector whose id is divisible by 20 as a query against all vectors."""
    vectors = c.table("embeddings").select("vec_id", "embedding")
    queries = vectors.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return vector_index.vector_search(queries, vector_index.build_vector_index(vectors, "vec_id"), probes=probes)


def stored_candidates(c: Context):
    return stored(candidates(c), "candidates")


def rerank_scores(c: Context, found):
    """External scores by place, for candidates with some lexical match; one query was never reranked."""
    place = F.col("candidate_index")
    reranked = found.filter("lexical_score >= 1 and not contains(lower(query_text), 'services')")
    return reranked.select(
        "query_id", "candidate_index", (((place * 13) % 60) / F.lit(200.0)).alias("rerank_score")
    )


def merged(c: Context):
    found = stored_candidates(c)
    return search.rerank_merge(found, rerank_scores(c, found)).select(
        "query_id", "candidate_index", ID, "rerank_score", "hybrid_score", "rank_source"
    )


def gated(c: Context):
    found = stored_candidates(c)
    return search.rerank_and_gate(found, rerank_scores(c, found)).select(
        "query_id", "rank", ID, "rerank_score", "semantic_score", "lexical_score", "match_confidence", "rank_source"
    )


def diagnostics(c: Context):
    return search.search_diagnostics(stored_candidates(c))


def cycle(c: Context):
    return enrichment.enrichment_cycle(c.review, c.enrichment_cache, enrichment_replies(c)).drop("created_at")


def profile_cycle(c: Context):
    filled = enrichment.profile_backfill(
        enrichment.merchant_candidates(c.fact), c.profiles, profile_replies(c), testbed.MODEL, testbed.CACHE_TIME
    )
    return filled


def profile_stats(c: Context):
    """Merchants that ever paid a credit get no reply."""
    credited = c.fact.filter("is_credit").select("normalized_merchant").distinct()
    replies = profile_replies(c).join(credited, "normalized_merchant", "left_anti")
    return enrichment.profile_backfill_stats(
        enrichment.merchant_candidates(c.fact), c.profiles, replies, testbed.MODEL
    )


NOT_NULL = ["transaction_id", "transaction_date", "raw_description", "raw_category", "ai_confidence", "final_category"]


def grain(c: Context):
    keys = [ID]
    frames = {
        "staged": (c.staged, keys),
        "normalized": (c.layers.normalized, keys),
        "features": (c.layers.features, keys),
        "recurring": (c.layers.recurring, ["normalized_merchant", "final_category"]),
        "fact": (c.fact, keys),
        "fact_by_merchant": (c.fact, ["normalized_merchant"]),
    }
    return quality.dq_grain_report(frames)


def required(c: Context):
    """Required columns that the export lacks once some of them are taken away; the whole export passes."""
    whole = quality.dq_required_columns(c.raw, REQUIRED_COLUMNS)
    lacking = whole.drop("Memo", "Post Date")
    rows = lacking.agg(F.count("*").alias("row_count")).scalar()
    return quality.dq_missing_columns(lacking, REQUIRED_COLUMNS).withColumn("row_count", rows)


def suite(c: Context):
    return quality.dq_declared(tested_tables(c.layers, build_marts(c.layers)), DECLARED_TESTS)


SUITE_CTES = {
    "fct_transactions": "fact", "mart_merchant_review": "review", "mart_spend_kpis": "spend_totals",
    "mart_monthly_kpis": "monthly_kpis", "mart_category_metrics": "category_metrics", "mart_data_quality": "source_quality",
    "mart_metric_summary": "period_pairs", "mart_daily_metric_values": "rolling", "staged_transactions": "staged",
    "staged_enrichments": "enrichments",
}


def suite_sql() -> str:
    lines = []
    for model, tests in DECLARED_TESTS.items():
        for column in tests["not_null"]:
            value = f"count(*) filter ({column} is null)"
            lines.append(f"select '{model}' as model, '{column}' as column_name, 'not_null' as test, {value} as failures from {SUITE_CTES[model]}")
        for column in tests.get("unique", ()):
            repeated = f"(select {column} from {SUITE_CTES[model]} where {column} is not null group by 1 having count(*) > 1)"
            lines.append(f"select '{model}', '{column}', 'unique', count(*) from {repeated}")
    return WITH_DAILY + " union all ".join(lines)


PROFILE_SQL = """profile as (
  select normalized_merchant, 'merchant_summary: Known for ' || min(merchant_group) || '. semantic_tags: shopping, '
         || lower(min(final_category)) || '.' as profile
  from fact where merchant_group <> 'Unmapped' group by 1
),
documented as (
  select f.*, 'merchant: ' || f.normalized_merchant || '. merchant_group: ' || merchant_group
    || '. category: ' || final_category || '. raw_description: ' || raw_description || '. transaction_type: '
    || transaction_type || '. amount: $' || format('{:,.2f}', amount_abs::double)
    || case when is_debit then ' debit' else ' credit' end || '. date: ' || strftime(transaction_date, '%Y-%m-%d')
    || '. signals: ' || case when is_recurring and is_anomaly then 'recurring, anomaly'
         when is_recurring then 'recurring' when is_anomaly then 'anomaly' else 'standard' end
    || '. merchant_source: ' || merchant_source || '. ' || coalesce(profile, '') as search_text
  from fact f left join profile using (normalized_merchant)
)"""
HYBRID_SQL = WITH_SEARCH + "," + PROFILE_SQL + """,
vectors as (select vec_id, embedding::double[] as v from embeddings),
placed as (
  select d.*, lower(search_text) as lowered, regexp_extract_all(lower(search_text), '[a-z0-9]+') as tokens, v.v as v
  from documented d join orders on o_orderkey::varchar = transaction_id
  join vectors v on v.vec_id = o_custkey % (select count(*) from embeddings)
),
scored as (
  select e.query_id, e.query_text, p.* exclude (v, lowered, tokens),
    coalesce(list_dot_product(p.v, q.v) / nullif(sqrt(list_dot_product(p.v, p.v)) * sqrt(list_dot_product(q.v, q.v)), 0), 0)
      as semantic_score,
    (case when contains(p.lowered, e.cleaned) then 3.0 else 0.0 end)::double + coalesce(list_sum([
      (case when contains(t, ' ') then case when contains(p.lowered, t) then 1.5 else 0 end
            when list_contains(p.tokens, t) then 1.0
            when contains(p.lowered, t) then 0.5 else 0 end)::double for t in e.terms]), 0) as lexical_score
  from expanded e join vectors q on q.vec_id = e.query_id, placed p
),
ranked as (
  select *, semantic_score + lexical_score * 0.08 as hybrid_score,
    row_number() over (partition by query_id order by semantic_score + lexical_score * 0.08 desc, semantic_score desc,
                       transaction_date desc, transaction_id) - 1 as candidate_index
  from scored
),
found as (select * from ranked where candidate_index < 60),
merged as (
  select *, case when lexical_score >= 1 and not contains(lower(query_text), 'services')
                 then ((candidate_index * 13) % 60) / 200.0::double end as rerank_score,
         if(bool_or(lexical_score >= 1 and not contains(lower(query_text), 'services')) over (partition by query_id),
            'cohere_rerank', 'hybrid_semantic') as rank_source
  from found
)
"""

NEAREST_SQL = """select query_id, vec_id, round(semantic_score, 6) + 0.0 as semantic_score, rank from (
  select *, row_number() over (partition by query_id order by semantic_score desc, vec_id)::int as rank from (
    select q.vec_id as query_id, v.vec_id, list_dot_product(v.e, q.e)
      / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))) as semantic_score
    from (select vec_id, embedding::double[] as e from embeddings) v
    join (select vec_id, embedding::double[] as e from embeddings where vec_id % 20 = 0) q on true))
where rank <= 60"""

ENTRIES = {
    "vector_search_exact": (lambda c: nearest_vectors(c, None), NEAREST_SQL),
    "vector_search": (nearest_vectors, None),  # finds most of them; tests measure how many
    "build_search_documents": (
        documents,
        LAYERS + "," + PROFILE_SQL + " select " + out("""s:transaction_id;d:transaction_date;s:normalized_merchant
s:merchant_group;s:final_category;n:amount_abs;s:raw_description;s:merchant_source;s:is_recurring;s:is_anomaly
s:search_text""") + " from documented",
    ),
    "embedding_backfill": (
        backfill,
        LAYERS + "," + PROFILE_SQL + " select transaction_id, search_text, concat_ws('|', "
        "(length(search_text))::varchar || '.0', " + ", ".join(
            f"(length(search_text) - length(replace(search_text, '{vowel}', '')))::varchar || '.0'" for vowel in "aeiou"
        ) + ") as embedding from documented",
    ),
    "backfill_stats": (
        stats,
        "select count(*) as document_count, count(*) filter (o_orderpriority not in ('1-URGENT', '2-HIGH')) as "
        "cache_hits, count(*) filter (o_orderpriority in ('1-URGENT', '2-HIGH')) as embedded_now, "
        "count(*) filter (o_orderpriority = '2-HIGH') as stale_rows from orders join customer on c_custkey = o_custkey",
    ),
    "query_vector_cache": (
        query_vectors,
        """with turns as (
  select conv_id * 1000 + turn as query_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as query_text
  from conversations where role = 'user'
),
asked as (
  select query_text, bool_or(query_id % 2 = 0) as held from turns where length(query_text) >= 3 group by 1
)
select sha256(json_object('embedding_model', '"""
        + testbed.EMBED_MODEL
        + """', 'query_text', query_text)::varchar) as query_key, query_text, '"""
        + testbed.EMBED_MODEL
        + """' as embedding_model, if(held, '0.0', concat_ws('|', length(query_text)::varchar || '.0', """
        + ", ".join(f"(length(query_text) - length(replace(query_text, '{v}', '')))::varchar || '.0'" for v in "aeiou")
        + ")) as embedding from asked",
    ),
    "rerank_cache": (
        reranked,
        HYBRID_SQL + "select query_id, candidate_index, (length(search_text) - length(query_text))::double as rerank_score from found",
    ),
    "hybrid_search": (
        lambda c: candidates(c).select(
            "query_id", "query_text", "candidate_index", ID, "normalized_merchant", "search_text", "semantic_score",
            "lexical_score", "hybrid_score",
        ),
        HYBRID_SQL + "select " + out("""s:query_id;s:query_text;i:candidate_index;s:transaction_id;s:normalized_merchant
s:search_text;n:semantic_score;n:lexical_score;n:hybrid_score""") + " from found",
    ),
    "rerank_merge": (
        merged,
        HYBRID_SQL + "select " + out("""s:query_id;i:candidate_index;s:transaction_id;n:rerank_score;n:hybrid_score
s:rank_source""") + " from merged",
    ),
    "rerank_and_gate": (
        gated,
        HYBRID_SQL + "select " + out("""s:query_id;i:rank;s:transaction_id;n:rerank_score;n:semantic_score;n:lexical_score
s:match_confidence;s:rank_source""") + """ from (
  select *, row_number() over (partition by query_id order by rerank_score desc nulls last, hybrid_score desc,
                               semantic_score desc, candidate_index) as rank,
    case when coalesce(rerank_score, 0) >= 0.15 or semantic_score >= 0.38 or lexical_score >= 4 then 'high'
         when coalesce(rerank_score, 0) >= 0.08 or semantic_score >= 0.30 or lexical_score >= 2 then 'medium'
         else 'low' end as match_confidence
  from merged
  where coalesce(rerank_score, 0) >= 0.08 or semantic_score >= 0.33 or (lexical_score >= 1 and semantic_score >= 0.20)
     or (lexical_score >= 2 and coalesce(rerank_score, 0) >= 0.04)
) where rank <= 25""",
    ),
    "search_diagnostics": (
        diagnostics,
        HYBRID_SQL + "select " + out("""s:query_id;i:candidate_index;n:hybrid_score;n:semantic_score;n:lexical_score
s:normalized_merchant;s:raw_description;i:candidate_count""") + " from (select *, count(*) over (partition by query_id) "
        "as candidate_count from found) where candidate_index < 5",
    ),
    "enrichment_cycle": (
        cycle,
        ALL_MARTS + "," + REPLIES_SQL.rstrip() + """,
asked as (
  select raw_description, min(raw_category) as raw_category from (
    select * from review where needs_review and raw_description not in (select raw_description from enrichments)
    order by review_priority_score desc, total_spend desc, raw_description, raw_category nulls last limit 25)
  group by 1)
select raw_description, 'Shop ' || n as suggested_merchant, if(category = 'Travel', 'Travel', 'Other') as suggested_category,
       'AI Suggested' as suggested_merchant_group, round(coalesce(confidence, 0), 6) as confidence, '' as reasoning, """
        + f"'{testbed.MODEL}' as model from replies join asked using (raw_description) where usable union all "
        "select raw_description, suggested_merchant, suggested_category, suggested_merchant_group, "
        "round(confidence, 6), reasoning, model from enrichments",
    ),
    "profile_backfill": (
        profile_cycle,
        LAYERS + f"""select normalized_merchant, min(merchant_group) as merchant_group, min(final_category) as final_category,
  if(bool_or(merchant_group <> 'Unmapped'), 'Known for ' || min(merchant_group), 'Profile of ' || normalized_merchant)
    as merchant_summary,
  if(bool_or(merchant_group <> 'Unmapped'), 'shopping|' || lower(min(final_category)),
     if(lower(min(final_category)) in ('travel', 'shopping'), 'cafe|' || lower(min(final_category)), 'cafe')) as semantic_tags,
  if(bool_or(merchant_group <> 'Unmapped'), '', 'guess') as reasoning, '{testbed.MODEL}' as model,
  '{testbed.CACHE_TIME}' as created_at
from fact group by normalized_merchant""",
    ),
    "profile_backfill_stats": (
        profile_stats,
        LAYERS + "select status, count(*) as merchants from (select case when bool_or(merchant_group <> 'Unmapped') "
        "then 'skipped' when bool_or(is_credit) then 'failed' else 'inserted' end as status from fact "
        "group by normalized_merchant) group by status",
    ),
    "dq_not_null": (
        lambda c: quality.dq_not_null(c.fact, NOT_NULL),
        LAYERS + " union all ".join(
            f"select '{name}' as column_name, count(*) filter ({name} is null) as failures from fact" for name in NOT_NULL
        ),
    ),
    "dq_unique": (
        lambda c: quality.dq_unique(c.fact, "normalized_merchant"),
        LAYERS + "select normalized_merchant as value, count(*) as occurrences from fact group by 1 having count(*) > 1",
    ),
    "dq_required_columns": (
        required,
        LAYERS + "select missing_column, (select count(*) from raw_export) as row_count "
        "from (values ('Memo'), ('Post Date')) as t(missing_column)",
    ),
    "dq_suite": (suite, suite_sql()),
    "dq_grain_report": (
        grain,
        LAYERS + " union all ".join(
            f"select '{layer}' as layer, count(*) as row_count, count(distinct {key}) as key_count from {cte}"
            for layer, cte, key in (
                ("staged", "staged", "transaction_id"),
                ("normalized", "normalized", "transaction_id"),
                ("features", "features", "transaction_id"),
                ("recurring", "recurrence", "(normalized_merchant, final_category)"),
                ("fact", "fact", "transaction_id"),
                ("fact_by_merchant", "fact", "normalized_merchant"),
            )
        ),
    ),
}
