"""Projections, filters and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark import constants as K, testbed
from ledgerspark.functions import amounts, rules, text, vectors
from ledgerspark.operators.aggregates import description_samples
from ledgerspark.operators.calendar import date_bounds, period_bucket
from ledgerspark.operators.filters import facet_values, filter_daily_metrics, filter_transactions
from ledgerspark.operators.windows import group_stats
from ledgerspark.oracle.base import ALL_MARTS, LAYERS, WITH_DAILY, WITH_SEARCH, WITH_TURNS, WITH_USER_TURNS, in_list, out, text as quoted
from ledgerspark.operators.joins import null_safe_left_join
from ledgerspark.plans import enrichment, lexical_index, search
from ledgerspark.plans.features import recurring_transactions
from ledgerspark.plans.normalization import merchant_normalization, resolve_precedence, with_best_rule
from ledgerspark.plans.staging import stage_enrichments, stage_transactions
from ledgerspark.registry.context import Context
from ledgerspark.schemas import ENRICHMENT_REPLY

ID = "transaction_id"


def stage(c: Context):
    return stage_transactions(c.raw).drop("source_file", "source_mode", "ingested_at")


def us_date(c: Context):
    parsed = amounts.parse_us_date(F.col("Transaction Date"))
    return c.raw.select(F.col("row_hash").alias(ID), parsed.alias("transaction_date"))


def cleaned(c: Context):
    padded = F.concat(F.lit("  "), F.lower("Description"), F.lit(" "))
    return c.raw.select(F.col("row_hash").alias(ID), text.clean_text(padded).alias("clean_description"))


def signed(c: Context):
    parts = amounts.signed_amount(F.col("Amount"))
    return c.raw.select(F.col("row_hash").alias(ID), *[column.alias(name) for name, column in parts.items()])


def precedence(c: Context):
    suggestion = c.enrichment_cache.select(
        "raw_description",
        F.struct("suggested_merchant", "suggested_category", "suggested_merchant_group", "confidence", "reasoning")
        .alias("__enrichment"),
    )
    joined = with_best_rule(c.staged, c.rules).join(suggestion, "raw_description", "left")
    return resolve_precedence(joined).select(ID, "normalized_merchant", "merchant_group", "rule_category", "ai_category")


def provenance(c: Context):
    resolved = merchant_normalization(c.staged, c.rules, c.enrichment_cache)
    return resolved.groupBy("normalized_merchant", "merchant_source", "category_source").agg(
        F.count("*").alias("transaction_count")
    )


def category(c: Context):
    value = rules.final_category(F.col("rule_category"), F.col("ai_category"), F.col("raw_category"))
    return c.layers.normalized.select(ID, value.alias("final_category"))


def zscore(c: Context):
    stats = group_stats(c.fact, "normalized_merchant", "amount_abs", "merchant")
    score = amounts.null_safe_zscore(F.col("amount_abs"), F.col("merchant_avg_amount"), F.col("merchant_std_amount"))
    return null_safe_left_join(c.fact, stats, ["normalized_merchant"]).select(ID, score.alias("zscore_vs_merchant"))


def gap(c: Context):
    days = amounts.day_gap(F.col("previous_merchant_transaction_date"), F.col("transaction_date"))
    return c.layers.features.select(ID, days.alias("days_since_last"))


def anomalies(c: Context):
    flags = rules.anomaly_flag(F.col("is_debit"), F.col("zscore_vs_merchant"), F.col("zscore_vs_category"))
    return c.layers.features.select(ID, *[column.alias(name) for name, column in flags.items()])


def severity(c: Context):
    score = rules.severity_score(F.col("zscore_vs_merchant"), F.col("zscore_vs_category"))
    return c.fact.select(ID, score.alias("severity_score"))


def recurrence(c: Context):
    verdict = rules.recurrence_rule(
        F.col("transaction_count"), F.col("avg_days_between_transactions"), F.col("amount_stddev"), F.col("avg_amount")
    )
    history = recurring_transactions(c.layers.features).drop("is_recurring")
    return history.select("normalized_merchant", "final_category", verdict.alias("is_recurring"))


def cadence(c: Context):
    label = rules.cadence_label(F.col("avg_days_between_transactions"))
    return c.layers.recurring.select("normalized_merchant", "final_category", label.alias("cadence"))


def monthly_cost(c: Context):
    """Each pattern is given one of the three cadences by its count, so that all branches occur."""
    assumed = F.when(F.col("transaction_count") % 3 == 0, "monthly").when(F.col("transaction_count") % 3 == 1, "weekly")
    cost = rules.monthly_cost_estimate(F.coalesce(assumed, F.lit("irregular")), F.col("avg_amount"))
    return c.layers.recurring.select("normalized_merchant", "final_category", cost.alias("monthly_cost"))


def review_flag(c: Context):
    flag = rules.needs_review_flag(
        F.col("merchant_source"), F.col("merchant_group"), F.col("normalized_merchant"), F.col("raw_description")
    )
    return c.fact.select(ID, flag.alias("needs_review"))


def _description_totals(c: Context):
    return c.fact.groupBy("raw_description", "normalized_merchant", "merchant_source").agg(
        F.count("*").alias("n"), F.sum("amount_abs").alias("spend")
    )


def reason(c: Context):
    value = rules.review_reason(
        F.col("merchant_source"), F.col("n"), F.col("spend"), F.col("normalized_merchant"), F.col("raw_description")
    )
    return _description_totals(c).select("raw_description", value.alias("review_reason"))


def priority(c: Context):
    value = rules.review_priority(F.col("merchant_source"), F.col("n"), F.col("spend"))
    return _description_totals(c).select("raw_description", value.alias("review_priority_score"))


def _category_sides(c: Context):
    return c.fact.groupBy("normalized_merchant").agg(
        F.coalesce(F.sum(F.when(F.col("is_credit"), F.col("amount_abs"))), F.lit(0)).alias("credit"),
        F.sum(F.when(F.col("is_debit"), F.col("amount_abs"))).alias("debit"),
    )


def ratio(c: Context):
    sides = _category_sides(c)
    return sides.select(
        "normalized_merchant",
        amounts.guarded_ratio(F.col("credit"), F.col("debit")).alias("credit_per_debit"),
        amounts.guarded_ratio(F.col("debit"), F.col("credit")).alias("debit_per_credit"),
    )


def change_pct(c: Context):
    change = amounts.guarded_change_pct(F.col("debit"), F.col("credit"))
    return _category_sides(c).select("normalized_merchant", change.alias("change_pct"))


def periods(c: Context):
    return period_bucket(c.fact, "transaction_date").select(ID, "transaction_date", "period_name")


def months(c: Context):
    return c.fact.select(ID, amounts.month_bucket(F.col("transaction_date")).alias("month"))


def deltas(c: Context):
    parts = amounts.delta_columns(F.col("debit"), F.col("credit"))
    return _category_sides(c).select("normalized_merchant", *[column.alias(name) for name, column in parts.items()])


def selected(c: Context):
    kept = filter_transactions(
        c.fact, "1996-01-15", "1999-06-30", ["Shopping", "1-URGENT", "Travel"], None, "debits"
    )
    return kept.select(ID, "transaction_date", "final_category", "amount_abs")


def selected_metrics(c: Context):
    kept = filter_daily_metrics(
        c.daily, "1996-01-15", "1999-06-30", None, ["Builder", "Machines", "Motors NATION_1"], "debits",
        ["Spend", "Risk"],
    )
    return kept.select(
        "metric_date", "metric_key", "final_category", "normalized_merchant", "merchant_source", "category_source",
        "metric_value", "metric_value_l30d", "metric_value_prior_l30d",
    )


def facets(c: Context):
    return facet_values(c.fact, "normalized_merchant")


def bounds(c: Context):
    return date_bounds(c.fact, "transaction_date")


def sentences(c: Context):
    return c.fact.select(ID, text.search_text().alias("search_text"))


def tokens(c: Context):
    return c.table("documents").select("doc_id", text.tokenize(F.col("text")).alias("tokens"))


def expansions(c: Context):
    turns = testbed.conversation_queries(c.spark, c.dir)
    return search.expand_query(search.query_guard(turns)).select("query_id", "query_text", "terms")


def text_index(c: Context):
    return lexical_index.build_lexical_index(c.table("documents").select("doc_id", "text"), "text", "doc_id")


def user_turns(c: Context):
    return testbed.conversation_queries(c.spark, c.dir).filter("role = 'user'").drop("role")


def lexical(c: Context):
    return search.lexical_search(c.queries, c.table("documents").select("doc_id", "text"), "text")


def lexical_turns(c: Context):
    """Several hundred queries and more: every user turn against every document, through the inverted index."""
    return lexical_index.indexed_search(user_turns(c), text_index(c))


def lexical_best(c: Context):
    return lexical_index.indexed_top_k(user_turns(c), text_index(c), 10)


def cosine(c: Context):
    anchor = c.table("embeddings").filter("vec_id = 0").select("embedding").scalar()
    scored = c.table("embeddings").withColumn("__anchor", anchor)
    return scored.select(
        "vec_id", vectors.cosine_similarity(F.col("embedding"), F.col("__anchor")).alias("similarity")
    )


def _scores(c: Context):
    """A semantic, lexical and rerank score for every transaction, from its amount and day."""
    cents = (F.col("amount_abs") * 100).cast("long")
    return c.fact.select(
        ID,
        ((cents % 97) / F.lit(200.0)).alias("semantic_score"),
        (F.dayofyear("transaction_date") % 11 / F.lit(2.0)).alias("lexical_score"),
        F.when(F.col("is_debit"), (cents % 53) / F.lit(300.0)).alias("rerank_score"),
    )


SCORES_SQL = """scores as (
  select transaction_id, ((amount_abs * 100)::bigint % 97) / 200.0::double as semantic_score,
         (dayofyear(transaction_date) % 11) / 2.0::double as lexical_score,
         case when is_debit then ((amount_abs * 100)::bigint % 53) / 300.0::double end as rerank_score
  from fact)
"""


def hybrid(c: Context):
    score = vectors.hybrid_score(F.col("semantic_score"), F.col("lexical_score"))
    return _scores(c).select(ID, score.alias("hybrid_score"))


def confidence(c: Context):
    label = vectors.confidence_label(F.col("rerank_score"), F.col("semantic_score"), F.col("lexical_score"))
    return _scores(c).select(ID, label.alias("match_confidence"))


def gated(c: Context):
    return search.confidence_gate(_scores(c)).select(ID)


def enrichment_replies(c: Context):
    """A model reply for every raw description, some without an object or with missing fields."""
    kinds = c.fact.groupBy("raw_description").agg(F.count("*").alias("n"))
    kind = F.col("n") % 5
    body = F.concat(
        F.lit('{"suggested_merchant": "Shop '), F.col("n").cast("string"), F.lit('", "suggested_category": "'),
        F.when(kind == 1, "Travel").when(kind == 2, "Space").otherwise(""),
        F.lit('", "confidence": '), F.when(kind == 3, "null").otherwise("0.8"), F.lit("}"),
    )
    reply = F.when(kind == 4, "sorry, no idea").otherwise(F.concat(F.lit("Sure:\n"), body, F.lit("\nBye.")))
    return kinds.select(
        "raw_description",
        reply.alias("reply"),
        F.lit(testbed.MODEL).alias("model"),
        F.lit(testbed.CACHE_TIME).cast("timestamp").alias("created_at"),
    )


REPLIES_SQL = """replies as (
  select raw_description, n,
         case n % 5 when 1 then 'Travel' when 2 then 'Space' else '' end as category,
         case when n % 5 = 3 then null else 0.8::double end as confidence, n % 5 <> 4 as usable
  from (select raw_description, count(*) as n from fact group by 1))
"""


def json_objects(c: Context):
    parsed = text.extract_json_object(F.col("reply"), ENRICHMENT_REPLY)
    return enrichment_replies(c).withColumn("parsed", parsed).select(
        "raw_description",
        F.col("parsed.suggested_merchant").alias("suggested_merchant"),
        F.col("parsed.suggested_category").alias("suggested_category"),
        F.col("parsed.confidence").cast("double").alias("confidence"),
    )


def _tag_lists(c: Context):
    """Tags written by hand in the reply style: mixed case, blanks, repeats and unknown words."""
    return c.fact.groupBy("normalized_merchant").agg(
        F.min("final_category").alias("final_category"), F.count("*").alias("n")
    ).select(
        "normalized_merchant",
        "final_category",
        F.when(
            F.col("n") % 3 != 0,
            F.array(F.lit(" Travel "), F.lit("travel"), F.lit("spaceship"), F.lit("HOTEL"),
                    F.when(F.col("n") % 2 == 0, "bar").otherwise("cafe")),
        ).otherwise(F.array(F.lit("unknown"))).alias("tags"),
    )


def tags(c: Context):
    return _tag_lists(c).select(
        "normalized_merchant", text.normalise_tags(F.col("tags"), F.col("final_category")).alias("tags")
    )


def validated(c: Context):
    return enrichment.validate_enrichment(enrichment_replies(c), c.review).drop("created_at")


def profile_replies(c: Context):
    """A batched reply for every merchant: its profile, and one of a stranger nobody asked for."""
    merchants = c.fact.groupBy("normalized_merchant").agg(F.min("final_category").alias("final_category"))
    item = F.struct(
        "normalized_merchant",
        F.concat(F.lit(" Profile of "), "normalized_merchant").alias("merchant_summary"),
        F.array(F.lit("Cafe"), F.lower("final_category")).alias("semantic_tags"),
        F.lit("guess").alias("reasoning"),
    )
    stranger = F.struct(
        F.lit("Nobody").alias("normalized_merchant"), F.lit("").alias("merchant_summary"),
        F.array(F.lit("bar")).alias("semantic_tags"), F.lit("").alias("reasoning"),
    )
    body = F.to_json(F.struct(F.array(item, stranger).alias("profiles")))
    return merchants.select(
        "normalized_merchant",
        F.xxhash64("normalized_merchant").alias("reply_id"),
        F.concat(F.lit("Here: "), body).alias("reply"),
    )


def profile_matches(c: Context):
    return enrichment.profile_batch_match(profile_replies(c), enrichment.merchant_candidates(c.fact))


def rejects(c: Context):
    asked = c.fact.select("raw_description", F.col("final_category").alias("raw_category"))
    return enrichment.rejected_replies(enrichment_replies(c), asked).select("raw_description")


def broken_profile_replies(c: Context):
    """As ``profile_replies``, but by the length of the merchant's name some are no objects, cut short or without profiles."""
    kind = F.length("normalized_merchant") % 5
    reply = (
        F.when(kind == 0, "nothing to say")
        .when(kind == 1, F.concat(F.substring("reply", 1, 40), F.lit("}")))
        .when(kind == 2, '{"note": "none"}')
        .when(kind == 3, F.replace("reply", F.lit("Nobody"), F.lit(" ")))
        .otherwise(F.col("reply"))
    )
    return profile_replies(c).withColumn("reply", reply)


def profile_rejects(c: Context):
    found = enrichment.rejected_profiles(broken_profile_replies(c), enrichment.merchant_candidates(c.fact))
    return found.groupBy("reason", F.col("place").cast("long").alias("place"), "normalized_merchant").agg(F.count("*").alias("n"))


def profile_sentences(c: Context):
    return c.profiles.select(
        "normalized_merchant",
        text.profile_text(F.col("merchant_summary"), F.col("semantic_tags")).alias("profile_text"),
    )


def samples(c: Context):
    return description_samples(c.fact, "normalized_merchant", "raw_description")


def keys(c: Context):
    key = text.content_key(model=F.lit("m1"), query_text=F.col("text"))
    return c.table("conversations").select("conv_id", "turn", key.alias("content_key"))


def guard(c: Context):
    asked = c.table("conversations").select("conv_id", "turn", F.col("text").alias("query_text"))
    return search.query_guard(asked).select("conv_id", "turn", F.length("query_text").alias("query_length"))


def formats(c: Context):
    unit = (
        F.when(F.col("raw_category") == "1-URGENT", "currency")
        .when(F.col("raw_category") == "2-HIGH", "percent")
        .when(F.col("raw_category") == "3-MEDIUM", "count")
        .otherwise("other")
    )
    value = F.when(F.dayofmonth("transaction_date") > 3, F.col("amount").cast("double") / 8)
    return c.fact.select(
        ID,
        text.unit_format(value, unit).alias("formatted"),
        text.signed_money_text(value).alias("signed_money"),
        text.money_text(value).alias("money"),
        text.percent_text(value).alias("percent"),
        text.date_text(F.col("transaction_date")).alias("day"),
    )


GAP = "date_diff('day', previous_merchant_transaction_date, transaction_date)"
SIDES_SQL = """sides as (
  select normalized_merchant, coalesce(sum(amount_abs) filter (is_credit), 0)::double as credit,
         (sum(amount_abs) filter (is_debit))::double as debit
  from fact group by 1)
"""
TOTALS_SQL = """totals as (
  select raw_description, normalized_merchant, merchant_source, count(*) as n, sum(amount_abs) as spend
  from fact group by all)
"""
LEX_SQL = """select * from (select d.doc_id, e.query_id, (case when contains(d.lowered, e.cleaned) then 3.0 else 0.0 end)::double
  + coalesce(list_sum([
      (case when contains(t, ' ') then case when contains(d.lowered, t) then 1.5 else 0 end
            when list_contains(d.tokens, t) then 1.0
            when contains(d.lowered, t) then 0.5 else 0 end)::double for t in e.terms]), 0) as lexical_score
from (select doc_id, lower(text) as lowered, regexp_extract_all(lower(text), '[a-z0-9]+') as tokens from documents) d,
     expanded e) where lexical_score > 0"""

ENTRIES = {
    "stage_transactions": (
        stage,
        LAYERS + "select " + out("s:transaction_id;d:transaction_date;d:post_date;s:raw_description;"
                                 "s:clean_description;s:raw_category;s:transaction_type;n:amount;n:amount_abs;"
                                 "s:is_debit;s:is_credit;s:memo;s:source_row_number") + " from staged",
    ),
    "parse_us_date": (us_date, LAYERS + "select " + out("s:transaction_id;d:transaction_date") + " from staged"),
    "clean_text": (cleaned, LAYERS + "select transaction_id, clean_description from staged"),
    "signed_amount": (
        signed, LAYERS + "select " + out("s:transaction_id;n:amount;n:amount_abs;s:is_debit;s:is_credit") + " from staged",
    ),
    "stage_enrichments": (
        lambda c: stage_enrichments(c.enrichment_cache),
        LAYERS + "select raw_description, suggested_merchant, suggested_category, suggested_merchant_group, "
        + out("n:confidence") + ", reasoning, model, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at "
        "from enrichments",
    ),
    "resolve_precedence": (
        precedence,
        LAYERS + "select transaction_id, normalized_merchant, merchant_group, rule_category, ai_category from normalized",
    ),
    "provenance_flags": (
        provenance,
        LAYERS + "select normalized_merchant, merchant_source, category_source, count(*) as transaction_count "
        "from normalized group by all",
    ),
    "final_category": (category, LAYERS + "select transaction_id, final_category from normalized"),
    "null_safe_zscore": (
        zscore, LAYERS + "select " + out("s:transaction_id;n:zscore_vs_merchant") + " from features",
    ),
    "day_gap": (gap, LAYERS + "select " + out(f"s:transaction_id;i:days_since_last={GAP}") + " from features"),
    "anomaly_flag": (anomalies, LAYERS + "select transaction_id, is_anomaly, anomaly_reason from fact"),
    "severity_score": (
        severity,
        LAYERS + "select " + out("s:transaction_id;n:severity_score=greatest(coalesce(zscore_vs_merchant, 0), "
                                 "coalesce(zscore_vs_category, 0))") + " from fact",
    ),
    "recurrence_rule": (
        recurrence, LAYERS + "select normalized_merchant, final_category, is_recurring from recurrence",
    ),
    "cadence_label": (cadence, LAYERS + "select normalized_merchant, final_category, cadence from recurrence"),
    "monthly_cost_estimate": (
        monthly_cost,
        LAYERS + "select " + out("s:normalized_merchant;s:final_category;n:monthly_cost=case transaction_count % 3 "
                                 "when 0 then avg_amount when 1 then avg_amount * 4.33 end") + " from recurrence",
    ),
    "needs_review_flag": (
        review_flag,
        LAYERS + "select transaction_id, merchant_source = 'fallback' or merchant_group = 'Unmapped' "
        "or normalized_merchant = raw_description as needs_review from fact",
    ),
    "review_reason": (
        reason,
        LAYERS + "," + TOTALS_SQL + "select raw_description, case when merchant_source = 'fallback' and n >= 3 then "
        f"{quoted(K.REVIEW_FREQUENT)} when merchant_source = 'fallback' and spend >= 250 then "
        f"{quoted(K.REVIEW_EXPENSIVE)} when merchant_source = 'cohere_cache' then {quoted(K.REVIEW_ENRICHED)} "
        f"when normalized_merchant = raw_description then {quoted(K.REVIEW_RAW)} else {quoted(K.REVIEW_RULE)} end "
        "as review_reason from totals",
    ),
    "review_priority": (
        priority,
        LAYERS + "," + TOTALS_SQL + "select " + out(
            "s:raw_description;n:review_priority_score=round(case merchant_source when 'fallback' then 100 "
            "when 'cohere_cache' then 10 else 0 end + least(n, 25) * 3 + least(spend::double / 100, 25), 2)"
        ) + " from totals",
    ),
    "guarded_ratio": (
        ratio,
        LAYERS + "," + SIDES_SQL + "select " + out(
            "s:normalized_merchant;n:credit_per_debit=credit / nullif(debit, 0);n:debit_per_credit=debit / nullif(credit, 0)"
        ) + " from sides",
    ),
    "guarded_change_pct": (
        change_pct,
        LAYERS + "," + SIDES_SQL + "select " + out(
            "s:normalized_merchant;n:change_pct=case when credit >= 50 then debit / credit - 1 end"
        ) + " from sides",
    ),
    "period_bucket": (
        periods,
        ALL_MARTS + "select " + out("s:transaction_id;d:transaction_date;s:period_name") + " from period_rows",
    ),
    "month_bucket": (
        months,
        LAYERS + "select " + out("s:transaction_id;d:month=date_trunc('month', transaction_date)") + " from fact",
    ),
    "delta_columns": (
        deltas,
        LAYERS + "," + SIDES_SQL + "select " + out(
            "s:normalized_merchant;n:delta_value=debit - credit;"
            "n:delta_pct=case when abs(credit) > 0 then debit / credit - 1 end"
        ) + " from sides",
    ),
    "filter_transactions": (
        selected,
        LAYERS + "select " + out("s:transaction_id;d:transaction_date;s:final_category;n:amount_abs")
        + " from fact where transaction_date between '1996-01-15' and '1999-06-30' and is_debit "
        "and final_category in ('Shopping', '1-URGENT', 'Travel')",
    ),
    "filter_daily_metrics": (
        selected_metrics,
        WITH_DAILY + "select " + out("d:metric_date;s:metric_key;s:final_category;s:normalized_merchant;"
                                     "s:merchant_source;s:category_source;n:metric_value;n:metric_value_l30d;"
                                     "n:metric_value_prior_l30d")
        + " from rolling where metric_date between '1996-01-15' and '1999-06-30' "
        "and normalized_merchant in ('Builder', 'Machines', 'Motors NATION_1') "
        "and metric_key not like 'credit%' and metric_group in ('Spend', 'Risk')",
    ),
    "facet_values": (facets, LAYERS + "select distinct normalized_merchant from fact"),
    "date_bounds": (
        bounds,
        LAYERS + "select " + out("d:min_date=min(transaction_date);d:max_date=max(transaction_date)") + " from fact",
    ),
    "search_text": (
        sentences,
        LAYERS + """select transaction_id, 'merchant: ' || normalized_merchant || '. merchant_group: ' || merchant_group
  || '. category: ' || final_category || '. raw_description: ' || raw_description || '. transaction_type: '
  || transaction_type || '. amount: $' || format('{:,.2f}', amount_abs::double)
  || case when is_debit then ' debit' else ' credit' end || '. date: ' || strftime(transaction_date, '%Y-%m-%d')
  || '. signals: ' || case when is_recurring and is_anomaly then 'recurring, anomaly'
       when is_recurring then 'recurring' when is_anomaly then 'anomaly' else 'standard' end
  || '. merchant_source: ' || merchant_source || '.' as search_text from fact""",
    ),
    "tokenize": (
        tokens,
        "select doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), '|') as tokens from documents",
    ),
    "expand_query": (
        expansions,
        WITH_TURNS + "select query_id, query_text, coalesce(array_to_string(terms, '|'), '') as terms from expanded",
    ),
    "lexical_score": (lexical, WITH_SEARCH + LEX_SQL),
    "lexical_score_turns": (lexical_turns, WITH_USER_TURNS + LEX_SQL),
    "lexical_top_k": (
        lexical_best,
        WITH_USER_TURNS + "select * from (select query_id, doc_id, lexical_score, row_number() over (partition by query_id "
        "order by lexical_score desc, doc_id)::int as rank from (" + LEX_SQL + ")) where rank <= 10",
    ),
    "cosine_similarity": (
        cosine,
        "select vec_id, round(list_dot_product(v, a) / nullif(sqrt(list_dot_product(v, v)) * "
        "sqrt(list_dot_product(a, a)), 0), 6) + 0.0 as similarity from (select vec_id, embedding::double[] as v, "
        "(select embedding::double[] from embeddings where vec_id = 0) as a from embeddings)",
    ),
    "hybrid_score": (
        hybrid,
        LAYERS + "," + SCORES_SQL + "select " + out(
            "s:transaction_id;n:hybrid_score=semantic_score + lexical_score * 0.08") + " from scores",
    ),
    "confidence_label": (
        confidence,
        LAYERS + "," + SCORES_SQL + "select transaction_id, case when coalesce(rerank_score, 0) >= 0.15 "
        "or semantic_score >= 0.38 or lexical_score >= 4 then 'high' when coalesce(rerank_score, 0) >= 0.08 "
        "or semantic_score >= 0.30 or lexical_score >= 2 then 'medium' else 'low' end as match_confidence from scores",
    ),
    "confidence_gate": (
        gated,
        LAYERS + "," + SCORES_SQL + "select transaction_id from scores where coalesce(rerank_score, 0) >= 0.08 "
        "or semantic_score >= 0.33 or (lexical_score >= 1 and semantic_score >= 0.20) "
        "or (lexical_score >= 2 and coalesce(rerank_score, 0) >= 0.04)",
    ),
    "extract_json_object": (
        json_objects,
        LAYERS + "," + REPLIES_SQL + "select raw_description, if(usable, 'Shop ' || n, null) as suggested_merchant, "
        "if(usable, category, null) as suggested_category, if(usable, confidence, null) as confidence from replies",
    ),
    "normalise_tags": (
        tags,
        LAYERS + "select normalized_merchant, case when count(*) % 3 <> 0 then 'travel|hotel|' || "
        "case when count(*) % 2 = 0 then 'bar' else 'cafe' end "
        "when min(final_category) = 'Shopping' then 'shopping' else 'entertainment' end as tags from fact group by 1",
    ),
    "validate_enrichment": (
        validated,
        ALL_MARTS + "," + REPLIES_SQL + "select raw_description, 'Shop ' || n as suggested_merchant, "
        "case when category = 'Travel' then 'Travel' when category = 'Space' then 'Other' "
        f"when asked in {in_list(K.ALLOWED_CATEGORIES)} then asked else 'Other' end as suggested_category, "
        "'AI Suggested' as suggested_merchant_group, coalesce(confidence, 0) as confidence, '' as reasoning, "
        f"'{testbed.MODEL}' as model from replies join (select raw_description, min(raw_category) as asked from review "
        "group by 1) using (raw_description) where usable",
    ),
    "rejected_replies": (rejects, LAYERS + "," + REPLIES_SQL + "select raw_description from replies where not usable"),
    "rejected_profiles": (
        profile_rejects,
        LAYERS + """, kinds as (select normalized_merchant, length(normalized_merchant) % 5 as kind from fact group by 1)
select case kind when 0 then 'no object' when 1 then 'unreadable' when 2 then 'no profiles' when 3 then 'no merchant'
       else 'not asked for' end as reason, case when kind >= 3 then 1::bigint end as place,
       case when kind = 4 then 'Nobody' end as normalized_merchant, count(*) as n from kinds group by all""",
    ),
    "profile_batch_match": (
        profile_matches,
        LAYERS + "select normalized_merchant, min(merchant_group) as merchant_group, min(final_category) as "
        "final_category, 'Profile of ' || normalized_merchant as merchant_summary, case when "
        f"lower(min(final_category)) in {in_list(K.ALLOWED_TAGS)} then 'cafe|' || lower(min(final_category)) "
        "else 'cafe' end as semantic_tags, 'guess' as reasoning from fact group by normalized_merchant",
    ),
    "profile_text": (
        profile_sentences,
        LAYERS + "select normalized_merchant, 'merchant_summary: Known for ' || min(merchant_group) || "
        "'. semantic_tags: shopping, ' || lower(min(final_category)) || '.' as profile_text from fact "
        "where merchant_group <> 'Unmapped' group by 1",
    ),
    "description_samples": (
        samples,
        LAYERS + "select normalized_merchant, array_to_string(list(raw_description order by raw_description), '|') "
        "as samples from (select *, row_number() over (partition by normalized_merchant order by raw_description) as "
        "place from (select distinct normalized_merchant, raw_description from fact)) where place <= 6 group by 1",
    ),
    "content_key": (
        keys,
        "select conv_id, turn, sha256(to_json({'model': 'm1', 'query_text': text})::varchar) as content_key "
        "from conversations",
    ),
    "query_guard": (
        guard,
        "select conv_id, turn, length(q)::bigint as query_length from (select conv_id, turn, "
        "trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) as q from conversations) "
        "where length(q) >= 3",
    ),
    "unit_format": (
        formats,
        LAYERS + """select transaction_id,
  coalesce(case raw_category when '1-URGENT' then '$' || format('{:,.2f}', v) when '2-HIGH' then format('{:.1f}', v * 100) || '%'
           when '3-MEDIUM' then format('{:,.0f}', v) else format('{:,.2f}', v) end, '—') as formatted,
  coalesce(case when v < 0 then '-$' || format('{:,.2f}', -v) when v > 0 then '+$' || format('{:,.2f}', v) end,
           '$0.00') as signed_money,
  coalesce('$' || format('{:,.2f}', v), '$0.00') as money,
  coalesce(format('{:.1f}', v * 100) || '%', '—') as percent,
  strftime(transaction_date, '%b %-d, %Y') as day
from (select *, case when day(transaction_date) > 3 then amount::double / 8 end as v from fact)""",
    ),
}
