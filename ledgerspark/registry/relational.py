"""Joins, aggregations, windows, sorts and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark import testbed
from ledgerspark.operators import aggregates as agg, calendar, joins, ordering, scans, sketches, windows
from ledgerspark.operators.caches import stale_cache_split
from ledgerspark.oracle.base import ALL_MARTS, LAYERS, WITH_DAILY, out
from ledgerspark.plans import enrichment, normalization, search, slices
from ledgerspark.plans.daily import daily_metric_events
from ledgerspark.plans.features import with_final_category
from ledgerspark.plans.marts import debits_by_month, metric_unpivot, period_base
from ledgerspark.registry.context import Context
from ledgerspark.session import stored

ID = "transaction_id"
MERCHANT, CATEGORY, DAY, AMOUNT = "normalized_merchant", "final_category", "transaction_date", "amount_abs"


def debits(c: Context):
    return c.fact.filter("is_debit")


def monthly_debits(c: Context):
    return debits_by_month(c.fact)


# --- joins -------------------------------------------------------------------------------------------------------


def rule_match(c: Context):
    return normalization.rule_match(c.staged, c.rules)


def best_match(c: Context):
    return normalization.best_match(normalization.rule_match(c.staged, c.rules))


def merchant_normalization(c: Context):
    return normalization.merchant_normalization(c.staged, c.rules, c.enrichment_cache)


def using_left_join(c: Context):
    normalized = normalization.merchant_normalization(c.staged, c.rules, c.enrichment_cache)
    return joins.using_left_join(c.staged.select(ID, AMOUNT), normalized.select(ID, MERCHANT), ID)


def composite_left_join(c: Context):
    keys = [MERCHANT, CATEGORY]
    flags = c.layers.recurring.select(*keys, "is_recurring", "cadence")
    return joins.composite_left_join(c.fact.select(ID, *keys), flags, keys)


def scalar_cross_join(c: Context):
    whole = debits(c).agg(F.sum(AMOUNT).alias("whole_spend"), F.count("*").alias("whole_count"))
    return joins.scalar_cross_join(slices.spend_by(c.fact, MERCHANT), whole)


def left_join_on_true(c: Context):
    """One optional row that exists and one that does not."""
    spend = slices.spend_by(c.fact, MERCHANT)
    top = ordering.top_one(spend, [(AMOUNT, "desc"), (MERCHANT, "asc")])
    present = top.select(F.col(MERCHANT).alias("top_merchant"))
    absent = top.filter(F.col(AMOUNT) < 0).select(F.col(MERCHANT).alias("no_merchant"))
    return joins.left_join_on_true(joins.left_join_on_true(spend, present), absent)


def conditional_left_join(c: Context):
    ranked = windows.rank_over_aggregate(monthly_debits(c), "month", CATEGORY, AMOUNT, "spend", "rank", 2)
    months = monthly_debits(c).groupBy("month").agg(F.count("*").alias("transaction_count"))
    return joins.conditional_left_join(months, ranked, "month", F.col("rank") == 2)


def period_self_join(c: Context):
    metrics = metric_unpivot(period_base(c.fact))
    return joins.period_self_join(metrics, "metric_key", "period_name", "metric_value")


def date_spine(c: Context):
    return calendar.date_spine(c.fact, DAY)


DIMS = [CATEGORY, "merchant_source"]


def daily_by_source(c: Context):
    return debits(c).groupBy(F.col(DAY).alias("metric_date"), *DIMS).agg(F.sum(AMOUNT).alias("metric_value"))


def dense(c: Context):
    return calendar.densify(daily_by_source(c), calendar.date_bounds(c.fact, DAY), DIMS, "metric_date", "metric_value")


def rolled(c: Context):
    return windows.rolling_sum_30(dense(c), DIMS, "metric_date", "metric_value", "metric_value_l30d")


def lagged(c: Context):
    return windows.lag_offset_30(rolled(c), DIMS, "metric_date", "metric_value_l30d", "metric_value_prior_l30d")


def uncached_candidates(c: Context):
    return enrichment.uncached_candidates(c.review, c.enrichment_cache, 25)


def profile_uncached(c: Context):
    return enrichment.profile_uncached(enrichment.merchant_candidates(c.fact), c.profiles, testbed.MODEL).drop(
        "raw_descriptions"
    )


def profile_requests(c: Context):
    waiting = enrichment.profile_requests(enrichment.merchant_candidates(c.fact), c.profiles, testbed.MODEL, 25)
    return waiting.select("batch", "place", MERCHANT, "transaction_count", "debit_spend", "raw_descriptions")


def visible_semi_join(c: Context):
    chosen = c.fact.filter("is_anomaly")
    return joins.visible_semi_join(slices.spend_by(c.fact, MERCHANT), chosen, MERCHANT)


def null_safe_outer_join(c: Context):
    spent = debits(c).groupBy("raw_category").agg(F.sum(AMOUNT).alias("debit"))
    returned = c.fact.filter("is_credit and merchant_source = 'fallback'").groupBy("raw_category").agg(
        F.sum(AMOUNT).alias("credit")
    )
    return joins.null_safe_outer_join(spent, returned, "raw_category", "debit", "credit")


def lookup_map_join(c: Context):
    lookup = search.profile_lookup(c.profiles, testbed.MODEL)
    defaults = {"merchant_profile_text": F.lit("")}
    return joins.lookup_map_join(c.fact.select(ID, MERCHANT), lookup, MERCHANT, defaults)


def embedding_states(c: Context):
    """Urgent orders are missing from the cache and high ones have an outdated text in it."""
    priority = c.table("orders").select(F.col("o_orderkey").cast("string").alias(ID), "o_orderpriority")
    cache = c.embedding_cache.join(priority, ID).filter("o_orderpriority <> '1-URGENT'")
    outdated = F.when(F.col("o_orderpriority") == "2-HIGH", "outdated").otherwise(F.col("search_text"))
    return cache.withColumn("search_text", outdated).drop("o_orderpriority")


def stale_split(c: Context):
    split = stale_cache_split(c.documents, embedding_states(c), ID, "search_text", testbed.EMBED_MODEL)
    return split.select(ID, "status")


# --- aggregations ----------------------------------------------------------------------------------------------


def global_aggregate(c: Context):
    base = debits(c).agg(
        agg.total(AMOUNT).alias("total_spend"),
        F.count("*").alias("transaction_count"),
        agg.mean(AMOUNT).alias("avg_amount"),
    )
    return joins.scalar_cross_join(base, agg.exact_median(debits(c), [], AMOUNT, "median_amount"))


def group_aggregate(c: Context):
    return agg.group_aggregate(
        debits(c),
        [MERCHANT, CATEGORY],
        {
            "transaction_count": F.count("*"),
            "total_spend": F.sum(AMOUNT),
            "avg_amount": agg.mean(AMOUNT),
            "first_seen": F.min(DAY),
            "last_seen": F.max(DAY),
        },
    )


def conditional_aggregate(c: Context):
    predicates = {
        "debit": F.col("is_debit"),
        "anomaly": F.col("is_anomaly"),
        "fallback": F.col("merchant_source") == "fallback",
    }
    return agg.conditional_aggregate(c.fact, [CATEGORY], AMOUNT, predicates)


def median_aggregate(c: Context):
    return agg.exact_median(debits(c), [MERCHANT], AMOUNT, "median_amount")


def latest_vs_prior_month(c: Context):
    return agg.latest_vs_prior_month(monthly_debits(c), MERCHANT, "month", AMOUNT)


# --- windows, order, unions --------------------------------------------------------------------------------------


def partition_stats(c: Context):
    enriched = with_final_category(c.layers.normalized).select(ID, CATEGORY, AMOUNT)
    return windows.partition_stats_window(enriched, CATEGORY, AMOUNT, "category").drop(CATEGORY, AMOUNT)


def lag_dates(c: Context):
    rows = c.layers.normalized.select(ID, MERCHANT, DAY, "source_row_number")
    return windows.lag_date_window(rows, MERCHANT, DAY, "source_row_number", "previous_date").select(ID, "previous_date")


def rank_over_aggregate(c: Context):
    return windows.rank_over_aggregate(monthly_debits(c), "month", MERCHANT, AMOUNT, "merchant_spend", "rank", 1)


def transaction_series(c: Context):
    """All transactions as one series in the order of day and id, with sums and values of earlier ones."""
    placed = scans.with_positions(c.fact.select(ID, DAY, AMOUNT), [F.col(DAY).asc(), F.col(ID).asc()])
    frames = {
        "last_30_amount": lambda window: F.sum(AMOUNT).over(window.rowsBetween(-29, 0)),
        "earlier_30_amount": lambda window: F.lag(AMOUNT, 30).over(window),
    }
    framed = scans.bounded_frames(placed, "position", 30, frames, block_rows=4096)
    return scans.running_total(framed, "position", AMOUNT, "amount_so_far", block_rows=4096)


def period_rank(c: Context):
    rows = calendar.period_bucket(c.fact, DAY).filter("is_debit")
    return windows.rank_over_aggregate(rows, "period_name", MERCHANT, AMOUNT, "spend", "rank", 5)


def global_row_number(c: Context):
    spend = slices.spend_by(c.fact, MERCHANT)
    return windows.global_row_number(spend, [F.desc(AMOUNT), F.asc(MERCHANT)], "merchant_rank")


def month_totals(c: Context):
    return monthly_debits(c).groupBy("month").agg(F.sum(AMOUNT).alias("total_spend"))


def category_months(c: Context):
    return monthly_debits(c).groupBy("month", CATEGORY).agg(F.sum(AMOUNT).alias("total_spend"))


def multi_key_sort(c: Context):
    spend = slices.spend_by(c.fact, MERCHANT, CATEGORY)
    return ordering.multi_key_sort(spend, [(CATEGORY, "asc"), (AMOUNT, "desc"), (MERCHANT, "asc")])


def top_one(c: Context):
    return ordering.top_one(slices.spend_by(c.fact, MERCHANT), [(AMOUNT, "desc"), (MERCHANT, "asc")])


def top_k_limit(c: Context):
    rows = c.fact.select(ID, DAY, AMOUNT)
    return ordering.top_k_limit(rows, [(DAY, "desc"), (AMOUNT, "desc"), (ID, "asc")], 100)


def display_order(c: Context):
    metrics = daily_metric_events(c.fact).groupBy("metric_key", "metric_name").agg(F.count("*").alias("n"))
    extra = c.fact.groupBy(F.col(CATEGORY).alias("metric_key"), F.col(CATEGORY).alias("metric_name")).agg(
        F.count("*").alias("n")
    )
    return ordering.display_order_sort(metrics.unionByName(extra), "metric_key", ["metric_name"])


def metric_rows(c: Context):
    return metric_unpivot(period_base(c.fact))


SOURCE_DENSE = """by_source as (
  select transaction_date as metric_date, final_category, merchant_source, sum(amount_abs) as metric_value
  from debits group by all
),
source_dense as (
  select s.metric_date, k.final_category, k.merchant_source, coalesce(b.metric_value, 0) as metric_value
  from (select unnest(generate_series(min(transaction_date), max(transaction_date), interval 1 day))::date
          as metric_date from fact) s
  cross join (select distinct final_category, merchant_source from by_source) k
  left join by_source b using (metric_date, final_category, merchant_source)
),
source_rolling as (
  select *, sum(metric_value) over (partition by final_category, merchant_source order by metric_date
                                    rows between 29 preceding and current row) as metric_value_l30d
  from source_dense
)
"""
MONTH_MERCHANT_SQL = "(select month, normalized_merchant, sum(amount_abs) as spend from debits group by all)"

SKETCH_START, SKETCH_END = "1996-01-15", "1999-06-30"


def by_sketch(c: Context):
    """Categories over some years, from stored daily sketches, held against the exact operators on the same rows."""
    daily = sketches.daily_sketches(c.fact, "transaction_date", [CATEGORY], ["raw_description", ID], [AMOUNT])
    merged = sketches.merged_sketches(stored(daily, "daily-sketches"), "transaction_date", [CATEGORY], SKETCH_START, SKETCH_END)
    about = merged.select(
        CATEGORY, "row_count", sketches.about_distinct("raw_description").alias("descriptions"),
        sketches.about_distinct(ID).alias("ids"), sketches.about_quantile(AMOUNT).alias("middle"),
    )
    rows = c.fact.filter(F.col("transaction_date").between(SKETCH_START, SKETCH_END))
    exact = agg.distinct_count(rows, [CATEGORY], ["raw_description", ID])
    below = rows.join(about.select(CATEGORY, "middle"), CATEGORY).groupBy(CATEGORY).agg(
        F.avg((F.col(AMOUNT) <= F.col("middle")).cast("double")).alias("at_most"),
        F.avg((F.col(AMOUNT) < F.col("middle")).cast("double")).alias("less"),
    )

    def near(estimate: str, value: str):
        return F.abs(F.col(estimate) - F.col(value)) <= 1 + F.col(value) * 0.03

    return about.join(exact, CATEGORY).join(below, CATEGORY).select(
        CATEGORY, "row_count", "distinct_raw_description", f"distinct_{ID}",
        near("descriptions", "distinct_raw_description").alias("descriptions_near"),
        near("ids", f"distinct_{ID}").alias("ids_near"),
        ((F.col("at_most") >= 0.48) & (F.col("less") <= 0.52)).alias("median_near"),
    )


ENTRIES = {
    "rule_match": (
        rule_match,
        LAYERS + "select transaction_id, h.pattern, h.normalized_merchant, h.merchant_group, h.default_category "
        "from staged left join rule_hits h using (clean_description)",
    ),
    "best_match": (
        best_match,
        LAYERS + "select transaction_id, h.pattern, h.normalized_merchant, h.merchant_group, h.default_category "
        "from staged left join rule_choice h using (clean_description)",
    ),
    "merchant_normalization": (
        merchant_normalization,
        LAYERS + "select " + out("s:transaction_id;s:normalized_merchant;s:merchant_group;s:rule_category;"
                                 "s:ai_category;n:ai_confidence;s:ai_reasoning;s:merchant_source;s:category_source")
        + " from normalized",
    ),
    "using_left_join": (
        using_left_join, LAYERS + "select " + out("s:transaction_id;n:amount_abs;s:normalized_merchant") + " from normalized",
    ),
    "composite_left_join": (
        composite_left_join,
        LAYERS + "select transaction_id, normalized_merchant, final_category, r.is_recurring, r.cadence from "
        "(select transaction_id, normalized_merchant, final_category from fact) left join "
        "(select normalized_merchant, final_category, is_recurring, cadence from recurrence) r "
        "using (normalized_merchant, final_category)",
    ),
    "scalar_cross_join": (
        scalar_cross_join,
        ALL_MARTS + "select " + out("s:normalized_merchant;n:amount_abs=spend;"
                                    "n:whole_spend=(select sum(amount_abs) from debits);"
                                    "i:whole_count=(select count(*) from debits)") + " from merchant_spend",
    ),
    "left_join_on_true": (
        left_join_on_true,
        ALL_MARTS + "select " + out("s:normalized_merchant;n:amount_abs=spend;s:top_merchant=(select top_merchant "
                                    "from spend_totals);s:no_merchant=null::varchar") + " from merchant_spend",
    ),
    "conditional_left_join": (
        conditional_left_join,
        LAYERS + "select " + out("d:month;i:transaction_count;s:final_category;n:spend;i:rank") + " from "
        "(select month, count(*) as transaction_count from debits group by 1) left join (select * from (select *, "
        "row_number() over (partition by month order by spend desc, final_category) as rank from (select month, "
        "final_category, sum(amount_abs) as spend from debits group by all)) where rank = 2) using (month)",
    ),
    "period_self_join": (
        period_self_join,
        ALL_MARTS + "select " + out("s:metric_key;n:current_value=metric_value;n:comparison_value")
        + " from period_pairs",
    ),
    "date_spine": (date_spine, WITH_DAILY + "select " + out("d:metric_date") + " from spine"),
    "densify": (
        dense,
        LAYERS + "," + SOURCE_DENSE + "select " + out("d:metric_date;s:final_category;s:merchant_source;n:metric_value")
        + " from source_dense",
    ),
    "uncached_candidates": (
        uncached_candidates,
        ALL_MARTS + "select " + out("s:raw_description;s:raw_category;i:transaction_count;n:total_spend;"
                                    "n:review_priority_score")
        + " from (select * from review where needs_review and raw_description not in (select raw_description "
        "from enrichments) order by review_priority_score desc, total_spend desc, raw_description, "
        "raw_category nulls last limit 25)",
    ),
    "profile_uncached": (
        profile_uncached,
        LAYERS + "select " + out("s:normalized_merchant;s:merchant_group;s:final_category;i:transaction_count;n:debit_spend")
        + " from (select normalized_merchant, min(merchant_group) as merchant_group, min(final_category) as "
        "final_category, count(*) as transaction_count, coalesce(sum(amount_abs) filter (is_debit), 0) as debit_spend "
        "from fact group by 1) where normalized_merchant not in (select normalized_merchant from fact "
        "where merchant_group <> 'Unmapped')",
    ),
    "visible_semi_join": (
        visible_semi_join,
        ALL_MARTS + "select " + out("s:normalized_merchant;n:amount_abs=spend") + " from merchant_spend "
        "where normalized_merchant in (select normalized_merchant from fact where is_anomaly)",
    ),
    "null_safe_outer_join": (
        null_safe_outer_join,
        LAYERS + "select " + out("s:raw_category;n:debit=coalesce(sum(amount_abs) filter (is_debit), 0);"
                                 "n:credit=coalesce(sum(amount_abs) filter (is_credit and merchant_source = 'fallback'), 0)")
        + " from fact where is_debit or (is_credit and merchant_source = 'fallback') group by raw_category",
    ),
    "lookup_map_join": (
        lookup_map_join,
        LAYERS + "select transaction_id, normalized_merchant, coalesce(profile, '') as merchant_profile_text from fact "
        "left join (select normalized_merchant, 'merchant_summary: Known for ' || min(merchant_group) || "
        "'. semantic_tags: shopping, ' || lower(min(final_category)) || '.' as profile from fact "
        "where merchant_group <> 'Unmapped' group by 1) using (normalized_merchant)",
    ),
    "stale_cache_split": (
        stale_split,
        "select o_orderkey::varchar as transaction_id, case o_orderpriority when '1-URGENT' then 'new' "
        "when '2-HIGH' then 'stale' else 'hit' end as status from orders join customer on c_custkey = o_custkey",
    ),
    "global_aggregate": (
        global_aggregate,
        LAYERS + "select " + out("n:total_spend=coalesce(sum(amount_abs), 0);i:transaction_count=count(*);"
                                 "n:avg_amount=avg(amount_abs);n:median_amount=median(amount_abs::double)")
        + " from debits",
    ),
    "group_aggregate": (
        group_aggregate,
        LAYERS + "select " + out("s:normalized_merchant;s:final_category;i:transaction_count;n:total_spend=amount;"
                                 "n:avg_amount;d:first_seen;d:last_seen")
        + " from (select normalized_merchant, final_category, count(*) as transaction_count, sum(amount_abs) as amount, "
        "avg(amount_abs) as avg_amount, min(transaction_date) as first_seen, max(transaction_date) as last_seen "
        "from debits group by all)",
    ),
    "conditional_aggregate": (
        conditional_aggregate,
        LAYERS + "select final_category, " + ", ".join(
            out(f"n:{name}_sum=coalesce(sum(amount_abs) filter ({test}), 0);i:{name}_count=count(*) filter ({test});"
                f"n:{name}_avg=avg(amount_abs) filter ({test})")
            for name, test in (("debit", "is_debit"), ("anomaly", "is_anomaly"),
                               ("fallback", "merchant_source = 'fallback'"))
        ) + " from fact group by final_category",
    ),
    "distinct_count": (
        lambda c: agg.distinct_count(c.fact, [CATEGORY], ["raw_description", MERCHANT]),
        LAYERS + "select final_category, count(distinct raw_description) as distinct_raw_description, "
        "count(distinct normalized_merchant) as distinct_normalized_merchant from fact group by 1",
    ),
    "median_aggregate": (
        median_aggregate,
        LAYERS + "select " + out("s:normalized_merchant;n:median_amount=median(amount_abs::double)")
        + " from debits group by normalized_merchant",
    ),
    "sketch_aggregate": (
        by_sketch,
        LAYERS + "select final_category, count(*) as row_count, count(distinct raw_description) as distinct_raw_description, "
        "count(distinct transaction_id) as distinct_transaction_id, true as descriptions_near, true as ids_near, true as median_near "
        f"from fact where transaction_date between '{SKETCH_START}' and '{SKETCH_END}' group by 1",
    ),
    "sample_stddev": (
        lambda c: agg.sample_stddev(c.fact, [MERCHANT, CATEGORY], AMOUNT),
        LAYERS + "select " + out("s:normalized_merchant;s:final_category;n:stddev=stddev_samp(amount_abs::double)")
        + " from fact group by normalized_merchant, final_category",
    ),
    "coefficient_of_variation": (
        lambda c: agg.coefficient_of_variation(c.fact, [MERCHANT], AMOUNT),
        LAYERS + "select " + out("s:normalized_merchant;n:volatility=stddev_samp(amount_abs::double) / "
                                 "nullif(avg(amount_abs), 0)") + " from fact group by normalized_merchant",
    ),
    "two_level_aggregate": (
        lambda c: agg.two_level_aggregate(monthly_debits(c), [CATEGORY, "month"], [CATEGORY], AMOUNT),
        ALL_MARTS + "select " + out("s:final_category;n:mean_of_sums=avg(spend);"
                                    "n:stddev_of_sums=stddev_samp(spend::double)")
        + " from category_months group by final_category",
    ),
    "latest_vs_prior_month": (
        latest_vs_prior_month,
        LAYERS + "select " + out("s:normalized_merchant;"
                                 "n:latest_month_spend=coalesce(sum(amount_abs) filter (month = latest), 0);"
                                 "n:prior_month_spend=coalesce(sum(amount_abs) filter (month = before), 0)")
        + " from debits, (select max(month) as latest, (max(month) - interval 1 month)::date as before from debits) "
        "group by normalized_merchant",
    ),
    "top_n_sum": (
        lambda c: agg.top_n_sum(debits(c), MERCHANT, AMOUNT, 5, "top_5_merchant_spend"),
        ALL_MARTS + "select " + out("n:top_5_merchant_spend") + " from spend_totals",
    ),
    "bool_or_aggregate": (
        lambda c: agg.bool_or_aggregate(c.fact, [MERCHANT], "is_recurring", "has_recurring"),
        LAYERS + "select normalized_merchant, bool_or(is_recurring) as has_recurring from fact group by 1",
    ),
    "distinct_rows": (
        lambda c: agg.distinct_rows(c.fact, [CATEGORY, MERCHANT, "merchant_source", "category_source"]),
        LAYERS + "select distinct final_category, normalized_merchant, merchant_source, category_source from fact",
    ),
    "ordered_string_agg": (
        lambda c: agg.ordered_string_agg(c.fact, [MERCHANT], "raw_description", " || ", "raw_descriptions"),
        LAYERS + "select normalized_merchant, string_agg(raw_description, ' || ' order by raw_description) as "
        "raw_descriptions from (select distinct normalized_merchant, raw_description from fact) group by 1",
    ),
    "any_value_aggregate": (
        lambda c: agg.any_value_aggregate(c.fact, [MERCHANT], ["merchant_group", CATEGORY]),
        LAYERS + "select normalized_merchant, min(merchant_group) as merchant_group, min(final_category) as "
        "final_category from fact group by 1",
    ),
    "merchant_candidates": (
        lambda c: enrichment.merchant_candidates(c.fact),
        LAYERS + "select " + out("s:normalized_merchant;s:merchant_group=min(merchant_group);"
                                 "s:final_category=min(final_category);i:transaction_count=count(*);"
                                 "n:debit_spend=coalesce(sum(amount_abs) filter (is_debit), 0);"
                                 "s:raw_descriptions=array_to_string(list_sort(list(distinct raw_description))[:6], ' || ')")
        + " from fact group by normalized_merchant",
    ),
    "profile_requests": (
        profile_requests,
        LAYERS + "select ceil(place / 10)::bigint as batch, place, normalized_merchant, transaction_count, "
        "round(debit_spend, 6) as debit_spend, raw_descriptions from (select *, row_number() over (order by transaction_count "
        "desc, debit_spend desc, normalized_merchant) as place from (select normalized_merchant, count(*) as transaction_count, "
        "coalesce(sum(amount_abs) filter (is_debit), 0)::double as debit_spend, "
        "array_to_string(list_sort(list(distinct raw_description))[:6], ' || ') as raw_descriptions "
        "from fact group by 1 having min(merchant_group) = 'Unmapped' and max(merchant_group) = 'Unmapped')) where place <= 25",
    ),
    "null_group_aggregate": (
        lambda c: agg.null_group_aggregate(c.fact, "raw_category", AMOUNT, "spend"),
        LAYERS + "select " + out("s:raw_category;n:spend=sum(amount_abs)") + " from fact group by raw_category",
    ),
    "nan_skipping_sum": (
        lambda c: agg.nan_skipping_sum(c.fact, [MERCHANT], ["ai_confidence"]),
        LAYERS + "select " + out("s:normalized_merchant;n:ai_confidence=coalesce(sum(ai_confidence), 0)")
        + " from fact group by normalized_merchant",
    ),
    "partition_stats_window": (
        partition_stats,
        LAYERS + "select " + out("s:transaction_id;n:category_avg_amount;n:category_std_amount") + " from features",
    ),
    "lag_date_window": (
        lag_dates,
        LAYERS + "select " + out("s:transaction_id;d:previous_date=previous_merchant_transaction_date")
        + " from features",
    ),
    "rank_over_aggregate": (
        rank_over_aggregate,
        LAYERS + "select " + out("d:month;s:normalized_merchant;n:merchant_spend=spend;i:rank") + " from (select *, "
        "row_number() over (partition by month order by spend desc, normalized_merchant) as rank from "
        + MONTH_MERCHANT_SQL + ") where rank = 1",
    ),
    "period_rank": (
        period_rank,
        ALL_MARTS + "select " + out("s:period_name;s:normalized_merchant;n:spend;i:rank=place")
        + " from period_merchants where place <= 5",
    ),
    "global_row_number": (
        global_row_number,
        ALL_MARTS + "select " + out("s:normalized_merchant;n:amount_abs=spend;"
                                    "i:merchant_rank=row_number() over (order by spend desc, normalized_merchant)")
        + " from merchant_spend",
    ),
    "transaction_series": (
        transaction_series,
        LAYERS + "select " + out("""s:transaction_id;d:transaction_date;n:amount_abs
i:position=row_number() over (order by transaction_date, transaction_id) - 1
n:last_30_amount=sum(amount_abs) over (order by transaction_date, transaction_id rows 29 preceding)
n:earlier_30_amount=lag(amount_abs, 30) over (order by transaction_date, transaction_id)
n:amount_so_far=sum(amount_abs) over (order by transaction_date, transaction_id)""") + " from fact",
    ),
    "lag_ordered_global": (
        lambda c: windows.lag_ordered_global(month_totals(c), "month", "total_spend", "previous_month_spend"),
        ALL_MARTS + "select " + out("d:month;n:total_spend;n:previous_month_spend=before") + " from monthly_kpis",
    ),
    "lag_partitioned": (
        lambda c: windows.lag_partitioned(category_months(c), CATEGORY, "month", "total_spend"),
        ALL_MARTS + "select " + out("d:month;s:final_category;n:total_spend;n:mom_change_amount;n:mom_change_pct")
        + " from monthly_spend",
    ),
    "rolling_sum_30": (
        rolled,
        LAYERS + "," + SOURCE_DENSE + "select " + out("d:metric_date;s:final_category;s:merchant_source;n:metric_value;"
                                                      "n:metric_value_l30d") + " from source_rolling",
    ),
    "lag_offset_30": (
        lagged,
        LAYERS + "," + SOURCE_DENSE + "select " + out(
            "d:metric_date;s:final_category;s:merchant_source;n:metric_value;n:metric_value_l30d;"
            "n:metric_value_prior_l30d=lag(metric_value_l30d, 30) over (partition by final_category, merchant_source "
            "order by metric_date)") + " from source_rolling",
    ),
    "multi_key_sort": (
        multi_key_sort,
        LAYERS + "select " + out("s:normalized_merchant;s:final_category;n:amount_abs=sum(amount_abs)")
        + " from debits group by normalized_merchant, final_category",
    ),
    "top_one": (
        top_one,
        ALL_MARTS + "select " + out("s:normalized_merchant;n:amount_abs=spend")
        + " from (select * from merchant_spend order by spend desc, normalized_merchant limit 1)",
    ),
    "top_k_limit": (
        top_k_limit,
        LAYERS + "select " + out("s:transaction_id;d:transaction_date;n:amount_abs") + " from (select * from fact "
        "order by transaction_date desc, amount_abs desc, transaction_id limit 100)",
    ),
    "display_order_sort": (
        display_order,
        WITH_DAILY + "select metric_key, metric_name, count(*) as n, coalesce(min(place), 999)::bigint as sort_order "
        "from (select metric_key, metric_name from events_daily union all select final_category, final_category "
        "from fact) left join (values ('total_spend', 0), ('debit_transaction_count', 1), ('recurring_spend', 2), "
        "('recurring_transaction_count', 3), ('anomaly_spend', 4), ('anomaly_transaction_count', 5), "
        "('fallback_spend', 6), ('fallback_transaction_count', 7), ('cohere_spend', 8), "
        "('cohere_transaction_count', 9), ('seed_rule_spend', 10), ('seed_rule_transaction_count', 11), "
        "('credit_amount', 12), ('credit_transaction_count', 13)) as o(metric_key, place) using (metric_key) "
        "group by metric_key, metric_name",
    ),
    "daily_metric_events": (
        lambda c: daily_metric_events(c.fact).groupBy(
            "metric_date", "metric_key", "metric_name", "metric_group", "unit", CATEGORY, "merchant_source"
        ).agg(F.sum("metric_value").alias("metric_value"), F.count("*").alias("events")),
        WITH_DAILY + "select " + out("d:metric_date;s:metric_key;s:metric_name;s:metric_group;s:unit;s:final_category;"
                                     "s:merchant_source;n:metric_value=v;i:events") + " from (select metric_date, "
        "metric_key, metric_name, metric_group, unit, final_category, merchant_source, sum(metric_value) as v, "
        "count(*) as events from events_daily group by all)",
    ),
    "metric_unpivot": (
        metric_rows,
        ALL_MARTS + "select " + out("s:period_name;s:metric_key;s:metric_label;s:metric_group;n:metric_value;s:unit;"
                                    "s:favorable_direction;s:definition") + " from period_metrics",
    ),
}
