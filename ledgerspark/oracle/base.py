"""Shared SQL: the derived transactions and every layer up to the marts, as common table expressions."""

from __future__ import annotations

from ledgerspark import constants as K
from ledgerspark.testbed import CACHE_TIME, MODEL, QUERIES, RULES


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(text(value) for value in values) + ")"


def rows(records) -> str:
    def one(value):
        if value is None:
            return "null"
        return text(value) if isinstance(value, str) else str(value)

    return ",\n".join("(" + ", ".join(one(v) for v in record) + ")" for record in records)


def out(spec: str) -> str:
    """Output columns from ``kind:name`` or ``kind:name=expression`` items, one per line or ``;``.

    Kinds: s as is, i integer, n number rounded to six digits, d date as text, l text list joined by a bar.
    """
    shapes = {
        "s": "{0}",
        "i": "cast({0} as bigint)",
        "n": "round(cast({0} as double), 6) + 0.0",
        "d": "strftime({0}, '%Y-%m-%d')",
        "l": "array_to_string({0}, '|')",
    }
    columns = []
    for item in spec.replace("\n", ";").split(";"):
        item = item.strip()
        if not item:
            continue
        kind, rest = item.split(":", 1)
        name, _, expression = rest.partition("=")
        columns.append(f"{shapes[kind].format(expression.strip() or name.strip())} as {name.strip()}")
    return ", ".join(columns)


STAGING = f"""
rules(pattern, normalized_merchant, merchant_group, default_category) as (values
{rows(RULES)}
),
enrichments as (
  select 'AUTOMOBILE ' || n_name as raw_description, 'Motors ' || n_name as suggested_merchant,
         case when n_nationkey % 5 <> 0 then 'Travel' end as suggested_category,
         'Automotive' as suggested_merchant_group,
         case n_nationkey % 4 when 0 then 0.95::double when 1 then 0.70::double when 2 then 0.65::double end as confidence,
         'Looks like a garage in ' || n_name as reasoning, '{MODEL}' as model,
         timestamp '{CACHE_TIME}' as created_at
  from nation
),
shaped as (
  select o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate::date as order_day,
         c_mktsegment, n_name, n_nationkey,
         c_mktsegment = 'HOUSEHOLD' as household,
         o_orderstatus = 'P' and o_orderkey % 5 = 0 as credit,
         case when c_mktsegment = 'HOUSEHOLD' then 19.99::decimal(18,2)
              when o_orderkey % 211 = 0 then (o_totalprice::decimal(18,2) * 15)::decimal(18,2)
              else o_totalprice::decimal(18,2) end as size
  from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey
),
raw_export as (
  select strftime(order_day, '%m/%d/%Y') as transaction_date_text,
         strftime(order_day + 1, '%m/%d/%Y') as post_date_text,
         case when household then 'Household Club ' || (o_custkey // 8)::varchar
              else c_mktsegment || ' ' || n_name end as description,
         case when o_orderpriority <> '4-NOT SPECIFIED' then o_orderpriority end as category,
         case when credit then 'Payment' else 'Sale' end as type,
         (case when credit then size else -size end)::varchar as amount,
         o_orderkey as source_row_number
  from shaped
),
staged as (
  select source_row_number::varchar as transaction_id,
         strptime(transaction_date_text, '%m/%d/%Y')::date as transaction_date,
         strptime(post_date_text, '%m/%d/%Y')::date as post_date,
         description as raw_description, upper(trim(description)) as clean_description,
         category as raw_category, type as transaction_type,
         amount::decimal(18,2) as amount, abs(amount::decimal(18,2)) as amount_abs,
         amount::decimal(18,2) < 0 as is_debit, amount::decimal(18,2) > 0 as is_credit,
         '' as memo, source_row_number
  from raw_export
),
rule_hits as (
  select d.clean_description, r.*
  from (select distinct clean_description from staged) d
  join rules r on contains(d.clean_description, upper(r.pattern))
),
rule_choice as (
  select a.* from rule_hits a
  where not exists (
    select 1 from rule_hits b
    where b.clean_description = a.clean_description
      and (length(b.pattern) > length(a.pattern) or (length(b.pattern) = length(a.pattern) and b.pattern < a.pattern)))
),
resolved as (
  select t.*, c.pattern, c.normalized_merchant as rule_merchant, c.merchant_group as rule_group,
         c.default_category as rule_category, e.confidence, e.reasoning,
         coalesce(e.confidence >= {K.ENRICHMENT_CONFIDENCE}, false) as trusted,
         e.suggested_merchant, e.suggested_category, e.suggested_merchant_group
  from staged t
  left join rule_choice c using (clean_description)
  left join enrichments e using (raw_description)
),
normalized as (
  select transaction_id, transaction_date, post_date, raw_description, clean_description, raw_category,
         transaction_type, amount, amount_abs, is_debit, is_credit, source_row_number,
         coalesce(rule_merchant, if(trusted, suggested_merchant, null), raw_description) as normalized_merchant,
         coalesce(rule_group, if(trusted, suggested_merchant_group, null), 'Unmapped') as merchant_group,
         rule_category, if(trusted, suggested_category, null) as ai_category,
         confidence as ai_confidence, reasoning as ai_reasoning,
         if(rule_merchant is not null, 'seed_rule', if(trusted, 'cohere_cache', 'fallback')) as merchant_source,
         if(rule_category is not null, 'seed_rule',
            if(trusted and suggested_category is not null, 'cohere_cache', 'chase_raw')) as category_source,
         coalesce(rule_category, if(trusted, suggested_category, null), raw_category, 'Other') as final_category
  from resolved
),
merchant_stats as (
  select normalized_merchant, avg(amount_abs) as merchant_avg_amount,
         stddev_samp(amount_abs::double) as merchant_std_amount
  from normalized group by normalized_merchant
),
category_stats as (
  select final_category, avg(amount_abs) as category_avg_amount,
         stddev_samp(amount_abs::double) as category_std_amount
  from normalized group by final_category
),
features as (
  select n.*, merchant_avg_amount, merchant_std_amount, category_avg_amount, category_std_amount,
         lag(transaction_date) over (partition by n.normalized_merchant order by transaction_date, source_row_number)
           as previous_merchant_transaction_date,
         (amount_abs::double - merchant_avg_amount) / nullif(merchant_std_amount, 0) as zscore_vs_merchant,
         (amount_abs::double - category_avg_amount) / nullif(category_std_amount, 0) as zscore_vs_category
  from normalized n join merchant_stats m using (normalized_merchant) join category_stats c using (final_category)
),
gaps as (
  select *, date_diff('day', previous_merchant_transaction_date, transaction_date)
              as days_since_last_transaction_at_merchant
  from features
),
recurrence as (
  select *, coalesce(transaction_count >= 3 and avg_days_between_transactions between 25 and 35
                     and coalesce(amount_stddev, 0) <= greatest(avg_amount * 0.15, 3), false) as is_recurring,
         case when avg_days_between_transactions between 25 and 35 then 'monthly'
              when avg_days_between_transactions between 6 and 8 then 'weekly' else 'irregular' end as cadence
  from (
    select normalized_merchant, final_category, count(*) as transaction_count,
           min(transaction_date) as first_seen, max(transaction_date) as last_seen,
           avg(amount_abs) as avg_amount, stddev_samp(amount_abs::double) as amount_stddev,
           avg(days_since_last_transaction_at_merchant) as avg_days_between_transactions
    from gaps where is_debit group by all)
),
flagged as (
  select g.*, coalesce(r.is_recurring, false) as is_recurring,
         coalesce(is_debit and zscore_vs_merchant >= 2.5, false) as by_merchant,
         coalesce(is_debit and zscore_vs_category >= 3, false) as by_category
  from gaps g left join recurrence r using (normalized_merchant, final_category)
),
fact as materialized (
  select transaction_id, transaction_date, post_date, raw_description, normalized_merchant, merchant_group,
         merchant_source, category_source, ai_confidence, ai_reasoning, raw_category, final_category,
         transaction_type, amount, amount_abs, is_debit, is_credit, is_recurring,
         by_merchant or by_category as is_anomaly,
         case when by_merchant then {text(K.REASON_MERCHANT)}
              when by_category then {text(K.REASON_CATEGORY)} end as anomaly_reason,
         zscore_vs_merchant, zscore_vs_category
  from flagged
),
debits as (
  select *, date_trunc('month', transaction_date)::date as month from fact where is_debit
)"""

MARTS = f"""
recurring_mart as (
  select normalized_merchant, final_category, cadence, avg_amount, amount_stddev, transaction_count,
         first_seen, last_seen,
         case cadence when 'monthly' then avg_amount when 'weekly' then avg_amount * 4.33 end as estimated_monthly_cost
  from recurrence where is_recurring
),
monthly as (
  select month, final_category, sum(amount_abs) as total_spend, count(*) as transaction_count,
         avg(amount_abs) as avg_transaction_amount
  from debits group by all
),
monthly_spend as (
  select *, total_spend - lag(total_spend) over w as mom_change_amount,
         total_spend::double / nullif(lag(total_spend) over w, 0)::double - 1 as mom_change_pct
  from monthly window w as (partition by final_category order by month)
),
month_leaders as (
  select month, arg_min(final_category, (-spend, final_category)) as top_category, max(spend) as top_category_spend
  from (select month, final_category, sum(amount_abs) as spend from debits group by all) group by month
),
month_merchants as (
  select month, arg_min(normalized_merchant, (-spend, normalized_merchant)) as top_merchant,
         max(spend) as top_merchant_spend
  from (select month, normalized_merchant, sum(amount_abs) as spend from debits group by all) group by month
),
month_totals as (
  select month, sum(amount_abs) as total_spend, count(*) as transaction_count,
         avg(amount_abs) as avg_transaction_amount, median(amount_abs::double) as median_transaction_amount,
         coalesce(sum(amount_abs) filter (is_recurring), 0) as recurring_spend,
         count(*) filter (is_anomaly) as anomaly_count,
         coalesce(sum(amount_abs) filter (is_anomaly), 0) as anomaly_spend
  from debits group by month
),
monthly_kpis as (
  select *, recurring_spend::double / nullif(total_spend, 0)::double as recurring_spend_share,
         total_spend - before as mom_spend_change_amount,
         case when before >= 50 then total_spend::double / before::double - 1 end as mom_spend_change_pct
  from (select *, lag(total_spend) over (order by month) as before from month_totals)
  join month_leaders using (month) join month_merchants using (month)
),
category_months as (
  select final_category, month, sum(amount_abs) as spend from debits group by all
),
category_leaders as (
  select final_category, arg_min(normalized_merchant, (-spend, normalized_merchant)) as top_merchant,
         max(spend) as top_merchant_spend
  from (select final_category, normalized_merchant, sum(amount_abs) as spend from debits group by all)
  group by final_category
),
category_movement as (
  select final_category,
         coalesce(sum(spend) filter (month = (select max(month) from debits)), 0) as latest_month_spend,
         coalesce(sum(spend) filter (month = (select (max(month) - interval 1 month)::date from debits)), 0)
           as prior_month_spend
  from category_months group by final_category
),
category_metrics as (
  select b.*, b.total_spend::double / nullif((select sum(amount_abs) from debits), 0)::double as spend_share,
         monthly_avg_spend, coalesce(deviation, 0) as monthly_spend_stddev,
         coalesce(deviation, 0) / nullif(monthly_avg_spend, 0) as monthly_spend_volatility,
         top_merchant, top_merchant_spend, latest_month_spend, prior_month_spend,
         latest_month_spend - prior_month_spend as latest_mom_change_amount,
         case when prior_month_spend >= 50
              then latest_month_spend::double / prior_month_spend::double - 1 end as latest_mom_change_pct
  from (select final_category, sum(amount_abs) as total_spend, count(*) as transaction_count,
               avg(amount_abs) as avg_transaction_amount, max(amount_abs) as largest_transaction_amount
        from debits group by final_category) b
  join (select final_category, avg(spend) as monthly_avg_spend, stddev_samp(spend::double) as deviation
        from category_months group by final_category) using (final_category)
  join category_leaders using (final_category) join category_movement using (final_category)
),
merchant_spend as (
  select normalized_merchant, sum(amount_abs) as spend from debits group by 1
),
category_spend as (
  select final_category, sum(amount_abs) as spend from debits group by 1
),
spend_totals as (
  select coalesce(sum(amount_abs) filter (is_debit), 0) as total_spend,
         coalesce(sum(amount_abs) filter (is_credit), 0) as credit_amount,
         count(*) as transaction_count, count(*) filter (is_debit) as debit_transaction_count,
         avg(amount_abs) filter (is_debit) as avg_transaction_amount,
         median(amount_abs::double) filter (is_debit) as median_transaction_amount,
         (select arg_min(final_category, (-spend, final_category)) from category_spend) as top_category,
         coalesce((select max(spend) from category_spend), 0) as top_category_spend,
         (select arg_min(normalized_merchant, (-spend, normalized_merchant)) from merchant_spend) as top_merchant,
         coalesce((select max(spend) from merchant_spend), 0) as top_merchant_spend,
         coalesce((select sum(spend) from (select spend from merchant_spend order by spend desc limit 5)), 0)
           as top_5_merchant_spend,
         coalesce((select sum(estimated_monthly_cost) from recurring_mart), 0) as estimated_monthly_recurring_spend,
         count(*) filter (is_debit and is_anomaly) as anomaly_count,
         coalesce(sum(amount_abs) filter (is_debit and is_anomaly), 0) as anomaly_spend,
         count(*) filter (is_debit and merchant_source = 'fallback') as fallback_transaction_count,
         coalesce(sum(amount_abs) filter (is_debit and merchant_source = 'fallback'), 0) as fallback_spend,
         count(*) filter (is_debit and merchant_source = 'cohere_cache') as cohere_transaction_count,
         coalesce(sum(amount_abs) filter (is_debit and merchant_source = 'cohere_cache'), 0) as cohere_spend,
         count(*) filter (is_debit and merchant_source = 'seed_rule') as seed_rule_transaction_count,
         coalesce(sum(amount_abs) filter (is_debit and merchant_source = 'seed_rule'), 0) as seed_rule_spend
  from fact
),
source_quality as (
  select merchant_source, category_source, count(*) as transaction_count, sum(amount_abs) as total_spend,
         count(*)::double / (select count(*) from debits) as transaction_share,
         sum(amount_abs)::double / (select sum(amount_abs) from debits)::double as spend_share,
         count(distinct raw_description) as unique_raw_descriptions,
         count(distinct normalized_merchant) as unique_normalized_merchants
  from debits group by all
),
review as (
  select *, merchant_source = 'fallback' or merchant_group = 'Unmapped' or normalized_merchant = raw_description
              as needs_review,
         case when merchant_source = 'fallback' and transaction_count >= 3 then {text(K.REVIEW_FREQUENT)}
              when merchant_source = 'fallback' and total_spend >= 250 then {text(K.REVIEW_EXPENSIVE)}
              when merchant_source = 'cohere_cache' then {text(K.REVIEW_ENRICHED)}
              when normalized_merchant = raw_description then {text(K.REVIEW_RAW)}
              else {text(K.REVIEW_RULE)} end as review_reason,
         round(case merchant_source when 'fallback' then 100 when 'cohere_cache' then 10 else 0 end
               + least(transaction_count, 25) * 3 + least(total_spend::double / 100, 25), 2) as review_priority_score
  from (
    select raw_description, normalized_merchant, merchant_group, merchant_source, category_source, raw_category,
           final_category, count(*) as transaction_count,
           coalesce(sum(amount_abs) filter (is_debit), 0) as total_spend,
           round(avg(amount_abs) filter (is_debit), 2) as avg_debit_amount,
           min(transaction_date) as first_seen, max(transaction_date) as last_seen,
           count(*) filter (is_anomaly) as anomaly_count, bool_or(is_recurring) as has_recurring_flag
    from fact group by all)
),
metric_texts(metric_key, metric_label, metric_group, unit, favorable_direction, definition) as (values
{rows(K.PERIOD_METRICS)}
),
periods as (
  select max(transaction_date) as as_of_date, max(transaction_date) - 29 as current_period_start,
         max(transaction_date) - 30 as comparison_period_end, max(transaction_date) - 59 as comparison_period_start
  from fact
),
period_rows as (
  select if(transaction_date >= current_period_start, 'current', 'comparison') as period_name, fact.*
  from fact, periods where transaction_date >= comparison_period_start
),
period_debits as (select * from period_rows where is_debit),
period_merchants as (
  select period_name, normalized_merchant, sum(amount_abs) as spend,
         row_number() over (partition by period_name order by sum(amount_abs) desc, normalized_merchant) as place
  from period_debits group by period_name, normalized_merchant
),
period_categories as (
  select period_name, final_category, sum(amount_abs) as spend,
         row_number() over (partition by period_name order by sum(amount_abs) desc, final_category) as place
  from period_debits group by period_name, final_category
),
period_wide as (
  select period_name, sum(amount_abs)::double as total_spend, count(*)::double as debit_transaction_count,
         avg(amount_abs) as avg_transaction_amount, median(amount_abs::double) as median_transaction_amount,
         (select max(spend)::double from period_categories c where c.period_name = d.period_name) as top_category_spend,
         (select max(spend)::double from period_merchants m where m.period_name = d.period_name) as top_merchant_spend,
         (select sum(spend)::double from period_merchants m where m.period_name = d.period_name and place <= 5)
           as top_5_merchant_spend,
         coalesce(sum(amount_abs) filter (is_recurring), 0)::double as recurring_spend,
         coalesce(sum(amount_abs) filter (is_anomaly), 0)::double as anomaly_spend,
         coalesce(sum(amount_abs) filter (merchant_source = 'fallback'), 0)::double as fallback_spend,
         coalesce(sum(amount_abs) filter (merchant_source = 'cohere_cache'), 0)::double as cohere_spend,
         coalesce(sum(amount_abs) filter (merchant_source = 'seed_rule'), 0)::double as seed_rule_spend,
         stddev_samp(amount_abs::double) / nullif(avg(amount_abs), 0) as transaction_amount_volatility
  from period_debits d group by period_name
),
period_metrics as (
  select period_name, t.*,
         case metric_key
           when 'total_spend' then total_spend
           when 'debit_transaction_count' then debit_transaction_count
           when 'avg_transaction_amount' then avg_transaction_amount
           when 'median_transaction_amount' then median_transaction_amount
           when 'top_category_share' then top_category_spend / nullif(total_spend, 0)
           when 'top_merchant_share' then top_merchant_spend / nullif(total_spend, 0)
           when 'top_5_merchant_share' then top_5_merchant_spend / nullif(total_spend, 0)
           when 'recurring_spend_share' then recurring_spend / nullif(total_spend, 0)
           when 'anomaly_spend_share' then anomaly_spend / nullif(total_spend, 0)
           when 'fallback_spend_share' then fallback_spend / nullif(total_spend, 0)
           when 'cohere_spend_share' then cohere_spend / nullif(total_spend, 0)
           when 'seed_rule_spend_share' then seed_rule_spend / nullif(total_spend, 0)
           when 'transaction_amount_volatility' then transaction_amount_volatility
         end as metric_value
  from period_wide, metric_texts t
),
period_pairs as (
  select c.*, p.metric_value as comparison_value
  from (select * from period_metrics where period_name = 'current') c
  left join (select * from period_metrics where period_name = 'comparison') p using (metric_key)
)"""

DAILY = f"""
populations(population, amount_key, amount_name, count_key, count_name, metric_group) as (values
{rows(K.DAILY_METRICS)}
),
members as (
  select fact.*, p.*
  from fact join populations p on case p.population
    when 'debit' then is_debit
    when 'credit' then is_credit
    when 'anomaly' then is_debit and is_anomaly
    when 'recurring' then is_debit and is_recurring
    when 'fallback' then is_debit and merchant_source = 'fallback'
    when 'enriched' then is_debit and merchant_source = 'cohere_cache'
    when 'rule' then is_debit and merchant_source = 'seed_rule' end
),
events_daily as (
  select transaction_date as metric_date, final_category, normalized_merchant, merchant_source, category_source,
         amount_key as metric_key, amount_name as metric_name, metric_group, 'currency' as unit,
         amount_abs as metric_value
  from members
  union all
  select transaction_date, final_category, normalized_merchant, merchant_source, category_source,
         count_key, count_name, metric_group, 'count', 1::decimal(18,2)
  from members
),
values_daily as (
  select * exclude (metric_value), sum(metric_value)::decimal(28,2) as metric_value from events_daily group by all
),
series as (select distinct * exclude (metric_date, metric_value) from values_daily),
spine as (
  select unnest(generate_series(min(transaction_date), max(transaction_date), interval 1 day))::date as metric_date
  from fact
),
dense as (
  select s.metric_date, c.*, coalesce(v.metric_value, 0)::decimal(28,2) as metric_value
  from spine s cross join series c
  left join values_daily v on v.metric_date = s.metric_date and v.metric_key = c.metric_key
    and v.final_category = c.final_category and v.normalized_merchant = c.normalized_merchant
    and v.merchant_source = c.merchant_source and v.category_source = c.category_source
),
rolling as (
  select *, sum(metric_value) over w30 as metric_value_l30d,
         case when row_number() over w > 30
              then sum(metric_value) over (w rows between 59 preceding and 30 preceding) end as metric_value_prior_l30d
  from dense
  window w as (partition by final_category, normalized_merchant, merchant_source, category_source, metric_key
               order by metric_date),
         w30 as (partition by final_category, normalized_merchant, merchant_source, category_source, metric_key
                 order by metric_date rows between 29 preceding and current row)
)"""

_SYNONYM_ROWS = ",\n".join(
    f"({text(word)}, [{', '.join(text(other) for other in others)}])" for word, others in K.SYNONYMS.items()
)
_SEARCH_STEPS = f"""
synonyms(word, others) as (values
{_SYNONYM_ROWS}
),
asked as (
  select query_id, query_text, lower(query_text) as cleaned from (
    select query_id, regexp_replace(query_text, '^\\s+|\\s+$', '', 'g') as query_text from queries
  ) where length(query_text) >= 3
),
seeds as (
  select query_id, unnest(regexp_extract_all(cleaned, '[a-z0-9]+')) as term from asked
  union
  select query_id, unnest(others) from asked join synonyms on word = cleaned
),
kept_seeds as (
  select query_id, term from seeds
  where (length(term) >= 2 and term not in {in_list(K.STOPWORDS)})
),
term_rows as (
  select query_id, term from kept_seeds
  union
  select query_id, unnest(others) from kept_seeds join synonyms on word = term
),
expanded as (
  select a.*, (select list(term order by term) from term_rows t where t.query_id = a.query_id) as terms from asked a
)"""

SEARCH = f"queries(query_id, query_text) as (values\n{rows(QUERIES)}\n)," + _SEARCH_STEPS
# The same steps for every user turn, and for every turn, of the conversations.
_TURNS = "with queries as (select conv_id * 1000 + turn as query_id, text as query_text from conversations{where}),"
WITH_TURNS = _TURNS.format(where="") + _SEARCH_STEPS + "\n"
WITH_USER_TURNS = _TURNS.format(where=" where role = 'user'") + _SEARCH_STEPS + "\n"

_LAYERS = "with " + STAGING.strip()
_MARTS = _LAYERS + ",\n" + MARTS.strip()
LAYERS = _LAYERS + "\n"
ALL_MARTS = _MARTS + "\n"
WITH_DAILY = _MARTS + ",\n" + DAILY.strip() + "\n"
WITH_SEARCH = _LAYERS + ",\n" + SEARCH.strip() + "\n"
