"""Layers, marts and dashboard slices."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from ledgerspark.operators.filters import filter_transactions
from ledgerspark.oracle.base import ALL_MARTS, LAYERS, WITH_DAILY, out
from ledgerspark.plans import marts, narrative, slices
from ledgerspark.plans.cube import MEASURES
from ledgerspark.plans.daily import daily_totals, expand_runs, mart_daily_metric_runs, mart_daily_metric_values
from ledgerspark.plans.features import fact_transactions, recurring_transactions, transaction_features
from ledgerspark.plans.normalization import normalize_merchants
from ledgerspark.registry.context import Context
from ledgerspark.session import stored

# One selection serves the slices that start from a filtered fact.
START, END = "1995-03-01", "2001-05-31"
# The days asked for from the stored runs of the daily mart.
RUNS_START, RUNS_END = "1996-01-15", "1996-04-14"
# Sums of the daily mart. Values below the bound are summed as whole cents, which is exact for 90 million rows of a day and
# metric and fails rather than be wrong beyond; others as decimals.
DAILY_SUMS, CENTS_BELOW = ("metric_value", "metric_value_l30d", "metric_value_prior_l30d"), 10**9
LINE, MARK = ("metric_key", "metric_name", "metric_group", "unit"), "\x1f"


def selection(c: Context):
    return filter_transactions(c.fact, START, END)


def cube_selection(c: Context):
    return filter_transactions(c.cube, START, END)


def cube_change(c: Context):
    return slices.change_table(cube_selection(c).filter("is_debit"), "normalized_merchant", slices.anchor_date(cube_selection(c)))


def daily_selection(c: Context):
    return daily_totals(c.fact, START, END)


def features(c: Context):
    """The whole chain from raw rows, without any stored layer."""
    normalized = normalize_merchants(c.staged, c.rules, c.enrichment_cache)
    return transaction_features(normalized).select(
        "transaction_id", "normalized_merchant", "final_category", "merchant_avg_amount", "merchant_std_amount",
        "category_avg_amount", "category_std_amount", "previous_merchant_transaction_date", "zscore_vs_merchant",
        "zscore_vs_category", "days_since_last_transaction_at_merchant",
    )


def daily_mart(c: Context):
    return by_day_and_metric(mart_daily_metric_values(c.fact, derived=day_entries()))


def stored_daily(c: Context):
    """A quarter of the daily mart, expanded from its stored runs."""
    runs = stored(mart_daily_metric_runs(c.fact), "daily-runs")
    return by_day_and_metric(expand_runs(runs, start=RUNS_START, end=RUNS_END, derived=day_entries()))


def daily_run_counts(c: Context):
    """The stored form by metric: its runs, the days they stand for and the sum of their values."""
    return mart_daily_metric_runs(c.fact).groupBy("metric_key").agg(
        F.sum(F.datediff("last_day", "first_day") + 1).alias("days"),
        F.sum("metric_value").alias("metric_value"),
        F.min("first_day").alias("first_day"),
        F.max("last_day").alias("last_day"),
    )


def fingerprint():
    """Of all columns of a row of the daily mart that do not follow from its day and metric."""
    prior = F.coalesce(F.col("metric_value_prior_l30d").cast("string"), F.lit("none"))
    row = F.concat_ws(
        "|", "final_category", "normalized_merchant", "merchant_source", "category_source",
        F.col("metric_value").cast("string"), F.col("metric_value_l30d").cast("string"), prior,
    )
    return F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long")


def day_entries():
    """What a row of the daily mart brings to its day and metric: its texts as one, its fingerprint, and its values as whole
    cents or, where they are large, as they are. All of it holds on every day of a run, so it is worked out once for them."""
    entries = {"line": F.concat_ws(MARK, *LINE), "fingerprint": fingerprint()}
    for name in DAILY_SUMS:
        value = F.col(name)
        small = F.abs(value) < CENTS_BELOW
        entries[f"{name}_cents"] = F.when(small, (value * 100).cast("long"))
        entries[f"{name}_large"] = F.when(~small, value)
    return entries


def exact_sum(name):
    cents = F.sum(f"{name}_cents").cast("decimal(20,0)") * F.lit(Decimal("0.01"))
    large = F.sum(f"{name}_large")
    return F.coalesce(cents + large, cents, large).cast("decimal(38,2)").alias(name)


def by_day_and_metric(mart):
    """A dense mart with its ``day_entries`` by day and metric. Every row enters through its sums and through its fingerprint, so
    one wrong cell anywhere changes a line. Rows meet by their day and one text, and add whole numbers."""
    days = mart.groupBy("metric_date", "line").agg(
        F.count("*").alias("series_count"), *map(exact_sum, DAILY_SUMS), F.sum("fingerprint").alias("fingerprint")
    )
    texts = F.split("line", MARK)
    return days.select(
        "metric_date", *(texts[at].alias(name) for at, name in enumerate(LINE)), "series_count", *DAILY_SUMS, "fingerprint"
    )


def change(c: Context, dimension: str = "normalized_merchant"):
    rows = selection(c)
    return slices.change_table(rows.filter("is_debit"), dimension, slices.anchor_date(rows))


def summary(c: Context):
    return narrative.summary_record(selection(c), daily_selection(c), START, END)


def selected(last_day: str) -> str:
    """The selection, its changes, and as anchor the given last day."""
    return f"""
chosen as (select * from fact where transaction_date between '{START}' and '{END}'),
chosen_debits as (select * from chosen where is_debit),
anchor as ({last_day}),
sided as (
  select *, transaction_date > day - 30 as is_current, transaction_date between day - 59 and day - 30 as is_prior
  from chosen_debits, anchor
),
merchant_changes as (
  select normalized_merchant, coalesce(sum(amount_abs) filter (is_current), 0) as current_spend,
         coalesce(sum(amount_abs) filter (is_prior), 0) as prior_spend
  from sided where is_current or is_prior group by 1
),
merchant_moves as (
  select *, current_spend - prior_spend as delta_amount,
         (current_spend - prior_spend)::double / nullif(prior_spend, 0)::double as delta_pct
  from merchant_changes
),
category_moves as (
  select *, current_spend - prior_spend as delta_amount,
         (current_spend - prior_spend)::double / nullif(prior_spend, 0)::double as delta_pct
  from (select final_category, coalesce(sum(amount_abs) filter (is_current), 0) as current_spend,
               coalesce(sum(amount_abs) filter (is_prior), 0) as prior_spend
        from sided where is_current or is_prior group by 1)
)
"""
CHOSEN = ALL_MARTS + "," + selected("select max(transaction_date) as day from chosen_debits")
CHOSEN_DAILY = WITH_DAILY + f""",
chosen_rolling as (select * from rolling where metric_date between '{START}' and '{END}'),
""" + selected("select max(metric_date) as day from chosen_rolling").rstrip() + """,
rollup_lines as (
  select metric_key, metric_name, metric_group, unit, coalesce(sum(metric_value_l30d), 0) as metric_value_l30d,
         coalesce(sum(metric_value_prior_l30d), 0) as metric_value_prior_l30d
  from chosen_rolling where metric_date = (select max(metric_date) from chosen_rolling) group by all
),
rollup as (
  select *, metric_value_l30d - metric_value_prior_l30d as delta_value,
         (metric_value_l30d - metric_value_prior_l30d)::double / nullif(metric_value_prior_l30d, 0)::double as delta_pct
  from rollup_lines
)
"""
MOVE = "s:{0};n:current_spend;n:prior_spend;n:delta_amount;n:delta_pct"
MERCHANT_MOVE = out(MOVE.format("normalized_merchant"))
SHARED = """i:transaction_count;n:total_spend"""

KPI_COLUMNS = """n:total_spend;n:credit_amount;i:transaction_count;i:debit_transaction_count;n:avg_transaction_amount
n:median_transaction_amount;s:top_category;n:top_category_spend
n:top_category_spend_share=top_category_spend::double / nullif(total_spend, 0)::double
s:top_merchant;n:top_merchant_spend;n:top_merchant_spend_share=top_merchant_spend::double / nullif(total_spend, 0)::double
n:top_5_merchant_spend;n:top_5_merchant_spend_share=top_5_merchant_spend::double / nullif(total_spend, 0)::double
n:estimated_monthly_recurring_spend
n:recurring_spend_share=estimated_monthly_recurring_spend / nullif(total_spend, 0)::double
i:anomaly_count;n:anomaly_spend;n:anomaly_transaction_rate=anomaly_count::double / nullif(debit_transaction_count, 0)
n:anomaly_spend_share=anomaly_spend::double / nullif(total_spend, 0)::double""" + "".join(
    f"""
i:{p}_transaction_count;n:{p}_spend
n:{p}_transaction_share={p}_transaction_count::double / nullif(debit_transaction_count, 0)
n:{p}_spend_share={p}_spend::double / nullif(total_spend, 0)::double"""
    for p in ("fallback", "cohere", "seed_rule")
)

REVIEW_COLUMNS = """s:raw_description;s:normalized_merchant;s:merchant_group;s:merchant_source;s:category_source
s:raw_category;s:final_category;i:transaction_count;n:total_spend;n:avg_debit_amount;d:first_seen;d:last_seen
i:anomaly_count;s:has_recurring_flag;s:needs_review;s:review_reason;n:review_priority_score"""

FACT_COLUMNS = """s:transaction_id;d:transaction_date;d:post_date;s:raw_description;s:normalized_merchant;s:merchant_group
s:merchant_source;s:category_source;n:ai_confidence;s:ai_reasoning;s:raw_category;s:final_category;s:transaction_type
n:amount;n:amount_abs;s:is_debit;s:is_credit;s:is_recurring;s:is_anomaly;s:anomaly_reason;n:zscore_vs_merchant
n:zscore_vs_category"""

_money = "'$' || format('{{:,.2f}}', ({0})::double)"


def money(expression: str) -> str:
    return f"coalesce({_money.format(expression)}, '$0.00')"


def percent(expression: str) -> str:
    return f"coalesce(format('{{:.1f}}', ({expression}) * 100) || '%', '—')"


def signed(expression: str) -> str:
    amount = f"format('{{:,.2f}}', abs(({expression})::double))"
    return f"coalesce(case when {expression} < 0 then '-$' || {amount} when {expression} > 0 then '+$' || {amount} end, '$0.00')"


def move_text(dimension: str, missing: str) -> str:
    return (
        f"coalesce(max({dimension} || case when delta_amount > 0 then ' up ' else ' down ' end || "
        f"{money('abs(delta_amount)')} || ' vs prior 30d (' || {money('current_spend')} || ' current)'), '{missing}')"
    )


def mover(view: str, dimension: str, where: str, order: str, missing: str) -> str:
    pick = f"(select * from {view} where {where} order by {order}, current_spend desc, {dimension} limit 1)"
    return (
        f"(select coalesce(max({dimension}), 'No change') as label, {move_text(dimension, missing)} as sentence, "
        f"max(delta_amount) as delta from {pick})"
    )


_FLAT = "No material change versus the prior 30 days."
_RISES = "delta_amount <> 0", "(delta_amount <= 0), abs(delta_amount) desc"


def share(expression: str, whole: str = "selected_total_spend") -> str:
    return percent(f"({expression})::double / nullif({whole}, 0)::double")


def long_date(expression: str) -> str:
    return f"strftime({expression}, '%b %-d, %Y')"


def rolled_line(label: str, key: str) -> str:
    value = f"(select max(metric_value_l30d) from rollup where metric_key = '{key}')"
    return f"'- {label}: ' || {money(value)} || ' (' || {share(value, 'l30')} || ' of total spend)'"


def lines(line: str, order: str, source: str, empty: str) -> str:
    """At most five rows of a source as lines in an order, or a fixed line."""
    return (
        f"coalesce((select string_agg({line}, chr(10) order by {order}) from "
        f"(select * from {source} order by {order} limit 5)), '{empty}')"
    )


def change_lines(view: str, dimension: str, empty: str) -> str:
    line = (
        f"'- ' || {dimension} || ': current ' || {money('current_spend')} || ', prior ' || {money('prior_spend')} "
        f"|| ', delta ' || {money('delta_amount')}"
    )
    return lines(line, f"delta_amount desc, current_spend desc, {dimension}", view, empty)


CONTEXT_SQL = f"""concat_ws(chr(10), 'Summary scope', '- View mode: all',
  '- Selected date window: ' || {long_date(f"date '{START}'")} || ' to ' || {long_date(f"date '{END}'")},
  '- Observed transaction window after filters: ' || {long_date('observed_start')} || ' to ' || {long_date('observed_end')},
  '- Category filter: All categories', '- Merchant filter: All merchants', '',
  'Selected-window metrics from marts.fct_transactions',
  '- Total debit spend: ' || {money('selected_total_spend')}, '- Credit amount: ' || {money('selected_credit_amount')},
  '- Total transactions: ' || format('{{:,}}', selected_transaction_count),
  '- Debit transactions: ' || format('{{:,}}', selected_debit_count),
  '- Credit transactions: ' || format('{{:,}}', selected_credit_count),
  '- Average debit transaction: ' || {money('selected_avg_debit')},
  '- Recurring spend: ' || {money('selected_recurring_spend')} || ' (' || {share('selected_recurring_spend')}
    || ' of debit spend)',
  '- Anomaly spend: ' || {money('selected_anomaly_spend')} || ' across ' || format('{{:,}}', selected_anomaly_count)
    || ' transactions (' || {share('selected_anomaly_spend')} || ' of debit spend)',
  '- Merchant source coverage: seed_rule=' || {money('rule_spend')} || ' (' || {share('rule_spend')}
    || '), cohere_cache=' || {money('enriched_spend')} || ' (' || {share('enriched_spend')} || '), fallback='
    || {money('fallback_spend')} || ' (' || {share('fallback_spend')} || ')', '',
  'Latest rolling 30-day window: ' || {long_date('latest_metric_date - 29')} || ' to ' || {long_date('latest_metric_date')},
  'Prior rolling 30-day window: ' || {long_date('latest_metric_date - 59')} || ' to '
    || {long_date('latest_metric_date - 30')},
  '- Total spend: ' || {money('l30')} || ' vs prior 30d ' || {money('l30_prior')},
  '- Total spend delta vs prior 30d: ' || {money('l30_delta')} || ' (' || {percent('l30_pct')} || ')',
  {rolled_line('Recurring spend', 'recurring_spend')}, {rolled_line('Anomaly spend', 'anomaly_spend')},
  {rolled_line('Fallback spend', 'fallback_spend')}, {rolled_line('Cohere-enriched spend', 'cohere_spend')}, '',
  'Primary summary cues',
  '- Primary category shift for the summary card: ' || cu_text,
  '- Primary merchant shift for the summary card: ' || mu_text,
  '- Largest category decline: ' || cd_text,
  '- Watch item for the summary card: ' || watch_label || ' | ' || watch_text, '',
  'Biggest recent changes by category',
  {change_lines('category_moves', 'final_category', '- No recent category comparison is available.')}, '',
  'Biggest recent changes by merchant',
  {change_lines('merchant_moves', 'normalized_merchant', '- No recent merchant comparison is available.')}, '',
  'Top categories in selected window',
  {lines(f"'- ' || final_category || ': ' || {money('s')} || ' (' || {share('s', '(select sum(amount_abs) from chosen_debits)')} || ')'",
         's desc, final_category',
         '(select final_category, sum(amount_abs) as s from chosen_debits group by 1)',
         '- No debit categories in the current filters.')}, '',
  'Largest anomalies in selected window',
  {lines(f"'- ' || strftime(transaction_date, '%Y-%m-%d') || ' | ' || normalized_merchant || ' | ' || "
         f"{money('amount_abs')} || ' | ' || anomaly_reason",
         'amount_abs desc, transaction_id', '(select * from chosen_debits where is_anomaly)',
         '- No anomalies in the current filters.')}, '',
  'Recurring merchants in selected window',
  {lines(f"'- ' || normalized_merchant || ' | ' || final_category || ' | ' || {money('s')} || ' across ' || "
         "format('{:,}', n) || ' transactions'",
         's desc, n desc, normalized_merchant, final_category',
         '(select normalized_merchant, final_category, sum(amount_abs) as s, count(*) as n from chosen_debits '
         'where is_recurring group by all)',
         '- No recurring merchants in the current filters.')}
) as context_text"""
SUMMARY_SQL = CHOSEN_DAILY.rstrip() + f""",
figures as (
  select coalesce(sum(amount_abs) filter (is_debit), 0) as selected_total_spend,
         coalesce(sum(amount_abs) filter (is_credit), 0) as selected_credit_amount,
         count(*) as selected_transaction_count, count(*) filter (is_debit) as selected_debit_count,
         count(*) filter (is_credit) as selected_credit_count,
         avg(amount_abs) filter (is_debit) as selected_avg_debit,
         coalesce(sum(amount_abs) filter (is_debit and is_recurring), 0) as selected_recurring_spend,
         coalesce(sum(amount_abs) filter (is_debit and is_anomaly), 0) as selected_anomaly_spend,
         count(*) filter (is_debit and is_anomaly) as selected_anomaly_count,
         coalesce(sum(amount_abs) filter (is_debit and merchant_source = 'fallback'), 0) as fallback_spend,
         coalesce(sum(amount_abs) filter (is_debit and merchant_source = 'cohere_cache'), 0) as enriched_spend,
         coalesce(sum(amount_abs) filter (is_debit and merchant_source = 'seed_rule'), 0) as rule_spend,
         min(transaction_date) as observed_start, max(transaction_date) as observed_end
  from chosen
),
latest as (select max(metric_date) as latest_metric_date from chosen_rolling),
windowed as (
  select coalesce(sum(amount_abs) filter (transaction_date > l - 30), 0) as current_window_spend,
         coalesce(sum(amount_abs) filter (transaction_date <= l - 30 and transaction_date > l - 60), 0) as prior_window_spend,
         coalesce(sum(amount_abs) filter (transaction_date > l - 30 and is_recurring), 0) as current_window_recurring_spend,
         coalesce(sum(amount_abs) filter (transaction_date > l - 30 and is_anomaly), 0) as current_window_anomaly_spend,
         coalesce(sum(amount_abs) filter (transaction_date > l - 30 and merchant_source = 'fallback'), 0)
           as current_window_fallback_spend
  from chosen_debits, (select latest_metric_date as l from latest)
),
spend_line as (select * from rollup where metric_key = 'total_spend'),
category_up as {mover('category_moves', 'final_category', *_RISES, _FLAT)},
merchant_up as {mover('merchant_moves', 'normalized_merchant', *_RISES, _FLAT)},
category_down as {mover('category_moves', 'final_category', 'delta_amount < 0', 'delta_amount',
                        'No category moved down versus the prior 30 days.')},
watch as (
  select coalesce(max(normalized_merchant), 'No major anomaly') as label,
         coalesce(max({_money.format('amount_abs')} || ' · ' || anomaly_reason),
                  'No anomalies in the current selection.') as sentence
  from (select * from chosen_debits where is_anomaly order by amount_abs desc, transaction_id limit 1)
),
together as (
  select f.*, w.*, latest_metric_date, s.metric_value_l30d as l30, s.metric_value_prior_l30d as l30_prior,
         s.delta_value as l30_delta, s.delta_pct as l30_pct,
         cu.label as cu_label, cu.sentence as cu_text, cu.delta as cu_delta,
         mu.label as mu_label, mu.sentence as mu_text, mu.delta as mu_delta,
         cd.label as cd_label, cd.sentence as cd_text, cd.delta as cd_delta,
         x.label as watch_label, x.sentence as watch_text,
         selected_anomaly_spend::double / nullif(selected_total_spend, 0)::double as anomaly_share,
         fallback_spend::double / nullif(selected_total_spend, 0)::double as fallback_share
  from figures f, windowed w, latest, spend_line s, category_up cu, merchant_up mu, category_down cd, watch x
)
select strftime(date '{START}', '%b %-d, %Y') as selected_start, strftime(date '{END}', '%b %-d, %Y') as selected_end,
""" + out("""n:selected_total_spend;n:selected_credit_amount;i:selected_transaction_count;i:selected_debit_count
i:selected_credit_count;n:selected_avg_debit;n:selected_recurring_spend;n:selected_anomaly_spend
i:selected_anomaly_count;n:selected_anomaly_share=anomaly_share;n:selected_fallback_share=fallback_share
d:latest_metric_date;n:current_30d_total_spend=l30;n:current_30d_total_spend_delta=l30_delta
n:current_30d_total_spend_delta_pct=l30_pct;n:current_window_spend;n:prior_window_spend
n:current_window_recurring_spend;n:current_window_anomaly_spend;n:current_window_fallback_spend
s:recent_category_label=cu_label;s:recent_category_text=cu_text;n:recent_category_delta=cu_delta
s:recent_merchant_label=mu_label;s:recent_merchant_text=mu_text;n:recent_merchant_delta=mu_delta
s:largest_decline_category_label=cd_label;s:largest_decline_category_text=cd_text
n:largest_decline_category_delta=cd_delta;s:summary_card_1_title='30D Trend'
s:summary_card_2_title='Recent Driver';s:summary_card_2_value=cu_label;s:summary_card_2_subtitle=cu_text
s:summary_card_3_title='Watch Item';s:summary_card_3_value=watch_label;s:summary_card_3_subtitle=watch_text""") + f""",
{money('current_window_spend')} as summary_card_1_value,
{signed('l30_delta')} || ' vs prior 30d (' || {percent('l30_pct')} || ')' as summary_card_1_subtitle,
concat_ws(chr(10), '## What changed',
  '- Rolling 30-day spend is ' || {money('current_window_spend')} || ', with a change of ' || {signed('l30_delta')}
    || ' vs the prior 30 days (' || {percent('l30_pct')} || ').',
  '- Biggest category mover: ' || cu_text, '- Biggest merchant mover: ' || mu_text,
  '- Largest category decline: ' || cd_text, '', '## What''s notable',
  '- Recurring spend in the latest 30-day window is ' || {money('current_window_recurring_spend')} || '.',
  '- Anomaly spend in the current selection is ' || {money('selected_anomaly_spend')} || ' ('
    || {percent('anomaly_share')} || ' of debit spend).',
  '- Watch item: ' || watch_label || ' — ' || watch_text, '', '## What to review',
  '- Fallback merchant coverage is ' || {percent('fallback_share')} || ' of selected debit spend.',
  '- If you are investigating recent change, start with ' || cu_label || ' and ' || mu_label || '.'
) as fallback_summary,
concat_ws(chr(10), 'Summary cues',
  '- Selected window: ' || strftime(date '{START}', '%b %-d, %Y') || ' to ' || strftime(date '{END}', '%b %-d, %Y'),
  '- Selected debit spend: ' || {money('selected_total_spend')},
  '- Debit transactions: ' || format('{{:,}}', selected_debit_count),
  '- Rolling 30-day spend: ' || {money('current_window_spend')} || ', delta ' || {signed('l30_delta')}
    || ' (' || {percent('l30_pct')} || ')',
  '- Primary category shift: ' || cu_text, '- Primary merchant shift: ' || mu_text,
  '- Largest category decline: ' || cd_text,
  '- Recurring spend in latest 30d: ' || {money('current_window_recurring_spend')},
  '- Anomaly spend in selected window: ' || {money('selected_anomaly_spend')} || ' (' || {percent('anomaly_share')}
    || ' of debit spend)',
  '- Watch item: ' || watch_label || ' — ' || watch_text,
  '- Fallback merchant coverage: ' || {percent('fallback_share')} || ' of selected debit spend'
) as prompt_context,
{CONTEXT_SQL}
from together"""

DAILY_SQL = WITH_DAILY + "select " + out("""d:metric_date;s:metric_key;s:metric_name;s:metric_group;s:unit;i:series_count
n:metric_value=v;n:metric_value_l30d=l30;n:metric_value_prior_l30d=p30;i:fingerprint""") + """
from (select metric_date, metric_key, metric_name, metric_group, unit, count(*) as series_count, sum(metric_value) as v,
        sum(metric_value_l30d) as l30, sum(metric_value_prior_l30d) as p30,
        sum(('0x' || substr(md5(concat_ws('|', final_category, normalized_merchant, merchant_source, category_source,
          metric_value::decimal(28,2)::varchar, metric_value_l30d::decimal(28,2)::varchar,
          coalesce(metric_value_prior_l30d::decimal(28,2)::varchar, 'none'))), 1, 8))::bigint) as fingerprint
      from rolling group by all)"""

ENTRIES = {
    "transaction_features": (
        features,
        LAYERS + "select " + out("""s:transaction_id;s:normalized_merchant;s:final_category;n:merchant_avg_amount
n:merchant_std_amount;n:category_avg_amount;n:category_std_amount;d:previous_merchant_transaction_date
n:zscore_vs_merchant;n:zscore_vs_category;i:days_since_last_transaction_at_merchant""") + " from gaps",
    ),
    "recurring_transactions": (
        lambda c: recurring_transactions(c.layers.features),
        LAYERS + "select " + out("""s:normalized_merchant;s:final_category;i:transaction_count;d:first_seen;d:last_seen
n:avg_amount;n:amount_stddev;n:avg_days_between_transactions;s:is_recurring;s:cadence""") + " from recurrence",
    ),
    "fact_transactions": (
        lambda c: fact_transactions(c.layers.features, c.layers.recurring),
        LAYERS + "select " + out(FACT_COLUMNS) + " from fact",
    ),
    "mart_anomalies": (
        lambda c: marts.mart_anomalies(c.fact),
        LAYERS + "select " + out("""s:transaction_id;d:transaction_date;s:normalized_merchant;s:final_category;n:amount_abs
s:anomaly_reason;n:severity_score=greatest(coalesce(zscore_vs_merchant, 0), coalesce(zscore_vs_category, 0))""")
        + " from fact where is_anomaly",
    ),
    "mart_recurring_spend": (
        lambda c: c.recurring_mart,
        ALL_MARTS + "select " + out("""s:normalized_merchant;s:final_category;s:cadence;n:avg_amount;n:amount_stddev
i:transaction_count;d:first_seen;d:last_seen;n:estimated_monthly_cost""") + " from recurring_mart",
    ),
    "mart_monthly_spend": (
        lambda c: marts.mart_monthly_spend(c.fact),
        ALL_MARTS + "select " + out("""d:month;s:final_category;n:total_spend;i:transaction_count;n:avg_transaction_amount
n:mom_change_amount;n:mom_change_pct""") + " from monthly_spend",
    ),
    "mart_monthly_kpis": (
        lambda c: marts.mart_monthly_kpis(c.fact),
        ALL_MARTS + "select " + out("""d:month;n:total_spend;i:transaction_count;n:avg_transaction_amount
n:median_transaction_amount;s:top_category;n:top_category_spend;s:top_merchant;n:top_merchant_spend;n:recurring_spend
n:recurring_spend_share;i:anomaly_count;n:anomaly_spend;n:mom_spend_change_amount;n:mom_spend_change_pct""")
        + " from monthly_kpis",
    ),
    "mart_category_metrics": (
        lambda c: marts.mart_category_metrics(c.fact),
        ALL_MARTS + "select " + out("""s:final_category;n:total_spend;n:spend_share;n:monthly_avg_spend
n:monthly_spend_stddev;n:monthly_spend_volatility;i:transaction_count;n:avg_transaction_amount
n:largest_transaction_amount;s:top_merchant;n:top_merchant_spend;n:latest_month_spend;n:prior_month_spend
n:latest_mom_change_amount;n:latest_mom_change_pct""") + " from category_metrics",
    ),
    "mart_spend_kpis": (
        lambda c: marts.mart_spend_kpis(c.fact, c.recurring_mart),
        ALL_MARTS + "select " + out(KPI_COLUMNS) + " from spend_totals",
    ),
    "mart_data_quality": (
        lambda c: marts.mart_data_quality(c.fact),
        ALL_MARTS + "select " + out("""s:merchant_source;s:category_source;i:transaction_count;n:total_spend
n:transaction_share;n:spend_share;i:unique_raw_descriptions;i:unique_normalized_merchants""") + " from source_quality",
    ),
    "mart_merchant_review": (
        lambda c: c.review, ALL_MARTS + "select " + out(REVIEW_COLUMNS) + " from review",
    ),
    "mart_metric_summary": (
        lambda c: marts.mart_metric_summary(c.fact),
        ALL_MARTS + "select " + out("""d:as_of_date;d:current_period_start;d:current_period_end=as_of_date
d:comparison_period_start;d:comparison_period_end;s:metric_key;s:metric_label;s:metric_group;n:metric_value
n:comparison_value;n:delta_value=metric_value - comparison_value
n:delta_pct=case when abs(comparison_value) > 0 then metric_value / comparison_value - 1 end
s:unit;s:favorable_direction;s:definition""") + " from period_pairs, periods",
    ),
    "mart_daily_metric_values": (daily_mart, DAILY_SQL),
    "mart_daily_metric_runs": (
        stored_daily,
        DAILY_SQL.replace("from rolling group", f"from rolling where metric_date between '{RUNS_START}' and '{RUNS_END}' group"),
    ),
    "daily_run_counts": (
        daily_run_counts,
        WITH_DAILY + "select " + out("s:metric_key;i:days=count(*);n:metric_value=sum(metric_value);d:first_day=min(metric_date)"
                                     ";d:last_day=max(metric_date)") + " from rolling group by metric_key",
    ),
    "kpi_row": (
        lambda c: slices.kpi_row(selection(c)),
        CHOSEN + "select " + out("""n:spend=coalesce(sum(amount_abs) filter (is_debit), 0)
n:credits=coalesce(sum(amount_abs) filter (is_credit), 0);i:anomaly_count=count(*) filter (is_anomaly)
i:transaction_count=count(*);n:avg_debit=avg(amount_abs) filter (is_debit)
n:recurring_total=coalesce(sum(amount_abs) filter (is_debit and is_recurring), 0)
s:top_category=(select arg_min(final_category, (-s, final_category)) from (select final_category, sum(amount_abs) as s from chosen_debits group by 1))
n:top_category_spend=(select max(s) from (select sum(amount_abs) as s from chosen_debits group by final_category))""")
        + " from chosen",
    ),
    "spend_by_month_category": (
        lambda c: slices.spend_by_month_category(selection(c)),
        CHOSEN + "select " + out("d:month;s:final_category;n:amount_abs=s") + " from (select date_trunc('month', "
        "transaction_date) as month, final_category, sum(amount_abs) as s from chosen_debits group by all)",
    ),
    "spend_by_category": (
        lambda c: slices.spend_by_category(selection(c)),
        CHOSEN + "select " + out("s:final_category;n:amount_abs=sum(amount_abs)") + " from chosen_debits group by final_category",
    ),
    "top_merchants": (
        lambda c: slices.top_merchants(selection(c)),
        CHOSEN + "select " + out("s:normalized_merchant;n:amount_abs=s") + " from (select normalized_merchant, "
        "sum(amount_abs) as s from chosen_debits group by 1 order by s desc, normalized_merchant limit 15)",
    ),
    "daily_spend": (
        lambda c: slices.daily_spend(selection(c)),
        CHOSEN + "select " + out("d:transaction_date;n:amount_abs=sum(amount_abs)")
        + " from chosen_debits group by transaction_date",
    ),
    "anomaly_ranking": (
        lambda c: slices.anomaly_ranking(selection(c)),
        CHOSEN + "select " + out("""s:transaction_id;d:transaction_date;s:normalized_merchant;s:final_category;n:amount_abs
s:anomaly_reason;n:zscore_vs_merchant;n:zscore_vs_category
n:severity=greatest(coalesce(zscore_vs_merchant, 0), coalesce(zscore_vs_category, 0))""")
        + " from (select * from chosen where is_anomaly order by zscore_vs_merchant desc nulls last, "
        "zscore_vs_category desc nulls last, transaction_id limit 10)",
    ),
    "recurring_visible": (
        lambda c: slices.recurring_visible(c.recurring_mart, selection(c)),
        CHOSEN + "select " + out("""s:normalized_merchant;s:final_category;s:cadence;n:avg_amount;n:amount_stddev
i:transaction_count;d:first_seen;d:last_seen;n:estimated_monthly_cost""") + " from recurring_mart "
        "where normalized_merchant in (select normalized_merchant from chosen_debits where is_recurring)",
    ),
    "review_summary": (
        lambda c: slices.review_summary(c.review, selection(c)),
        CHOSEN + "select " + out("""i:needs_review_count=count(*) filter (needs_review)
n:unmapped_spend=coalesce(sum(total_spend) filter (needs_review), 0)
i:mapped_count=count(*) filter (not needs_review);n:top_priority_score=max(review_priority_score)""")
        + " from review where raw_description in (select raw_description from chosen)",
    ),
    "review_sections": (
        lambda c: slices.review_sections(c.review).select(
            "section", "section_count", "raw_description", "raw_category", "final_category", "review_priority_score"
        ),
        ALL_MARTS + "select " + out("s:section;i:section_count=count(*) over (partition by section);s:raw_description;"
                                    "s:raw_category;s:final_category;n:review_priority_score")
        + " from (select 'needs_review' as section, * from review where needs_review union all "
        "select 'enriched', * from review where merchant_source = 'cohere_cache' union all "
        "select 'rule_mapped', * from review where merchant_source = 'seed_rule')",
    ),
    "metric_rollup": (
        lambda c: slices.metric_rollup(daily_selection(c)),
        CHOSEN_DAILY + "select " + out("""s:metric_key;s:metric_name;s:metric_group;s:unit;n:metric_value_l30d
n:metric_value_prior_l30d;n:delta_value;n:delta_pct
i:sort_order=case metric_key when 'total_spend' then 0 when 'debit_transaction_count' then 1 when 'recurring_spend' then 2 when 'recurring_transaction_count' then 3 when 'anomaly_spend' then 4 when 'anomaly_transaction_count' then 5 when 'fallback_spend' then 6 when 'fallback_transaction_count' then 7 when 'cohere_spend' then 8 when 'cohere_transaction_count' then 9 when 'seed_rule_spend' then 10 when 'seed_rule_transaction_count' then 11 when 'credit_amount' then 12 when 'credit_transaction_count' then 13 else 999 end""")
        + " from rollup",
    ),
    "metric_trend": (
        lambda c: slices.metric_trend(daily_selection(c)),
        CHOSEN_DAILY + "select " + out("d:metric_date;s:metric_key;s:metric_name;s:metric_group;s:unit;n:metric_value_l30d=v")
        + " from (select metric_date, metric_key, metric_name, metric_group, unit, sum(metric_value_l30d) as v "
        "from chosen_rolling group by all)",
    ),
    "selected_window_summary": (
        lambda c: slices.selected_window_summary(selection(c)),
        CHOSEN + "select " + out("""n:selected_total_spend=spend;n:selected_credit_amount=coalesce(credit, 0)
i:selected_transaction_count=n;i:selected_debit_count=debits;i:selected_credit_count=credits;n:selected_avg_debit=mean
n:selected_recurring_spend=a1;n:selected_anomaly_spend=a2;i:selected_anomaly_count=anomalies
n:selected_fallback_spend=a3;n:selected_cohere_spend=a4;n:selected_seed_rule_spend=a5
n:selected_recurring_share=a1::double / spend::double;n:selected_anomaly_share=a2::double / spend::double
n:selected_fallback_share=a3::double / spend::double;n:selected_cohere_share=a4::double / spend::double
n:selected_seed_rule_share=a5::double / spend::double""") + """ from (select
  coalesce(sum(amount_abs) filter (is_debit), 0) as spend, sum(amount_abs) filter (is_credit) as credit,
  count(*) as n, count(*) filter (is_debit) as debits, count(*) filter (is_credit) as credits,
  avg(amount_abs) filter (is_debit) as mean, count(*) filter (is_debit and is_anomaly) as anomalies,
  coalesce(sum(amount_abs) filter (is_debit and is_recurring), 0) as a1,
  coalesce(sum(amount_abs) filter (is_debit and is_anomaly), 0) as a2,
  coalesce(sum(amount_abs) filter (is_debit and merchant_source = 'fallback'), 0) as a3,
  coalesce(sum(amount_abs) filter (is_debit and merchant_source = 'cohere_cache'), 0) as a4,
  coalesce(sum(amount_abs) filter (is_debit and merchant_source = 'seed_rule'), 0) as a5 from chosen)""",
    ),
    "rolling_windows": (
        lambda c: slices.rolling_windows(selection(c), slices.anchor_date(selection(c))),
        CHOSEN + "select " + out("""n:current_window_spend=coalesce(sum(amount_abs) filter (is_current), 0)
n:prior_window_spend=coalesce(sum(amount_abs) filter (is_prior), 0)
n:current_window_recurring_spend=coalesce(sum(amount_abs) filter (is_current and is_recurring), 0)
n:current_window_anomaly_spend=coalesce(sum(amount_abs) filter (is_current and is_anomaly), 0)
n:current_window_fallback_spend=coalesce(sum(amount_abs) filter (is_current and merchant_source = 'fallback'), 0)
d:current_window_start=max(day) - 29;d:current_window_end=max(day);d:prior_window_start=max(day) - 59
d:prior_window_end=max(day) - 30""") + " from sided",
    ),
    "change_table": (change, CHOSEN + "select " + MERCHANT_MOVE + " from merchant_moves"),
    "top_mover": (
        lambda c: slices.top_mover(change(c), "normalized_merchant"),
        CHOSEN + "select " + MERCHANT_MOVE + " from (select * from merchant_moves where delta_amount <> 0 "
        "order by abs(delta_amount) desc, current_spend desc, normalized_merchant limit 1)",
    ),
    "directional_mover": (
        lambda c: slices.directional_mover(change(c), "normalized_merchant", "up").unionByName(
            slices.directional_mover(change(c), "normalized_merchant", "down")
        ),
        CHOSEN + "select " + MERCHANT_MOVE + " from ((select * from merchant_moves where delta_amount > 0 "
        "order by delta_amount desc, current_spend desc, normalized_merchant limit 1) union all "
        "(select * from merchant_moves where delta_amount < 0 order by delta_amount, current_spend desc, "
        "normalized_merchant limit 1))",
    ),
    "largest_anomaly": (
        lambda c: slices.largest_anomaly(selection(c)),
        CHOSEN + "select " + out("s:transaction_id;d:transaction_date;s:normalized_merchant;n:amount_abs;s:anomaly_reason")
        + " from (select * from chosen_debits where is_anomaly order by amount_abs desc, transaction_id limit 1)",
    ),
    "top_categories": (
        lambda c: slices.top_categories(selection(c)),
        CHOSEN + "select " + out("s:final_category;n:amount_abs=s;n:spend_share=s::double / (select sum(amount_abs) "
                                 "from chosen_debits)::double")
        + " from (select final_category, sum(amount_abs) as s from chosen_debits group by 1 "
        "order by s desc, final_category limit 5)",
    ),
    "recurring_merchants": (
        lambda c: slices.recurring_merchants(selection(c)),
        CHOSEN + "select " + out("s:normalized_merchant;s:final_category;n:amount_abs=s;i:transaction_count")
        + " from (select normalized_merchant, final_category, sum(amount_abs) as s, count(*) as transaction_count "
        "from chosen_debits where is_recurring group by all order by s desc, transaction_count desc, "
        "normalized_merchant, final_category limit 5)",
    ),
    "summary_record": (summary, SUMMARY_SQL),
}

# The same marts from month states that two overlapping loads were merged into.
ENTRIES |= {
    f"loaded_{name}": (lambda c, name=name: c.loaded_marts[name], ENTRIES[name][1])
    for name in (
        "mart_recurring_spend",
        "mart_monthly_spend",
        "mart_monthly_kpis",
        "mart_category_metrics",
        "mart_spend_kpis",
        "mart_data_quality",
        "mart_merchant_review",
    )
}
ENTRIES |= {
    "loaded_fact_transactions": (lambda c: c.loaded.fact(), ENTRIES["fact_transactions"][1]),
    "loaded_mart_anomalies": (lambda c: marts.mart_anomalies(c.loaded.fact()), ENTRIES["mart_anomalies"][1]),
}

# The same slices from the stored cube.
ENTRIES |= {
    f"cube_{name}": (build, ENTRIES[name][1])
    for name, build in {
        "kpi_row": lambda c: slices.kpi_row(cube_selection(c), MEASURES),
        "spend_by_month_category": lambda c: slices.spend_by_month_category(cube_selection(c)),
        "spend_by_category": lambda c: slices.spend_by_category(cube_selection(c)),
        "top_merchants": lambda c: slices.top_merchants(cube_selection(c)),
        "daily_spend": lambda c: slices.daily_spend(cube_selection(c)),
        "rolling_windows": lambda c: slices.rolling_windows(cube_selection(c), slices.anchor_date(cube_selection(c))),
        "change_table": cube_change,
        "top_categories": lambda c: slices.top_categories(cube_selection(c)),
        "recurring_merchants": lambda c: slices.recurring_merchants(cube_selection(c), by=MEASURES),
    }.items()
}
