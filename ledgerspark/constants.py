"""Fixed values. They define the result vocabulary, so they are stated as plain text and never derived."""

# --- fixed values: required columns of a card export, in file order -------------------------------------
REQUIRED_COLUMNS = [
    "Transaction Date",
    "Post Date",
    "Description",
    "Category",
    "Type",
    "Amount",
    "Memo",
]

# --- fixed values: provenance labels --------------------------------------------------------------------
SOURCE_RULE = "seed_rule"
SOURCE_ENRICHED = "cohere_cache"
SOURCE_FALLBACK = "fallback"
SOURCE_RAW_CATEGORY = "chase_raw"
UNMAPPED_GROUP = "Unmapped"
OTHER_CATEGORY = "Other"
ENRICHMENT_CONFIDENCE = 0.70

# --- fixed values: anomaly, recurrence and change thresholds -----------------------------------------------
MERCHANT_Z = 2.5
CATEGORY_Z = 3.0
REASON_MERCHANT = "High amount compared with usual merchant spend"
REASON_CATEGORY = "High amount compared with category spend"
MONTHLY_GAP = (25, 35)
WEEKLY_GAP = (6, 8)
MIN_RECURRENCES = 3
AMOUNT_TOLERANCE = 0.15
AMOUNT_TOLERANCE_FLOOR = 3
WEEKS_PER_MONTH = 4.33
CHANGE_FLOOR = 50
PERIOD_DAYS = 30

# --- fixed values: review queue --------------------------------------------------------------------------
REVIEW_FREQUENT = "High-frequency fallback merchant"
REVIEW_EXPENSIVE = "High-spend fallback merchant"
REVIEW_ENRICHED = "Mapped by Cohere enrichment cache"
REVIEW_RAW = "Raw description used as merchant fallback"
REVIEW_RULE = "Mapped by seed rules"
REVIEW_MIN_COUNT = 3
REVIEW_MIN_SPEND = 250
REVIEW_WEIGHT_FALLBACK = 100
REVIEW_WEIGHT_ENRICHED = 10
REVIEW_COUNT_CAP, REVIEW_POINTS_PER_COUNT = 25, 3
REVIEW_SPEND_PER_POINT, REVIEW_SPEND_CAP = 100, 25

# --- fixed values: categories an enrichment may use ------------------------------------------------------
ALLOWED_CATEGORIES = [
    "Groceries",
    "Food & Drink",
    "Travel",
    "Bills & Utilities",
    "Entertainment",
    "Shopping",
    "Health & Wellness",
    "Personal",
    "Professional Services",
    "Fees & Adjustments",
    "Gifts & Donations",
    "Gas",
    "Home",
    "Other",
]
DEFAULT_ENRICHED_GROUP = "AI Suggested"

# --- fixed values: tags a merchant profile may use --------------------------------------------------------
ALLOWED_TAGS = [
    "air_travel",
    "bar",
    "bookstore",
    "cafe",
    "coffee_shop",
    "delivery",
    "entertainment",
    "fitness",
    "gas_station",
    "grocery_store",
    "healthcare",
    "hotel",
    "live_events",
    "medical_services",
    "movie_theater",
    "music_audio",
    "news_media",
    "online_retail",
    "personal_care",
    "pharmacy",
    "professional_services",
    "public_transit",
    "restaurant",
    "rideshare",
    "saas_subscription",
    "shopping",
    "streaming_subscription",
    "subscription_service",
    "telecom",
    "travel",
    "utilities",
]
MAX_TAGS = 6

# --- fixed values: search vocabulary and thresholds --------------------------------------------------------
STOPWORDS = ["a", "an", "and", "for", "in", "of", "on", "the", "to", "with"]
SYNONYMS = {
    "cafe": ["cafe", "café", "coffee", "espresso", "latte", "starbucks"],
    "coffee": ["coffee", "cafe", "café", "espresso", "latte", "starbucks"],
    "commute": ["commute", "train", "subway", "metro", "uber", "lyft", "transit", "amtrak"],
    "groceries": ["groceries", "grocery", "market", "foods", "whole", "trader", "fresh"],
    "health": ["health", "medical", "wellness", "therapy", "physical", "pharmacy", "doctor"],
    "movie": ["movie", "movies", "film", "cinema", "theater", "theatre"],
    "movies": ["movie", "movies", "film", "cinema", "theater", "theatre"],
    "cinema": ["movie", "movies", "film", "cinema", "theater", "theatre"],
    "theater": ["movie", "movies", "film", "cinema", "theater", "theatre"],
    "theatre": ["movie", "movies", "film", "cinema", "theater", "theatre"],
    "restaurants": ["restaurant", "restaurants", "food", "dining", "eatery", "cafe"],
    "streaming": ["streaming", "subscription", "premium", "netflix", "youtube", "spotify"],
    "subscription": ["subscription", "subscriptions", "premium", "membership", "recurring", "monthly"],
    "subscriptions": ["subscription", "subscriptions", "premium", "membership", "recurring", "monthly"],
    "travel": ["travel", "flight", "hotel", "airline", "uber", "lyft", "transit", "amtrak"],
}
WHOLE_QUERY_SCORE, PHRASE_SCORE, TOKEN_SCORE, PART_SCORE = 3.0, 1.5, 1.0, 0.5
# (rerank, semantic, lexical) scores, any of which is enough for the label
HIGH_CONFIDENCE = (0.15, 0.38, 4)
MEDIUM_CONFIDENCE = (0.08, 0.30, 2)
# enough alone: rerank, semantic; enough together: (lexical, semantic), (lexical, rerank)
GATE_RERANK, GATE_SEMANTIC = 0.08, 0.33
GATE_LEXICAL_SEMANTIC = (1, 0.20)
GATE_LEXICAL_RERANK = (2, 0.04)
MIN_QUERY_LENGTH = 3
RESULT_LIMIT = 25
CANDIDATE_COUNT = 60
LEXICAL_WEIGHT = 0.08
EMBED_BATCH = 96
PROFILE_BATCH = 10

# --- fixed values: the thirteen period metrics ---------------------------------------------------------------
# (key, label, group, unit, favourable direction, definition)
PERIOD_METRICS = [
    ("total_spend", "Total Spend", "Spend", "currency", "lower",
     "Debit spend in the period. Payments and credits are excluded."),
    ("debit_transaction_count", "Debit Transactions", "Spend", "count", "neutral",
     "Count of debit transactions in the period."),
    ("avg_transaction_amount", "Average Transaction", "Spend", "currency", "lower",
     "Average debit transaction amount in the period."),
    ("median_transaction_amount", "Median Transaction", "Spend", "currency", "lower",
     "Median debit transaction amount in the period."),
    ("top_category_share", "Top Category Share", "Concentration", "percent", "lower",
     "Largest category spend divided by total debit spend."),
    ("top_merchant_share", "Top Merchant Share", "Concentration", "percent", "lower",
     "Largest merchant spend divided by total debit spend."),
    ("top_5_merchant_share", "Top 5 Merchant Share", "Concentration", "percent", "lower",
     "Top five merchants by spend divided by total debit spend."),
    ("recurring_spend_share", "Recurring Spend Share", "Behavior", "percent", "lower",
     "Debit spend marked as recurring divided by total debit spend."),
    ("anomaly_spend_share", "Anomaly Spend Share", "Risk", "percent", "lower",
     "Anomalous debit spend divided by total debit spend."),
    ("fallback_spend_share", "Fallback Spend Share", "Data Quality", "percent", "lower",
     "Debit spend using raw fallback merchant normalization divided by total debit spend."),
    ("cohere_spend_share", "Cohere-Enriched Share", "Data Quality", "percent", "neutral",
     "Debit spend with merchant/category values supplied by the Cohere enrichment cache."),
    ("seed_rule_spend_share", "Seed Rule Share", "Data Quality", "percent", "higher",
     "Debit spend covered by deterministic merchant seed rules."),
    ("transaction_amount_volatility", "Transaction Volatility", "Volatility", "percent", "lower",
     "Standard deviation of debit transaction amount divided by average debit transaction amount."),
]

# --- fixed values: the seven daily populations; each yields one currency and one count metric --------------
# (population, amount key, amount name, count key, count name, group)
DAILY_METRICS = [
    ("debit", "total_spend", "Total Spend", "debit_transaction_count", "Debit Transactions", "Spend"),
    ("credit", "credit_amount", "Credit Amount", "credit_transaction_count", "Credit Transactions", "Credits"),
    ("anomaly", "anomaly_spend", "Anomaly Spend", "anomaly_transaction_count", "Anomaly Transactions", "Risk"),
    ("recurring", "recurring_spend", "Recurring Spend", "recurring_transaction_count", "Recurring Transactions",
     "Behavior"),
    ("fallback", "fallback_spend", "Fallback Spend", "fallback_transaction_count", "Fallback Transactions",
     "Data Quality"),
    ("enriched", "cohere_spend", "Cohere-Enriched Spend", "cohere_transaction_count", "Cohere-Enriched Transactions",
     "Data Quality"),
    ("rule", "seed_rule_spend", "Seed Rule Spend", "seed_rule_transaction_count", "Seed Rule Transactions",
     "Data Quality"),
]

# --- fixed values: display order of the daily metrics ------------------------------------------------------
DISPLAY_ORDER = [
    "total_spend",
    "debit_transaction_count",
    "recurring_spend",
    "recurring_transaction_count",
    "anomaly_spend",
    "anomaly_transaction_count",
    "fallback_spend",
    "fallback_transaction_count",
    "cohere_spend",
    "cohere_transaction_count",
    "seed_rule_spend",
    "seed_rule_transaction_count",
    "credit_amount",
    "credit_transaction_count",
]
UNLISTED_POSITION = 999

# --- fixed values: texts of the search sentence, the profile sentence and the summary ----------------------------
# Names in braces stand for formatted columns.
SEARCH_SENTENCE = (
    "merchant: {merchant}. merchant_group: {group}. category: {category}. raw_description: {raw_description}. "
    "transaction_type: {type}. amount: {amount}. date: {date}. signals: {signals}. merchant_source: {source}."
)
PROFILE_SENTENCE = "merchant_summary: {summary}. semantic_tags: {tags}."

NO_CHANGE = "No change"
NO_MATERIAL_CHANGE = "No material change versus the prior 30 days."
NO_DECLINE = "No category moved down versus the prior 30 days."
NO_ANOMALY = "No major anomaly"
NO_ANOMALY_TEXT = "No anomalies in the current selection."
MOVE = "{label} {direction} {size} vs prior 30d ({current} current)"
ANOMALY_TEXT = "{amount} · {reason}"
CARD_TITLES = ("30D Trend", "Recent Driver", "Watch Item")
CARD_TREND = "{delta} vs prior 30d ({delta_pct})"

FALLBACK_SUMMARY = """## What changed
- Rolling 30-day spend is {window_spend}, with a change of {delta} vs the prior 30 days ({delta_pct}).
- Biggest category mover: {category_move}
- Biggest merchant mover: {merchant_move}
- Largest category decline: {category_decline}

## What's notable
- Recurring spend in the latest 30-day window is {window_recurring}.
- Anomaly spend in the current selection is {anomaly_spend} ({anomaly_share} of debit spend).
- Watch item: {watch} — {watch_text}

## What to review
- Fallback merchant coverage is {fallback_share} of selected debit spend.
- If you are investigating recent change, start with {category_label} and {merchant_label}."""

PROMPT_CONTEXT = """Summary cues
- Selected window: {start} to {end}
- Selected debit spend: {total_spend}
- Debit transactions: {debit_count}
- Rolling 30-day spend: {window_spend}, delta {delta} ({delta_pct})
- Primary category shift: {category_move}
- Primary merchant shift: {merchant_move}
- Largest category decline: {category_decline}
- Recurring spend in latest 30d: {window_recurring}
- Anomaly spend in selected window: {anomaly_spend} ({anomaly_share} of debit spend)
- Watch item: {watch} — {watch_text}
- Fallback merchant coverage: {fallback_share} of selected debit spend"""

CONTEXT_ROLLING = """Latest rolling 30-day window: {window_start} to {window_end}
Prior rolling 30-day window: {prior_start} to {prior_end}
- Total spend: {l30_total} vs prior 30d {l30_prior}
- Total spend delta vs prior 30d: {l30_delta} ({delta_pct})
- Recurring spend: {l30_recurring} ({l30_recurring_share} of total spend)
- Anomaly spend: {l30_anomaly} ({l30_anomaly_share} of total spend)
- Fallback spend: {l30_fallback} ({l30_fallback_share} of total spend)
- Cohere-enriched spend: {l30_enriched} ({l30_enriched_share} of total spend)"""
CONTEXT_NO_ROLLING = """Rolling 30-day metrics
- No daily metric rollups match the current filters."""

CONTEXT = """Summary scope
- View mode: {view}
- Selected date window: {start} to {end}
- Observed transaction window after filters: {observed_start} to {observed_end}
- Category filter: {categories}
- Merchant filter: {merchants}

Selected-window metrics from marts.fct_transactions
- Total debit spend: {total_spend}
- Credit amount: {credit_amount}
- Total transactions: {count}
- Debit transactions: {debit_count}
- Credit transactions: {credit_count}
- Average debit transaction: {avg_debit}
- Recurring spend: {recurring_spend} ({recurring_share} of debit spend)
- Anomaly spend: {anomaly_spend} across {anomaly_count} transactions ({anomaly_share} of debit spend)
- Merchant source coverage: seed_rule={rule_spend} ({rule_share}), cohere_cache={enriched_spend} ({enriched_share}), \
fallback={fallback_spend} ({fallback_share})

{rolling}

Primary summary cues
- Primary category shift for the summary card: {category_move}
- Primary merchant shift for the summary card: {merchant_move}
- Largest category decline: {category_decline}
- Watch item for the summary card: {watch} | {watch_text}

Biggest recent changes by category
{category_changes}

Biggest recent changes by merchant
{merchant_changes}

Top categories in selected window
{top_categories}

Largest anomalies in selected window
{largest_anomalies}

Recurring merchants in selected window
{recurring_merchants}"""
ALL_CATEGORIES, ALL_MERCHANTS = "All categories", "All merchants"
CHANGE_LINE = "- {label}: current {current}, prior {prior}, delta {delta}"
CATEGORY_LINE = "- {label}: {amount} ({share})"
ANOMALY_LINE = "- {date} | {merchant} | {amount} | {reason}"
RECURRING_LINE = "- {merchant} | {category} | {amount} across {count} transactions"
NO_CATEGORY_CHANGES = "- No recent category comparison is available."
NO_MERCHANT_CHANGES = "- No recent merchant comparison is available."
NO_CATEGORIES = "- No debit categories in the current filters."
NO_ANOMALIES = "- No anomalies in the current filters."
NO_RECURRING = "- No recurring merchants in the current filters."

# --- declared data tests: fixed values -------------------------------------------------------------------------

DECLARED_TESTS = {
    "fct_transactions": {"not_null": ["transaction_id", "transaction_date", "final_category"], "unique": ["transaction_id"]},
    "mart_merchant_review": {"not_null": ["raw_description", "normalized_merchant", "review_priority_score"]},
    "mart_spend_kpis": {"not_null": ["total_spend", "transaction_count"]},
    "mart_monthly_kpis": {"not_null": ["month", "total_spend"], "unique": ["month"]},
    "mart_category_metrics": {"not_null": ["final_category", "total_spend"], "unique": ["final_category"]},
    "mart_data_quality": {"not_null": ["merchant_source", "category_source"]},
    "mart_metric_summary": {"not_null": ["metric_key", "metric_value", "unit"], "unique": ["metric_key"]},
    "mart_daily_metric_values": {"not_null": ["metric_date", "metric_key", "metric_value", "metric_value_l30d"]},
    "staged_transactions": {
        "not_null": ["transaction_id", "transaction_date", "raw_description", "amount", "transaction_type"],
        "unique": ["transaction_id"],
    },
    "staged_enrichments": {
        "not_null": ["raw_description", "suggested_merchant", "confidence"],
        "unique": ["raw_description"],
    },
}
