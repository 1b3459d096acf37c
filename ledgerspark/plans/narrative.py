"""The deterministic summary of a selection: cues, formatted lines and texts in one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerspark import constants as K
from ledgerspark.functions.amounts import guarded_ratio
from ledgerspark.functions.text import count_text, date_text, fill, money_text, percent_text, signed_money_text
from ledgerspark.operators.joins import scalar_cross_join
from ledgerspark.plans import slices

CATEGORY, MERCHANT = "final_category", "normalized_merchant"


def money(name: str) -> Column:
    return money_text(F.col(name))


def percent(name: str) -> Column:
    return percent_text(F.col(name))


def count(name: str) -> Column:
    return count_text(F.col(name))


def move_text(row: Column, dimension: str, missing: str) -> Column:
    """Sentence about a mover, or a fixed one where nothing moved."""
    delta = row["delta_amount"]
    parts = {"label": row[dimension], "size": money_text(F.abs(delta)), "current": money_text(row["current_spend"])}
    sentence = fill(K.MOVE, direction=F.when(delta > 0, "up").otherwise("down"), **parts)
    return F.coalesce(sentence, F.lit(missing))


def listing(df: DataFrame, order: Sequence[Column], line: Column, empty: str) -> Column:
    """The few rows of ``df`` as lines in an order, or a fixed line where there is none."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    lines = df.agg(F.array_join(F.transform(ordered, lambda row: row["line"]), "\n").alias("lines")).scalar()
    return F.coalesce(F.nullif(lines, F.lit("")), F.lit(empty))


def rolled_metrics(daily: DataFrame) -> DataFrame:
    """The rolled-up metrics the summary names, side by side in one row."""
    wanted = {
        "l30_total": ("total_spend", "metric_value_l30d"),
        "l30_prior": ("total_spend", "metric_value_prior_l30d"),
        "l30_delta": ("total_spend", "delta_value"),
        "l30_delta_pct": ("total_spend", "delta_pct"),
        "l30_recurring": ("recurring_spend", "metric_value_l30d"),
        "l30_anomaly": ("anomaly_spend", "metric_value_l30d"),
        "l30_fallback": ("fallback_spend", "metric_value_l30d"),
        "l30_enriched": ("cohere_spend", "metric_value_l30d"),
    }
    columns = [
        F.max(F.when(F.col("metric_key") == key, F.col(field))).alias(name) for name, (key, field) in wanted.items()
    ]
    return slices.metric_rollup(daily).agg(*columns)


def summary_record(
    filtered: DataFrame,
    daily: DataFrame,
    start: str | None = None,
    end: str | None = None,
    categories: Sequence[str] | None = None,
    merchants: Sequence[str] | None = None,
    view: str = "all",
) -> DataFrame:
    """All summary figures, cue sentences, the grounding context and the ready-made summary, as one row.

    ``filtered`` and ``daily`` are the selected transactions and daily metrics (the mart's rows or their totals);
    the remaining arguments only describe the selection.
    """
    anchor = slices.anchor_date(filtered, daily)
    debits = filtered.filter("is_debit")
    by_category = slices.change_table(debits, CATEGORY, anchor)
    by_merchant = slices.change_table(debits, MERCHANT, anchor)
    movers = {
        "__category": slices.primary_mover(by_category, CATEGORY),
        "__merchant": slices.primary_mover(by_merchant, MERCHANT),
        "__decline": slices.directional_mover(by_category, CATEGORY, "down"),
        "__anomaly": slices.largest_anomaly(filtered),
    }
    base = scalar_cross_join(
        slices.selected_window_summary(filtered),
        filtered.agg(
            F.min("transaction_date").alias("observed_start"), F.max("transaction_date").alias("observed_end")
        ),
        slices.rolling_windows(filtered, anchor),
        rolled_metrics(daily),
        daily.agg(F.max("metric_date").alias("latest_metric_date")),
        *[row.select(F.struct(*row.columns).alias(name)) for name, row in movers.items()],
    )
    cues = base.withColumns(cue_columns(start, end))
    texts = cues.withColumns(text_parts())
    lists = {
        "__category_changes": change_lines(by_category, CATEGORY, K.NO_CATEGORY_CHANGES),
        "__merchant_changes": change_lines(by_merchant, MERCHANT, K.NO_MERCHANT_CHANGES),
        **short_lists(filtered),
    }
    described = texts.withColumns(lists)
    scope = {
        "view": F.lit(view),
        "categories": F.lit(", ".join(categories) if categories else K.ALL_CATEGORIES),
        "merchants": F.lit(", ".join(merchants) if merchants else K.ALL_MERCHANTS),
    }
    parts = {name[2:]: F.col(name) for name in described.columns if name.startswith("__")}
    rolling = F.when(F.col("latest_metric_date").isNotNull(), fill(K.CONTEXT_ROLLING, **parts))
    return described.select(
        *RECORD_COLUMNS,
        fill(K.FALLBACK_SUMMARY, **parts).alias("fallback_summary"),
        fill(K.PROMPT_CONTEXT, **parts).alias("prompt_context"),
        fill(K.CONTEXT, **{**parts, **scope, "rolling": F.coalesce(rolling, F.lit(K.CONTEXT_NO_ROLLING))}).alias(
            "context_text"
        ),
    )


def cue_columns(start: str | None, end: str | None) -> dict[str, Column]:
    """Labels, sentences and summary cards, from the gathered figures."""
    category, merchant = F.col("__category"), F.col("__merchant")
    decline, anomaly = F.col("__decline"), F.col("__anomaly")
    category_text = move_text(category, CATEGORY, K.NO_MATERIAL_CHANGE)
    anomaly_text = fill(K.ANOMALY_TEXT, amount=money_text(anomaly["amount_abs"]), reason=anomaly["anomaly_reason"])
    trend = fill(
        K.CARD_TREND, delta=signed_money_text(F.col("l30_delta")), delta_pct=percent("l30_delta_pct")
    )

    def chosen(text: str | None, name: str) -> Column:
        return date_text(F.lit(text).cast("date") if text else F.col(name))

    def label(row: Column, dimension: str) -> Column:
        return F.coalesce(row[dimension], F.lit(K.NO_CHANGE))

    return {
        "selected_start": chosen(start, "observed_start"),
        "selected_end": chosen(end, "observed_end"),
        "current_30d_total_spend": F.col("l30_total"),
        "current_30d_total_spend_delta": F.col("l30_delta"),
        "current_30d_total_spend_delta_pct": F.col("l30_delta_pct"),
        "recent_category_label": label(category, CATEGORY),
        "recent_category_text": category_text,
        "recent_category_delta": category["delta_amount"],
        "recent_merchant_label": label(merchant, MERCHANT),
        "recent_merchant_text": move_text(merchant, MERCHANT, K.NO_MATERIAL_CHANGE),
        "recent_merchant_delta": merchant["delta_amount"],
        "largest_decline_category_label": label(decline, CATEGORY),
        "largest_decline_category_text": move_text(decline, CATEGORY, K.NO_DECLINE),
        "largest_decline_category_delta": decline["delta_amount"],
        "summary_card_1_title": F.lit(K.CARD_TITLES[0]),
        "summary_card_1_value": money("current_window_spend"),
        "summary_card_1_subtitle": trend,
        "summary_card_2_title": F.lit(K.CARD_TITLES[1]),
        "summary_card_2_value": label(category, CATEGORY),
        "summary_card_2_subtitle": category_text,
        "summary_card_3_title": F.lit(K.CARD_TITLES[2]),
        "summary_card_3_value": F.coalesce(anomaly[MERCHANT], F.lit(K.NO_ANOMALY)),
        "summary_card_3_subtitle": F.coalesce(anomaly_text, F.lit(K.NO_ANOMALY_TEXT)),
    }


def text_parts() -> dict[str, Column]:
    """The formatted parts of the texts; a leading ``__`` marks them as parts, the rest is the name in the text."""
    parts = {
        "start": F.col("selected_start"),
        "end": F.col("selected_end"),
        "observed_start": date_text(F.col("observed_start")),
        "observed_end": date_text(F.col("observed_end")),
        "window_start": date_text(F.col("current_window_start")),
        "window_end": date_text(F.col("current_window_end")),
        "prior_start": date_text(F.col("prior_window_start")),
        "prior_end": date_text(F.col("prior_window_end")),
        "count": count("selected_transaction_count"),
        "debit_count": count("selected_debit_count"),
        "credit_count": count("selected_credit_count"),
        "anomaly_count": count("selected_anomaly_count"),
        "total_spend": money("selected_total_spend"),
        "credit_amount": money("selected_credit_amount"),
        "avg_debit": money("selected_avg_debit"),
        "window_spend": money("current_window_spend"),
        "window_recurring": money("current_window_recurring_spend"),
        "delta": signed_money_text(F.col("l30_delta")),
        "delta_pct": percent("l30_delta_pct"),
        "l30_total": money("l30_total"),
        "l30_prior": money("l30_prior"),
        "l30_delta": money("l30_delta"),
        "category_label": F.col("recent_category_label"),
        "category_move": F.col("recent_category_text"),
        "merchant_label": F.col("recent_merchant_label"),
        "merchant_move": F.col("recent_merchant_text"),
        "category_decline": F.col("largest_decline_category_text"),
        "watch": F.col("summary_card_3_value"),
        "watch_text": F.col("summary_card_3_subtitle"),
    }
    selected = {"recurring": "recurring", "anomaly": "anomaly", "fallback": "fallback", "enriched": "cohere",
                "rule": "seed_rule"}
    for name, column in selected.items():
        parts[f"{name}_spend"] = money(f"selected_{column}_spend")
        parts[f"{name}_share"] = percent(f"selected_{column}_share")
    for name in ("recurring", "anomaly", "fallback", "enriched"):
        share = guarded_ratio(F.col(f"l30_{name}"), F.col("l30_total"))
        parts[f"l30_{name}"] = money(f"l30_{name}")
        parts[f"l30_{name}_share"] = percent_text(share)
    return {f"__{name}": column for name, column in parts.items()}


def change_lines(changes: DataFrame, dimension: str, empty: str) -> Column:
    line = fill(
        K.CHANGE_LINE,
        label=F.col(dimension),
        current=money("current_spend"),
        prior=money("prior_spend"),
        delta=money("delta_amount"),
    )
    order = [(-F.col("delta_amount")).alias("a"), (-F.col("current_spend")).alias("b"), F.col(dimension)]
    return listing(changes.limit(5), order, line, empty)


def short_lists(filtered: DataFrame) -> dict[str, Column]:
    """The bullet lists of leading categories, anomalies and recurring merchants."""
    by_amount = (-F.col("amount_abs")).alias("a")
    category_line = fill(
        K.CATEGORY_LINE, label=F.col(CATEGORY), amount=money("amount_abs"), share=percent("spend_share")
    )
    anomaly_line = fill(
        K.ANOMALY_LINE,
        date=F.date_format("transaction_date", "yyyy-MM-dd"),
        merchant=F.col(MERCHANT),
        amount=money("amount_abs"),
        reason=F.col("anomaly_reason"),
    )
    recurring_line = fill(
        K.RECURRING_LINE,
        merchant=F.col(MERCHANT),
        category=F.col(CATEGORY),
        amount=money("amount_abs"),
        count=count("transaction_count"),
    )
    by_count = (-F.col("transaction_count")).alias("b")
    return {
        "__top_categories": listing(
            slices.top_categories(filtered), [by_amount, F.col(CATEGORY)], category_line, K.NO_CATEGORIES
        ),
        "__largest_anomalies": listing(
            slices.largest_anomalies(filtered), [by_amount, F.col("transaction_id")], anomaly_line, K.NO_ANOMALIES
        ),
        "__recurring_merchants": listing(
            slices.recurring_merchants(filtered),
            [by_amount, by_count, F.col(MERCHANT), F.col(CATEGORY)],
            recurring_line,
            K.NO_RECURRING,
        ),
    }


RECORD_COLUMNS = [
    "selected_start",
    "selected_end",
    "selected_total_spend",
    "selected_credit_amount",
    "selected_transaction_count",
    "selected_debit_count",
    "selected_credit_count",
    "selected_avg_debit",
    "selected_recurring_spend",
    "selected_anomaly_spend",
    "selected_anomaly_count",
    "selected_anomaly_share",
    "selected_fallback_share",
    "latest_metric_date",
    "current_30d_total_spend",
    "current_30d_total_spend_delta",
    "current_30d_total_spend_delta_pct",
    "current_window_spend",
    "prior_window_spend",
    "current_window_recurring_spend",
    "current_window_anomaly_spend",
    "current_window_fallback_spend",
    "recent_category_label",
    "recent_category_text",
    "recent_category_delta",
    "recent_merchant_label",
    "recent_merchant_text",
    "recent_merchant_delta",
    "largest_decline_category_label",
    "largest_decline_category_text",
    "largest_decline_category_delta",
    "summary_card_1_title",
    "summary_card_1_value",
    "summary_card_1_subtitle",
    "summary_card_2_title",
    "summary_card_2_value",
    "summary_card_2_subtitle",
    "summary_card_3_title",
    "summary_card_3_value",
    "summary_card_3_subtitle",
]
