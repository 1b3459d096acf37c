"""Merchant resolution: governed rules first, then confident enrichments, then the raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerspark import constants as K
from ledgerspark.functions.rules import accepted, provenance_flags
from ledgerspark.operators.joins import null_safe_left_join

RULE_FIELDS = ["pattern", "normalized_merchant", "merchant_group", "default_category"]

# Letters of a rule that its candidates are joined by; what the join finds is verified by the whole rule.
PIECE = 4


def _ranked() -> Column:
    """Rule as a struct that sorts by preference: longest pattern first, then by pattern."""
    return F.struct((-F.length("pattern")).alias("preference"), *RULE_FIELDS, "match_text")


def _pieces(text: Column) -> Column:
    """All substrings a rule could start with: one per position and length up to ``PIECE``, and the empty one."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))

    def sized(size: int) -> Column:
        return F.transform(places, lambda place: F.substring(text, place, size))

    return F.array_distinct(F.concat(F.array(F.lit("")), *[sized(size) for size in range(1, PIECE + 1)]))


def _piece_matches(txn: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct descriptions with every rule found in them, from an equi-join on the rule's first letters.

    One path for rule tables of any size: Catalyst broadcasts the rules while they are small, and AQE splits a
    piece that is hot.
    """
    texts = txn.select("clean_description").filter(F.col("clean_description").isNotNull()).distinct()
    probes = texts.select("clean_description", F.explode(_pieces(F.col("clean_description"))).alias("__piece"))
    keyed = rules.select(_ranked().alias("__rule"), F.substring("match_text", 1, PIECE).alias("__piece"))
    found = probes.join(keyed, on="__piece")
    return found.filter(F.contains("clean_description", F.col("__rule.match_text"))).drop("__piece")


def rule_match(txn: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule whose text occurs in a transaction's description; unmatched transactions stay, once."""
    found = _piece_matches(txn, rules)
    matched = null_safe_left_join(txn.select("transaction_id", "clean_description"), found, ["clean_description"])
    return matched.select("transaction_id", *[F.col(f"__rule.{name}").alias(name) for name in RULE_FIELDS])


def best_match(matched: DataFrame) -> DataFrame:
    """Per transaction the rule with the longest pattern, ties by pattern; an aggregate, so it combines early."""
    order = F.struct(
        F.isnull("pattern").alias("unmatched"), (-F.length("pattern")).alias("preference"), *RULE_FIELDS
    )
    best = matched.groupBy("transaction_id").agg(F.min(order).alias("__rule"))
    return best.select("transaction_id", *[F.col(f"__rule.{name}").alias(name) for name in RULE_FIELDS])


def with_best_rule(txn: DataFrame, rules: DataFrame) -> DataFrame:
    """``rule_match`` and ``best_match`` in one step: a struct column ``__rule`` on every transaction.

    Rules are matched to distinct descriptions. The join back may split a description with many transactions.
    """
    best = _piece_matches(txn, rules).groupBy("clean_description").agg(F.min("__rule").alias("__rule"))
    return null_safe_left_join(txn, best, ["clean_description"]).select(*txn.columns, "__rule")


def resolve_precedence(matched: DataFrame) -> DataFrame:
    """Merchant, group and categories from rule, confident enrichment or raw text, with their provenance.

    Expects the struct columns ``__rule`` and ``__enrichment`` (either may be NULL).
    """
    rule, enrichment = F.col("__rule"), F.col("__enrichment")
    confidence = enrichment["confidence"]

    def suggested(field: str) -> Column:
        return accepted(confidence, enrichment[field])

    flags = provenance_flags(
        rule["normalized_merchant"], rule["default_category"], confidence, enrichment["suggested_category"]
    )
    return matched.withColumns(
        {
            "normalized_merchant": F.coalesce(
                rule["normalized_merchant"], suggested("suggested_merchant"), F.col("raw_description")
            ),
            "merchant_group": F.coalesce(
                rule["merchant_group"], suggested("suggested_merchant_group"), F.lit(K.UNMAPPED_GROUP)
            ),
            "rule_category": rule["default_category"],
            "ai_category": suggested("suggested_category"),
            "ai_confidence": confidence,
            "ai_reasoning": enrichment["reasoning"],
            **flags,
        }
    ).drop("__rule", "__enrichment")


def _suggestions(enrichments: DataFrame) -> DataFrame:
    fields = ["suggested_merchant", "suggested_category", "suggested_merchant_group", "confidence", "reasoning"]
    return enrichments.select("raw_description", F.struct(*fields).alias("__enrichment"))


def known_descriptions(descriptions: DataFrame, rules: DataFrame, enrichments: DataFrame) -> DataFrame:
    """The descriptions that a rule or an enrichment knows, with both as ``with_best_rule`` and the cache give them.

    ``descriptions`` are those of ``stage_descriptions``. Stored, the result tells Catalyst its size: a small one is
    broadcast, and no transaction is moved to be resolved.
    """
    found = with_best_rule(descriptions, rules).join(_suggestions(enrichments), on="raw_description", how="left")
    return found.filter("__rule is not null or __enrichment is not null").drop("clean_description")


def normalize_merchants(
    txn: DataFrame, rules: DataFrame, enrichments: DataFrame, known: DataFrame | None = None
) -> DataFrame:
    """Transactions with all resolution columns, so that no later join by transaction is needed. ``known`` is a stored
    ``known_descriptions`` of at least the descriptions of ``txn``."""
    if known is None:
        matched = with_best_rule(txn, rules).join(_suggestions(enrichments), on="raw_description", how="left")
    else:
        matched = txn.join(known, on="raw_description", how="left")
    return resolve_precedence(matched.select(*txn.columns, "__rule", "__enrichment"))


def merchant_normalization(txn: DataFrame, rules: DataFrame, enrichments: DataFrame) -> DataFrame:
    return normalize_merchants(txn, rules, enrichments).select(
        "transaction_id",
        "normalized_merchant",
        "merchant_group",
        "rule_category",
        "ai_category",
        "ai_confidence",
        "ai_reasoning",
        "merchant_source",
        "category_source",
    )
