"""Text expressions: cleaning, tokens, lexical scoring, labelled sentences, replies, display formats."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, functions as F
from pyspark.sql.types import StructType

from ledgerspark import constants as K

WHITESPACE = " \t\n\r\x0b\x0c"
DASH = "—"


def clean_text(text: Column) -> Column:
    return F.upper(F.trim(text))


def strip(text: Column) -> Column:
    """Remove surrounding white space of any kind, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def or_default(text: Column, default: str) -> Column:
    """The text, or a default where it is missing or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


# --- tokens and lexical score ---------------------------------------------------------------------------


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def synonym_map(synonyms: dict[str, list[str]] | None = None) -> Column:
    entries = []
    for word, others in (synonyms or K.SYNONYMS).items():
        entries += [F.lit(word), F.array(*[F.lit(other) for other in others])]
    return F.create_map(*entries)


def expanded_terms(query: Column, synonyms: Column | None = None) -> Column:
    """Sorted search terms of a query.

    Its tokens without stop words and single characters, the synonyms of the whole query, and then the
    synonyms of each term found so far.
    """
    lookup = synonym_map() if synonyms is None else synonyms
    nothing = F.array().cast("array<string>")
    cleaned = F.lower(strip(query))
    words = F.filter(tokenize(cleaned), lambda t: (F.length(t) >= 2) & ~t.isin(K.STOPWORDS))
    seeds = F.array_union(words, F.coalesce(F.try_element_at(lookup, cleaned), nothing))
    related = F.flatten(F.transform(seeds, lambda t: F.coalesce(F.try_element_at(lookup, t), nothing)))
    return F.array_sort(F.array_union(seeds, related))


def lexical_score(query: Column, terms: Column, document: Column) -> Column:
    """Score of one document for one query: 3 where the text holds the whole query, 1 per term that is a token,
    half for a term that is only part of one, 1.5 for a phrase."""
    cleaned, lowered = F.lower(strip(query)), F.lower(F.coalesce(document, F.lit("")))
    tokens = tokenize(document)

    def inside(term: Column, score: float) -> Column:
        return F.when(F.contains(lowered, term), score).otherwise(0.0)

    words = F.filter(terms, lambda t: ~F.contains(t, F.lit(" ")))
    phrases = F.filter(terms, lambda t: F.contains(t, F.lit(" ")))
    hits = F.size(F.array_intersect(words, tokens)) * F.lit(K.TOKEN_SCORE)
    asked = (F.length(cleaned) > 0) & F.contains(lowered, cleaned)
    whole = F.when(asked, K.WHOLE_QUERY_SCORE).otherwise(0.0)
    parts = F.aggregate(F.array_except(words, tokens), hits, lambda total, t: total + inside(t, K.PART_SCORE))
    return F.aggregate(phrases, whole + parts, lambda total, t: total + inside(t, K.PHRASE_SCORE))


# --- display formats ---------------------------------------------------------------------------------------


def money_text(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(value, 2)), F.lit("$0.00"))


def signed_money_text(value: Column) -> Column:
    digits = F.format_number(F.abs(value), 2)
    return (
        F.when(value < 0, F.concat(F.lit("-$"), digits))
        .when(value > 0, F.concat(F.lit("+$"), digits))
        .otherwise("$0.00")
    )


def percent_text(value: Column) -> Column:
    digits = F.replace(F.format_number(value.cast("double") * 100, 1), F.lit(","), F.lit(""))
    return F.coalesce(F.concat(digits, F.lit("%")), F.lit(DASH))


def count_text(value: Column) -> Column:
    return F.format_number(value, 0)


def date_text(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "MMM d, yyyy"), F.lit(DASH))


def unit_format(value: Column, unit: Column) -> Column:
    """A metric value in its unit; a missing value is a dash. A date is given as the number of its day since 1970."""
    text = (
        F.when(unit == "currency", money_text(value))
        .when(unit == "signed_currency", signed_money_text(value))
        .when(unit == "date", date_text(F.date_from_unix_date(F.when(unit == "date", value).cast("int"))))
        .when(unit == "percent", percent_text(value))
        .when(unit == "count", count_text(value))
        .otherwise(F.format_number(value, 2))
    )
    return F.when(value.isNull() | F.isnan(value.cast("double")), F.lit(DASH)).otherwise(text)


# --- labelled sentences --------------------------------------------------------------------------------------


def fill(template: str, **columns: Column) -> Column:
    """A text with the named columns in the places of their names; NULL where one of them is NULL."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            parts.append(columns[name])
    return F.concat(*parts)


def profile_text(summary: Column, tags: Column) -> Column:
    listed = F.array_join(F.coalesce(tags, F.array().cast("array<string>")), ", ")
    return fill(K.PROFILE_SENTENCE, summary=F.coalesce(summary, F.lit("")), tags=listed)


def search_text() -> Column:
    """One labelled sentence per transaction, built from the fact's columns."""
    signals = F.concat_ws(", ", F.when(F.col("is_recurring"), "recurring"), F.when(F.col("is_anomaly"), "anomaly"))
    category = F.coalesce(F.nullif(F.col("final_category"), F.lit("")), F.col("raw_category"))
    direction = F.when(F.coalesce("is_debit", F.lit(False)), " debit").otherwise(" credit")
    unknown = "Unknown"
    return fill(
        K.SEARCH_SENTENCE,
        merchant=or_default(F.col("normalized_merchant"), unknown),
        group=or_default(F.col("merchant_group"), unknown),
        category=or_default(category, unknown),
        raw_description=F.coalesce("raw_description", F.lit("")),
        type=or_default(F.col("transaction_type"), unknown),
        amount=F.concat(money_text(F.col("amount_abs")), direction),
        date=F.coalesce(F.date_format("transaction_date", "yyyy-MM-dd"), F.lit(unknown)),
        signals=or_default(signals, "standard"),
        source=or_default(F.col("merchant_source"), unknown),
    )


# --- keys and replies ----------------------------------------------------------------------------------------


def content_key(**fields: Column) -> Column:
    """Digest of named values, independent of the order in which they are given."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.sha2(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}), 256)


def json_slice(reply: Column) -> Column:
    """The text from the first opening to the last closing brace, or NULL."""
    return F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))


def extract_json_object(reply: Column, schema: StructType) -> Column:
    """Parse the object inside a free-text reply. ``_malformed`` is set where the text is not valid JSON."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"}
    return F.from_json(json_slice(reply), schema, options)


def normalise_tags(tags: Column, category: Column) -> Column:
    """Known tags in first-seen order, at most six; a default by category where none is left."""
    nothing = F.array().cast("array<string>")
    cleaned = F.transform(F.coalesce(tags, nothing), lambda t: F.lower(strip(t)))
    known = F.slice(F.array_distinct(F.filter(cleaned, lambda t: t.isin(K.ALLOWED_TAGS))), 1, K.MAX_TAGS)
    default = F.when(category == "Shopping", F.array(F.lit("shopping"))).otherwise(F.array(F.lit("entertainment")))
    return F.when(F.size(known) > 0, known).otherwise(default)
