"""Vector similarity and match confidence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerspark import constants as K


def dot(left: Column, right: Column) -> Column:
    """Inner product over the shorter length."""
    products = F.zip_with(left, right, lambda a, b: F.coalesce(a.cast("double") * b.cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda total, product: total + product)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))


def cosine_similarity(left: Column, right: Column) -> Column:
    return cosine_prepared(left, norm(left), right, norm(right))


def cosine_prepared(left: Column, left_norm: Column, right: Column, right_norm: Column) -> Column:
    """Cosine with lengths computed beforehand; 0 where a vector is missing or has no length."""
    scale = F.nullif(left_norm * right_norm, F.lit(0.0))
    return F.coalesce(dot(left, right) / scale, F.lit(0.0))


def hybrid_score(semantic: Column, lexical: Column) -> Column:
    return semantic + lexical * K.LEXICAL_WEIGHT


def _known(*scores: Column) -> list[Column]:
    return [F.coalesce(score, F.lit(0.0)) for score in scores]


def confidence_label(rerank: Column, semantic: Column, lexical: Column) -> Column:
    scores = _known(rerank, semantic, lexical)

    def reaches(limits: tuple) -> Column:
        r, s, x = (score >= limit for score, limit in zip(scores, limits, strict=True))
        return r | s | x

    return F.when(reaches(K.HIGH_CONFIDENCE), "high").when(reaches(K.MEDIUM_CONFIDENCE), "medium").otherwise("low")


def is_confident(rerank: Column, semantic: Column, lexical: Column) -> Column:
    r, s, x = _known(rerank, semantic, lexical)
    words, meaning = K.GATE_LEXICAL_SEMANTIC
    more_words, order = K.GATE_LEXICAL_RERANK
    together = ((x >= words) & (s >= meaning)) | ((x >= more_words) & (r >= order))
    return (r >= K.GATE_RERANK) | (s >= K.GATE_SEMANTIC) | together
