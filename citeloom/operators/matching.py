"""Similarity, scoring and decisions for matching references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the match score, floors and margin of a decision, padding and longest title compared.
SCORE = {"title": 0.62, "authors": 0.22, "year": 0.10, "venue": 0.06}
TITLE_FLOOR, TOTAL_FLOOR, ACCEPT, LEAD = 0.55, 0.45, 0.72, 0.06
PAD, LONGEST = "\u0000\u0000", 1024


def trigrams(key: Column) -> Column:
    """Character trigrams of a key between two sentinels at each end, each numbered among its equals so that sets act as multisets."""
    padded = F.concat(F.lit(PAD), key, F.lit(PAD))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))
    return F.when(F.length(key) > 0, grams).otherwise(F.expr("cast(array() as array<string>)"))


def shared(a: Column, b: Column) -> Column:
    """How many elements two multisets share."""
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, g: n + F.least(F.size(F.filter(a, lambda x: x == g)), F.size(F.filter(b, lambda x: x == g))))


def title_similarity(a: Column, b: Column) -> Column:
    """Dice coefficient of trigram multisets; 1 for equal keys, 0 for empty ones and for keys of over 1,024 characters."""
    ga, gb = trigrams(a), trigrams(b)
    dice = 2.0 * shared(ga, gb) / (F.size(ga) + F.size(gb))
    empty = (F.length(a) == 0) | (F.length(b) == 0)
    return F.when(empty, 0.0).when(a == b, 1.0).when((F.length(a) > LONGEST) | (F.length(b) > LONGEST), 0.0).otherwise(dice)


def year_agreement(a: Column, b: Column) -> Column:
    """1, .7, .3 or 0 for years 0, 1, 2 or more apart; null if one is unknown."""
    gap = F.abs(a - b)
    return F.when(gap == 0, 1.0).when(gap == 1, 0.7).when(gap == 2, 0.3).when(gap > 2, 0.0)


def year_compatible(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) <= 2, F.lit(True))


def family_overlap(a: Column, b: Column) -> Column:
    """F1 of two sets of family names; null if one is empty or null."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Mean of the known parts by weight; null if none is known."""
    value = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.when(weight > 0, value / weight)


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two bags of words; 0 without shared words."""
    n = shared(a, b)
    return F.when(n > 0, 2.0 * n / (F.size(a) + F.size(b))).otherwise(0.0)


def words_found(needle: Column, hay: Column) -> Column:
    """Share of the needle's distinct words that stand in hay; null with fewer than three words."""
    w = F.array_distinct(needle)
    return F.when(F.size(w) >= 3, F.size(F.array_intersect(w, hay)) / F.size(w))
