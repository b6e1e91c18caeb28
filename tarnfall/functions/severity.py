"""Severities and confidences from scores, words and levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnfall.model import lookup

#: Fixed values.
RULE_WORDS = {"CRITICAL": "critical", "ERROR": "high", "HIGH": "high", "WARNING": "medium", "MEDIUM": "medium", "INFO": "low", "LOW": "low"}
LEVELS = {"error": "high", "warning": "medium", "note": "low", "none": "info"}
LEADING_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def from_score(score: Column) -> Column:
    """Null for a null score."""
    place = (score > 0).cast("int") + (score >= 4).cast("int") + (score >= 7).cast("int") + (score >= 9).cast("int")
    return F.get(F.array(*map(F.lit, ("info", "low", "medium", "high", "critical"))), place)


def leading_number(text: Column) -> Column:
    """The number that a text begins with; null where it begins with none."""
    return F.nullif(F.regexp_extract(text, LEADING_NUMBER, 1), F.lit("")).try_cast("double")


def from_word(word: Column) -> Column:
    return lookup(F.upper(word), RULE_WORDS)


def from_level(level: Column) -> Column:
    return F.coalesce(lookup(F.lower(level), LEVELS), F.lit("medium"))


def normalize(is_secret: Column, live: Column, score: Column, word: Column, level: Column, number: Column | None = None) -> Column:
    """Secrets first, then a numeric score, the rule's word, the result's level; medium if there is nothing.

    number: the score's :func:`leading_number`, if it is a column already; it is compared several times.
    """
    number = leading_number(score) if number is None else number
    secret = F.when(is_secret, F.when(live, "critical").otherwise("high"))
    return F.coalesce(secret, from_score(number), from_word(word), from_level(level))


def confidence(precision: Column, is_secret: Column) -> Column:
    low = F.lower(precision)
    return F.when(is_secret | low.isin("very-high", "high"), "high").when(low == "low", "low").otherwise("medium")
