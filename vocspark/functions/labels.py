"""Expressions over model responses, labels and percentages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocspark import config


def json_field(col: str, name: str) -> Column:
    """One top-level field of a JSON text; NULL when the text is not JSON."""
    return F.get_json_object(F.col(col), f"$.{name}")


def canonical(col: Column) -> Column:
    return F.lower(F.trim(col))


def sentiment_label(
    col: Column, rules: Sequence[tuple[str, str]] = config.SENTIMENT_RULES
) -> Column:
    """First rule whose substring occurs decides; nothing matching, or NULL, is undefined."""
    return _first_match([(col.contains(part), name) for part, name in rules], config.UNDEFINED)


def is_sentiment(name: str, col: str = "sentimento") -> Column:
    return F.col(col) == name


def percentage(part: Column, whole: Column, digits: int = 1) -> Column:
    """part / whole in percent, 0 for an empty whole."""
    return F.when(whole > 0, F.round(part / whole * 100, digits)).otherwise(F.lit(0.0))


def band(
    col: Column,
    bands: Sequence[tuple[float, str]] = config.CRITICALITY_BANDS,
    default: str = config.CRITICALITY_DEFAULT,
) -> Column:
    """Name of the highest band whose inclusive lower bound is reached."""
    return _first_match([(col >= bound, name) for bound, name in bands], default)


def _first_match(cases: Sequence[tuple[Column, str]], default: str) -> Column:
    (condition, name), *others = cases
    chain = F.when(condition, name)
    for condition, name in others:
        chain = chain.when(condition, name)
    return chain.otherwise(default)
