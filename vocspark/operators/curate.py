"""Enriched reviews -> the classified table analyses start from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark import config


def classified_reviews(
    enriched: DataFrame,
    enforce_domain: bool = False,
    topics: Sequence[str] = config.TOPICS,
) -> DataFrame:
    """Business columns of the reviews that got a topic and a sentiment.

    Topics outside the closed list stay in (the quality checks report them) unless
    `enforce_domain` is set. The embedding is left behind on purpose.
    """
    kept = F.col("assunto").isNotNull() & (F.col("sentimento") != config.UNDEFINED)
    if enforce_domain:
        kept = kept & F.col("assunto").isin(*topics)
    return enriched.filter(kept).select(*config.CLASSIFIED_COLUMNS)
