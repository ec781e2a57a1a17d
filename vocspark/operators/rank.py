"""Rankings, worst topics, drill-downs and per-topic samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocspark import config
from vocspark.functions.labels import is_sentiment
from vocspark.functions.ordering import (
    first_rows,
    first_rows_per_group,
    numbered,
    review_order,
)
from vocspark.operators.aggregate import negatives_by_topic

DRILLDOWN_COLUMNS = ("review_id", "texto_completo", "rating", "age", "department_name")
PREVIEW_COLUMNS = (
    "review_id", "texto_completo", "assunto", "sentimento", "rating", "department_name",
)


def top(df: DataFrame, n: int, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """The first n rows of an aggregate with their place; only those n rows are numbered."""
    place = F.row_number().over(Window.orderBy(*order)).cast("int")
    return df.orderBy(*order).limit(n).select(place.alias(rank), *df.columns)


def ranked(df: DataFrame, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """All rows of a small aggregate, one per label, with their place."""
    place = F.row_number().over(Window.orderBy(*order)).cast("int")
    return df.select(place.alias(rank), *df.columns)


def critical_topics(gold: DataFrame, n: int = config.TOP_TOPICS) -> DataFrame:
    """The n topics with most negative reviews."""
    return top(negatives_by_topic(gold), n, [F.desc("qtd_negativos"), F.asc("assunto")])


def topic_catalog(gold: DataFrame) -> DataFrame:
    """Every topic with its position in alphabetical order, from 0."""
    topics = gold.select("assunto").distinct()
    return numbered(topics, [F.asc("assunto")], "ordinal", start=0).select("assunto", "ordinal")


def in_order(df: DataFrame, *keys: str, rank: str = "rank") -> DataFrame:
    """A stored aggregate as it is read: rows numbered by `keys` ascending, missing values first.

    Order is no property of a table, so it is a column. Keys have no bound on their number.
    """
    return numbered(df, [F.col(k).asc_nulls_first() for k in keys], rank)


def pain_ranking(summary: DataFrame) -> DataFrame:
    """Topics by share of negative reviews, flagged when above the median topic.

    Shares carry one decimal, so there are at most 1,001 of them: the median keeps
    a count per share.
    """
    median = summary.agg(F.median("pct_negativo")).scalar()
    flagged = summary.select(
        "assunto", "pct_negativo", (F.col("pct_negativo") > median).alias("above_median")
    )
    return numbered(flagged, worst_first(), "rank")


def worst_first() -> list[Column]:
    """Order of a topic summary: highest share of negative reviews first."""
    return [F.desc("pct_negativo"), F.asc("assunto")]


def worst_topic_by_count(gold: DataFrame) -> DataFrame:
    """One row: the topic with most negative reviews (NULL without any)."""
    order = F.struct(-F.col("qtd_negativos"), F.col("assunto"))
    return negatives_by_topic(gold).agg(F.min_by("assunto", order).alias("assunto"))


def worst_topic_by_pct(summary: DataFrame) -> DataFrame:
    """One row: the topic with the highest share of negative reviews."""
    order = F.struct(-F.col("pct_negativo"), F.col("assunto"))
    return summary.agg(F.min_by("assunto", order).alias("assunto"))


def drilldown(
    gold: DataFrame,
    topic: str | DataFrame,
    sentiment: str = config.NEGATIVE,
    n: int = 10,
    columns: Sequence[str] = DRILLDOWN_COLUMNS,
) -> DataFrame:
    """The first n reviews of a topic and sentiment.

    `topic` may be a one-row frame: it is then evaluated inside the same query, and
    its value still reaches the file scan as a pushed filter.
    """
    wanted = topic.scalar() if isinstance(topic, DataFrame) else F.lit(topic)
    hits = gold.filter((F.col("assunto") == wanted) & is_sentiment(sentiment)).select(*columns)
    return first_rows(hits, n, review_order(), spread=["review_id"])


def preview(
    gold: DataFrame, n: int = 10, columns: Sequence[str] = PREVIEW_COLUMNS
) -> DataFrame:
    return first_rows(gold.select(*columns), n, review_order(), spread=["review_id"])


def critical_negatives(gold: DataFrame, topics: int = config.TOP_TOPICS) -> DataFrame:
    """All negative reviews of the most critical topics, each with its topic's number of them."""
    critical = critical_topics(gold, topics).select("assunto", "qtd_negativos")
    negatives = gold.filter(is_sentiment(config.NEGATIVE)).select(
        "assunto", "review_id", "texto_completo"
    )
    # `critical` has at most `topics` rows, whatever the size of the data.
    return negatives.join(F.broadcast(critical), "assunto")


def review_samples(negatives: DataFrame, k: int = config.REVIEWS_PER_SUMMARY) -> DataFrame:
    """The first k reviews of each topic: what fits into a model's prompt."""
    return first_rows_per_group(negatives, k, ["assunto"], review_order(), "pos")


def topic_review_samples(
    gold: DataFrame,
    topics: int = config.TOP_TOPICS,
    k: int = config.REVIEWS_PER_SUMMARY,
) -> DataFrame:
    """Up to k negative reviews for each of the most critical topics, in one query."""
    return review_samples(critical_negatives(gold, topics), k)
