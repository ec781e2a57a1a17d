"""Checks of the data, each one pass and one small result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark import config
from vocspark.functions.text import has_text


class CountMismatch(AssertionError):
    """Source and table hold different numbers of rows."""


def reconcile_counts(records: DataFrame, table: DataFrame, written: int | None = None) -> DataFrame:
    """One row: records of the source files, rows written, rows of the table, and whether all agree.

    `records` is a one-row frame with the number of records, counted without the reader that loaded
    the table (`reviews_csv.record_count`): a reader that loses rows does not agree with itself here. `written` is
    what the write observed, by default the rows of the table.
    """
    rows = table.agg(F.count(F.lit(1)).alias("table_rows"))
    counted = rows.select(
        records.scalar().alias("source_rows"),
        (F.col("table_rows") if written is None else F.lit(written).cast("bigint")).alias("written_rows"),
        "table_rows",
    )
    same = (F.col("source_rows") == F.col("written_rows")) & (F.col("written_rows") == F.col("table_rows"))
    return counted.withColumn("passed", same)


def require_equal_counts(records: DataFrame, table: DataFrame, written: int | None = None) -> int:
    """Number of rows; raises CountMismatch when any of the counts differ."""
    row = reconcile_counts(records, table, written).first()
    if not row.passed:
        raise CountMismatch(
            f"source has {row.source_rows} records, {row.written_rows} rows were written, "
            f"table has {row.table_rows}")
    return row.table_rows


def text_completeness(df: DataFrame, col: str = "review_text") -> DataFrame:
    """Rows with and without text. Spaces count as text here, unlike in the blank filter."""
    present = F.col(col).isNotNull() & (F.col(col) != "")
    return df.agg(
        F.count_if(present).alias("with_text"),
        F.count_if(~present).alias("without_text"),
        F.count("*").alias("total"),
    )


def removed_rows(df: DataFrame, col: str = "review_text") -> DataFrame:
    """How many rows the blank filter removes and keeps."""
    kept = has_text(col)
    return df.agg(F.count_if(~kept).alias("removed"), F.count_if(kept).alias("kept"))


def embedding_profile(df: DataFrame, col: str = "embedding") -> DataFrame:
    size = F.when(F.col(col).isNotNull(), F.size(col))
    return df.agg(
        F.min(size).alias("min_dim"),
        F.max(size).alias("max_dim"),
        F.count(col).alias("with_embedding"),
        F.count("*").alias("total"),
    )


def off_domain_topics(enriched: DataFrame, topics: Sequence[str] = config.TOPICS) -> DataFrame:
    """Topics outside the closed list with their counts; reviews without topic are not listed."""
    outside = enriched.filter(~F.col("assunto").isin(*topics))
    return outside.groupBy("assunto").agg(F.count("*").alias("count"))


def unclassified_counts(enriched: DataFrame) -> DataFrame:
    return enriched.agg(
        F.count_if(F.col("sentimento") == config.UNDEFINED).alias("indefinidos"),
        F.count_if(F.col("assunto").isNull()).alias("sem_assunto"),
    )


def sentiment_coherence(enriched: DataFrame) -> DataFrame:
    """Mean rating per sentiment; coherent when it rises from negative to positive."""
    means = enriched.agg(
        *(
            F.round(F.avg(F.when(F.col("sentimento") == s, F.col("rating"))), 2).alias(s)
            for s in config.SENTIMENTS
        )
    )
    rises = (F.col("negativo") < F.col("neutro")) & (F.col("neutro") < F.col("positivo"))
    return means.withColumn("coherent", F.coalesce(rises, F.lit(False)))


def share_totals(shares: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """Sum of the rounded shares per topic, which must be 100 but for rounding."""
    totals = shares.groupBy("assunto").agg(F.round(F.sum("pct"), 1).alias("total_pct"))
    off = F.round(F.abs(F.col("total_pct") - 100), 1)
    return totals.withColumn("ok", off <= tolerance)
