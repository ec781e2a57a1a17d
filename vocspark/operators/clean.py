"""Raw reviews -> typed reviews with one text column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark import config
from vocspark.functions.ordering import first_wide_rows, review_key
from vocspark.functions.text import full_text, has_text


def rename(df: DataFrame, names: Mapping[str, str] = config.RENAMES) -> DataFrame:
    """Apply a rename map; names the frame lacks are ignored."""
    return df.withColumnsRenamed(dict(names))


def cast_ints(df: DataFrame, columns: Sequence[str] = config.INT_COLUMNS) -> DataFrame:
    """Cast to int; text that is no integer becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast("int") for c in columns})


def drop_blank(df: DataFrame, col: str = "review_text") -> DataFrame:
    return df.filter(has_text(col))


def add_full_text(df: DataFrame, skip_empty_title: bool = False) -> DataFrame:
    text = full_text("title", "review_text", skip_empty_title)
    return df.withColumn("texto_completo", text)


def clean_reviews(df: DataFrame, skip_empty_title: bool = False) -> DataFrame:
    return add_full_text(drop_blank(cast_ints(rename(df))), skip_empty_title)


def bounded_sample(
    df: DataFrame, n: int | None = None, partitions: int | None = None
) -> DataFrame:
    """The n reviews with the lowest ids; all of them for None.

    The sample leaves the top-k step in one partition; `partitions` spreads it again
    before per-row model calls.
    """
    if n is None:
        return df
    sample = first_wide_rows(df, n, review_key(), spread=["review_id"])
    return sample.repartition(partitions, "review_id") if partitions else sample
