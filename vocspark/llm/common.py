"""Helpers shared by the operators: tables, stored intermediates, joins with hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocspark.sources.scratch import shared_folder

WORD = r"[^\x20\x09-\x0D]+"
HOT_SHARE = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and scan it: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_arrow(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    return df.mapInArrow(fn, schema)


def ascii_lower(column: str):
    """Lower-case A-Z only; null counts as empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.col(column), F.lit("")), upper, upper.lower())


def attach(rows: DataFrame, labels: DataFrame, key: str, count: str, hint: str | None = None) -> DataFrame:
    """Inner join of `rows` with one row per key of `labels`, safe for hot keys.

    `count` is the number of rows a key has. Keys with over a thousandth of all of them
    number at most `HOT_SHARE`, so their labels are broadcast; all other keys go through
    a shuffle in which none is large. Both inputs should be stored: each is read twice.
    `hint` names the join of these, where it is not left to Spark.
    """
    total = labels.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * HOT_SHARE > F.lit(total)
    hot, cold = labels.filter(is_hot), labels.filter(~is_hot)
    cold = cold.hint(hint) if hint else cold
    marked = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(marked.join(cold, key))
