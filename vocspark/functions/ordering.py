"""Top-k and numbering that stay spread over many tasks.

`orderBy(...).limit(n)` hands n rows of every input task to one last task, and
`row_number()` over an unpartitioned window sorts everything in one. The helpers
here reduce in two steps instead, so the last task only sees a bounded amount.
All of them are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocspark.sources.scratch import shared_folder

# monotonically_increasing_id() holds the partition above the row's place in it
_PARTITION_SHIFT = 33
_ROW_IN_PARTITION = (1 << _PARTITION_SHIFT) - 1


def review_order(col: str = "review_id") -> list[Column]:
    """Total order of reviews: numeric ids by value, then any other id as text."""
    return [F.col(col).try_cast("bigint").asc_nulls_last(), F.col(col).asc()]


def review_key(col: str = "review_id") -> Column:
    """One column that sorts like `review_order`."""
    number = F.col(col).try_cast("bigint")
    return F.struct(number.isNull().alias("text"), number.alias("number"), F.col(col).alias("id"))


def first_rows(df: DataFrame, n: int, order: Sequence[Column], spread: Sequence[str]) -> DataFrame:
    """The first n rows in `order`; `spread` names columns to distribute candidates by."""
    candidates = _first_of_each_partition(df, n, order)
    candidates = _first_of_each_partition(candidates.repartition(*spread), n, order)
    return candidates.orderBy(*order).limit(n)


def _first_of_each_partition(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    position = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_IN_PARTITION))
    return (
        df.sortWithinPartitions(*order)
        .withColumn("_position", position)
        .filter(F.col("_position") < n)
        .drop("_position")
    )


def first_wide_rows(df: DataFrame, n: int, order_key: Column, spread: Sequence[str]) -> DataFrame:
    """`first_rows` by one column, for many or wide rows: only the keys take part in the search.

    The n-th key is found from the keys alone; rows past it are then filtered out
    where they are read. Rows that tie with it are cut to exactly n in all.
    """
    keys = first_rows(
        df.select(order_key.alias("_key"), *spread), n, [F.asc("_key")], [*spread]
    )
    last = keys.agg(F.max("_key")).scalar()
    return first_rows(df.filter(order_key <= last), n, [order_key.asc()], spread)


def first_rows_per_group(
    df: DataFrame,
    n: int,
    by: Sequence[str],
    order: Sequence[Column],
    position: str,
    salts: int = 64,
) -> DataFrame:
    """The first n rows of every group, numbered from 1 in `position`.

    A hot group is cut down per salt before its rows meet in one task: the input
    task's number is the salt, so each task sends at most n rows per group, and the
    final task of a group receives at most n * salts rows.
    """
    salted = Window.partitionBy(*by, "_salt").orderBy(*order)
    whole = Window.partitionBy(*by).orderBy(*order)
    return (
        df.withColumn("_salt", F.spark_partition_id() % salts)
        .withColumn(position, F.row_number().over(salted))
        .filter(F.col(position) <= n)
        .drop("_salt")
        .withColumn(position, F.row_number().over(whole))
        .filter(F.col(position) <= n)
    )


def numbered(df: DataFrame, order: Sequence[Column], name: str, start: int = 1) -> DataFrame:
    """Number all rows in `order`, a total order, without sorting them in one task.

    Rows are dealt over range partitions and sorted there; a number is a row's place in its
    partition plus the rows of all earlier ones, of which only the counts, one per partition, come
    together. The bounds of the ranges are sampled, so the sorted rows are written to the shared folder
    first: every later reading sees the same partitions.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "numbered")
    seat = F.monotonically_increasing_id()
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_seat", seat).write.parquet(path)
    seated = spark.read.parquet(path).withColumn("_part", F.shiftright("_seat", _PARTITION_SHIFT))
    counts = seated.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_seat").bitwiseAND(F.lit(_ROW_IN_PARTITION)) + start
    # a row per partition, never more than `spark.sql.shuffle.partitions`
    return seated.join(F.broadcast(before), "_part").select(place.cast("int").alias(name), *df.columns)
