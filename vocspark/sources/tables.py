"""Named tables: write with replacement, append, scan, drop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from vocspark.config import Layout

FILE_FORMATS = ("parquet", "orc", "json", "csv")  # plain files: an overwrite deletes before it writes
STAGED, BEFORE = "__staged", "__before"


def create_schemas(spark: SparkSession, layout: Layout) -> None:
    """Create the layers' schemas, below `layout.location` where that is set."""
    for name in dict.fromkeys((layout.bronze, layout.silver, layout.gold)):
        place = f" LOCATION '{layout.location.rstrip('/')}/{name}'" if layout.location else ""
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}{place}")


def write_table(
    df: DataFrame,
    name: str,
    layout: Layout = Layout(),
    mode: str = "overwrite",
    bucket_by: str | None = None,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Save as a table, replacing rows and schema, and return a scan of it.

    A replacement is written beside the old table and takes its name only when it is whole, so a
    write that fails leaves the old table as it was, and a table may be replaced by rows read from
    itself. Formats outside `FILE_FORMATS` replace their tables in one step of their own; partitioned tables
    are written in place.

    With `layout.buckets` set, `bucket_by` stores the rows hashed and sorted on that
    column, so joins between tables bucketed alike need no shuffle. The rows are
    hashed the same way first, which gives one file per bucket.
    """
    bucketed = bucket_by is not None and layout.buckets is not None
    if bucketed:
        df = df.repartition(layout.buckets, bucket_by)
    writer = df.write.format(layout.fmt).mode(mode).options(**layout.options)
    if bucketed:
        writer = writer.bucketBy(layout.buckets, bucket_by).sortBy(bucket_by)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    spark = df.sparkSession
    if mode != "overwrite" or partition_by or layout.fmt not in FILE_FORMATS:
        writer.saveAsTable(name)
        return spark.table(name)
    staged, before = f"{name}{STAGED}", f"{name}{BEFORE}"
    restore(spark, name)
    drop_tables(spark, staged)
    writer.saveAsTable(staged)
    if spark.catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {name} RENAME TO {before}")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {name}")
    spark.catalog.refreshTable(name)  # the session may remember the old table's files
    drop_tables(spark, before)
    return spark.table(name)


def restore(spark: SparkSession, name: str) -> None:
    """Finish or undo a replacement that was cut off between its two renames."""
    before = f"{name}{BEFORE}"
    if not spark.catalog.tableExists(before):
        return
    if spark.catalog.tableExists(name):
        drop_tables(spark, before)
    else:
        spark.sql(f"ALTER TABLE {before} RENAME TO {name}")
        spark.catalog.refreshTable(name)


def drop_tables(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def spread(df: DataFrame, scan: DataFrame, per_split: int = 16) -> DataFrame:
    """Repartition `df` when the scan it starts from would leave cores idle.

    For costly per-row work on few or unsplittable files. Spark cuts small files into
    about one split per core even where a file's only row group falls into one of
    them, so enough work is a file per core or, for large files, two splits per core.
    Such inputs are left as they are: nothing large is shuffled for this.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, scan.rdd.getNumPartitions()
    if splits >= 2 * cores or (len(scan.inputFiles()) or splits) >= cores:
        return df
    return df.repartition(min(cores, max(splits, 1) * per_split))
