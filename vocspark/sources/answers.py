"""Answers of a model, kept by what was asked, so that a run can stop at any point and go on later.

A request is the hash of a text and of the model's version. Its answer is appended to a journal
table, slice by slice; whatever was committed is never asked again. Result tables are put together from the
rows as they are now: a changed text is another request, a row that is gone has no result, and texts
that occur many times are asked once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspark.config import Layout
from vocspark.sources.tables import drop_tables, spread, write_table

SLICES = 16


def request_key(text: str, version: str = "") -> Column:
    """Hash of the model's version and the text; a missing text differs from an empty one."""
    framed = F.coalesce(F.concat(F.lit("+"), F.col(text)), F.lit("-"))
    return F.sha2(F.concat(F.lit(f"{version}\x1f"), framed), 256)


def journal_answers(journal: str, like: DataFrame) -> DataFrame:
    """One row per request of the journal; rows that a cut-off commit left twice count once."""
    return like.sparkSession.table(journal).dropDuplicates(["request"])


def start_journal(
    table: DataFrame, out: str, journal: str, layout: Layout = Layout(), version: str = "",
    text: str = "texto_completo",
) -> None:
    """Take the answers of a result table that was made without a journal, by the same version of the model."""
    known = table.select(request_key(text, version).alias("request"), out).dropDuplicates(["request"])
    write_table(known, journal, layout)


def ask_missing(
    source: DataFrame,
    job: Callable[[DataFrame], DataFrame],
    out: str,
    journal: str,
    layout: Layout = Layout(),
    version: str = "",
    text: str = "texto_completo",
    slices: int = SLICES,
) -> None:
    """Run `job` on the texts of `source` whose answers the journal lacks.

    `job` adds the column `out` to a frame that holds `text` and nothing else it may read. The missing
    requests are written down first, in `slices` parts by their hash; each part is one append to
    the journal. If the job dies, the next call asks only for the parts that were not committed.
    """
    spark = source.sparkSession
    wanted = source.select(request_key(text, version).alias("request"), text).dropDuplicates(["request"])
    if spark.catalog.tableExists(journal):
        wanted = wanted.join(spark.table(journal).select("request"), "request", "left_anti")
    pending = f"{journal}_pending"
    part = F.pmod(F.xxhash64("request"), F.lit(slices)).cast("int")
    todo = write_table(wanted.withColumn("slice", part), pending, layout, partition_by=["slice"])
    for row in todo.select("slice").distinct().orderBy("slice").collect():  # at most `slices` rows
        rows = spark.table(pending).filter(F.col("slice") == row.slice).select("request", text)
        answered = job(spread(rows, rows)).select("request", out)
        write_table(answered, journal, layout, mode="append")
    drop_tables(spark, pending)


def with_answers(
    source: DataFrame,
    job: Callable[[DataFrame], DataFrame],
    out: str,
    journal: str,
    layout: Layout = Layout(),
    version: str = "",
    text: str = "texto_completo",
    slices: int = SLICES,
) -> DataFrame:
    """`source` with the model's answers in `out`, asking only for those the journal lacks.

    A text that many rows share makes a hot key of the join; its side is split at run time (AQE),
    and the journal has one row for it.
    """
    spark = source.sparkSession
    ask_missing(source, job, out, journal, layout, version, text, slices)
    asked = source.withColumn("request", request_key(text, version))
    if not spark.catalog.tableExists(journal):  # nothing was ever asked: no rows, but the job's column
        return job(source.limit(0))
    return asked.join(journal_answers(journal, source), "request").select(*source.columns, out)


def forget_unused(source: DataFrame, journal: str, layout: Layout = Layout(), version: str = "",
                  text: str = "texto_completo") -> DataFrame:
    """Keep only the answers that the rows of `source` still use."""
    used = source.select(request_key(text, version).alias("request")).distinct()
    return write_table(journal_answers(journal, source).join(used, "request", "left_semi"), journal, layout)
