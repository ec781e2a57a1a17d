"""Mixing sources to target weights along a curriculum that changes over training.

A source's weight moves linearly from its own `start` to its own `end` times its share while
training runs from 0 to 1, so the sources' shares of the stream change; the integral of that schedule, scaled to the source's target, is its cumulative
token demand. Documents of a source stand on its token axis in a hashed order, each pass
over the source following the one before. A copy whose middle lies below the target is
taken, and the inverse of the demand at that middle is its training position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocspark.llm.common import WORD

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
REPEATS = 2
START, END = 1.5, 0.5
BUCKET_ROWS = 1 << 14
SCHEDULES = ((START, END), (END, START), (1.0, 1.0))  # by source rank, as the weights


def word_count(column: str):
    return F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(
    sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS,
    schedules=SCHEDULES,
) -> DataFrame:
    """Targets by water-filling: budget shared by weight, none above `repeats` times its size.

    `sizes` has one row per source (source, source_size). With sources by growing
    cap / weight, the level is the first at which the uncapped rest shares what the capped
    leave. Sources are the only rows of these two windows. `start` and `end` are the
    source's factors at both ends of training.
    """
    if any(min(s) < 0 or sum(s) <= 0 for s in schedules):
        raise ValueError("a schedule's factors are 0 or more, one of them above 0")
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rank = F.row_number().over(order) - 1
    ranked = sizes.withColumns({
        "weight": F.element_at(F.array(*map(F.lit, weights)), rank % len(weights) + 1),
        "cap": F.col("source_size") * F.lit(repeats),
        **{
            name: F.element_at(
                F.array(*[F.lit(float(s[at])) for s in schedules]), rank % len(schedules) + 1)
            for at, name in enumerate(("start", "end"))}})
    by_cap = Window.orderBy(
        F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(0, Window.unboundedFollowing)
    level = (
        F.lit(budget) * F.sum("source_size").over(Window.partitionBy(F.lit(1)))
        - F.coalesce(F.sum("cap").over(before), F.lit(0))
    ) / F.sum("weight").over(rest)
    # once one source stays below its cap, that level holds for all after it
    levelled = ranked.withColumn("level", level).withColumn(
        "open", F.col("level") * F.col("weight") < F.col("cap"))
    first_open = F.first(F.when(F.col("open"), F.col("level")), True).over(
        by_cap.rowsBetween(Window.unboundedPreceding, 0))
    return levelled.select(
        "source", "source_size", "weight", "start", "end",
        F.coalesce(first_open * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def position(middle, target, start=START, end=END):
    """Training time in [0, 1] at which the demand of a source reaches `middle` tokens."""
    start, end = (x if isinstance(x, Column) else F.lit(float(x)) for x in (start, end))
    area = (middle / target) * (start + end)
    root = F.sqrt(F.greatest(start * start + (end - start) * area, F.lit(0.0)))
    return F.least(F.coalesce(F.try_divide(area, start + root), F.lit(0.0)), F.lit(1.0))


def place_hash() -> Column:
    """What documents of a source are ordered by: the doc_id, salted with the text for null and repeated ids."""
    text = F.md5(F.coalesce(F.col("text"), F.lit("")))
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))


def mix(
    docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, schedules=SCHEDULES,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Every document with its source's target, the words taken and its training positions.

    Returns `row` (the input row as a struct, or its columns `keep`: what is left out here crosses no
    shuffle), size, source_size, target, taken and
    `positions` (one per copy taken, ascending; empty if the mix leaves the document out).
    A null source is a source of its own, after all others. Null or empty texts have size 0
    and are taken as often as their place says, with 0 words. Ties in the hashed order go
    by doc_id and size; repeated rows count once each. An empty table gives none.

    Running sums go over the hash buckets of a source first and inside one bucket then. There are enough
    buckets for some `BUCKET_ROWS` rows in each, were all rows of one source, so a source that
    holds a third of all rows is spread over many groups.
    """
    digits = 2
    while 16 ** digits * BUCKET_ROWS < docs.count():
        digits += 1
    columns = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    sized = docs.select(
        F.struct(*columns).alias("_row"), "source", "doc_id", word_count("text").alias("size"),
        place_hash().alias("hash"),
    ).withColumnRenamed("_row", "row").withColumn("bucket", F.substring("hash", 1, digits))
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(sizes, weights, budget, repeats, schedules)
    frame = buckets.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"),
        F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("base")
    ).join(targets, F.col("s").eqNullSafe(F.col("source"))).select(
        "s", "b", "base", "source_size", "target", "start", "end")
    inside = Window.partitionBy("source", "bucket").orderBy("hash", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        frame, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    middle = F.col("base") + F.col("inside") + F.col("size") / F.lit(2)
    middles = F.array(*[middle + F.col("source_size") * F.lit(k) for k in range(repeats)])
    taken = F.filter(middles, lambda m: m < F.col("target"))
    return placed.withColumn("middles", taken).select(
        "row", "size", "source_size", "target",
        (F.col("size") * F.size("middles")).alias("taken"),
        F.transform("middles", lambda m: position(
            m, F.col("target"), F.col("start"), F.col("end"))).alias("positions"))


def training_stream(docs: DataFrame, **parameters) -> DataFrame:
    """The documents in training order: one row per copy taken, range-sorted by position."""
    copies = mix(docs, **parameters).select("row", F.explode("positions").alias("position"))
    ordered = copies.repartitionByRange("position", F.col("row.doc_id")).sortWithinPartitions(
        "position", F.col("row.doc_id"))
    return ordered.select("row.*")
