"""SimHash fingerprints from DataFrame functions only.

Every word of a text is a term: its 64-bit hash votes on 64 bits, weighted by the word's
length (up to `LONGEST` letters), so that short function words decide little. Votes of two bits share a long (32 bits
each), which makes 32 sums per text; a weight is at most the word's length, so a sum stays below
the text's length. A bit is set when over half the weight voted for it.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocspark.llm.common import stored

RADIUS = 3
BLOCKS = 6
LONGEST = 18
_SPACE = r"[\x20\x09-\x0D]+"
_LANES = (1 << 32) | 1


def _bits(lanes: list[Column], weight: Column) -> Column:
    parts = []
    for k, lane in enumerate(lanes):
        low, high = lane.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(lane, 32)
        for place, votes in ((k, low), (k + 32, high)):
            bit = F.shiftleft(F.lit(1).cast("long"), place)
            parts.append(F.when(votes * 2 > weight, bit).otherwise(F.lit(0).cast("long")))
    return reduce(Column.bitwiseOR, parts)


def simhash(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """`keys` and `fp` (signed long) of every text; texts of equal keys vote together.

    Null, empty or blank texts have fingerprint zero.
    """
    words = texts.select(*keys, F.explode(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACE)).alias("word"))
    size = F.length("word")
    voted = words.select(
        *keys, F.xxhash64("word").alias("term"),
        F.when(size == 0, 0).otherwise(F.greatest(F.least(size, F.lit(LONGEST)) - 2, F.lit(1)))
        .cast("long").alias("w"))
    sums = [
        F.sum(F.shiftrightunsigned("term", k).bitwiseAND(F.lit(_LANES)) * F.col("w")).alias(f"v{k}")
        for k in range(32)]
    tallied = voted.groupBy(*keys).agg(F.sum("w").alias("weight"), *sums)
    return tallied.select(
        *keys, _bits([F.col(f"v{k}") for k in range(32)], F.col("weight")).alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """One mask per permuted table: every choice of `blocks` - `radius` leading blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    whole = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(kept) for kept in combinations(whole, blocks - radius)]


def within_radius(
    queries: DataFrame, fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS
) -> DataFrame:
    """Pairs (query, fp, distance) of distinct fingerprints at most `radius` bits apart.

    `radius` differing bits touch at most that many blocks, so some table has all its leading blocks
    equal. Copies are removed first: rows join the pairs by `fp`.
    """
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(radius, blocks)]
    tables = lambda c: F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col(c).bitwiseAND(F.lit(m)).alias("k"))
        for t, m in enumerate(masks)])).alias("block")
    asked = queries.select(F.col("fp").alias("query")).distinct().select("query", tables("query"))
    held = fps.select("fp").distinct().select("fp", tables("fp"))
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fp")))
    return asked.join(held, "block").withColumn("distance", distance).filter(
        F.col("distance") <= radius).select("query", "fp", "distance").distinct()


def successors(rows: DataFrame) -> DataFrame:
    """(doc_id, h) of every row with the next row's as (next_id, next_h); the last's is the first.

    Order: doc_id (null first), then h. Rows are range-sorted; the next is found inside a range, and
    for the last of a range it is the first of the following one.
    """
    placed = stored(
        rows.select("doc_id", "h", "n_chars").distinct().repartitionByRange("doc_id", "h")
        .withColumn("part", F.spark_partition_id()), "order")
    here = F.struct("doc_id", "h")
    heads = placed.groupBy("part").agg(F.min(here).alias("head"))
    over = Window.orderBy("part")
    first = F.first("head").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    following = heads.select("part", F.coalesce(F.lead("head").over(over), first).alias("following"))
    inside = F.lead(here).over(Window.partitionBy("part").orderBy("doc_id", "h"))
    return placed.withColumn("inside", inside).join(following, "part").withColumn(
        "next", F.coalesce("inside", "following")).select(
        "doc_id", "h", "n_chars", F.col("next.doc_id").alias("next_id"), F.col("next.h").alias("next_h"))


def _keyed(rows: DataFrame, doc_id: str, h: str, prefix: str) -> DataFrame:
    """Key columns without nulls, so that joins and groups by them share one partitioning."""
    return rows.withColumns({
        f"{prefix}id": F.coalesce(F.col(doc_id), F.lit(0)), f"{prefix}null": F.col(doc_id).isNull(),
        f"{prefix}h": F.col(h)})


def edited_fingerprints(docs: DataFrame, share: int = 4) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last floor(n_chars / `share`) code points replaced by as many (or
    all) from the start of the next text. Null counts as empty. Rows with one doc_id and equal
    text are one; different texts of one doc_id follow in order of their hash. A
    single document is its own next. An empty table gives an empty result.

    Whole texts cross one shuffle, by document. From there each sends the head that the
    document before it needs; texts, heads and votes are then joined and summed where they are.
    """
    key = ["k_id", "k_null", "k_h"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "h", F.xxhash64("text"))
    order = stored(successors(rows.withColumn("n_chars", F.char_length("text").cast("long"))), "next")
    cut = F.floor(F.col("n_chars") / share).cast("int")
    whole = _keyed(rows, "doc_id", "h", "k_").select(*key, "text").dropDuplicates(key)
    # a document may be the next of one other: its head goes there
    wanted = _keyed(_keyed(order, "next_id", "next_h", "k_"), "doc_id", "h", "p_").select(
        *key, "p_id", "p_null", "p_h", "n_chars", "doc_id", "next_id", "next_h")
    heads = whole.join(wanted, key).select(
        F.col("p_id").alias("k_id"), F.col("p_null").alias("k_null"), F.col("p_h").alias("k_h"),
        "doc_id", "n_chars", "next_id", "next_h", F.substring("text", F.lit(1), cut).alias("head"))
    both = whole.join(heads, key).withColumn(
        "edited", F.concat(
            F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.col("head")))
    keys = [*key, "doc_id", "n_chars", "next_id", "next_h"]
    each = both.select(*keys, F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(
        F.struct(F.lit(0).alias("which"), "text"),
        F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("version"))
    keys = [*keys, "edited_sha256"]
    voted = simhash(
        each.select(*keys, F.col("version.which").alias("which"), F.col("version.text").alias("text")),
        [*keys, "which"])
    pick = lambda n: F.max(F.when(F.col("which") == n, F.col("fp")))
    made = stored(voted.groupBy(*keys).agg(pick(0).alias("fp"), pick(1).alias("edited_fp")), "votes")
    nexts = made.select(*key, F.col("fp").alias("next_fp"))
    return _keyed(made.drop(*key), "next_id", "next_h", "k_").join(nexts, key).select(
        "doc_id", "n_chars", "edited_sha256", "fp", "edited_fp",
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
