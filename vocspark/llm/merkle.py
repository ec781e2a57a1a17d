"""Merkle manifest of a table: a tree of hashes per language, a tree over their roots, a proof per row.

Every node is labelled with the interval of leaf ranks that it covers, nested in its parent's
interval. Leaves are put in order by range partitions, and a rank is a leaf's place in its
partition plus the rows of its tree in the partitions before it, so no tree is numbered in one
task. The nodes of one level fall into buckets of `fanout ** level` ranks: a node finds its parent
in the bucket that its interval starts in, where the parent's interval contains its own, and what
the parent's children cover besides that interval are its siblings. Sibling digests are handed
down from the root level by level, so only the last of these joins has a row per document; no
key of any join or group has more than `fanout` rows, whatever share of the table one language has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspark.llm.common import shuffle_partitions, stored

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 over the fields, each `-` if null, else its UTF-8 byte count, `:` and its value."""
    def framed(field):
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(framed, fields)), 256)


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with `lo`, `hi` (place in its tree, from 0, and the next one) and `size` (leaves of the tree).

    Leaves ascend by the `order` columns, nulls first. Rows equal in all of these take any order.
    """
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "_tie")]
    parts = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys)
    seated = stored(
        parts.sortWithinPartitions(*keys).drop("_tie").withColumn("_seat", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_seat", 33)), "merkle-seated")
    counts = seated.groupBy("tree", "_part").agg(
        F.count(F.lit(1)).alias("n"), F.min("_seat").alias("first"))
    # a row per tree and range partition that holds some of it
    counts = counts.selectExpr(
        "tree", "_part",
        "coalesce(sum(n) OVER (PARTITION BY tree ORDER BY _part"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - first AS shift",
        "sum(n) OVER (PARTITION BY tree) AS size")
    return (
        seated.join(counts, ["tree", "_part"])
        .withColumns({"lo": F.col("_seat") + F.col("shift"), "hi": F.col("_seat") + F.col("shift") + 1})
        .drop("_seat", "_part", "shift"))


def _is_root() -> Column:
    return (F.col("lo") == 0) & (F.col("hi") == F.col("size"))


def _bucket(level: int, fanout: int) -> Column:
    return F.expr(f"lo div {fanout ** level}L")


def levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """All nodes by level, leaves first: tree, lo, hi, size, digest and (above the leaves) kids.

    A tree has no node above the level at which one node covers all its leaves.
    """
    largest = leaves.agg(F.max("size")).first()[0] or 1
    found = [leaves]
    while fanout ** (len(found) - 1) < largest:
        grouped = found[-1].filter(~_is_root()).groupBy(
            "tree", _bucket(len(found), fanout).alias("bucket")).agg(
            F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("kids"),
            F.first("size").alias("size"))
        digests = F.array_join(F.transform("kids", lambda kid: kid.digest), "")
        found.append(stored(grouped.select(
            "tree", F.col("kids")[0].lo.alias("lo"), F.element_at("kids", -1).hi.alias("hi"), "size",
            F.sha2(digests, 256).alias("digest"), "kids"), "merkle-level"))
    return found


def roots(nodes: Sequence[DataFrame]) -> DataFrame:
    """One row per tree: tree, digest."""
    tops = [level.filter(_is_root()).select("tree", "digest") for level in nodes]
    found = tops[0]
    for top in tops[1:]:
        found = found.unionByName(top)
    return found


def paths(nodes: Sequence[DataFrame], above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """tree, lo and path of every leaf, with further columns of its own and of `above`.

    `above` has, per tree, the `path` of its root; a path lists, per level upwards, the digests
    of the siblings to the left and to the right.
    """
    carried = [c for c in above.columns if c not in ("tree", "path")]
    parents = None
    for level in reversed(range(len(nodes))):
        kids = ["kids"] if level else [
            c for c in nodes[0].columns if c not in ("tree", "lo", "hi", "size")]
        own = nodes[level].filter(_is_root()).join(above, "tree").select(
            "tree", "lo", "hi", *kids, "path", *carried)
        if parents is not None:
            child = nodes[level].filter(~_is_root()).select(
                "tree", "lo", "hi", _bucket(level + 1, fanout).alias("bucket"), *kids)
            parent = parents.select(
                F.col("tree").alias("its_tree"), _bucket(level + 1, fanout).alias("its_bucket"),
                F.col("lo").alias("its_lo"), F.col("hi").alias("its_hi"),
                F.col("kids").alias("siblings"), F.col("path").alias("its_path"), *carried)
            met = child.join(parent, (
                (F.col("tree") == F.col("its_tree")) & (F.col("bucket") == F.col("its_bucket"))
                & (F.col("its_lo") <= F.col("lo")) & (F.col("hi") <= F.col("its_hi"))))
            left = F.filter("siblings", lambda x: x.hi <= F.col("lo"))
            right = F.filter("siblings", lambda x: x.lo >= F.col("hi"))
            step = F.struct(*[
                F.array_join(F.transform(side, lambda x: x.digest), "").alias(name)
                for name, side in (("left", left), ("right", right))])
            own = own.unionByName(met.select(
                "tree", "lo", "hi", *kids, F.concat(F.array(step), "its_path").alias("path"), *carried))
        parents = stored(own, "merkle-paths") if level > 1 else own
    return parents.drop("hi")


def folded(leaf: str, path: str = "path") -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(path, F.col(leaf), lambda digest, at: F.sha2(F.concat(at.left, digest, at.right), 256))


def manifest(docs: DataFrame, claimed_text: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row per row of `docs`: doc_id, leaf, subroot, root, path, proof_sha256, folded_root, verified.

    Per lang, leaves ascend by doc_id (null first; rows that share one by leaf digest, equal rows in
    any order) and every `fanout` consecutive nodes get a parent, until one is left. The subroots
    form one more tree in order of lang, null first. `path` holds the sibling digests on
    the way to the root, `proof_sha256` their hash. `folded_root` starts from the leaf of the same
    row with `claimed_text` in place of its text; `verified` tells whether it reaches the root.
    Null and empty values differ; a row alone in its lang is its subroot; a table of one row
    has an empty proof. Further columns play no part. An empty table gives an empty result.
    """
    fields = [F.col(f"`{c}`") for c in FIELDS]
    claimed = fields[-1] if claimed_text is None else claimed_text
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), "doc_id",
        leaf_digest(fields).alias("digest"), leaf_digest([*fields[:-1], claimed]).alias("claim"))
    # range partitioning samples its input first: stored, the texts are hashed once
    leaves = ranked(stored(rows, "merkle-leaves"), "doc_id", "digest")
    nodes = levels(leaves, fanout)
    subroots = roots(nodes)
    top = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang_tree"), "digest"), "lang_tree")
    top_nodes = levels(top, fanout)
    root = roots(top_nodes).select(
        "tree", F.col("digest").alias("root"),
        F.array().cast("array<struct<left string, right string>>").alias("path"))
    above = stored(paths(top_nodes, root, fanout).select(
        F.col("lang_tree").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "merkle-subroots")
    proven = paths(nodes, above, fanout)
    hops = F.transform("path", lambda at: F.concat(at.left, at.right))
    return proven.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path",
        F.sha2(F.array_join(hops, ""), 256).alias("proof_sha256"), folded("claim").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
