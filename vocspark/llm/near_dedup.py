"""SimHash near-dedup by covering locality-sensitive hashing.

Covering masks (Pagh, 2016): every bit position gets a non-zero vector of radius + 1 bits;
table v keeps the positions whose vector has an even product with v. Any `radius` differing
positions leave some v for which none of them is kept, so the pair collides in that table.
Within a table's bucket two fingerprints differ only in positions the mask leaves free, so
each member votes for itself and its one-bit changes there: members meeting at a vote are
within two bits, a vote gathers at most 65 fingerprints, and no pairs of a bucket are listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark.llm.common import attach, stored

SHINGLE = 3
RADIUS = 2
_SEED = 42
_CHUNK = 1 << 14


def word_shingles(text: str | None, shingle: int) -> list[bytes]:
    """All word shingles; the whole text if it has fewer words, nothing if it has none."""
    words = (text or "").encode().lower().split()
    if len(words) <= shingle:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits over the XXH64 of all word shingles; no words: zero."""
    grams = word_shingles(text, shingle)
    if not grams:
        return 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, _SEED) for g in grams), ">u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at:at + _CHUNK]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fp (64 bits as a signed long) of every row."""

    def run(batches):
        for b in batches:
            values = np.fromiter(
                (simhash(t, shingle) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(values.view(np.int64))],
                names=["doc_id", "text_hash", "fp"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, "doc_id long, text_hash long, fp long")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """One 64-bit mask per table: 2^(radius + 1) - 1 tables."""
    vectors = [i % ((2 << radius) - 1) + 1 for i in range(64)]
    return [
        sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2 == 0)
        for v in range(1, 2 << radius)
    ]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(fps: DataFrame) -> DataFrame:
    """Links (u, v), u > v, that join all distinct `fp` within two bits of each other."""
    masks = covering_masks(RADIUS)
    free = [[_signed(1 << i) for i in range(64) if not m >> i & 1] for m in masks]
    tables = F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits"))
        for t, m in enumerate(masks)])
    entries = stored(
        fps.select("fp", F.explode(tables).alias("bucket")).select(
            "fp", F.col("bucket.t").alias("t"),
            F.xxhash64("bucket.t", "bucket.bits").alias("bucket")), "simhash-tables")
    shared = stored(
        entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"),
        "simhash-buckets")
    members = attach(entries, shared, "bucket", "size").select("fp", "t").distinct()
    changes = F.element_at(
        F.array(*[F.array(*[F.lit(b).cast("long") for b in [0, *row]]) for row in free]),
        F.col("t") + 1)
    votes = members.select("fp", F.explode(changes).alias("change")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("change")).alias("vote")).distinct()
    met = votes.groupBy("vote").agg(F.collect_set("fp").alias("met")).filter("size(met) > 1")
    pairs = met.select(F.array_min("met").alias("v"), F.explode("met").alias("u"))
    return pairs.filter("u > v").select("u", "v").distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of alternating stars (Kiveris et al., 2014): hang neighbours on the least node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    arcs = both if large else edges
    least = stored(
        arcs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        .withColumn("m", F.least("u", "m")), "star-least")
    hung = attach(stored(arcs, "star-arcs"), least, "u", "n")
    if large:
        moved = hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return stored(moved.filter("u <> v").distinct(), "star-edges")


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node but the least of its component, with that least node."""
    def state(e):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = stored(edges, "links")
    before = state(edges)
    while True:
        edges = _star(_star(edges, large=True), large=False)
        after = state(edges)
        if after == before:
            return edges
        before = after


def _labelled(rows: DataFrame, fps: DataFrame, edges: DataFrame) -> DataFrame:
    tree = components(edges)
    grown = fps.join(tree.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left")
    grown = stored(grown.withColumn("root", F.coalesce("root", "fp")), "roots")
    roots = stored(
        grown.groupBy("root").agg(
            F.min("first").alias("component_id"), F.count(F.lit(1)).alias("fps")), "components")
    labels = stored(attach(grown, roots, "root", "fps").select(
        "fp", "root", "component_id", "n"), "labels")
    return attach(rows, labels, "fp", "n").select(
        "doc_id", "text_hash", "fp", "root", "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _distinct(rows: DataFrame) -> DataFrame:
    return stored(
        rows.groupBy("fp").agg(
            F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct-fps")


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, root, component_id and kept of every row.

    Texts are lower-cased (A-Z); null and empty texts have fingerprint zero and link like
    any other. Repeated rows share a component; `root` is its least fp. `component_id` is the smallest doc_id
    reachable (null only if all are null); `kept` marks that document. An empty table
    gives an empty result.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    fps = _distinct(rows)
    return _labelled(rows, fps, links(fps))


def keep_one(docs: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """The rows of `docs` that stay: one document per component of `marked` (near_dedup of `docs`).

    The smallest doc_id stays, a null one only where all are null; where texts of one
    component share it, the least text hash stays.
    """
    marked = near_dedup(docs) if marked is None else marked
    winners = marked.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash")).alias("w")).select(
        F.col("w.doc_id").alias("id"), F.col("w.text_hash").alias("h"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("text_hash"))
    stays = rows.join(
        winners, rows.doc_id.eqNullSafe(winners.id) & (rows.text_hash == winners.h), "left_semi")
    return stays.dropDuplicates(["doc_id", "text_hash"]).select("row.*")
