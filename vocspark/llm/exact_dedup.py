"""Exact dedup by a Golomb-coded exchange of text hashes.

Each task hashes its texts, sorts the hashes and sends every owner (a range of the hash
space) its share as one Golomb-Rice coded row. Owners merge what they receive and return
their slice of a duplicate bitmap: the bits of hashes seen at least twice. The bitmap has a
fixed size (`bits`, 2^27 bits = 16 MB) however many documents there are. Tasks read the
texts again and test the bitmap: only suspects are shuffled, and compared byte by byte as
grouping keys. All steps depend on contents alone, so a lost task is simply run again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark.llm.common import ascii_lower, attach, shuffle_partitions, stored

BITMAP_BITS = 27
_SEED = 42


def golomb_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Rice-code sorted unsigned 64-bit values: (remainder bits, quotients in unary, remainders)."""
    gaps = np.diff(values, prepend=np.uint64(0))
    gaps[:1] = values[:1]
    mean = int(values[-1]) // len(values)
    width = max(mean.bit_length() - 1, 0)
    quotients = (gaps >> np.uint64(width)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    shifts = np.arange(width, dtype=np.uint64)
    remainders = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return width, np.packbits(unary).tobytes(), np.packbits(remainders).tobytes()


def golomb_decode(count: int, width: int, unary: bytes, remainders: bytes) -> np.ndarray:
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:count]
    quotients = np.diff(ones, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(remainders, np.uint8))[: count * width]
    low = bits.reshape(count, width).astype(np.uint64) << np.arange(width, dtype=np.uint64)
    gaps = (quotients.astype(np.uint64) << np.uint64(width)) + low.sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _hash(text: str | None) -> int:
    return xxhash.xxh64_intdigest((text or "").encode().lower(), _SEED)


def _send_hashes(owners: int):
    schema = "owner int, n int, width int, unary binary, remainders binary"

    def run(batches):
        hashes = [
            np.fromiter(map(_hash, b.column(0).to_pylist()), np.uint64, b.num_rows) for b in batches
        ]
        values = np.sort(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)
        owner = ((values >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
        rows = []
        for o in np.unique(owner):
            mine = values[owner == o]
            base = _owner_start(int(o), owners)
            rows.append({"owner": int(o), "n": len(mine)} | dict(zip(
                ("width", "unary", "remainders"), golomb_encode(mine - np.uint64(base)))))
        yield pa.RecordBatch.from_pylist(rows, pa.schema([
            ("owner", pa.int32()), ("n", pa.int32()), ("width", pa.int32()),
            ("unary", pa.binary()), ("remainders", pa.binary())]))

    return run, schema


def _owner_start(owner: int, owners: int) -> int:
    return (-(-(owner << 32) // owners)) << 32


def _find_duplicates(owners: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        owner = rows[0]["owner"]
        values = np.sort(np.concatenate([
            golomb_decode(r["n"], r["width"], r["unary"], r["remainders"]) for r in rows
        ])) + np.uint64(_owner_start(owner, owners))
        twice = np.unique(values[1:][values[1:] == values[:-1]] >> np.uint64(64 - bits))
        cells = twice >> np.uint64(3)
        first = int(cells[0]) if len(cells) else 0
        piece = np.zeros(int(cells[-1]) - first + 1 if len(cells) else 0, np.uint8)
        np.bitwise_or.at(
            piece, (cells - np.uint64(first)).astype(np.int64),
            (1 << (twice & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        return pa.table({"first": pa.array([first], pa.int64()),
                         "piece": pa.array([piece.tobytes()], pa.binary())})

    return run


def duplicate_bitmap(docs: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """Bits of the leading `bits` of every text hash that at least two rows share."""
    owners = shuffle_partitions(docs.sparkSession)
    send, schema = _send_hashes(owners)
    pieces = (
        docs.select("text").mapInArrow(send, schema)
        .groupBy("owner").applyInArrow(_find_duplicates(owners, bits), "first long, piece binary")
    )
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    for row in pieces.toLocalIterator():
        piece = np.frombuffer(row.piece, np.uint8)
        bitmap[row.first:row.first + len(piece)] |= piece
    return bitmap


def exact_dedup(docs: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """All documents with `keep_id`, `group_size`, `kept` and `text_sha256`.

    Returns `row` (the input row as a struct, so no column name can clash) and the four
    columns. Texts are equal when identical after lower-casing A-Z; null is the empty
    text. Of equal texts the largest doc_id stays; a null doc_id is smaller than any
    other. Rows with the same doc_id and equal text are one document and give one row;
    `group_size` counts every input row. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(duplicate_bitmap(docs, bits).tobytes())

    @F.pandas_udf("boolean")
    def suspect(texts):
        import pandas as pd
        marks, shift = bitmap.value, 64 - bits
        keys = (_hash(t) >> shift for t in texts)
        return pd.Series([bool(marks[k >> 3] >> (k & 7) & 1) for k in keys])

    tested = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", ascii_lower("row.text").alias("norm"), suspect("row.text").alias("suspect"))
    tested = tested.withColumn("text_sha256", F.sha2("norm", 256))
    alone = tested.filter(~F.col("suspect")).select(
        "row", F.col("row.doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    suspects = tested.filter("suspect")
    groups = stored(
        suspects.groupBy("norm")
        .agg(F.max("row.doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"), "exact-groups")
    rows = stored(suspects.select("row", "text_sha256"), "exact-suspects")
    together = (
        attach(rows, groups, "text_sha256", "group_size")
        .withColumn("id", F.col("row.doc_id"))
        .dropDuplicates(["text_sha256", "id"])
        .select("row", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                "text_sha256")
    )
    return alone.unionByName(together)
