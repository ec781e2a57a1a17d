"""Token ids as Simple-8b words.

A word has a selector in its upper 4 bits and up to 240 values in the lower 60. Selector
15 escapes: the word's low bits are the place of a raw 64-bit value in the block's escape list.
A block is self-describing bytes, little-endian:

    magic "S8B1" | u32 documents | u32 words | u32 escapes | u64 ids
    u32 length of each document | u32 first id of every 1024th word | words | escapes

The per-block offsets say which id each group of 1,024 words starts with, so a reader can
decode any group without the words before it.
"""

from __future__ import annotations

import struct
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocspark.llm.encoding import BYTE_VOCABULARY, worker_encoder

MAGIC = b"S8B1"
GROUP = 1024
BLOCK_IDS = 1 << 16
_HEAD = "<4sIIIQ"
# selector -> (values per word, bits per value); 15 is the escape
LAYOUTS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7),
           (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (1, 60), (1, 64)]
ESCAPE = 15
_EXACT = 1 << 53  # below, a float holds every integer
_COUNTS = np.array([n for n, _ in LAYOUTS], np.int64)


def widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    if not len(values) or values.max() < _EXACT:
        return np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    found = np.zeros(len(values), np.uint8)
    rest = values
    for half in (32, 16, 8, 4, 2, 1):
        high = rest >> np.uint64(half)
        above = high > 0
        found[above] += half
        rest = np.where(above, high, rest)
    return found + (rest > 0)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of unsigned 64-bit values: the fullest selector that fits, from the left."""
    values = values.astype(np.uint64)
    n = len(values)
    best = np.full(n, ESCAPE, np.uint8)
    # the widest of the next `reach` values from each place; past the end nothing fits
    widest, reach = widths(values), 1
    for selector in range(ESCAPE - 1, -1, -1):
        count, bits = LAYOUTS[selector]
        if count > n:
            break
        while reach < count:
            ahead = min(reach, count - reach)
            widest = np.maximum(widest[:-ahead], widest[ahead:])
            reach += ahead
        best[:len(widest)][widest <= bits] = selector
    step = _COUNTS[best].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts, np.int64)
    chosen = best[starts] if n else np.empty(0, np.int64)
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(chosen):
        count, bits = LAYOUTS[selector]
        rows = np.flatnonzero(chosen == selector)
        if selector == ESCAPE:
            words[rows] |= np.arange(len(rows), dtype=np.uint64)
        elif bits:
            cells = values[starts[rows, None] + np.arange(count)]
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            words[rows] |= np.bitwise_or.reduce(cells << shifts, axis=1)
    return words, values[starts[chosen == ESCAPE]] if n else values


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[selectors]
    firsts = np.cumsum(counts) - counts
    values = np.zeros(int(counts.sum()), np.uint64)
    data = words & np.uint64((1 << 60) - 1)
    for selector in np.unique(selectors):
        count, bits = LAYOUTS[selector]
        rows = np.flatnonzero(selectors == selector)
        if selector == ESCAPE:
            values[firsts[rows]] = escapes[data[rows].astype(np.int64)]
        elif bits:
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            values[firsts[rows, None] + np.arange(count)] = (
                data[rows, None] >> shifts) & np.uint64((1 << bits) - 1)
    return values


def write_block(lengths: list[int], ids: np.ndarray) -> bytes:
    words, escapes = pack(ids)
    counts = _COUNTS[(words >> np.uint64(60)).astype(np.int64)]
    offsets = (np.cumsum(counts) - counts)[::GROUP]
    return b"".join([
        struct.pack(_HEAD, MAGIC, len(lengths), len(words), len(escapes), len(ids)),
        np.array(lengths, "<u4").tobytes(), offsets.astype("<u4").tobytes(),
        words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()])


def read_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(document lengths, ids) of a block."""
    magic, documents, words, escapes, ids = struct.unpack_from(_HEAD, block)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b block")
    at = struct.calcsize(_HEAD)
    lengths = np.frombuffer(block, "<u4", documents, at)
    at += 4 * documents
    starts = np.frombuffer(block, "<u4", -(-words // GROUP), at)
    at += 4 * len(starts)
    body = np.frombuffer(block, "<u8", words, at)
    raw = np.frombuffer(block, "<u8", escapes, at + 8 * words)
    if int(lengths.sum()) != ids:
        raise ValueError("damaged Simple-8b block")
    values = np.empty(ids, np.uint64)
    # each group of words goes where its offset says, whatever the groups before it hold
    for group, (start, stop) in enumerate(zip(starts.tolist(), [*starts.tolist()[1:], ids])):
        found = unpack(body[group * GROUP:(group + 1) * GROUP], raw)
        if len(found) != stop - start:
            raise ValueError("damaged Simple-8b block")
        values[start:stop] = found
    return lengths.astype(np.int64), values


_BLOCKS = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
    ("n_ids", pa.int64()), ("data", pa.binary())])


def _encode(batches, vocabulary: str, end: int):
    encoder, part, block = worker_encoder(vocabulary), TaskContext.get().partitionId(), 0
    doc_ids: list[int | None] = []
    parts: list[np.ndarray] = []
    held = 0

    def flush():
        ids = np.concatenate(parts)
        return pa.RecordBatch.from_pylist([{
            "part": part, "block": block, "doc_ids": list(doc_ids), "n_ids": len(ids),
            "data": write_block([len(p) for p in parts], ids)}], _BLOCKS)

    for batch in batches:
        for doc_id, found in zip(batch.column(0).to_pylist(), encoder.all_ids(batch.column(1))):
            ids = np.append(found, np.uint32(end))
            doc_ids.append(doc_id)
            parts.append(ids)
            held += len(ids)
            if held >= BLOCK_IDS:
                yield flush()
                doc_ids.clear(), parts.clear()
                block, held = block + 1, 0
    if parts:
        yield flush()


def write_ids(docs: DataFrame, path: str, vocabulary: str = BYTE_VOCABULARY, end: int = 0) -> None:
    """Encode every text, append `end`, and write blocks in ascending doc_id order to `path`.

    Rows are range-sorted by doc_id (nulls first, ties by text); a null text is empty and
    gives the end id alone; repeated rows are all written. Blocks are rows of Parquet files, so a
    lost task leaves no half file. An empty table writes an empty file.
    """
    rows = docs.select("doc_id", "text")
    ordered = rows.repartitionByRange(
        "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(
        partial(_encode, vocabulary=vocabulary, end=end),
        "part int, block int, doc_ids array<long>, n_ids long, data binary").write.parquet(path)


def _decode(batches):
    for batch in batches:
        for row in batch.to_pylist():
            lengths, ids = read_block(row["data"])
            stops = np.cumsum(lengths)
            starts = stops - lengths
            raw = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays([
                pa.array(row["doc_ids"], pa.int64()),
                pa.array([row["part"]] * len(lengths), pa.int32()),
                pa.array([row["block"]] * len(lengths), pa.int32()),
                pa.array(starts), pa.array(lengths),
                pa.array([zlib.crc32(raw[a:b].tobytes()) for a, b in zip(starts, stops)], pa.int64()),
            ], names=["doc_id", "part", "block", "inside", "n_tokens", "ids_crc32"])


def read_ids(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the written files.

    Starts come from the blocks' id counts: sums per part (one row per file), then inside each.
    """
    blocks = spark.read.schema(
        "part int, block int, doc_ids array<long>, n_ids long, data binary").parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("part_ids").over(ahead), F.lit(0)).alias("part_base"))
    starts = blocks.select("part", "block", "n_ids").withColumn(
        "block_base", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(bases, "part")
    decoded = blocks.mapInArrow(
        _decode, "doc_id long, part int, block int, inside long, n_tokens long, ids_crc32 long")
    return decoded.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("part_base") + F.col("block_base") + F.col("inside")).alias("start"),
        "n_tokens", "ids_crc32")
