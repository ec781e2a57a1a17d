"""Best-fit packing of token sequences, as bulk-synchronous steps.

Documents are ordered by length and gaps by size; a step takes all documents of the next
length, longest first, and matches them to the smallest gaps that hold them. Documents of one
length differ only in rank, as do gaps of one step, so conflicts are resolved by rank: the
k-th document takes the k-th place. Gaps are updated and the next step begins. Documents without a
gap open sequences.

A step handles whole runs of equal gaps, so what steps read is the count of documents per
length: at most `capacity` rows however large the corpus. The documents' ranks and their
places are found by Spark: ranks by counts per part and length, places by search in the runs.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocspark.llm.common import stored
from vocspark.llm.encoding import WORD_VOCABULARY, worker_encoder

CAPACITY = 4096
END = 1
_PIECES = ("doc_id long, piece int, start long, length int, ids_crc32 long, part int, local long")


def _pieces(batches, vocabulary: str, end: int, capacity: int):
    encoder, part = worker_encoder(vocabulary), TaskContext.get().partitionId()
    seen: Counter[int] = Counter()
    for batch in batches:
        rows = []
        for doc_id, found in zip(batch.column(0).to_pylist(), encoder.all_ids(batch.column(1))):
            ids = np.append(found, np.uint32(end)).astype("<u4")
            for piece, start in enumerate(range(0, len(ids), capacity)):
                cut = ids[start:start + capacity]
                rows.append((doc_id, piece, start, len(cut), zlib.crc32(cut.tobytes()), part,
                             seen[len(cut)]))
                seen[len(cut)] += 1
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
        columns = list(zip(*rows)) or [()] * len(kinds)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def best_fit_runs(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple]]:
    """Per length: runs (first rank, first sequence, offset) of documents placed side by side.

    `counts` maps a length to its number of documents. Gaps are runs of consecutive sequences
    with equal room, kept in a heap per room; rooms are searched upwards from the length.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    runs: dict[int, list[tuple]] = {}
    opened = 0

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in gaps:
                gaps[room] = []
                rooms.insert(bisect_left(rooms, room), room)
            heapq.heappush(gaps[room], (first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        runs[length] = []
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                first, n, room = opened, -(-left // (capacity // length)), capacity
                opened += n
            else:
                room = rooms[at]
                first, n = heapq.heappop(gaps[room])
                if not gaps[room]:
                    del gaps[room]
                    rooms.pop(at)
            fits = room // length
            used = min(n, -(-left // fits))
            add(room, first + used, n - used)
            n = used
            # fill each sequence of the run as often as the length fits: best fit returns to it
            for k in range(fits):
                take = min(n, left)
                if not take:
                    add(room - k * length, first, n)
                    break
                runs[length].append((rank, first, capacity - room + k * length))
                rank, left = rank + take, left - take
                if take < n:
                    add(room - k * length, first + take, n - take)
                    n = take
            else:
                add(room - fits * length, first, n)
    return runs


def _place(batches, runs):
    table = {k: tuple(map(np.array, zip(*v))) for k, v in runs.value.items()}
    for batch in batches:
        lengths = batch.column("length").to_numpy()
        ranks = batch.column("local").to_numpy() + batch.column("base").to_numpy()
        sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
        for length in np.unique(lengths):
            first_rank, first, place = table[int(length)]
            mine = np.flatnonzero(lengths == length)
            run = np.searchsorted(first_rank, ranks[mine], "right") - 1
            sequence[mine] = first[run] + ranks[mine] - first_rank[run]
            offset[mine] = place[run]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("piece"), batch.column("start"),
            batch.column("length").cast(pa.int64()), batch.column("ids_crc32"),
            pa.array(sequence), pa.array(offset),
        ], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(
    docs: DataFrame, vocabulary: str = WORD_VOCABULARY, end: int = END, capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece with the end id alone. Repeated rows and null ids are
    packed like any other row. Documents of over `capacity` ids are cut into full pieces and a
    last one. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = stored(docs.select("doc_id", "text").mapInArrow(
        partial(_pieces, vocabulary=vocabulary, end=end, capacity=capacity), _PIECES), "pieces")
    tally = stored(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r.length: r.n for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(best_fit_runs(counts, capacity))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = tally.select(
        "part", "length", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    return pieces.join(bases, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "local", "base"
    ).mapInArrow(
        partial(_place, runs=runs),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
