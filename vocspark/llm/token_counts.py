"""Token counts by a two-tier lookup on the map side, without shuffling any pre-token.

Tier one is a broadcast table of frequent pre-tokens: the pieces the public vocabulary spells
out whole, each with its token count as the library gives it. It has at most one entry per
id of the vocabulary, whatever the data. Tier two encodes misses once per worker and remembers their counts
in a bounded cache.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from vocspark.llm.encoding import _REMEMBERED, BYTE_VOCABULARY, PieceEncoder


def frequent_pieces(vocabulary: str = BYTE_VOCABULARY) -> dict[str, int]:
    """Token counts of the pre-tokens that the vocabulary has an entry for."""
    encoder = PieceEncoder(vocabulary)
    size = encoder.library.get_vocab_size(with_added_tokens=False)
    texts = {encoder.library.decode([i]) for i in range(size)}
    whole = [t for t in texts if encoder.pieces(t) == [t]]
    return {t: len(encoder.ids(t)) for t in whole}


def _count(batches, vocabulary: str, frequent):
    encoder, table = PieceEncoder(vocabulary), frequent.value
    remembered: dict[str, int] = {}

    def tokens(text: str) -> int:
        pieces = encoder.pieces(text)
        if pieces is None:
            return len(encoder.whole(text))
        missed = {p for p in pieces if p not in table and p not in remembered}
        if missed:
            if len(remembered) > _REMEMBERED:
                remembered.clear()
                missed = {p for p in pieces if p not in table}
            order = list(missed)
            coded = encoder.library.encode_batch_fast(order, add_special_tokens=False)
            remembered.update(zip(order, (len(e.ids) for e in coded)))
        return sum(table[p] if p in table else remembered[p] for p in pieces)

    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column(0),
            pa.array([len(t.encode()) for t in texts], pa.int64()),
            pa.array([tokens(t) for t in texts], pa.int64()),
        ], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, vocabulary: str = BYTE_VOCABULARY) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row, repeated rows and null ids included.

    A null text counts as empty: no bytes, no tokens. An empty table gives an empty result.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_pieces(vocabulary))
    return docs.select("doc_id", "text").mapInArrow(
        partial(_count, vocabulary=vocabulary, frequent=table),
        "doc_id long, n_bytes long, n_tokens long")
