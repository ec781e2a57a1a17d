"""Deterministic stand-ins for the model jobs, built from Spark expressions.

None of them shuffles the reviews: tokens are counted inside each row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark import config
from vocspark.functions.ordering import first_rows_per_group
from vocspark.functions.text import tokens

_CELLS_AT_ONCE = 1 << 20
_WORDS_AT_ONCE = 1 << 18
_WORDS_REMEMBERED = 1 << 17


def embed_hashed(
    df: DataFrame,
    dim: int = config.EMBEDDING_DIM,
    text: str = "texto_completo",
    out: str = "embedding",
) -> DataFrame:
    """Add a vector of hashed token counts, scaled to length 1 (all zeros without tokens).

    A token's place is the first 32 bits of its md5 modulo `dim`. Texts are split in
    the JVM; numpy counts a bounded number of tokens and cells at a time, linear in the tokens for any
    `dim`, and remembers the places of a bounded number of tokens. Marked nondeterministic so that filters
    the optimizer derives from the vector do not compute it again.
    """

    @F.arrow_udf("array<float>")
    def unit_counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        places: dict[str, int] = {}
        for words in batches:
            parts = [_unit_counts(some, dim, places) for some in _slices(words, max(1, _CELLS_AT_ONCE // dim))]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

    return df.withColumn(out, unit_counts.asNondeterministic()(tokens(text)))


def _slices(words: pa.Array, most_rows: int) -> Iterator[pa.Array]:
    """Runs of rows with at most `_WORDS_AT_ONCE` words each; a longer text is one by itself.

    A batch has many times the bytes of its words in numpy, and its rows have no bound on their length.
    """
    ends = words.offsets.to_numpy()
    start = 0
    while start < len(words):
        fit = int(np.searchsorted(ends, ends[start] + _WORDS_AT_ONCE, "right")) - 1
        stop = max(start + 1, min(fit, start + most_rows))
        yield words.slice(start, stop - start)
        start = stop


def _row_of_word(words: pa.Array) -> np.ndarray:
    return np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))


def _unit_counts(words: pa.Array, dim: int, places: dict[str, int]) -> pa.Array:
    rows = len(words)
    coded = words.flatten().dictionary_encode()
    place = np.array(_places(coded.dictionary.to_pylist(), dim, places), dtype=np.int64)
    cell = _row_of_word(words) * dim + place[coded.indices.to_numpy()]
    counts = np.bincount(cell, minlength=rows * dim).reshape(rows, dim)
    length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    unit = np.floor(counts / np.where(length == 0, 1, length) * 1e6 + 0.5) / 1e6
    starts = np.arange(0, rows * dim + 1, dim, dtype=np.int32)
    return pa.ListArray.from_arrays(starts, unit.astype(np.float32).ravel())


def _places(words: list[str], dim: int, known: dict[str, int]) -> list[int]:
    """Places of the words; `known` remembers them within a task, up to a fixed size."""
    if len(known) > _WORDS_REMEMBERED:
        known.clear()
    for word in words:
        if word not in known:
            head = hashlib.md5(word.encode(), usedforsecurity=False).digest()[:4]
            known[word] = int.from_bytes(head, "big") % dim
    return [known[word] for word in words]


def embedding_cells(df: DataFrame, key: str = "review_id", col: str = "embedding") -> DataFrame:
    """Vectors in long form: key, bucket from 0, value."""
    return df.select(key, F.posexplode(col).alias("bucket", "value")).select(
        key, "bucket", F.col("value").cast("double").alias("value")
    )


def classify_lexicon(
    df: DataFrame,
    lexicon: Iterable[tuple[str, str, int]],
    polarity: Iterable[tuple[str, int]],
    topics: Sequence[str] = config.TOPICS,
    text: str = "texto_completo",
    out: str = "classificacao_json",
) -> DataFrame:
    """Topic and sentiment by word lists, as the JSON text a model would answer.

    The topic with the highest summed weight of its words wins, ties go to the
    earlier topic of the list, no hit to the fallback. The sign of the summed polarity
    gives the sentiment. A word listed more than once has the sum of its weights.

    Each listed word has one row of weights, one per topic and one for the polarity, and is looked
    up once per batch. The lists go to the executors as one broadcast value: they are given by the
    caller and do not grow with the reviews, nor does the plan with them.
    """
    rows, weights = _word_weights(lexicon, polarity, topics)
    held = df.sparkSession.sparkContext.broadcast((rows, weights))
    answers = [
        json.dumps({"assunto": topic, "sentimento": mood}, ensure_ascii=False, separators=(",", ":"))
        for topic in (*topics, config.FALLBACK_TOPIC)
        for mood in (config.NEGATIVE, config.NEUTRAL, config.POSITIVE)
    ]

    @F.arrow_udf("string")
    def answer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rows, weights = held.value
        for words in batches:
            found = [a for some in _slices(words, len(words)) for a in _answer_numbers(some, rows, weights)]
            yield pa.array([answers[i] for i in found], pa.string())

    return df.withColumn(out, answer.asNondeterministic()(tokens(text)))


def _answer_numbers(words: pa.Array, rows: dict[str, int], weights: np.ndarray) -> list[int]:
    """Per text: three times the place of its topic (the fallback is the last), plus 0, 1 or 2 for the sentiment."""
    fallback = weights.shape[1] - 1
    coded = words.flatten().dictionary_encode()
    known = np.array([rows.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)
    row = known[coded.indices.to_numpy()]
    heard = row >= 0
    sums = np.zeros((len(words), fallback + 1), np.int64)
    np.add.at(sums, _row_of_word(words)[heard], weights[row[heard]])
    scores = np.hstack([sums[:, :fallback], np.zeros((len(words), 1), np.int64)])
    best = np.where(scores.max(axis=1) > 0, scores.argmax(axis=1), fallback)
    return (3 * best + np.sign(sums[:, fallback]) + 1).tolist()


def _word_weights(
    lexicon: Iterable[tuple[str, str, int]], polarity: Iterable[tuple[str, int]], topics: Sequence[str]
) -> tuple[dict[str, int], np.ndarray]:
    """Row number per word; per row the weight for each topic, then the polarity."""
    place = {topic: i for i, topic in enumerate(topics)}
    entries = [(word, place[topic], weight) for word, topic, weight in lexicon if topic in place]
    entries += [(word, len(place), weight) for word, weight in polarity]
    rows: dict[str, int] = {}
    for word, _, _ in entries:
        rows.setdefault(word, len(rows))
    weights = np.zeros((len(rows) + 1, len(place) + 1), np.int64)
    for word, column, weight in entries:
        weights[rows[word], column] += weight
    return rows, weights


def summarise_extractive(negatives: DataFrame, terms: int = 3, min_letters: int = 4) -> DataFrame:
    """The words most reviews of a topic share, as bullet lines, and a closing line.

    Words are counted over all the reviews given, first inside each task, so a topic with a large part of
    them crosses the shuffle as one row per task and word. A stand-in that keeps the report runnable and
    testable without a model.
    """
    topic = ["assunto", "qtd_negativos"]
    long_words = F.filter(
        F.array_distinct(tokens("texto_completo")), lambda w: F.length(w) >= min_letters
    )
    # a review without such words keeps its topic in, as a NULL word
    words = negatives.select(*topic, F.explode_outer(long_words).alias("word"))
    frequency = words.groupBy(*topic, "word").agg(F.count("word").alias("reviews"))
    # a topic's vocabulary has no bound: its best words are found per task first
    best = first_rows_per_group(frequency, terms, topic, [F.desc("reviews"), F.asc("word")], "place")
    ranked = F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("place", "word"))))
    bullets = F.transform(ranked, lambda b: F.concat(F.lit("- "), b.word))
    closing = F.array(F.concat(F.lit("Revisar: "), F.col("assunto")))
    return best.groupBy(*topic).agg(
        F.array_join(F.concat(bullets, closing), "\n").alias("resumo")
    )
