"""Language ID by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's
likelihood is the sum over all its segmentations into pieces (forward algorithm); piece
probabilities are learnt by expectation maximisation, whose expected counts come from the
forward and backward sums. Words are runs of letters, lower-cased, with the vocabulary's word mark.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark.llm.common import shuffle_partitions, stored

PIECES = "piece_bpe_32k.model"
SAMPLE_DOCS = 1000
ROUNDS = 3
SMOOTHING = 0.1
UNKNOWN = 1e-7
FLOAT_LETTERS = 40  # the probability of a longer word may be too small for a float: its sums are kept as logs
_LETTERS = re.compile(r"[^\W\d_]+")
_MARK = "▁"
_BEGUN = -2
_REMEMBERED = 1 << 18
_TOGETHER = 1 << 10
_WORDS_AT_ONCE = 1 << 16


def vocabulary(name: str = PIECES) -> list[str]:
    """Lower-case pieces of letters, with or without the word mark, in id order."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return [p for p in pieces if p == p.lower() and _LETTERS.fullmatch(p.removeprefix(_MARK) or "a")]


def words(text: str | None) -> list[str]:
    found = _LETTERS.findall((text or "").lower())
    return [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def _log_sum(logs: list[float]) -> float:
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs))


class Segmenter:
    """Sums over segmentations for all languages at once: `probs` is pieces x languages."""

    def __init__(self, pieces: list[str], probs: np.ndarray):
        # every piece, and every beginning of one as `_BEGUN`
        self.index = {p[:n]: _BEGUN for p in pieces for n in range(1, len(p))}
        self.index.update((p, i) for i, p in enumerate(pieces))
        self.probs = probs
        # the last row stands for piece -1, an unknown character
        self.rows = [*probs.tolist(), [UNKNOWN] * probs.shape[1]]
        self.weights = np.array(self.rows)
        self._grow_trie()

    def _grow_trie(self) -> None:
        """Sorted (node, letter) keys with the node that each leads to, and the piece that ends at a node."""
        self.letters = {c: i for i, c in enumerate(sorted({c for p in self.index for c in p}))}
        nodes = {p: i for i, p in enumerate(["", *self.index])}
        keys = np.array([nodes[p[:-1]] * len(self.letters) + self.letters[p[-1]] for p in self.index], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], order + 1
        self.piece = np.array([_BEGUN, *self.index.values()], np.int64)

    def spans(self, word: str) -> list[list[tuple[int, int]]]:
        """For each start: the (end, piece) that it reaches; -1 is an unknown character."""
        text = _MARK + word
        size, index, out = len(text), self.index, []
        for start in range(size):
            found, end = [], start + 1
            while end <= size and (piece := index.get(text[start:end])) is not None:
                if piece != _BEGUN:
                    found.append((end, piece))
                end += 1
            if not found or found[0][0] != start + 1:
                found.append((start + 1, -1))
            out.append(found)
        return out

    def edges(self, word: str) -> list[list[tuple[int, int]]]:
        """For each end: the (start, piece) that reach it."""
        spans = self.spans(word)
        reach: list[list[tuple[int, int]]] = [[] for _ in spans]
        for start, found in enumerate(spans):
            for end, piece in found:
                reach[end - 1].append((start, piece))
        return reach

    def log_likelihood(self, word: str) -> list[float]:
        return self.log_likelihoods([word])[0].tolist()

    def log_likelihoods(self, words: list[str]) -> np.ndarray:
        """A row per word, a column per language. Words of one length are summed side by side."""
        out = np.empty((len(words), self.probs.shape[1]))
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if len(word) > FLOAT_LETTERS:
                out[i] = self._scaled(self.edges(word))
            else:
                by_length.setdefault(len(word), []).append(i)
        for length, places in by_length.items():
            for at in range(0, len(places), _TOGETHER):
                part = places[at:at + _TOGETHER]
                out[part] = np.log(self._forward([words[i] for i in part], length + 1))
        return out

    def _forward(self, words: list[str], size: int) -> np.ndarray:
        """Forward sums of words whose text with the mark has `size` letters."""
        letters = np.array([self.letters.get(c, -1) for w in words for c in _MARK + w]).reshape(-1, size)
        # for each (start, end), the words and pieces that step there: all starts walk down the trie together
        steps: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        row, start = (x.ravel() for x in np.indices(letters.shape))
        node = np.zeros(len(row), np.int64)
        for depth in range(size):
            letter = letters[row, start + depth]
            key = node * len(self.letters) + letter
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = (self.keys[at] == key) & (letter >= 0)
            piece = np.where(there, self.piece[self.child[at]], _BEGUN)
            if not depth:
                piece[piece == _BEGUN] = -1  # an unknown character
            met = piece != _BEGUN
            for s in np.unique(start[met]).tolist():
                mine = met & (start == s)
                steps[s, s + depth + 1] = row[mine], piece[mine]
            on = there & (start + depth + 1 < size)
            row, start, node = row[on], start[on], self.child[at[on]]
        sums = np.zeros((size + 1, len(words), self.probs.shape[1]))
        sums[0] = 1.0
        for (begun, end), (rows, pieces) in sorted(steps.items()):
            sums[end, rows] += sums[begun, rows] * self.weights[pieces]
        return sums[size]

    def _scaled(self, edges) -> list[float]:
        """The same sums as logs."""
        rows = np.log(self.rows)
        logs = [np.zeros(self.probs.shape[1])]
        for found in edges:
            logs.append(np.logaddexp.reduce([logs[start] + rows[piece] for start, piece in found]))
        return logs[-1].tolist()

    def _expected_scaled(self, edges, language: int) -> dict[int, float]:
        """`expected` with all sums as logs."""
        weights = [[(s, p, math.log(self.rows[p][language])) for s, p in found] for found in edges]
        forward = [0.0]
        for found in weights:
            forward.append(_log_sum([forward[s] + w for s, _, w in found]))
        back: list[list[float]] = [[] for _ in edges] + [[0.0]]
        uses: dict[int, float] = {}
        for end in range(len(edges), 0, -1):
            after = _log_sum(back[end])
            for start, piece, weight in weights[end - 1]:
                back[start].append(weight + after)
                if piece >= 0:
                    uses[piece] = uses.get(piece, 0.0) + math.exp(forward[start] + weight + after - forward[-1])
        return uses

    def expected(self, word: str, language: int) -> dict[int, float]:
        """Expected uses of each piece in a word of one language."""
        edges = self.edges(word)
        if len(word) > FLOAT_LETTERS:
            return self._expected_scaled(edges, language)
        weights = [[(s, p, self.rows[p][language]) for s, p in found] for found in edges]
        forward = [1.0]
        for found in weights:
            forward.append(sum(forward[s] * w for s, _, w in found))
        back = [0.0] * len(edges) + [1.0]
        uses: dict[int, float] = {}
        for end in range(len(edges), 0, -1):
            for start, piece, weight in weights[end - 1]:
                flow = weight * back[end]
                back[start] += flow
                if piece >= 0:
                    uses[piece] = uses.get(piece, 0.0) + forward[start] * flow / forward[-1]
        return uses


def _count_words(batches):
    for batch in batches:
        rows: dict[tuple[str, str], int] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for w in words(text):
                rows[lang, w] = rows.get((lang, w), 0) + 1
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.string()),
            pa.array(list(rows.values()), pa.int64())], names=["lang", "word", "n"])


def _expect(batches, pieces, probs, languages):
    segmenter = Segmenter(pieces, probs.value)
    place = {name: i for i, name in enumerate(languages)}
    uses: dict[tuple[str, int], float] = {}
    for batch in batches:
        for row in batch.to_pylist():
            for piece, n in segmenter.expected(row["word"], place[row["lang"]]).items():
                key = (row["lang"], piece)
                uses[key] = uses.get(key, 0.0) + n * row["n"]
    yield pa.RecordBatch.from_arrays([
        pa.array([k[0] for k in uses], pa.string()), pa.array([k[1] for k in uses], pa.int32()),
        pa.array(list(uses.values()), pa.float64())], names=["lang", "piece", "uses"])


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS):
    """(languages, pieces, probabilities) from rows with text and a non-null lang.

    Fitted on about `sample_docs` documents per language, those with the lowest hash of text and doc_id;
    the bound is a parameter of the classifier. Words of any length are learnt from. Expected counts
    are at most one row per piece and language. No labelled rows: no languages.
    """
    spark = labelled.sparkSession
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "text", "lang", "doc_id")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages, pieces = sorted(sizes), vocabulary()
    if not languages:
        return [], pieces, np.empty((len(pieces), 0))
    share = F.element_at(
        F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(sample_docs / n))]), F.col("lang"))
    # the id keeps repeated texts from being taken all or not at all
    place = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 20))
    sample = known.filter(place < share * F.lit(1 << 20)).select("text", "lang")
    counted = stored(
        sample.mapInArrow(_count_words, "lang string, word string, n long")
        .groupBy("lang", "word").agg(F.sum("n").alias("n"))
        .repartition(shuffle_partitions(spark)), "language-words")
    probs = np.full((len(pieces), len(languages)), 1 / len(pieces))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(probs)
        uses = counted.mapInArrow(
            partial(_expect, pieces=pieces, probs=shared, languages=languages),
            "lang string, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))
        totals = np.full(probs.shape, SMOOTHING)
        for row in uses.toLocalIterator():
            totals[row.piece, languages.index(row.lang)] += row.uses
        probs = totals / totals.sum(axis=0)
    return languages, pieces, probs


def _predict(batches, model):
    languages, pieces, probs = model.value
    segmenter = Segmenter(pieces, probs)
    known: dict[str, int] = {}  # rows of `values`
    values = np.empty((_REMEMBERED, len(languages)))

    def learn(new: set[str]) -> None:
        listed = sorted(new)
        values[len(known):len(known) + len(listed)] = segmenter.log_likelihoods(listed)
        known.update(zip(listed, range(len(known), len(known) + len(listed))))

    def add_up(parts: list[tuple[np.ndarray, list[str]]]) -> None:
        """Add the log likelihoods of each part's words to its total; words met before are looked up."""
        wanted = set().union(*(part for _, part in parts))
        new = wanted.difference(known)
        if len(known) + len(new) > _REMEMBERED:
            known.clear()
            new = wanted
        learn(new)
        for total, part in parts:
            total += values[[known[w] for w in part]].sum(axis=0)

    def totals(texts) -> Iterator[np.ndarray | None]:
        """Per text the summed log likelihoods of its words (none: null), some `_WORDS_AT_ONCE` words at a time."""
        done: list[np.ndarray | None] = []
        parts: list[tuple[np.ndarray, list[str]]] = []
        held = 0
        for text in texts:
            found = words(text.as_py()) if languages else []
            done.append(np.zeros(len(languages)) if found else None)
            for at in range(0, len(found), _WORDS_AT_ONCE):
                parts.append((done[-1], found[at:at + _WORDS_AT_ONCE]))
                held += len(parts[-1][1])
                if held >= _WORDS_AT_ONCE:
                    add_up(parts)
                    parts, held = [], 0
            if not held:
                yield from done
                done = []
        add_up(parts)
        yield from done

    for batch in batches:
        names, scores = [], []
        for total in totals(batch.column(1)):
            if total is None:
                names.append("und")
                scores.append(0.0)
                continue
            best = int(np.argmax(total))
            names.append(languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
            names=["row", "lang_pred", "score"])


def identify(docs: DataFrame, model) -> DataFrame:
    """`row` (the input row as a struct), lang_pred and score (its posterior) of every row.

    A text that is null, empty or without a letter is `und` with score 0, as is every text if
    the model knows no language. Ties go to the first language by code point.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    fields = rows.select("row", F.col("row.text").alias("text"))
    return fields.mapInArrow(
        partial(_predict, model=shared), f"row {kind}, lang_pred string, score double")
