"""Runs of words that repeat with a period, found by multi-scale minimizers.

A run of period q and at least 4q words holds every window of a scale g (a power of two, g/2 < q
<= g: g/2 grams of g words each) twice, q words apart, so the least gram of a window recurs at
distance q; and as a gram is no shorter than the period, equal grams inside the run lie multiples
of q apart. Neighbouring occurrences of a minimizer at a distance that the scale covers are
therefore seeds, and no run of the scale is without one. A seed is extended word by word in both
directions as far as words that lie its distance apart agree. Periods up to `SHORT` are too short
for windows: there all words are compared directly, one lag after the other.

The texts of an Arrow batch are searched together, up to `AT_ONCE` words, with a word of its own
after each text, so that nothing matches across texts. Words are compared by number, hashes
only order the grams: whatever a hash collision seeds is turned down by the extension.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vocspark.llm.common import map_arrow

SHORT = 8
SHORTEST, REPEATS = 6, 4  # a run has at least 6 words and 4 periods
AT_ONCE = 1 << 20
_STRIDE = 64

SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>, "
    "collapsed string")
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
    ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()),
    ("collapsed_sha256", pa.string()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def needed(period: int) -> int:
    """The least length of a run of this period."""
    return max(SHORTEST, REPEATS * period)


def _slide(values: np.ndarray, window: int, better: np.ufunc) -> np.ndarray:
    """`better` over each window; a power of two wide, so it doubles."""
    width = 1
    while width < window:
        values = better(values[:-width], values[width:])
        width *= 2
    return values


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` (a power of two) consecutive words."""
    found, width = _mixed(words.astype(np.uint64) + np.uint64(1)), 1
    while width < size:
        found = _mixed(found[:-width] * np.uint64(0xD6E8FEB86659FD93) + found[width:])
        width *= 2
    return found


def _seeds(words: np.ndarray, scale: int) -> Iterator[tuple[int, int]]:
    """(place, distance) of neighbouring equal minimizers, by place, whose distance the scale covers."""
    window = scale // 2
    grams = _grams(words, scale)
    least = _slide(grams, window, np.minimum)
    # a gram is a minimizer if it is the least of some window that holds it
    edge = np.zeros(window - 1, np.uint64)
    chosen = np.flatnonzero(grams == _slide(np.concatenate([edge, least, edge]), window, np.maximum))
    order = np.argsort(grams[chosen], kind="stable")
    at, value = chosen[order], grams[chosen][order]
    gap = at[1:] - at[:-1]
    fit = (value[1:] == value[:-1]) & (gap > window) & (gap <= scale)
    places, gaps = at[:-1][fit], gap[fit]
    by_place = np.argsort(places, kind="stable")
    return zip(places[by_place].tolist(), gaps[by_place].tolist())


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values of `a` and `b` agree."""
    total = min(len(a), len(b))
    a, b = a[:total], b[:total]
    done, step = 0, _STRIDE
    while done < total:
        differ = a[done:done + step] != b[done:done + step]
        if differ.any():
            return done + int(differ.argmax())
        done += step
        step *= 2
    return total


def _primitive(run: np.ndarray, period: int) -> bool:
    """Whether no proper divisor of the period is a period of the run too."""
    shorter = (period // f for f in range(2, period + 1) if period % f == 0)
    return not any(np.array_equal(run[:-q], run[q:]) for q in shorter)


def _short_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    found = []
    for period in range(1, SHORT + 1):
        same = np.zeros(max(len(words) - period, 0) + 2, np.int8)
        same[1:-1] = words[:-period] == words[period:]
        turns = np.diff(same)
        starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        long_enough = ends - starts + period >= needed(period)
        for a, b in zip(starts[long_enough].tolist(), ends[long_enough].tolist()):
            if _primitive(words[a:b + period], period):
                found.append((a, b + period, period))
    return found


def _long_runs(words: np.ndarray, scale: int) -> list[tuple[int, int, int]]:
    found, reached = [], {}
    for place, period in _seeds(words, scale):
        if place < reached.get(period, 0):
            continue  # inside the stretch that an earlier seed of this distance led to
        end = place + _agreeing(words[place:], words[place + period:])
        start = place - _agreeing(words[:place][::-1], words[:place + period][::-1][:place])
        reached[period] = end
        if end - start + period >= needed(period) and _primitive(words[start:end + period], period):
            found.append((start, end + period, period))
    return found


def runs(words: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs in `words`; text number i ends before `ends[i]`, at a word of its own."""
    found = _short_runs(words)
    lengths = np.diff(ends, prepend=-1) - 1
    starts = ends - lengths
    scale = 2 * SHORT
    while True:
        enough = lengths >= needed(scale // 2 + 1)
        if not enough.any():
            return sorted(found)
        # only texts long enough for a run of this scale; their own last words keep them apart
        pieces = [(s, e) for s, e in zip(starts[enough].tolist(), ends[enough].tolist())]
        part = np.concatenate([words[s:e + 1] for s, e in pieces])
        if len(pieces) == len(ends):
            found.extend(_long_runs(part, scale))
        else:
            offsets = np.cumsum([0] + [e + 1 - s for s, e in pieces])
            for a, b, period in _long_runs(part, scale):
                i = int(np.searchsorted(offsets, a, side="right")) - 1
                shift = pieces[i][0] - int(offsets[i])
                found.append((a + shift, b + shift, period))
        scale *= 2


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _described(doc_id: int | None, words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    """The row of a text from its words and its runs (start, end, period), by start."""
    listed = [{"start": a, "length": b - a, "period": q} for a, b, q in found]
    kept = words
    if found:
        inside = np.zeros(len(words), bool)
        for a, b, q in found:
            inside[a + q:b] = True
        kept = [w for w, dropped in zip(words, inside.tolist()) if not dropped]
    top = (None,) * 4
    if found:
        a, b, q = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]))
        top = (a, b - a, q, 1000 * (b - a) // q)
    lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in found)
    collapsed = b" ".join(kept)
    return (doc_id, len(found), *top, _sha(lines.encode()), _sha(collapsed), listed, collapsed.decode())


def describe(docs: list[tuple[int | None, list[bytes]]]) -> list[tuple]:
    """The rows of some (doc_id, words)."""
    flat = [w for _, words in docs for w in (*words, b"")]
    coded = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    ends = np.cumsum([len(words) + 1 for _, words in docs]) - 1
    coded[ends] = -1 - np.arange(len(ends))  # unlike any word and one another
    per_doc: list[list] = [[] for _ in docs]
    for a, b, q in runs(coded, ends):
        i = int(np.searchsorted(ends, a))
        start = int(ends[i - 1]) + 1 if i else 0
        per_doc[i].append((a - start, b - start, q))
    return [_described(doc_id, words, found) for (doc_id, words), found in zip(docs, per_doc)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def periodic_runs(docs: DataFrame, rewrite=None) -> DataFrame:
    """One row per row of `docs`: doc_id, n_runs, the longest run, hashes, all runs and the collapsed text.

    Words are what spaces and the control characters 9 to 13 set apart. A run is a maximal stretch of words
    with smallest period q and at least `needed(q)` words; `start`, `length`, `period` and `exponent_milli`
    describe the longest one (ties: smallest start, then period; no run: null). `collapsed` is the text
    without the words that a run holds after its first period, joined by single spaces. `rewrite`,
    a function of (doc_id, words), may change the words of a text first. Null and empty texts have no
    runs and collapse to the empty text; null doc_ids, repeated rows and further columns do not matter;
    an empty table gives an empty result. Nothing is shuffled; a task holds one Arrow batch of texts.
    """

    def run(batches):
        for b in batches:
            waiting, held = [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                if rewrite:
                    words = rewrite(doc_id, words)
                waiting.append((doc_id, words))
                held += len(words)
                if held >= AT_ONCE:
                    yield _batch(describe(waiting))
                    waiting, held = [], 0
            yield _batch(describe(waiting))

    return map_arrow(docs.select("doc_id", "text"), run, SCHEMA)
