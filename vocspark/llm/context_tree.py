"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each a node of the tree under the bytes before it. Every
node has a Krichevsky-Trofimov estimate from its counts, and its weighted probability is
half that estimate and half the product of its children's, up to contexts of `DEPTH` bytes.
Prediction mixes the estimates of all depths with the weights that training left at each node.

Texts are dealt into parts by their id. A part asks only for the words and byte strings it
holds, once each: one compressed message per owner, with its training counts. An owner (of a
share of the pairs of nearest context bytes, or of the words) adds up what the parts send and
answers each in the order it asked. `OWNERS` of each kind bound the messages of a part. Nodes of two and more context bytes are
computed by the owners; those above have at most 256 x 255 nodes, whatever the corpus.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark.llm.common import shuffle_partitions, stored

DEPTH = 6
OWNERS = 64
END_WORD = "\n"
_CHUNK = 1 << 21
_LOG_HALF = math.log(0.5)


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def grams(words: list[bytes]) -> np.ndarray:
    """The context bytes, nearest first, and the byte of every place of a text and its end."""
    data = np.frombuffer(b"\n" * DEPTH + b" ".join(words) + b"\n", np.uint8).astype(np.int64)
    n = len(data) - DEPTH
    out = np.zeros(n, np.int64)
    for k in range(1, DEPTH + 1):
        out = (out << 8) | data[DEPTH - k:DEPTH - k + n]
    return (out << 8) | data[DEPTH:]


def shrink(values: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zlib.compress(planes.tobytes(), 1)


def grow(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


def _lgamma(x: np.ndarray) -> np.ndarray:
    shift = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    y = x + 6
    series = 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - np.log(
        np.where(x < 1e40, shift, 1))


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    small = _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - math.log(math.pi) - _lgamma(n0 + n1 + 1.0)
    return np.where(n0 + n1 > 0, small, 0.0)


def _kt_one(n0, n1):
    return (n1 + 0.5) / (n0 + n1 + 1.0)


_LEVELS = np.arange(8, dtype=np.int64)


def _decisions(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node (1 to 255) and bit of each of a byte's eight decisions: arrays bytes x 8."""
    byte = byte[:, None]
    return (1 << _LEVELS) | (byte >> (8 - _LEVELS)), (byte >> (7 - _LEVELS)) & 1


class Nodes:
    """Nodes of one context length and one decision, of sorted byte strings with counts."""

    def __init__(self, key: np.ndarray, n: np.ndarray, decision: int):
        same = key >> (8 - decision)
        self.first = np.flatnonzero(np.diff(same, prepend=same[0] - 1))
        self.place = np.repeat(np.arange(len(self.first)), np.diff(self.first, append=len(key)))
        self.n1 = np.add.reduceat(n * (key >> (7 - decision) & 1), self.first)
        self.n0 = np.add.reduceat(n, self.first) - self.n1
        self.log_weighted = self.kt = log_kt(self.n0, self.n1)
        self.own = np.ones(len(self.kt))

    def weigh(self, below: np.ndarray) -> None:
        """`below`: sums of the children's log weighted probabilities."""
        self.log_weighted = _LOG_HALF + np.logaddexp(self.kt, below)
        self.own = np.exp(_LOG_HALF + self.kt - self.log_weighted)


class Level:
    """Byte strings of one context length; `up` holds their places in the next shorter level."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        self.key, self.n, self.up = key, n, None
        self.nodes = [Nodes(key, n, j) for j in range(8)]

    def shorter(self) -> Level:
        key, self.up = np.unique((self.key >> 16 << 8) | (self.key & 0xFF), return_inverse=True)
        return Level(key, np.bincount(self.up, self.n, len(key)))


def _levels(key: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels of 2 to DEPTH context bytes of one owner's strings, weighed from the deepest up."""
    levels = [Level(key, n)]
    while len(levels) < DEPTH - 1:
        longer = levels[0]
        levels.insert(0, longer.shorter())
        for nodes, children in zip(levels[0].nodes, longer.nodes):
            parent = nodes.place[longer.up[children.first]]
            nodes.weigh(np.bincount(parent, children.log_weighted, len(nodes.first)))
    return levels


def _merged(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each message's places among an owner's distinct byte strings, these, and their counts."""
    sent = [np.cumsum(grow(m)) for m in table.column("keys").to_pylist()]
    counts = np.concatenate([grow(m) for m in table.column("counts").to_pylist()])
    key, place = np.unique(np.concatenate(sent), return_inverse=True)
    stops = np.cumsum([len(m) for m in sent])
    return np.split(place, stops[:-1]), key, np.bincount(place, counts, len(key))


def _near(table: pa.Table) -> pa.Table:
    """What the levels above need of an owner: per nearest byte, node sums and byte counts."""
    _, key, n = _merged(table)
    top = _levels(key, n)[0]
    byte, near = top.key & 0xFF, top.key >> 16
    slots = [(1 << j) | (byte[nodes.first] >> (8 - j)) for j, nodes in enumerate(top.nodes)]
    slot = np.concatenate([*slots, 256 + byte])
    value = np.concatenate([*(nodes.log_weighted for nodes in top.nodes), top.n])
    near = np.concatenate([*(near[nodes.first] for nodes in top.nodes), near])
    return pa.table({"near": pa.array(near, pa.int32()),
                     "slot": pa.array(slot, pa.int32()), "value": pa.array(value)})


def _upper_levels(rows) -> dict[str, np.ndarray]:
    """Estimates and weights of contexts of one and no byte, as tables by byte and node."""
    sums = np.zeros((256, 512))
    for row in rows:
        sums[row.near, row.slot] = row.value
    node, bit = _decisions(np.arange(256))
    n0, n1 = np.zeros((256, 256)), np.zeros((256, 256))
    for j in range(8):
        for byte in range(256):
            (n1 if bit[byte, j] else n0)[:, node[byte, j]] += sums[:, 256 + byte]
    kt = log_kt(n0, n1)
    weighted = _LOG_HALF + np.logaddexp(kt, sums[:, :256])
    r0, r1 = n0.sum(axis=0), n1.sum(axis=0)
    root_kt = log_kt(r0, r1)
    root = _LOG_HALF + np.logaddexp(root_kt, weighted.sum(axis=0))
    return {"p1": _kt_one(n0, n1), "w1": np.exp(_LOG_HALF + kt - weighted),
            "p0": _kt_one(r0, r1), "w0": np.exp(_LOG_HALF + root_kt - root)}


def _code(table: pa.Table, upper) -> pa.Table:
    """Answers of an owner of byte strings: log10 probability of the last byte of each."""
    places, key, n = _merged(table)
    levels, up = _levels(key, n), upper.value
    near, byte = levels[0].key >> 16, levels[0].key & 0xFF
    value = np.zeros(len(key))
    for j in range(8):
        node = (1 << j) | (byte >> (8 - j))
        w0, w1 = up["w0"][node], up["w1"][near, node]
        one = w0 * up["p0"][node] + (1 - w0) * w1 * up["p1"][near, node]
        left = (1 - w0) * (1 - w1)
        for level, longer in zip(levels, [*levels[1:], None]):
            nodes = level.nodes[j]
            own = nodes.own[nodes.place]
            one = one + left * own * _kt_one(nodes.n0, nodes.n1)[nodes.place]
            left = left * (1 - own)
            if longer:
                one, left = one[longer.up], left[longer.up]
        value += np.log10(np.where(key >> (7 - j) & 1, one, 1 - one))
    return _answers(table, [value[p].astype("<f4").tobytes() for p in places])


def _count(table: pa.Table) -> pa.Table:
    """Answers of an owner of words: the training count of each."""
    sent = [zlib.decompress(m).split(b" ") for m in table.column("keys").to_pylist()]
    total: Counter[bytes] = Counter()
    for mine, counts in zip(sent, table.column("counts").to_pylist()):
        for word, n in zip(mine, grow(counts).tolist()):
            total[word] += n
    answers = _answers(table, [shrink(np.array([total[w] for w in mine])) for mine in sent])
    # the owner's sums stand in its first answer
    rest = [0] * (len(sent) - 1)
    return answers.append_column("n", pa.array([sum(total.values()), *rest], pa.int64())).append_column(
        "v", pa.array([sum(c > 0 for c in total.values()), *rest], pa.int64()))


def _answers(table: pa.Table, values: list[bytes]) -> pa.Table:
    return table.select(["part", "owner", "keys"]).append_column("value", pa.array(values, pa.binary()))


def _messages(part: int, owner: np.ndarray, keys: list[bytes], counts: list[bytes]) -> pa.Table:
    return pa.table({
        "part": pa.array([part] * len(keys), pa.int32()), "owner": pa.array(owner, pa.int32()),
        "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})


def string_owner(keys: np.ndarray) -> np.ndarray:
    """Owner of byte strings: the same for all with the same two nearest context bytes."""
    pair = (keys >> (8 * DEPTH - 8)).astype(np.uint64)
    return (pair * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % OWNERS


def _ask(table: pa.Table) -> pa.Table:
    """Messages of a part. Owners of words are numbered below zero."""
    words: Counter[bytes] = Counter()
    pieces: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[np.ndarray] = []  # twice the string, and one more where it is learnt from
    size = 0

    def fold():
        tagged = np.sort(np.concatenate(held))
        keys = tagged >> 1
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        pieces.append((keys[first], np.add.reduceat(tagged & 1, first)))
        held.clear()

    for text, learn in zip(table.column("text"), table.column("train").to_pylist()):
        found = normal_words(text.as_py())
        words.update(found if learn else dict.fromkeys(found, 0))
        words[END_WORD.encode()] += int(learn)
        held.append(2 * grams(found) + int(learn))
        size += len(held[-1])
        if size > _CHUNK:
            fold()
            size = 0
    if held:
        fold()
    keys, counts = (np.concatenate(x) for x in zip(*pieces))
    if len(pieces) > 1:
        order = np.argsort(keys, kind="stable")  # runs that are sorted already
        first = np.flatnonzero(np.diff(keys[order], prepend=-1))
        keys, counts = keys[order][first], np.add.reduceat(counts[order], first)
    part = table.column("part")[0].as_py()
    owner = string_owner(keys)
    order = np.argsort(owner, kind="stable")
    owner, keys, counts = owner[order], keys[order], counts[order]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    strings = _messages(
        part, owner[first], [shrink(np.diff(k, prepend=0)) for k in np.split(keys, first[1:])],
        [shrink(n) for n in np.split(counts, first[1:])])
    owned: dict[int, list[bytes]] = {}
    for word in sorted(words):
        owned.setdefault(-1 - xxhash.xxh64_intdigest(word) % OWNERS, []).append(word)
    return pa.concat_tables([strings, _messages(
        part, np.array(list(owned)), [zlib.compress(b" ".join(m), 1) for m in owned.values()],
        [shrink(np.array([words[w] for w in m])) for m in owned.values()])])


def _score(texts: pa.Table, answers: pa.Table, total: int, distinct: int) -> pa.Table:
    count: dict[bytes, int] = {}
    strings: list[tuple[np.ndarray, np.ndarray]] = []
    for owner, asked, value in zip(*(answers.column(c).to_pylist() for c in ("owner", "keys", "value"))):
        if owner < 0:
            count.update(zip(zlib.decompress(asked).split(b" "), grow(value).tolist()))
        else:
            strings.append((np.cumsum(grow(asked)), np.frombuffer(value, "<f4")))
    keys = np.concatenate([m[0] for m in strings])
    order = np.argsort(keys)
    keys, logs = keys[order], np.concatenate([m[1] for m in strings])[order].astype(np.float64)
    scale = total + 0.1 * (distinct + 1)
    rows, waiting, held, size = [], [], [], 0

    def score_waiting():
        """Strings of many texts are looked up in order, which reads the keys once through."""
        flat = np.concatenate(held)
        order = np.argsort(flat)
        value = np.empty(len(flat))
        value[order] = logs[np.searchsorted(keys, flat[order])]
        lengths = np.array([len(h) for h in held])
        sums = np.add.reduceat(value, np.cumsum(lengths) - lengths)
        for row, score, length in zip(waiting, sums.tolist(), lengths.tolist()):
            rows.append((*row, score, -score / math.log10(2) / length))
        waiting.clear(), held.clear()

    for doc_id, text, train in zip(
            texts.column("doc_id").to_pylist(), texts.column("text"), texts.column("train").to_pylist()):
        found = normal_words(text.as_py())
        mine = np.array([count[w] for w in [*found, END_WORD.encode()]])
        base = float(np.log10((mine + 0.1) / scale).sum())
        waiting.append((doc_id, not train, len(mine), int((mine > 0).sum()), total, base))
        held.append(grams(found))
        size += len(held[-1])
        if size > _CHUNK:
            score_waiting()
            size = 0
    if held:
        score_waiting()
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 3]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.table(dict(zip(
        ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
         "bits_per_byte"), (pa.array(c, k) for c, k in zip(columns, kinds)))))


def score_texts(docs: DataFrame, train) -> DataFrame:
    """Scores of every row; `train` is the condition of the rows to learn from.

    The scored string is the lower-cased (A-Z) words joined by single spaces, then a line
    end; a null or blank text is the end alone. `score` is its log10 probability (each byte's
    crosses as a 32-bit float), base_score that of the smoothed word counts. Repeated rows are
    scored, and learnt from, each. With no row to learn from, estimates are those of empty nodes.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    dealt = docs.select("doc_id", "text", F.coalesce(train, F.lit(True)).alias("train")).withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shuffle_partitions(spark))).cast("int"))
    asked = stored(dealt.groupBy("part").applyInArrow(
        _ask, "part int, owner int, keys binary, counts binary"), "asked")
    strings = asked.filter("owner >= 0").groupBy("owner")
    reply = "part int, owner int, keys binary, value binary"
    words = stored(asked.filter("owner < 0").groupBy("owner").applyInArrow(
        _count, f"{reply}, n long, v long"), "word-counts")
    known = words.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    near = strings.applyInArrow(_near, "near int, slot int, value double")
    upper = spark.sparkContext.broadcast(_upper_levels(
        near.groupBy("near", "slot").agg(F.sum("value").alias("value")).toLocalIterator()))
    answers = words.drop("n", "v").unionByName(
        strings.applyInArrow(lambda t: _code(t, upper), reply))
    total, distinct = known.n or 0, known.v or 0
    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(
        lambda a, b: _score(a, b, total, distinct),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double, bits_per_byte double")
