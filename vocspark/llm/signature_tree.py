"""Jaccard join of documents by their sets of word shingles, with signature trees.

A tree is built over sets that may be similar. Its leaves hold one set each: a bitmap of its
shingles, its size and how many of its shingles occur in another set of the tree at all. Inner nodes hold
the OR of their children's bitmaps and the ranges of the numbers. Two nodes can only hold a similar
pair if the overlap that their bitmaps and counts admit reaches what the smallest sizes below them
ask for, so a dual traversal starts with the root against itself and goes down where that holds
and where not all sets below are linked already. What is left at the leaves is compared exactly.

Which sets share a tree is found exactly, too. Of a set's `p = n - ceil(0.8 n) + 1` rarest
shingles, in one order for all sets, a similar set shares at least one. Every task sends the owners
of hash ranges its shingles in packed messages; owners answer with those that occur more than once and how
often, so that boilerplate comes last in the order. Half of all shingles (by hash) are ordered
by frequency; the rest follow in hash order, listed only by sets that need them for their p. Sets
connected by such shared shingles form a candidate component. Small components are packed
together into tasks by their number of shingles; a large one is dealt over as many tasks as it needs,
each with the component's centres, and what this leaves outside the largest cluster then
meets every block of its component. No list of pairs is ever held.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark.llm.common import attach, map_arrow, stored
from vocspark.llm.near_dedup import components

SHINGLE = 5
PERCENT = 80
CHUNK_TOKENS = 1 << 21  # shingles that a task gathers before it sends messages
OWNER_TOKENS = 1 << 21  # shingles that an owner gets, on average
BLOCK_TOKENS = 1 << 19  # shingles of the sets that one tree gathers, but for single larger sets
CENTRES = 8
LEAF_FANOUT = 8
PAIRS_AT_ONCE = 1 << 14
_SEED = 42
_ODD = np.random.default_rng(11).integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


def least_overlap(size):
    """How much of a set of this size any similar set must share."""
    return (size * PERCENT + 99) // 100


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts; words are hashed once per task."""

    remembered = 1 << 19

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) > self.remembered:
                known.clear()
                new = set(words)
            known.update((w, xxhash.xxh64_intdigest(w, _SEED)) for w in new)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(words) < SHINGLE:
            return _mixed((hashes * _ODD[:len(words)]).sum(keepdims=True) + np.uint64(len(words)))
        grams = hashes[:len(words) - SHINGLE + 1] * _ODD[0]
        for i in range(1, SHINGLE):
            grams += hashes[i:len(words) - SHINGLE + 1 + i] * _ODD[i]
        return np.unique(_mixed(grams))


def set_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (binary), key (128 bits that stand for the set; null: empty) and n (its size) of every row."""

    def run(batches):
        shingles = Shingler()
        for b in batches:
            keys, sizes = [], []
            for text in b.column(1).to_pylist():
                found = shingles(text)
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sizes.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())],
                names=["doc_id", "text_hash", "key", "n"])

    hashed = docs.select("doc_id", "text", F.unhex(F.md5("text")).alias("text_hash"))
    return map_arrow(hashed, run, "doc_id long, text_hash binary, key binary, n long")


# ---- shared shingles -------------------------------------------------------

def listed(shingles: np.ndarray) -> np.ndarray:
    """The half that is ordered by frequency, and of the others as many as the set's prefix still needs."""
    first = shingles[(shingles & np.uint64(1)) == 0]
    short = len(shingles) - least_overlap(len(shingles)) + 1 - len(first)
    if short <= 0:
        return first
    return np.concatenate([first, shingles[(shingles & np.uint64(1)) == 1][:short]])


def _messages(bits: int):
    """Packed shingles by owner, the leading `bits` of their hash; owner -1: the sets of the chunk."""
    schema = pa.schema([
        ("chunk", pa.int64()), ("owner", pa.int32()), ("tokens", pa.binary()), ("sets", pa.binary())])

    def packed(chunk, keys, sizes, lists):
        counts = np.fromiter(map(len, lists), np.uint32, len(lists))
        tokens = np.concatenate(lists)
        places = np.repeat(np.arange(len(lists), dtype=np.uint32), counts)
        order = np.argsort(tokens)
        tokens, places = tokens[order], places[order]
        owner = (tokens >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(tokens), np.int64)
        cuts = np.flatnonzero(np.diff(owner)) + 1
        low = ((tokens >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        rows = [{"chunk": chunk, "owner": -1, "tokens": b"".join(keys),
                 "sets": np.array([sizes, counts], np.uint32).tobytes()}]
        for t, p, o in zip(np.split(low, cuts), np.split(places, cuts), owner[np.r_[0, cuts]].tolist()):
            rows.append({"chunk": chunk, "owner": o, "tokens": t.tobytes(), "sets": p.tobytes()})
        return pa.RecordBatch.from_pylist(rows, schema)

    def run(batches):
        shingles, seen, number = Shingler(), {}, TaskContext.get().partitionId() << 32
        sizes, lists, held = [], [], 0
        for b in batches:
            for text in b.column(0).to_pylist():
                found = shingles(text)
                key = xxhash.xxh3_128_digest(found.tobytes())
                if not len(found) or key in seen:
                    continue
                seen[key] = None
                sizes.append(len(found))
                lists.append(listed(found))
                held += len(lists[-1])
                if held >= CHUNK_TOKENS:
                    yield packed(number, seen, sizes, lists)
                    number, seen, sizes, lists, held = number + 1, {}, [], [], 0
        if lists:
            yield packed(number, seen, sizes, lists)

    return run


def _answers(table: pa.Table) -> pa.Table:
    """For one owner: per chunk the shingles that occur more than once, with their number."""
    tokens = [np.frombuffer(t, np.uint32) for t in table["tokens"].to_pylist()]
    _, place, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    many = np.minimum(count, 0xFFFF).astype(np.uint16)[place]
    rows, start = [], 0
    for chunk, owner, own, sets in zip(
            table["chunk"].to_pylist(), table["owner"].to_pylist(), tokens, table["sets"].to_pylist()):
        mine = many[start:start + len(own)]
        start += len(own)
        shared = mine > 1
        rows.append((chunk, owner, own[shared].tobytes(), np.frombuffer(sets, np.uint32)[shared].tobytes(),
                     mine[shared].tobytes()))
    chunks, owners, values, sets, counts = zip(*rows)
    return pa.table({
        "chunk": pa.array(chunks, pa.int64()), "owner": pa.array(owners, pa.int32()),
        "tokens": pa.array(values, pa.binary()), "sets": pa.array(sets, pa.binary()),
        "counts": pa.array(counts, pa.binary())})


def _prefixes(table: pa.Table) -> pa.Table:
    """Of a chunk's sets, those with shared shingles among their p rarest: key, n and these shingles."""
    head, tokens, places, counts = None, [], [], []
    for row in table.to_pylist():
        if row["owner"] < 0:
            head = row
            continue
        tokens.append(np.frombuffer(row["tokens"], np.uint32).astype(np.int64) | row["owner"] << 32)
        places.append(np.frombuffer(row["sets"], np.uint32))
        counts.append(np.frombuffer(row["counts"], np.uint16))
    keys = head["tokens"]
    sizes, lengths = np.frombuffer(head["sets"], np.uint32).reshape(2, -1).astype(np.int64)
    out = [], [], []
    if tokens:
        tokens, places, counts = map(np.concatenate, (tokens, places, counts))
        order = np.lexsort((tokens, counts, places))
        tokens, shared = tokens[order], np.bincount(places, minlength=len(sizes))
        starts = np.cumsum(shared) - shared
        wanted = np.minimum(sizes - least_overlap(sizes) + 1 - (lengths - shared), shared)
        for i in np.flatnonzero(wanted > 0).tolist():
            out[0].append(keys[16 * i:16 * i + 16])
            out[1].append(int(sizes[i]))
            out[2].append(tokens[starts[i]:starts[i] + wanted[i]])
    return pa.table({
        "key": pa.array(out[0], pa.binary()), "n": pa.array(out[1], pa.int64()),
        "tokens": pa.array(out[2], pa.list_(pa.int64()))})


def candidate_sets(docs: DataFrame) -> DataFrame:
    """id, key, n and tokens of the distinct sets that may be similar to another: tokens are what they share."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # some six bytes a word, half of the shingles listed
    bits = min(max(size // 12 // OWNER_TOKENS, 0).bit_length(), 30)
    sent = stored(
        map_arrow(docs.select("text"), _messages(bits), "chunk long, owner int, tokens binary, sets binary"),
        "shingle-messages")
    answers = sent.filter("owner >= 0").groupBy("owner").applyInArrow(
        _answers, "chunk long, owner int, tokens binary, sets binary, counts binary")
    heads = sent.filter("owner < 0").withColumn("counts", F.lit(None).cast("binary"))
    found = heads.unionByName(answers).groupBy("chunk").applyInArrow(
        _prefixes, "key binary, n long, tokens array<long>")
    return stored(
        found.dropDuplicates(["key"]).withColumn("id", F.monotonically_increasing_id()), "candidate-sets")


# ---- the tree --------------------------------------------------------------

class Labels:
    """Union-find over set numbers."""

    def __init__(self, start: np.ndarray):
        _, first, place = np.unique(start, return_index=True, return_inverse=True)
        self.up = first[place]

    def roots(self, of: np.ndarray) -> np.ndarray:
        up = self.up[of]
        while not np.array_equal(up, above := self.up[up]):
            up = above
        self.up[of] = up
        return up

    def root(self, i: int) -> int:
        while self.up[i] != i:
            i = int(self.up[i])
        return i


class SignatureTree:
    """Sets (sorted hashes, sizes) in a tree; `links` walks it against itself."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, start: np.ndarray):
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count > 1  # a shingle of one set alone overlaps with nothing
        inside = shared[code]
        code, row = (np.cumsum(shared) - 1)[code[inside]], row[inside]
        weight = np.bincount(row, count[shared][code], len(sets))
        n = np.bincount(row, minlength=len(sets))
        # sets that could be similar to another, neighbours in the tree being of one size
        able = np.flatnonzero(n >= least_overlap(sizes))
        self.ids = able[np.lexsort((n[able], sizes[able]))]
        place = np.full(len(sets), -1)
        place[self.ids] = np.arange(len(self.ids))
        keep = place[row] >= 0
        order = np.argsort(place[row[keep]], kind="stable")
        self.codes, rows = code[keep][order], place[row[keep]][order]
        self.n, self.size, self.weight = n[self.ids], sizes[self.ids], weight[self.ids]
        self.begin = np.cumsum(self.n) - self.n
        self.different = int(shared.sum())
        self.labels = Labels(start[self.ids]) if len(self.ids) else None
        self.found: list[tuple[int, int]] = []
        if len(self.ids) > 1:
            self._grow(rows)

    def _grow(self, rows: np.ndarray) -> None:
        width = min(max(1 << int(4 * self.n.mean()).bit_length(), 64), 1 << 16)
        bit = (_mixed(self.codes.astype(np.uint64)) % np.uint64(width)).astype(np.int64)
        maps = np.zeros((len(self.ids), width // 64), np.uint64)
        np.bitwise_or.at(maps, (rows, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        slack = self.n - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)  # shingles that share a bit
        # per level: bitmaps, least size, most shared shingles, most slack
        self.levels = [(maps, self.size, self.n, slack)]
        while len(self.levels[-1][0]) > 1:
            maps, least, most, slack = self.levels[-1]
            cuts = np.arange(0, len(maps), LEAF_FANOUT)
            self.levels.append((
                np.bitwise_or.reduceat(maps, cuts), np.minimum.reduceat(least, cuts),
                np.maximum.reduceat(most, cuts), np.maximum.reduceat(slack, cuts)))

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which node pairs may hold two similar sets."""
        maps, least, most, slack = self.levels[level]
        # overlap c of sizes x and y is enough if 100 c >= 80 (x + y - c)
        asked = (100 + PERCENT) * np.minimum(most[a], most[b]) >= PERCENT * (least[a] + least[b])
        # and no less than 80 % of either
        asked &= 100 * np.minimum(most[a], most[b]) >= PERCENT * np.maximum(least[a], least[b])
        keep = np.flatnonzero(asked)
        common = np.bitwise_count(maps[a[keep]] & maps[b[keep]]).sum(axis=1, dtype=np.int64)
        common += np.minimum(slack[a[keep]], slack[b[keep]])
        asked[keep] = (100 + PERCENT) * common >= PERCENT * (least[a[keep]] + least[b[keep]])
        return asked

    def _compare(self, i: int, others: np.ndarray) -> None:
        """Link set `i` with those of `others` that are similar, exactly."""
        mark = self.mark
        own = self.codes[self.begin[i]:self.begin[i] + self.n[i]]
        mark[own] = True
        lengths = self.n[others]
        ends = np.cumsum(lengths)
        flat = np.arange(ends[-1]) + np.repeat(self.begin[others] - (ends - lengths), lengths)
        overlap = np.add.reduceat(mark[self.codes[flat]].astype(np.int64), ends - lengths)
        mark[own] = False
        similar = 100 * overlap >= PERCENT * (self.size[i] + self.size[others] - overlap)
        for j in others[similar].tolist():
            x, y = self.labels.root(i), self.labels.root(j)
            if x != y:
                self.labels.up[max(x, y)] = min(x, y)
                self.found.append((int(self.ids[i]), int(self.ids[j])))

    def _several(self, i: int, others: np.ndarray) -> None:
        others = others[self.labels.roots(others) != self.labels.root(i)]
        for at in range(0, len(others), PAIRS_AT_ONCE >> 4):
            self._compare(i, others[at:at + (PAIRS_AT_ONCE >> 4)])

    def _uniform(self) -> list[np.ndarray]:
        """Per level: the label that all sets below a node have, or -1 less its number."""
        low = high = self.labels.roots(np.arange(len(self.ids)))
        out = [low]
        for _ in self.levels[1:]:
            cuts = np.arange(0, len(low), LEAF_FANOUT)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            out.append(np.where(low == high, low, -1 - np.arange(len(low))))
        return out

    def links(self) -> list[tuple[int, int]]:
        """Links between set numbers that join all similar sets, beside those that `start` joins."""
        if len(self.ids) < 2:
            return []
        self.mark = np.zeros(self.different, bool)
        everyone = np.arange(len(self.ids))
        for _ in range(min(CENTRES, len(self.ids) // 4)):
            roots = self.labels.roots(everyone)
            outside = np.flatnonzero(roots != np.bincount(roots).argmax()) if self.found else everyone
            if not len(outside):
                break
            centre = int(outside[self.weight[outside].argmax()])
            partners = everyone[everyone != centre]
            self._several(centre, partners[self._possible(0, np.full(len(partners), centre), partners)])
            self.weight[centre] = 0
        uniform, known = self._uniform(), len(self.found)
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if len(self.found) > known:
                uniform, known = self._uniform(), len(self.found)
            label = uniform[level]
            keep = (a == b) | (label[a] != label[b])
            keep &= (a != b) | (label[a] < 0) if level else a != b
            a, b = a[keep], b[keep]
            keep = self._possible(level, a, b)
            a, b = a[keep], b[keep]
            if not level:
                cuts = np.flatnonzero(np.diff(a)) + 1 if len(a) else []
                for i, js in zip(a[np.r_[0, cuts].astype(int)].tolist() if len(a) else [], np.split(b, cuts)):
                    self._several(i, js)
                continue
            below = len(self.levels[level - 1][0])
            step = np.arange(LEAF_FANOUT)
            left = np.repeat(a * LEAF_FANOUT, LEAF_FANOUT ** 2) + np.tile(np.repeat(step, LEAF_FANOUT), len(a))
            right = np.repeat(b * LEAF_FANOUT, LEAF_FANOUT ** 2) + np.tile(step, len(a) * LEAF_FANOUT)
            fit = (left <= right) & (right < below)
            left, right = left[fit], right[fit]
            order = np.lexsort((right, left))
            for at in range(0, len(order), PAIRS_AT_ONCE):
                part = order[at:at + PAIRS_AT_ONCE]
                stack.append((level - 1, left[part], right[part]))
        return self.found


def similar_links(sets: list[np.ndarray], start: np.ndarray | None = None) -> list[tuple[int, int]]:
    sizes = np.array([len(s) for s in sets], np.int64)
    return SignatureTree(sets, sizes, np.arange(len(sets)) if start is None else start).links()


def _walk(table: pa.Table) -> pa.Table:
    """Links (u, v), u > v, of the sets of one task: comp, id, label, key, text."""
    shingles, us, vs = Shingler(), [], []
    comps = np.array(table["comp"].to_pylist())
    order = np.argsort(comps, kind="stable")
    ids, labels = table["id"].to_numpy(), table["label"].to_numpy()
    keys, texts = table["key"].to_pylist(), table["text"]
    for part in np.split(order, np.flatnonzero(np.diff(comps[order])) + 1):
        # a centre may be in its block already
        first = part[np.unique(ids[part], return_index=True)[1]]
        sets, kept = [], []
        for i in first.tolist():
            found = shingles(texts[i].as_py())
            if xxhash.xxh3_128_digest(found.tobytes()) == keys[i]:
                sets.append(found)
                kept.append(i)
        kept = np.array(kept)
        if len(kept) < 2:
            continue
        for x, y in similar_links(sets, labels[kept]):
            u, v = int(ids[kept[x]]), int(ids[kept[y]])
            us.append(max(u, v))
            vs.append(min(u, v))
    return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})


# ---- candidate components and their tasks ----------------------------------

def _rooted(nodes: DataFrame, tree: DataFrame, name: str) -> DataFrame:
    """`nodes` with the least node of their component."""
    roots = tree.select(F.col("u").alias("id"), F.col("v").alias(name))
    return nodes.join(roots, "id", "left").withColumn(name, F.coalesce(name, "id"))


def candidate_components(sets: DataFrame) -> DataFrame:
    """id, key, n, weight and comp of the sets that are connected to another by a shared token."""
    entries = stored(sets.select("id", F.explode("tokens").alias("token")), "candidate-entries")
    groups = stored(
        entries.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("v")).filter("size > 1"),
        "candidate-groups")
    met = stored(attach(entries, groups, "token", "size").select("id", "v", "size"), "candidate-met")
    edges = met.filter("id > v").select(F.col("id").alias("u"), "v").distinct()
    weights = met.groupBy("id").agg(F.sum("size").alias("weight"))
    members = sets.select("id", "key", "n").join(weights, "id")
    return stored(_rooted(members, components(edges), "comp"), "candidate-members")


def _fetched(docs: DataFrame, rows: DataFrame, members: DataFrame) -> DataFrame:
    """`members` with the text of one document each."""
    texts = rows.groupBy("key").agg(F.min("text_hash").alias("text_hash")).join(
        members.select("key", "id"), "key").select("id", "text_hash")
    copies = rows.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies"))
    wanted = stored(texts.join(copies, "text_hash"), "wanted-texts")
    found = attach(
        docs.select("text", F.unhex(F.md5("text")).alias("text_hash")), wanted, "text_hash", "copies", "merge")
    return members.join(found.groupBy("id").agg(F.first("text").alias("text")), "id")


def _each(count: str):
    """A row for each number below `count`."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))


def join_links(docs: DataFrame, rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between ids of `sets` that join all similar ones."""
    members = candidate_components(sets)
    comps = stored(
        members.groupBy("comp").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("sets")), "candidate-comps")
    total = comps.agg(F.sum("tokens")).first()[0] or 0
    comps = comps.withColumn("blocks", F.ceil(F.col("tokens") / BLOCK_TOKENS))
    members = stored(
        attach(_fetched(docs, rows, members), comps, "comp", "sets").withColumn("label", F.col("id")),
        "candidate-texts")
    tasks = total // BLOCK_TOKENS + 1
    cell = F.when(F.col("blocks") == 1, F.struct(
        F.lit(-1).cast("long").alias("comp"), F.pmod(F.xxhash64("comp"), F.lit(tasks)).alias("block")))
    cell = cell.otherwise(F.struct("comp", F.pmod(F.xxhash64("id"), "blocks").alias("block")))
    columns = ["comp", "id", "label", "key", "text"]
    whole = members.select(cell.alias("cell"), *columns)
    large = members.filter("blocks > 1")
    salted = large.groupBy("comp", F.pmod(F.xxhash64("id"), F.lit(CENTRES)).alias("salt")).agg(
        F.max(F.struct("weight", "id")).alias("best"), F.first("blocks").alias("blocks"))
    centres = salted.select(F.col("best.id").alias("id"), "blocks")
    spread = large.drop("blocks").join(centres, "id").select(_each("blocks").alias("block"), *columns)
    spread = spread.select(F.struct("comp", "block").alias("cell"), *columns)
    first = stored(
        whole.unionByName(spread).groupBy("cell").applyInArrow(_walk, "u long, v long"), "tree-links")
    if large.isEmpty():
        return first
    return first.unionByName(_outsiders(large, first, columns))


def _outsiders(large: DataFrame, first: DataFrame, columns: list[str]) -> DataFrame:
    """Links of sets outside the largest cluster of a component that was dealt over several tasks."""
    large = large.select("comp", "id", "key", "n", "text", "blocks")
    labelled = stored(_rooted(large, components(first), "label"), "labelled-sets")
    clusters = labelled.groupBy("comp", "label").agg(
        F.count(F.lit(1)).alias("members"), F.sum("n").alias("tokens"), F.first("blocks").alias("blocks"))
    rest = clusters.groupBy("comp").agg(
        F.max(F.struct("members", "label")).alias("most"), F.sum("members").alias("sets"),
        F.sum("tokens").alias("tokens"), F.max_by("tokens", F.struct("members", "label")).alias("inside"),
        F.first("blocks").alias("all_blocks"))
    rest = stored(rest.select(
        "comp", "sets", F.col("most.label").alias("main"), "all_blocks",
        F.ceil((F.col("tokens") - F.col("inside")) / BLOCK_TOKENS).alias("out_blocks")).filter("out_blocks > 0"),
        "outsider-comps")
    meant = attach(labelled.drop("blocks"), rest, "comp", "sets")
    place = F.pmod(F.xxhash64("id"), "all_blocks")
    out_place = F.pmod(F.xxhash64("id", F.lit(1)), "out_blocks")

    def dealt(rows, block, out_block):
        rows = rows.withColumn("block", block).withColumn("out_block", out_block)
        return rows.select(F.struct("comp", "block", "out_block").alias("cell"), *columns)

    outside = meant.filter("label <> main")
    cells = dealt(meant, place, _each("out_blocks")).unionByName(dealt(outside, _each("all_blocks"), out_place))
    return stored(cells.groupBy("cell").applyInArrow(_walk, "u long, v long"), "outsider-links")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Two documents link when the sets of their 5-word shingles (words lower-cased A-Z, what spaces and control
    characters 9 to 13 set apart; fewer words: the whole sequence) have a Jaccard similarity of at
    least `PERCENT` / 100. `component_id` is the smallest doc_id reachable by links, null only
    if all reachable ones are null. Null texts and texts without words have no shingles and link with nothing:
    their component is their own doc_id. Repeated rows and equal texts link like any others; rows that
    share a doc_id are told apart. Sets are compared by 64-bit shingle hashes and known by 128 bits.
    An empty table gives an empty result; further columns play no part.
    """
    rows = stored(set_keys(docs), "set-keys")
    empty = rows.filter("key IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    rows = rows.filter("key IS NOT NULL")
    sets = candidate_sets(docs)
    keys = stored(
        rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "distinct-sets")
    tree = stored(components(join_links(docs, rows, sets)), "link-trees")
    linked = stored(
        _rooted(sets.select("id", "key"), tree, "root").join(keys, "key"), "linked-sets")
    roots = stored(
        linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("sets")), "link-roots")
    named = attach(linked.select("key", "root"), roots, "root", "sets").select("key", "component_id")
    labels = stored(
        keys.join(named.withColumn("found", F.lit(True)), "key", "left").select(
            "key", "copies", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("first")).alias("component_id")),
        "set-labels")
    joined = attach(rows, labels, "key", "copies").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id")
    return joined.unionByName(empty)
