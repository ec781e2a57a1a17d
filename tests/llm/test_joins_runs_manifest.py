"""Signature-tree join, periodic runs and Merkle manifest against brute force, odd rows included."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vocspark.llm import merkle, periodic, registry, signature_tree

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, tree string, lo int"
LONG = " ".join(f"w{i * i % 977}" for i in range(3000))
FAMILY = [
    (100 + i, " ".join(f"x{i}" if (j * 7 + i * 3) % 97 == 0 else f"t{j}" for j in range(60 + i % 5)), "en", "f")
    for i in range(60)]
ODD = [
    (1, "the cat sat on the mat and slept", "en", "a"), (2, "THE cat  sat on the mat\tand slept", "en", "a"),
    (2, "THE cat  sat on the mat\tand slept", "en", "a"), (3, None, "en", "b"), (4, "", None, None),
    (5, " \t\n ", "fr", "b"), (None, "le chat est sur la table", "fr", None), (None, "le chat est sur la table", "fr", None),
    (None, "un autre texte sans id ici", None, None), (7, None, None, "c"), (8, "a", "d:e", "c"), (8, "b c", "d:e", "c"),
    (9, "A", "", "-"), (10, LONG, "fr", "a"), (11, LONG + " z", "fr", "a"), (12, "x" * 50000, "en", "a"),
    (13, "mot " * 30000, "fr", "a"), (14, "é è\x1c漢 İ", "zz", "é"), *FAMILY,
]


def frame(spark, rows):
    filled = [(*r, None if r[0] == 5 else len(r[1] or ""), 3, "clash", "clash", 4) for r in rows]
    return spark.createDataFrame(filled, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SMALL}/documents.parquet' ORDER BY 1")
    return rows.fetchall()


@pytest.fixture(scope="module", params=["odd", "small", "empty", "one"])
def corpus(request, spark, texts):
    rows = {"odd": ODD, "small": texts, "empty": [], "one": ODD[:1]}[request.param]
    return frame(spark, rows), rows


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def words_of(text):
    return (text or "").encode().split()


# ---- Jaccard join ----------------------------------------------------------

def shingles(text):
    words = words_of((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*(words[i:] for i in range(5))))


def linked(sets):
    """A label per set, equal where links lead from one to the other."""
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both and 100 * both >= 80 * len(a | b):
                up[root(i)] = root(j)
    return [root(i) for i in range(len(sets))]


def brute_join(rows):
    sets = [shingles(r[1]) for r in rows]
    labels, least = linked(sets), {}
    for (d, *_), label in zip(rows, labels):
        if d is not None:
            least[label] = min(d, least.get(label, d))
    return sorted(
        ((d, len(s), least.get(label) if s else d) for (d, *_), s, label in zip(rows, sets, labels)), key=repr)


COLUMNS = ("doc_id", "n_shingles", "component_id")


def test_jaccard_join(corpus):
    docs, rows = corpus
    assert got(signature_tree.jaccard_join(docs), *COLUMNS) == brute_join(rows)


def test_large_components_are_dealt_over_tasks(spark, monkeypatch):
    """With blocks of a few sets, links between blocks are found by centres and outsiders."""
    monkeypatch.setattr(signature_tree, "BLOCK_TOKENS", 300)
    rng = random.Random(4)
    rows = list(FAMILY)
    for base in range(3):
        text = [f"b{base}-{j}" for j in range(80)]
        for i in range(40):
            edited = list(text)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(80)] = f"e{rng.randint(0, 200)}"
            rows.append((1000 + 100 * base + i, " ".join(edited), "en", "f"))
    assert got(signature_tree.jaccard_join(frame(spark, rows)), *COLUMNS) == brute_join(rows)


@pytest.mark.parametrize("seed", range(40))
def test_tree_links_what_brute_force_links(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(signature_tree, "PAIRS_AT_ONCE", rng.choice([64, 1 << 14]))
    bases = [rng.sample(range(10**6), rng.randint(1, 120)) for _ in range(rng.randint(1, 4))]
    sets = set()
    for _ in range(rng.randint(1, 80)):
        base = list(rng.choice(bases))
        for _ in range(int(len(base) * rng.choice([0, .05, .1, .15, .2, .3]))):
            base[rng.randrange(len(base))] = rng.randrange(10**6) if rng.random() < .6 else rng.randrange(40)
        sets.add(frozenset(base[:max(1, int(len(base) * rng.choice([1, .9])))]))
    sets = sorted(sets, key=sorted)
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    found = signature_tree.similar_links([np.array(sorted(s), np.uint64) for s in sets])
    for a, b in found:
        assert 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
        assert root(a) != root(b)
        up[root(a)] = root(b)
    want = linked(sets)
    for i in range(len(sets)):
        for j in range(i):
            assert (want[i] == want[j]) == (root(i) == root(j))


def test_unlike_edits_of_one_text_are_not_compared_in_pairs(monkeypatch):
    """A family whose members share under 80 % with one another: the root already tells."""
    compared = []
    monkeypatch.setattr(signature_tree.SignatureTree, "_compare", lambda self, i, others: compared.extend(others))
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    for size in (100, 200, 400):
        sets = []
        for _ in range(size):
            edit = base.copy()
            edit[rng.choice(300, 50, replace=False)] = rng.integers(0, 1 << 60, 50)
            sets.append(np.unique(edit))
        assert signature_tree.similar_links(sets) == [] and not compared


# ---- periodic runs ---------------------------------------------------------

def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            w = words[a:i + q]
            if i > a and len(w) >= max(6, 4 * q) and not any(w[r:] == w[:-r] for r in range(1, q)):
                out.append((a, len(w), q))
            i += i == a
    return sorted(out)


def brute_row(doc_id, words):
    found = brute_runs(words)
    dropped = {i for a, length, q in found for i in range(a + q, a + length)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    top = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    lines = "".join(f"{a},{length},{q}\n" for a, length, q in found).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *top, hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest())


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@pytest.mark.parametrize("seed", range(60))
def test_runs(seed):
    """Periods at and around the scales' bounds, small and large alphabets, runs that touch."""
    rng = random.Random(seed)

    def some(n):
        top = rng.choice([0, 1, 2, 5, 1000])
        return [b"w%d" % rng.randint(0, top) for _ in range(n)]

    docs = []
    for d in range(rng.randint(1, 6)):
        words = []
        for _ in range(rng.randint(0, 6)):
            piece = some(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 18, 31, 32, 33, 40]))
            words += some(rng.randint(0, 60)) if rng.random() < .5 else (piece * 8)[:rng.randint(1, len(piece) * 7)]
        docs.append((d, words))
    assert [r[:8] for r in periodic.describe(docs)] == [brute_row(d, w) for d, w in docs]


def test_long_period():
    words = [b"%d" % (i * 7919 % 100_003) for i in range(5000)] * 4
    (row,) = periodic.describe([(1, [b"a", *words, b"b"])])
    assert row[1:6] == (1, 1, 20000, 5000, 4000)


def test_periodic_runs(corpus):
    docs, rows = corpus
    made = periodic.periodic_runs(docs)
    lone = (13, 1, 0, 30000, 1, 30_000_000, *(hashlib.sha256(x).hexdigest() for x in (b"0,30000,1\n", b"mot")))
    want = [lone if (t or "").startswith("mot mot") else brute_row(d, words_of(t)) for d, t, *_ in rows]
    assert got(made, *RUN_COLUMNS) == sorted(want, key=repr)
    for r in made.filter("n_runs > 0").collect():
        assert [(x.start, x.length, x.period) for x in r.runs] and hashlib.sha256(
            r.collapsed.encode()).hexdigest() == r.collapsed_sha256


def test_periodic_query(spark, texts):
    def planted(d, words):
        h, n = zlib.crc32(str(d).encode()), len(words)
        g = h // 10
        if h % 10 or not n:
            return words
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [words[i if i < a else a + (i - a) % p] for i in range(n)]

    result = registry.op12_periodic_runs(spark, SMALL)
    assert result.columns == list(RUN_COLUMNS)
    assert [t for c, t in result.dtypes] == ["bigint"] * 6 + ["string"] * 2
    want = sorted((brute_row(d, planted(d, words_of(t))) for d, t, *_ in texts), key=repr)
    assert got(result, *RUN_COLUMNS) == want and any(r[1] for r in want)
    assert registry.planted_period(None, [b"a"] * 9) is not None


# ---- Merkle manifest -------------------------------------------------------

def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    d, _, lang, source, n_chars = row
    shown = (d, source, lang, n_chars, text)
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in shown))


def climb(hashes, fanout):
    """The root, and per node the (left, right) siblings on the way to it."""
    paths, level, at = [[] for _ in hashes], list(hashes), list(range(len(hashes)))
    while len(level) > 1:
        groups = [level[i:i + fanout] for i in range(0, len(level), fanout)]
        for path, i in zip(paths, at):
            group, j = groups[i // fanout], i % fanout
            path.append(("".join(group[:j]), "".join(group[j + 1:])))
        level, at = [digest(*g) for g in groups], [i // fanout for i in at]
    return level[0], paths


def brute_manifest(rows, tampered, fanout=8):
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append((row[0] is not None, row[0] or 0, leaf(row, row[1]), row))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for lang in langs:
        trees[lang].sort(key=lambda x: x[:3])
        built[lang] = climb([x[2] for x in trees[lang]], fanout)
    root, tops = climb([built[lang][0] for lang in langs], fanout) if langs else (None, [])
    out = []
    for lang, top in zip(langs, tops):
        subroot, paths = built[lang]
        for (_, _, own, row), path in zip(trees[lang], paths):
            fold = leaf(row, tampered(row))
            for left, right in path + top:
                fold = digest(left, fold, right)
            proof = digest(*(left + right for left, right in path + top))
            out.append((row[0], own, subroot, root, proof, fold, fold == root))
    return sorted(out, key=repr)


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def with_sizes(rows):
    return [(*r, None if r[0] == 5 else len(r[1] or "")) for r in rows]


@pytest.mark.parametrize("fanout", [8, 2])
def test_manifest(corpus, fanout):
    docs, rows = corpus
    claimed = F.when(F.col("doc_id") % 2 == 0, F.lower("text")).otherwise(F.col("text"))
    want = brute_manifest(
        with_sizes(rows), lambda r: r[1].lower() if r[1] and r[0] is not None and r[0] % 2 == 0 else r[1], fanout)
    assert got(merkle.manifest(docs, claimed, fanout), *MANIFEST) == want


@pytest.mark.parametrize("count", [1, 8, 9, 64, 65])
def test_manifest_at_full_levels(spark, count):
    rows = [(i, f"T{i}", "en", "s") for i in range(count)]
    found = merkle.manifest(frame(spark, rows))
    assert got(found, *MANIFEST) == brute_manifest(with_sizes(rows), lambda r: r[1])
    assert found.filter("NOT verified").isEmpty()


def test_manifest_query(spark, texts):
    made = {r.doc_id: r for r in registry.op13_merkle_manifest(spark, SMALL).collect()}
    changed = {
        d for d, t, *_ in texts if zlib.crc32(str(d).encode()) % 3 == 0
        and t and any("A" <= c <= "Z" for c in t)}
    assert changed and {d for d, r in made.items() if not r.verified} == changed
