"""Each operator against brute force, exact round trips or held-out accuracy, odd rows included."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from vocspark.llm import (
    context_tree, encoding, exact_dedup, fingerprints, language_id, licenses, mixing, near_dedup, packing, registry,
    simple8b, token_counts,
)
from vocspark.llm.encoding import BYTE_VOCABULARY, WORD_VOCABULARY, PieceEncoder

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, h int"

ODD = [
    (1, "The cat sat on the mat and slept", "en", "a"), (2, "THE cat sat on the mat and slept", "en", "a"),
    (2, "THE cat sat on the mat and slept", "en", "a"), (3, None, "en", "b"), (4, "", None, None),
    (5, " \t\n ", "fr", "b"), (None, "le chat est sur la table", "fr", None), (7, None, None, "c"),
    (8, "12 34 !!", "de", "c"), (9, "der Hund und die Katze 漢字 İ\x1c<|endoftext|> it's", "de", "c"),
    (10, "mot " * 30000, "fr", "a"), (11, "x" * 50000, "en", "a"), (12, "a", "en", "b"), (13, "a b", "en", "b"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 1, "clash", 2) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SMALL}/documents.parquet' ORDER BY 1")
    return rows.fetchall()


@pytest.fixture(scope="module", params=["odd", "small"])
def corpus(request, odd, small, texts):
    return (odd, ODD) if request.param == "odd" else (small, texts)


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# ---- encoding, counts, files -----------------------------------------------

@pytest.mark.parametrize("vocabulary", [BYTE_VOCABULARY, WORD_VOCABULARY])
@settings(max_examples=200, deadline=None, derandomize=True)
@given(st.text(st.one_of(
    st.characters(exclude_categories=["Cs"]), st.sampled_from("'sltre \n\t AbÉß1²<|>\xa0’İ"))))
def test_ids_as_the_library_gives(vocabulary, text):
    encoder = ENCODERS.setdefault(vocabulary, PieceEncoder(vocabulary))
    assert encoder.ids(text).tolist() == encoder.whole(text)


ENCODERS: dict = {}


@pytest.mark.parametrize("vocabulary", [BYTE_VOCABULARY, WORD_VOCABULARY])
@settings(max_examples=100, deadline=None, derandomize=True)
@given(st.lists(st.one_of(st.none(), st.text(st.one_of(
    st.characters(exclude_categories=["Cs"]), st.sampled_from("'sltre \n\t AbÉß1²<|>\xa0’İ,.-")), max_size=40))))
def test_ids_of_many_texts_side_by_side(vocabulary, texts):
    encoder = ENCODERS.setdefault(vocabulary, PieceEncoder(vocabulary))
    found = encoder.all_ids(pa.array(["x", *texts, None], pa.string()).slice(1))
    assert [f.tolist() for f in found] == [encoder.whole(t or "") for t in [*texts, None]]


@pytest.mark.parametrize("remembered, asked", [(1 << 20, 1), (2, 40)])
def test_units_are_coded_once_while_they_are_remembered(monkeypatch, remembered, asked):
    monkeypatch.setattr(encoding, "_REMEMBERED", remembered)
    monkeypatch.setattr(encoding, "_BYTES_AT_ONCE", 20)
    encoder, coded = PieceEncoder(WORD_VOCABULARY), Counter()
    library = encoder.model
    encoder.model = SimpleNamespace(tokenize=lambda p: coded.update([p]) or library.tokenize(p))
    texts = ["The cat, the cat. 12", " cat!\n", "", "no dog's tail at all"] * 40
    for _ in range(2):
        assert [f.tolist() for f in encoder.all_ids(pa.array(texts))] == [encoder.whole(t) for t in texts]
    assert coded["dog"] == (1 if asked == 1 else 80) and coded["cat"] <= 5 * asked
    assert encoding.worker_encoder(WORD_VOCABULARY) is encoding.worker_encoder(WORD_VOCABULARY)


def test_counts(corpus):
    docs, rows = corpus
    encoder = PieceEncoder(BYTE_VOCABULARY)
    want = [(d, len((t or "").encode()), len(encoder.whole(t or ""))) for d, t, *_ in rows]
    assert got(token_counts.token_counts(docs), "doc_id", "n_bytes", "n_tokens") == sorted(want, key=repr)
    assert len(token_counts.frequent_pieces()) <= 50_257


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=800))
def test_words_round_trip(values):
    array = np.array(values, np.uint64)
    words, escapes = simple8b.pack(array)
    assert simple8b.unpack(words, escapes).tolist() == values


def test_groups_decode_by_their_offsets():
    """Each group of words lands where its offset says; a wrong offset is found."""
    values = np.random.default_rng(5).integers(0, 50_000, 60_000).astype(np.uint64)
    block = simple8b.write_block([20_000, 40_000], values)
    lengths, ids = simple8b.read_block(block)
    assert lengths.tolist() == [20_000, 40_000] and np.array_equal(ids, values)
    words = len(simple8b.pack(values)[0])
    assert words > 3 * simple8b.GROUP
    head = 4 + 4 * 3 + 8 + 4 * 2
    broken = bytearray(block)
    broken[head + 4] ^= 1
    with pytest.raises(ValueError):
        simple8b.read_block(bytes(broken))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=400))
def test_the_fullest_selector_is_taken(values):
    def fits(i, count, bits):
        return i + count <= len(values) and all(v < 1 << bits for v in values[i:i + count])

    i, chosen = 0, []
    while i < len(values):
        chosen.append(next(k for k, (count, bits) in enumerate(simple8b.LAYOUTS) if k == 15 or fits(i, count, bits)))
        i += simple8b.LAYOUTS[chosen[-1]][0]
    words, _ = simple8b.pack(np.array(values, np.uint64))
    assert (words >> np.uint64(60)).tolist() == chosen


def test_zero_runs_and_damaged_blocks():
    assert len(simple8b.pack(np.zeros(480, np.uint64))[0]) == 2
    block = simple8b.write_block([3, 0, 2], np.array([1, 2, 3, 4, 5]))
    lengths, ids = simple8b.read_block(block)
    assert (lengths.tolist(), ids.tolist()) == ([3, 0, 2], [1, 2, 3, 4, 5])
    with pytest.raises(ValueError):
        simple8b.read_block(b"XXXX" + block[4:])


def test_files(spark, corpus, tmp_path):
    docs, rows = corpus
    simple8b.write_ids(docs, str(tmp_path / "ids"))
    read = sorted(simple8b.read_ids(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    encoder = PieceEncoder(BYTE_VOCABULARY)
    at = 0
    for row, (d, t, *_) in zip(read, sorted(rows, key=lambda r: (r[0] is not None, r[0])), strict=True):
        ids = np.array([*encoder.whole(t or ""), 0], "<u4")
        assert tuple(row) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


# ---- mixing ----------------------------------------------------------------

def test_targets_and_taken(corpus):
    docs, rows = corpus
    out = [r.asDict() for r in mixing.mix(docs).collect()]
    size = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += size(t)
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= 2 * sizes[s]}
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: 2 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    assert len(out) == len(rows)
    taken, largest = Counter(), Counter()
    for r in out:
        s = r["row"]["source"]
        assert r["target"] == pytest.approx(target[s]) and r["source_size"] == sizes[s]
        assert r["size"] == size(r["row"]["text"]) and r["taken"] in (0, r["size"], 2 * r["size"])
        assert all(0 <= p <= 1 for p in r["positions"])
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in names)


def test_curriculum_inverts_its_integral(spark):
    t = mixing.position(F.col("m"), F.lit(100.0))
    for r in spark.range(0, 101, 10).withColumn("m", F.col("id")).withColumn("t", t).collect():
        demand = (mixing.START * r.t + (mixing.END - mixing.START) * r.t ** 2 / 2)
        assert 100 * demand / ((mixing.START + mixing.END) / 2) == pytest.approx(r.m)


def test_shares_of_sources_change_over_training(spark):
    docs = frame(spark, [(i, "word " * 10, "en", "abc"[i % 3]) for i in range(3000)])
    copies = [(p, r.row.source, r.target) for r in mixing.mix(docs).collect() for p in r.positions]
    targets = {s: t for _, s, t in copies}
    counts = lambda low, high: Counter(s for p, s, _ in copies if low <= p < high)
    first, last, every = counts(0, 0.1), counts(0.9, 1), counts(0, 2)
    for s, (start, end) in zip("abc", mixing.SCHEDULES):
        assert every[s] * 10 == pytest.approx(targets[s], abs=10)
        assert first[s] / every[s] == pytest.approx((0.95 * start + 0.05 * end) / 10, abs=0.005)
        assert last[s] / every[s] == pytest.approx((0.05 * start + 0.95 * end) / 10, abs=0.005)
    # `a` falls, `b` rises
    assert first["a"] / first.total() > 1.5 * last["a"] / last.total()
    assert last["b"] / last.total() > 1.5 * first["b"] / first.total()
    with pytest.raises(ValueError):
        mixing.mix(docs, schedules=((0, 0),))


def test_rows_without_ids_fall_into_many_buckets(spark):
    """Rows that share a doc_id, or have none, are told apart by their texts."""
    rows = [(None, f"text {i}", "en", "a") for i in range(300)] + [(1, f"other {i}", "en", "a") for i in range(300)]
    docs = frame(spark, rows)
    hashes = docs.select(F.substring(mixing.place_hash(), 1, 2).alias("b")).distinct().count()
    assert hashes > 150
    out = mixing.mix(docs, keep=["doc_id"])
    assert out.schema["row"].dataType.names == ["doc_id"] and out.count() == 600
    assert sum(r.taken for r in out.collect()) == pytest.approx(1.5 * 1200, abs=4)


def test_stream_is_in_order(small):
    assert mixing.training_stream(small).columns == small.columns
    assert got(mixing.training_stream(small), "doc_id") == got(mixing.training_stream(small), "doc_id")


# ---- dedup -----------------------------------------------------------------

@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**63), min_size=1, max_size=200))
def test_golomb_round_trip(values):
    array = np.sort(np.array(values, np.uint64))
    assert (exact_dedup.golomb_decode(len(array), *exact_dedup.golomb_encode(array)) == array).all()


def lower(text):
    return (text or "").encode().lower()


def test_exact(corpus):
    docs, rows = corpus
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[lower(t)].append(d)
    want = set()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want |= {(d, keep, len(ids), d == keep, hashlib.sha256(t).hexdigest()) for d in ids}
    out = [(r.row.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)
           for r in exact_dedup.exact_dedup(docs).collect()]
    assert len(out) == len(set(out)) and set(out) == want


def brute_fingerprint(text):
    words = lower(text).split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    distinct = sorted(set(values))
    root = {v: v for v in distinct}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return [find(v) for v in values]


def test_near(corpus):
    docs, rows = corpus
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    least = {}
    comps = brute_components(fps)
    for (d, *_), c in zip(rows, comps):
        least[c] = min((x for x in (d, least.get(c)) if x is not None), default=None)
    want = [(d, f, least[c]) for (d, *_), f, c in zip(rows, fps, comps)]
    out = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in near_dedup.near_dedup(docs).collect()]
    assert sorted(out, key=repr) == sorted(want, key=repr)
    stay = near_dedup.keep_one(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect() if r.doc_id is not None) == sorted(
        {x for x in least.values() if x is not None})


def test_near_stage_keeps_one_of_linked_texts(spark, texts):
    """The stage uses the SimHash operator with its 3-word shingles and two bits."""
    edits = [(100 + i, " ".join(f"w{j}" if j != 7 * i else f"x{i}" for j in range(400)), "en", "a") for i in range(12)]
    rows = [r for r in [*ODD, *edits, *texts[:60]] if r[0] is not None]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    stay = corpus_pipeline.drop_near_copies(spark, frame(spark, rows), SMALL)
    groups = {}
    for (d, *_), c in zip(rows, brute_components([brute_fingerprint(t) for _, t, *_ in rows])):
        groups.setdefault(c, d)
    assert sorted(r.doc_id for r in stay.collect()) == sorted(groups.values())
    assert len(groups) < len(rows)


def test_one_row_stays_per_component(spark):
    """Also of components whose ids are null or stand in another component too."""
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcdef"}
    rows = [(None, text["a"], "en", "a"), (None, text["b"], "en", "a"), (None, text["b"].upper(), "en", "a"),
            (1, text["c"], "en", "a"), (1, text["d"], "en", "a"), (2, text["d"], "en", "a"),
            (None, text["e"], "en", "a"), (5, text["e"], "en", "a"), (7, text["f"], "en", "a")]
    stay = near_dedup.keep_one(frame(spark, rows)).collect()
    assert sorted((r.text.lower(), r.doc_id or 0) for r in stay) == [
        (text["a"], 0), (text["b"], 0), (text["c"], 1), (text["d"], 1), (text["e"], 5), (text["f"], 7)]


def test_masks_cover_every_pair_of_bits():
    masks = near_dedup.covering_masks()
    assert all(any(not (m >> a & 1 or m >> b & 1) for m in masks) for a in range(64) for b in range(64))


def test_chains_become_one_component(spark):
    values = [(1 << k) - 1 for k in range(0, 60, 2)] + [1 << 63, (1 << 63) - 1 ^ 0x5555]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    tree = {r.u: r.v for r in near_dedup.components(near_dedup.links(fps)).collect()}
    comps = brute_components(values)
    assert len({tree.get(v, v) for v in signed}) == len(set(comps))


# ---- fingerprints ----------------------------------------------------------

def test_edited_texts(corpus):
    docs, rows = corpus
    seen = {(d, t or "") for d, t, *_ in rows}
    order = sorted(seen, key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest(r[1].encode(), 42)))
    out = {}
    for i, (d, t) in enumerate(order):
        n = len(t) // 4
        edited = t[:len(t) - n] + order[(i + 1) % len(order)][1][:n]
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest())
    found = fingerprints.edited_fingerprints(docs).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in found} == out and len(found) == len(seen)
    by_text = defaultdict(set)
    text = dict(order)
    for r in found:
        by_text[text[r.doc_id]].add(r.fp)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(f) == 1 for f in by_text.values())


def brute_votes(text):
    """The 64 bits, one vote at a time."""
    votes, weight = [0] * 64, 0
    for word in re.split(r"[\x20\x09-\x0D]+", text.lower()):
        w = max(min(len(word), 18) - 2, 1) if word else 0
        h, weight = xxhash.xxh64_intdigest(word.encode(), 42), weight + w
        for k in range(64):
            votes[k] += w * (h >> k & 1)
    return sum(1 << k for k in range(64) if votes[k] * 2 > weight)


def test_every_bit_and_likeness(spark, texts):
    rows = [(d, t[:400], "en", "a") for d, t, *_ in texts if t and t.isascii()][:40]
    rows += [(900, "", "en", "a"), (901, None, "en", "a"), (900, "other text of the same id", "en", "a"),
             (902, "word " * 500, "en", "a"), (None, "no id", "en", "a")]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, np.int64(np.uint64(
        xxhash.xxh64_intdigest((r[1] or "").encode(), 42)))))
    want = []
    for i, (d, t, *_) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        n = len(t) // 4
        fp, edited, following = map(brute_votes, (t, t[:len(t) - n] + after[:n], after))
        want.append((d, fp, edited, 1 - (fp ^ edited).bit_count() / 64, 1 - (fp ^ following).bit_count() / 64))
    got = [(r.doc_id, r.fp % (1 << 64), r.edited_fp % (1 << 64), r.near_edited, r.near_next)
           for r in fingerprints.edited_fingerprints(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_edits_stay_nearer_than_neighbours(small):
    rows = fingerprints.edited_fingerprints(small).collect()
    assert np.mean([r.near_edited for r in rows]) > np.mean([r.near_next for r in rows]) + 0.1


def test_all_within_radius(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(-2**63, 2**63, 30)]
    near = [b ^ sum(1 << int(p) for p in rng.choice(63, k, False)) for b in base for k in (1, 2, 3, 4)]
    fps = spark.createDataFrame([(v,) for v in base + near], "fp long")
    asked = spark.createDataFrame([(v,) for v in base], "fp long")
    want = {(a, b) for a in base for b in base + near if ((a ^ b) % (1 << 64)).bit_count() <= 3}
    assert {(r.query, r.fp) for r in fingerprints.within_radius(asked, fps).collect()} == want


def test_fingerprints_plan_has_no_python(spark):
    df = registry.op3_fingerprints(spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- licenses --------------------------------------------------------------

def test_licenses(corpus):
    docs, rows = corpus
    whole, possible = set(), set()
    for d, t, *_ in rows:
        found = licenses.words(t)
        for name, template in (licenses.TEMPLATES | licenses.license_bodies()).items():
            grams = set(licenses.shingles(licenses.words(template)))
            size = len(next(iter(grams)).split())
            mine = {" ".join(found[i:i + size]) for i in range(len(found) - size + 1)}
            share = len(grams & mine) / len(grams)
            whole |= {(d, name)} if share == 1 else set()
            possible |= {(d, name)} if share >= licenses.CONTAINMENT else set()
    got_ = {(r.doc_id, r.template) for r in licenses.scan_licenses(docs).collect()}
    assert whole <= got_ <= possible


def test_recall_of_edited_licenses():
    """Templates with a few of their words changed, inside other text: all that keep 80 % of their shingles."""
    rng = np.random.default_rng(7)
    templates = licenses.TEMPLATES | licenses.license_bodies()
    index, asked, missed = licenses.template_index(templates), 0, []
    for name, template in templates.items():
        grams = set(licenses.shingles(licenses.words(template)))
        for share in (.005, .01, .02, .03):
            edited = licenses.words(template)
            for at in rng.choice(len(edited), int(share * len(edited)), replace=False):
                edited[at] = f"edit{at}"
            if len(edited) < 5 or len(grams & set(licenses.shingles(edited))) < licenses.CONTAINMENT * len(grams):
                continue
            text = " ".join([*(f"w{i}" for i in range(500)), *edited, *(f"v{i}" for i in range(300))])
            asked += 1
            missed += [name] if name not in {n for n, _, _ in licenses.scan_text(text, index)} else []
    assert asked >= 60 and len(missed) <= 0.01 * asked


def test_license_lines_of_the_tables(spark):
    """Every notice that stands in the given texts is found, also without its usual neighbours."""
    lines = {
        "all rights reserved": "all-rights-reserved-notice", "released under the mit license": "MIT-notice",
        "licensed under the apache license, version 2.0": "Apache-2.0-notice",
        "licensed under cc by-nc 4.0": "CC-BY-NC-4.0-notice",
        "licensed under the gnu general public license, version 3": "GPL-3.0-notice"}
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = duckdb.sql(f"SELECT doc_id, lower(text) FROM '{path}' WHERE text IS NOT NULL").fetchall()
    want = {(d, name) for d, t in rows for line, name in lines.items() if line in t}
    assert {name for _, name in want} == set(lines.values())
    found = {(r.doc_id, r.template) for r in licenses.scan_licenses(spark.read.parquet(path)).collect()}
    assert found >= want


def test_short_templates_and_bodies():
    index = licenses.template_index({"short": "All rights reserved.", "long": "one two three four five"})
    assert licenses.scan_text("ALL RIGHTS, reserved: all rights reserved. b all rights reservedly", index) == [
        ("short", 1.0, [0, 3])]
    only = licenses.template_index({"short": "All rights reserved."})
    assert licenses.scan_text("x all rights reserved", only) == [("short", 1.0, [1])]
    bodies = licenses.license_bodies()
    whole = licenses.template_index(licenses.TEMPLATES | bodies)
    for name, body in bodies.items():
        text = " ".join([*(f"w{i}" for i in range(777)), body, *(f"v{i}" for i in range(777))])
        assert name in {n for n, share, _ in licenses.scan_text(text, whole) if share == 1}


def test_edited_license_inside_a_long_text():
    index = licenses.template_index(licenses.TEMPLATES)
    grant = licenses.TEMPLATES["MIT-grant"].split()
    grant[20] = "other"
    text = " ".join([*(f"w{i}" for i in range(40000)), *grant, *(f"v{i}" for i in range(3000))])
    (name, share, places), = licenses.scan_text(text, index)
    assert name == "MIT-grant" and 0.8 <= share < 1 and places[0] == 40000
    assert licenses.scan_text(" ".join(f"w{i}" for i in range(5000)), index) == []


# ---- packing ---------------------------------------------------------------

def test_packing(corpus):
    docs, rows = corpus
    out = packing.pack(docs).collect()
    encoder = PieceEncoder(WORD_VOCABULARY)
    want = []
    for d, t, *_ in rows:
        ids = np.array([*encoder.whole(t or ""), 1], "<u4")
        want += [(d, i, a, len(ids[a:a + 4096]), zlib.crc32(ids[a:a + 4096].tobytes()))
                 for i, a in enumerate(range(0, len(ids), 4096))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=repr) == sorted(
        want, key=repr)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    least = math.ceil(sum(r.length for r in out) / 4096)
    assert len(bins) <= 1.05 * least + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=120))
def test_runs_pack_like_best_fit(lengths):
    runs = packing.best_fit_runs(Counter(lengths), 60)
    filled, placed = Counter(), 0
    for length, n in Counter(lengths).items():
        ranks = [r[0] for r in runs[length]]
        assert ranks == sorted(set(ranks)) and (not n or ranks[0] == 0)
        for (rank, first, offset), stop in zip(runs[length], [*ranks[1:], n]):
            for k in range(stop - rank):
                assert (first + k, offset) not in filled
                filled[first + k, offset] = length
                placed += 1
    assert placed == len(lengths)
    ends = defaultdict(int)
    for (sequence, offset), length in sorted(filled.items()):
        assert ends[sequence] == offset
        ends[sequence] += length
    gaps: list[int] = []
    for length in sorted(lengths, reverse=True):
        room = min((g for g in gaps if g >= length), default=None)
        if room is None:
            gaps.append(60 - length)
        else:
            gaps[gaps.index(room)] -= length
    assert len(ends) <= len(gaps) + 1


# ---- language --------------------------------------------------------------

def test_segmentations_are_summed():
    pieces, probs = ["▁", "▁a", "a", "b", "ab"], np.array([[.3], [.2], [.2], [.1], [.2]])
    s = language_id.Segmenter(pieces, probs)
    want = .2 * .1 + .3 * .2 * .1 + .3 * .2
    assert s.log_likelihood("ab")[0] == pytest.approx(math.log(want))
    assert s._scaled(s.edges("ab"))[0] == pytest.approx(math.log(want))
    uses = s.expected("ab", 0)
    assert uses[4] == pytest.approx(.3 * .2 / want) and uses[1] == pytest.approx(.2 * .1 / want)


def segmentations(pieces, text):
    """Every way to cut the text into pieces, an unlisted letter being piece -1."""
    if not text:
        yield []
    for end in range(1, len(text) + 1):
        piece = pieces.index(text[:end]) if text[:end] in pieces else -1
        if piece >= 0 or end == 1:
            for rest in segmentations(pieces, text[end:]):
                yield [piece, *rest]


PIECES = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "abab", "bb"]


def test_sums_equal_the_enumeration_of_all_segmentations():
    rng = np.random.default_rng(3)
    probs = rng.random((len(PIECES), 3))
    probs /= probs.sum(axis=0)
    s = language_id.Segmenter(PIECES, probs)
    words = ["".join(rng.choice(list("abc"), n)) for n in range(1, 9) for _ in range(8)]
    batch = s.log_likelihoods(words)
    for word, row in zip(words, batch):
        ways = list(segmentations(PIECES, "▁" + word))
        weights = np.array([np.prod([s.weights[p] for p in way], axis=0) for way in ways])
        assert np.allclose(row, np.log(weights.sum(axis=0))) and np.allclose(row, s._scaled(s.edges(word)))
        share = weights[:, 1] / weights[:, 1].sum()
        want = Counter()
        for way, part in zip(ways, share):
            for p in way:
                want[p] += part
        for uses in (s.expected(word, 1), s._expected_scaled(s.edges(word), 1)):
            assert uses.keys() == want.keys() - {-1}
            assert all(uses[p] == pytest.approx(want[p]) for p in uses)


def test_long_words_are_summed_like_short_ones():
    probs = np.full((len(PIECES), 2), 1 / len(PIECES))
    s = language_id.Segmenter(PIECES, probs)
    long, short = "ab" * 400, "ab" * 15
    assert np.isfinite(s.log_likelihood(long)).all()
    assert s._scaled(s.edges(short)) == pytest.approx(s.log_likelihood(short))
    uses, parts = s.expected(long, 0), s._expected_scaled(s.edges(short), 0)
    assert uses.keys() == parts.keys() and all(np.isfinite(x) and x > 0 for x in uses.values())


def test_training_is_plain_expectation_maximisation(spark, texts):
    rows = [(d, t[:300], x, s) for d, t, x, s in texts if t and x][:24]
    languages, pieces, probs = language_id.train(frame(spark, rows), sample_docs=10**6, rounds=2)
    want = np.full((len(pieces), len(languages)), 1 / len(pieces))
    for _ in range(2):
        s, totals = language_id.Segmenter(pieces, want), np.full(want.shape, language_id.SMOOTHING)
        for _, t, x, _ in rows:
            for word in language_id.words(t):
                for piece, n in s.expected(word, languages.index(x)).items():
                    totals[piece, languages.index(x)] += n
        want = totals / totals.sum(axis=0)
    assert languages == sorted({x for _, _, x, _ in rows}) and np.allclose(probs, want)


def unspaced(letters, n, seed):
    """Texts of 60 to 120 letters without a space or a mark."""
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(letters), rng.integers(60, 120))) for _ in range(n)]


def test_languages_written_without_spaces_are_learnt(spark):
    kinds = {
        "ja": unspaced("のにをはがとでたしれさるもなあいうえこそ日本人", 40, 1),
        "zh": unspaced("的一是不了人在有我他这中大来上国日本", 40, 2),
        "en": ["the cat sat on the mat and it was good"] * 40,
        "de": unspaced(["der", "hund", "und", "katze", "nicht", "haus"], 40, 3),
        "fr": unspaced(["chat", "est", "sur", "maison", "avec", "pour"], 40, 4),
    }
    rows = [(i, t, x, "s") for i, (t, x) in enumerate((t, x) for x, ts in kinds.items() for t in ts)]
    docs = frame(spark, rows)
    found = language_id.identify(docs, language_id.train(docs)).select("row.lang", "lang_pred").collect()
    assert len(found) == 200 and all(r.lang == r.lang_pred for r in found)


def test_language_stage_drops_what_it_rejects(spark):
    english = ["the cat sat on the mat and it was a good cat", "and the dog was on the table with the cat"]
    german = ["der Hund und die Katze sind nicht im Haus", "das Haus ist nicht der Garten und der Hund"]
    rows = [(i, t, x, "s") for i, (t, x) in enumerate(
        [(t, "en") for t in english * 20] + [(t, "de") for t in german * 20] + [("12 34", "en"), (None, "de")])]
    docs = frame(spark, rows)
    stay = corpus_pipeline.keep_known_language(spark, docs, SMALL, languages=["en"]).collect()
    assert {r.doc_id for r in stay} == set(range(40))
    everything = corpus_pipeline.keep_known_language(spark, docs, SMALL).collect()
    assert {r.doc_id for r in everything} == set(range(80))
    assert not corpus_pipeline.keep_known_language(spark, docs, SMALL, min_score=1.1).collect()


def test_language_accuracy_and_odd_rows(spark, odd, texts):
    out = registry.op8_language_id(spark, SMALL).collect()
    lang = {d: x for d, _, x, _ in texts}
    held = [r for r in out if r.held_out]
    assert len(out) == len(texts) and held
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)
    found = {r.row.doc_id: (r.lang_pred, r.score) for r in
             language_id.identify(odd, language_id.train(odd)).collect()}
    assert all(found[d] == ("und", 0.0) for d in (3, 4, 5, 7, 8))
    assert all(found[d][0] in {"en", "fr", "de"} and 0 < found[d][1] <= 1 for d in (1, None, 9, 10, 11))
    nothing = language_id.identify(odd, language_id.train(odd.limit(0))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


# ---- language model --------------------------------------------------------

def brute_tree(train, data):
    """log10 of `data`'s probability under a frozen tree: dictionaries and recursion."""
    depth = context_tree.DEPTH
    counts = defaultdict(lambda: [0, 0])

    def steps(text):
        raw = b"\n" * depth + text
        for i in range(depth, len(raw)):
            node = 1
            for j in range(8):
                bit = raw[i] >> (7 - j) & 1
                yield [(raw[i - d:i], node) for d in range(depth + 1)], bit
                node = node * 2 + bit

    children = defaultdict(set)
    for text in train:
        for path, bit in steps(text):
            for d, key in enumerate(path):
                counts[key][bit] += 1
                if d < depth:
                    children[key].add(path[d + 1])
    kt = lambda c: (math.lgamma(c[0] + .5) + math.lgamma(c[1] + .5) - math.log(math.pi)
                    - math.lgamma(sum(c) + 1)) if sum(c) else 0.0
    cache = {}

    def weighted(key):
        if key not in cache:
            own = kt(counts.get(key, (0, 0)))
            if len(key[0]) == depth:
                cache[key] = own
            else:
                cache[key] = math.log(.5) + np.logaddexp(own, sum(map(weighted, children.get(key, ()))))
        return cache[key]

    total = 0.0
    for path, bit in steps(data):
        p = None
        for key in reversed(path):
            c = counts.get(key, (0, 0))
            own = (c[1] + .5) / (sum(c) + 1)
            w = 1 if p is None else math.exp(math.log(.5) + kt(c) - weighted(key))
            p = own if p is None else w * own + (1 - w) * p
        total += math.log10(p if bit else 1 - p)
    return total


def test_scores(spark):
    rows = [(i, t, None, None) for i, t in enumerate(
        ["the cat", "The  cat sat", None, "", "cats and dogs", "the cat", "zzz é", "dogs sat"])]
    out = {r.doc_id: r for r in context_tree.score_texts(frame(spark, rows), registry.id_fold(10) != 0).collect()}
    learn = [t for d, t, *_ in rows if zlib.crc32(str(d).encode()) % 10]
    words = lambda t: lower(t).split()
    count = Counter(w for t in learn for w in [*words(t), b"\n"])
    total, scale = sum(count.values()), sum(count.values()) + .1 * (len(count) + 1)
    norm = lambda t: b" ".join(words(t)) + b"\n"
    for d, t, *_ in rows:
        tokens = [*words(t), b"\n"]
        r = out[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 10 == 0) and r.train_tokens == total
        assert (r.n_tokens, r.n_known) == (len(tokens), sum(count[w] > 0 for w in tokens))
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + .1) / scale) for w in tokens))
        assert r.score == pytest.approx(brute_tree(map(norm, learn), norm(t)), rel=1e-6)


def test_scores_of_odd_rows(odd):
    out = context_tree.score_texts(odd, registry.id_fold(10) != 0).collect()
    assert len(out) == len(ODD) and all(r.score < 0 and r.base_score < 0 for r in out)


# ---- all -------------------------------------------------------------------

def test_empty_tables(spark, odd, tmp_path):
    none = odd.limit(0)
    assert token_counts.token_counts(none).count() == 0
    assert mixing.mix(none).count() == mixing.training_stream(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert near_dedup.near_dedup(none).count() == near_dedup.keep_one(none).count() == 0
    assert fingerprints.edited_fingerprints(none).count() == 0
    assert licenses.scan_licenses(none).count() == packing.pack(none).count() == 0
    assert language_id.identify(none, language_id.train(none)).count() == 0
    assert context_tree.score_texts(none, registry.id_fold(10) != 0).count() == 0
    simple8b.write_ids(none, str(tmp_path / "none"))
    assert simple8b.read_ids(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("source", ["odd", "empty"])
def test_pipeline_stages_keep_columns(spark, odd, source):
    docs = odd if source == "odd" else odd.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() >= (source == "odd")


def test_language_stage_without_labels(spark):
    """Without a labelled row only texts without a letter go."""
    rows = [(d, t, None, s) for d, t, _, s in ODD]
    stay = corpus_pipeline.keep_known_language(spark, frame(spark, rows), SMALL)
    want = [d for d, t, *_ in rows if any(map(str.isalpha, t or ""))]
    assert sorted((r.doc_id for r in stay.collect()), key=repr) == sorted(want, key=repr)


def test_pipeline(spark, texts):
    """All five stages against brute force and, for the mixture, its SQL over what the near stage keeps."""
    packed = corpus_pipeline.run(spark, SMALL).collect()
    known = [(d, t) for d, t, *_ in texts if any(map(str.isalpha, t or ""))]
    keep = {}
    for d, t in known:
        keep[lower(t)] = max(d, keep.get(lower(t), d))
    left = sorted((d, t) for d, t in known if keep[lower(t)] == d)
    comps = brute_components([brute_fingerprint(t) for _, t in left])
    first = {}
    for (d, _), c in zip(left, comps):
        first.setdefault(c, d)
    stayed = ", ".join(str(d) for d, _ in left if d in set(first.values()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet' WHERE doc_id IN ({stayed})")
    want = Counter()
    for r in con.sql(registry.OP1_SQL).fetchall():
        if n := sum(x is not None for x in r[-2:]):
            want[r[0]] = n
    assert Counter(r.doc_id for r in packed if r.piece == 0) == want and max(want.values()) == 2
    rooms = Counter()
    for r in packed:
        rooms[r.sequence_id] += r.length
    assert max(rooms.values()) <= 4096
