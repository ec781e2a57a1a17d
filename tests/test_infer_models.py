import hashlib
import json
import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import optimized, plan, tuples
from vocspark import config
from vocspark.operators import infer, models, parse, rank, semantic

TEXTS = ["The cat, the dog and la maison", "de la was from", "", "123", "É é com with for was",
         "of of of and and the"]


def texts(spark, values=TEXTS):
    rows = [(str(i), t) for i, t in enumerate(values)]
    return spark.createDataFrame(rows, "review_id string, texto_completo string").repartition(3)


def words(text):
    return re.findall(r"[^\W\d_]+", text.lower())


@pytest.mark.parametrize("dim", [4, 64])
def test_embed_hashed_against_python(spark, dim):
    got = {r.review_id: r.embedding for r in infer.embed_hashed(texts(spark), dim).collect()}
    for i, t in enumerate(TEXTS):
        counts = [0] * dim
        for w in words(t):
            counts[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim] += 1
        norm = math.sqrt(sum(c * c for c in counts)) or 1
        assert got[str(i)] == pytest.approx([c / norm for c in counts], abs=1e-6)


def test_embed_hashed_many_rows_and_empty_frame(spark):
    many = spark.range(3000).selectExpr("string(id) AS review_id", "'a b a' AS texto_completo")
    vectors = infer.embed_hashed(many.coalesce(1), 8).select(F.array_sort("embedding").alias("v"))
    assert [tuple(np.round(r.v[-2:], 4)) for r in vectors.distinct().collect()] == [(0.4472, 0.8944)]
    assert infer.embed_hashed(many.limit(0), 8).count() == 0


def test_stand_ins_take_a_batch_in_bounded_steps(spark):
    """One Arrow batch of 900,000 words: memory of a step stays far below that of the whole batch."""
    batch = pa.array([["a", "b", "a"] * 100] * 2999 + [[], ["c"] * (infer._WORDS_AT_ONCE + 1)]).slice(1)
    steps = list(infer._slices(batch, 1000))
    assert pa.concat_arrays(steps).equals(batch)
    assert all(len(s.flatten()) <= infer._WORDS_AT_ONCE or len(s) == 1 for s in steps)
    assert max(map(len, steps)) <= 1000
    tracemalloc.start()
    for some in steps:
        infer._unit_counts(some, 8, {})
    assert tracemalloc.get_traced_memory()[1] < 8 * 2 * len(batch.flatten())
    tracemalloc.stop()
    rows = spark.range(3000).selectExpr(
        "string(id) AS review_id", "repeat(if(id % 2 = 0, 'the a ', 'from and '), 150) AS texto_completo").coalesce(1)
    vectors = infer.embed_hashed(rows, 8).groupBy(F.expr("int(review_id) % 2"), "embedding").count()
    assert sorted(r["count"] for r in vectors.collect()) == [1500, 1500]
    answers = parse.enrich(infer.classify_lexicon(rows, LEXICON, POLARITY))
    got = answers.groupBy(F.expr("int(review_id) % 2").alias("odd"), "assunto", "sentimento").count()
    assert tuples(got, "odd") == [(0, "caimento", "neutro", 1500), (1, "tamanho", "negativo", 1500)]


def test_embedding_is_computed_once(spark):
    cells = infer.embedding_cells(infer.embed_hashed(texts(spark), 8))
    assert plan(cells).count("ArrowEvalPython") == 1


LEXICON = (("the", "caimento", 1), ("and", "tamanho", 1), ("of", "conforto", 2), ("la", "tecido", 1),
           ("la", "cor", 3))
POLARITY = (("with", 1), ("for", 1), ("was", -1), ("from", -1))


def test_classify_lexicon_against_python(spark):
    df = parse.enrich(infer.classify_lexicon(texts(spark), LEXICON, POLARITY))
    got = {r.review_id: (r.assunto, r.sentimento) for r in df.collect()}
    for i, t in enumerate(TEXTS):
        n = Counter(words(t))
        scores = {a: sum(k * n[w] for w, b, k in LEXICON if a == b) for a in config.TOPICS}
        best = max(config.TOPICS, key=lambda a: (scores[a], -config.TOPICS.index(a)))
        topic = best if scores[best] > 0 else "outro"
        balance = sum(s * n[w] for w, s in POLARITY)
        mood = "positivo" if balance > 0 else "negativo" if balance < 0 else "neutro"
        assert got[str(i)] == (topic, mood)


def test_a_lexicon_of_50_000_words(spark):
    """The plan holds no word, and each topic's and mood's sums are right."""
    lexicon = [(f"w{chr(97 + i % 26)}{'abcdefghij'[i // 26 % 10]}{'xyz' * (i // 260 + 1)}"[:60] + "q" * (i // 5000),
                config.TOPICS[i % 12], 1 + i % 3) for i in range(50_000)]
    polarity = [(w, 1 if i % 2 else -1) for i, (w, _, _) in enumerate(lexicon)]
    said = [lexicon[i][0] for i in (3, 15, 15, 49_999)]
    df = infer.classify_lexicon(texts(spark, [" ".join(said), "nada"]), lexicon, polarity)
    small = infer.classify_lexicon(texts(spark, [" ".join(said), "nada"]), lexicon[:1], polarity[:1])
    assert abs(len(plan(df)) - len(plan(small))) < 50
    weight, balance = Counter(), 0
    for w, topic, n in lexicon:
        weight[topic] += n * said.count(w)
    for w, sign in polarity:
        balance += sign * said.count(w)
    best = max(config.TOPICS, key=lambda t: (weight[t], -config.TOPICS.index(t)))
    mood = "positivo" if balance > 0 else "negativo" if balance < 0 else "neutro"
    got = {r.review_id: (r.assunto, r.sentimento) for r in parse.enrich(df).collect()}
    assert got == {"0": (best, mood), "1": ("outro", "neutro")}


def test_words_listed_twice_have_the_sum_of_their_weights(spark):
    topics = config.TOPICS[:2]
    lexicon = [("bom", topics[0], 2), ("bom", topics[0], 2), ("bom", topics[1], 3)]
    df = infer.classify_lexicon(texts(spark, ["bom"]), lexicon, [("bom", 1), ("bom", -1)])
    row = parse.enrich(df).first()
    assert (row.assunto, row.sentimento) == (topics[0], "neutro")


def test_stand_ins_do_not_shuffle(spark):
    df = spark.range(10).selectExpr("string(id) AS review_id", "'a b' AS texto_completo")
    assert "Exchange" not in plan(infer.classify_lexicon(df, LEXICON, POLARITY))
    assert "Exchange" not in plan(infer.embed_hashed(df, 8))


def test_prompts(spark):
    row = texts(spark, ["bom"]).select(
        models.closed_topic_prompt().alias("closed"), models.open_topic_prompt().alias("open")).first()
    assert row.closed.endswith("Avaliação: bom") and "\n- caimento\n- tamanho\n" in row.closed
    assert "\n- outro\n\nRegras" in row.closed and "<assuntos>" not in row.closed
    assert row.open.startswith("Analise esta avaliação") and row.open.endswith("Avaliação: bom")


def test_model_is_made_once_per_task_and_sees_batches(spark):
    def make():
        made = {"calls": 0}

        def model(batch):
            made["calls"] += 1
            return [json.dumps({"n": len(batch), "call": made["calls"]})] * len(batch)

        return model

    df = spark.range(10).selectExpr("string(id) AS t").coalesce(1)
    got = models.apply_model(df, make, "t", "o", "string", batch_size=4).collect()
    assert [json.loads(r.o) for r in got] == (
        [{"n": 4, "call": 1}] * 4 + [{"n": 4, "call": 2}] * 4 + [{"n": 2, "call": 3}] * 2)


def test_model_vectors_and_nulls(spark):
    df = spark.createDataFrame([("ab",), (None,)], "texto_completo string").coalesce(1)
    make = lambda: lambda ts: [None if t is None else [float(len(t)), 0.5] for t in ts]
    assert [r.embedding for r in models.embed_with_model(df, make).collect()] == [[2.0, 0.5], None]


@pytest.mark.parametrize("model", [lambda ts: ts[:-1], lambda ts: 1 / 0, lambda ts: [None, *ts[1:]]])
def test_model_failures_fail_the_job(spark, model):
    df = spark.range(4).selectExpr("string(id) AS t").coalesce(1)
    with pytest.raises(Exception, match="model returned|ZeroDivision"):
        models.apply_model(df, lambda: model, "t", "o", "string").collect()


def test_filter_on_model_output_does_not_ask_again(spark):
    df = spark.range(4).selectExpr("string(id) AS texto_completo")
    out = models.classify_with_model(df, lambda: lambda ts: ['{"assunto":"cor"}'] * len(ts))
    kept = parse.enrich(out).filter("assunto = 'cor' AND sentimento = 'indefinido'")
    assert plan(kept).count("ArrowEvalPython") == 1 and kept.count() == 4


def test_summary_prompt(spark, gold):
    samples = rank.topic_review_samples(gold)
    got = {r.assunto: r.prompt for r in models.summary_prompts(samples).collect()}
    assert "sobre o assunto 'cor' em uma loja" in got["cor"]
    assert "Avaliações:\n- texto 1\n- texto 2\n\nSintetize" in got["cor"]


def test_summaries(spark, gold, empty_gold):
    samples = rank.critical_negatives(gold)
    assert tuples(infer.summarise_extractive(samples), "assunto") == [
        ("cor", 2, "- texto\nRevisar: cor"), ("estilo", 2, "- texto\nRevisar: estilo")]
    make = lambda limit: lambda ps: [f"{limit}" for _ in ps]
    asked = models.summarise_with_model(samples, make)
    assert tuples(asked, "assunto") == [("cor", 2, "300"), ("estilo", 2, "300")]
    nothing = infer.summarise_extractive(rank.critical_negatives(empty_gold))
    assert nothing.count() == 0
    assert [t for _, t in nothing.dtypes] == ["string", "bigint", "string"]


def test_extractive_summary_without_long_words(spark):
    samples = spark.createDataFrame(
        [("cor", 1, "a b c", 1)], "assunto string, qtd_negativos bigint, texto_completo string, pos int")
    assert infer.summarise_extractive(samples).first().resumo == "Revisar: cor"


def test_extractive_summary_ranks_by_reviews_then_word(spark):
    rows = [("cor", 3, "seda seda lona", 1), ("cor", 3, "lona brim", 2), ("cor", 3, "algo brim", 3)]
    samples = spark.createDataFrame(
        rows, "assunto string, qtd_negativos bigint, texto_completo string, pos int")
    assert infer.summarise_extractive(samples).first().resumo == (
        "- brim\n- lona\n- algo\nRevisar: cor")


def test_semantic_map_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 5)) * np.array([5.0, 3.0, 1.0, 0.5, 0.2]) + 2
    df = spark.createDataFrame(
        [(str(i), [float(v) for v in row], "cor") for i, row in enumerate(x)],
        "review_id string, embedding array<double>, assunto string").repartition(3)
    got = {int(r.review_id): (r.x, r.y) for r in semantic.semantic_map(df).collect()}
    values, vectors = np.linalg.eigh(np.cov(x, rowvar=False))
    axes = vectors[:, np.argsort(values)[::-1][:2]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(2)])
    want = x @ axes  # points are not centred
    assert np.allclose(np.array([got[i] for i in range(80)]), want, atol=1e-8)


def test_moments_merge_over_partitions(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3)).astype(np.float32)
    rows = [([float(v) for v in row],) for row in x] + [(None,)]
    df = spark.createDataFrame(rows, "embedding array<float>").repartition(7)
    got = semantic.moments(df).orderBy("i").collect()
    assert [r.n for r in got] == [50] * 3
    wide = x.astype(float)
    assert np.allclose([r.total for r in got], wide.sum(axis=0))
    assert np.allclose([r.products for r in got], wide.T @ wide)
    assert plan(semantic.moments(df)).count("FlatMapGroupsInArrow") == 1
    assert semantic.moments(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="at least two"):
        semantic.principal_axes(df.limit(0))
    uneven = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "embedding array<double>")
    with pytest.raises(Exception, match="length"):
        semantic.moments(uneven.coalesce(1)).collect()


def test_the_map_is_projected_in_the_jvm(spark):
    df = spark.createDataFrame([("1", [1.0, 2.0], "a"), ("2", [2.0, 1.0], "a"), ("3", [0.0, 0.5], "b")],
                               "review_id string, embedding array<double>, assunto string")
    assert "Python" not in plan(semantic.semantic_map(df)) and "Arrow" not in plan(semantic.semantic_map(df))


def test_semantic_join_is_inner_and_narrow(spark, gold):
    vectors = spark.createDataFrame(
        [("1", [1.0], 0), ("99", [2.0], 1)], "review_id string, embedding array<float>, label int")
    joined = semantic.semantic_join(vectors, gold)
    assert tuples(joined) == [("1", [1.0], 0, "cor", "negativo")]
    assert "department_name" not in optimized(joined).split("Join")[0]
