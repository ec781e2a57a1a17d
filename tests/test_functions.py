import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan, tuples
from vocspark.functions import labels, ordering, text


def one(spark, expression, **values):
    names = list(values)
    ddl = ", ".join(f"{n} {t}" for n, (t, _) in values.items())
    row = tuple(v for _, v in values.values())
    return spark.createDataFrame([row], ddl).select(expression.alias("x")).first().x if names else None


@pytest.mark.parametrize("body, kept", [
    (None, False), ("", False), ("   ", False), ("\n", True), (" a ", True)])
def test_has_text_strips_spaces_only(spark, body, kept):
    assert one(spark, text.has_text("b"), b=("string", body)) is kept


@pytest.mark.parametrize("title, body, plain, clean", [
    ("Great", "fits well ", "Great. fits well", "Great. fits well"),
    (None, "fits", ". fits", "fits"),
    ("", "fits", ". fits", "fits"),
    ("Great", None, "Great", "Great"),
    ("  Great", "x", "Great. x", "Great. x"),
])
def test_full_text(spark, title, body, plain, clean):
    values = {"t": ("string", title), "b": ("string", body)}
    assert one(spark, text.full_text("t", "b"), **values) == plain
    assert one(spark, text.full_text("t", "b", skip_empty_title=True), **values) == clean


@pytest.mark.parametrize("value, words", [
    ("Très BON, très-bon 5x", ["très", "bon", "très", "bon", "x"]),
    ("  ", []), ("", []), (None, []), ("123 !", []),
])
def test_tokens(spark, value, words):
    assert one(spark, text.tokens("t"), t=("string", value)) == words


@pytest.mark.parametrize("said, label", [
    ("positivo", "positivo"), ("muito negativo", "negativo"), ("neutral", "neutro"),
    ("negativo e positivo", "positivo"), ("misto", "indefinido"), (None, "indefinido"),
    ("", "indefinido"),
])
def test_sentiment_label(spark, said, label):
    assert one(spark, labels.sentiment_label(F.col("s")), s=("string", said)) == label


@pytest.mark.parametrize("answer, topic", [
    ('{"assunto":" Cor "}', " Cor "),
    ('```json\n{"assunto":"cor"}\n```', None),
    ('{"assunto":"cor"} pronto', "cor"),
    ('{"Assunto":"cor"}', None),
    ('{"assunto":null}', None),
    ('{"assunto":5}', "5"),
    ('{"assunto":["a","b"]}', '["a","b"]'),
    ("{bad", None), ("", None), (None, None),
])
def test_json_field(spark, answer, topic):
    assert one(spark, labels.json_field("j", "assunto"), j=("string", answer)) == topic


@pytest.mark.parametrize("pct, name", [
    (100.0, "red"), (50.0, "red"), (49.9, "amber"), (25.0, "amber"), (24.9, "green"), (0.0, "green")])
def test_band_bounds_are_inclusive(spark, pct, name):
    assert one(spark, labels.band(F.col("p")), p=("double", pct)) == name


@pytest.mark.parametrize("part, whole, pct", [(1, 3, 33.3), (0, 0, 0.0), (1, 400, 0.3), (3, 3, 100.0)])
def test_percentage_rounds_half_up_and_guards_zero(spark, part, whole, pct):
    got = one(spark, labels.percentage(F.col("a"), F.col("b")), a=("bigint", part), b=("bigint", whole))
    assert got == pct


def scattered(spark, n, partitions=7, seed=1):
    rng = random.Random(seed)
    ids = list(range(n))
    rng.shuffle(ids)
    return spark.createDataFrame([(str(i),) for i in ids], "review_id string").repartition(partitions)


def test_review_order_is_numeric_then_text(spark):
    df = spark.createDataFrame([("10",), ("9",), ("b",), ("a",), ("100",)], "review_id string")
    assert [r.review_id for r in df.orderBy(*ordering.review_order()).collect()] == [
        "9", "10", "100", "a", "b"]


@pytest.mark.parametrize("n", [1, 13, 500, 2000])
def test_first_rows_equals_sort_and_cut(spark, n):
    df = scattered(spark, 1500)
    got = ordering.first_rows(df, n, ordering.review_order(), ["review_id"])
    assert sorted(int(r.review_id) for r in got.collect()) == list(range(min(n, 1500)))


@pytest.mark.parametrize("n", [1, 13, 500, 2000])
def test_first_wide_rows_equals_sort_and_cut(spark, n):
    df = scattered(spark, 1500).withColumn("wide", F.repeat("review_id", 50))
    got = ordering.first_wide_rows(df, n, ordering.review_key(), ["review_id"])
    assert got.columns == ["review_id", "wide"]
    assert sorted(int(r.review_id) for r in got.collect()) == list(range(min(n, 1500)))


def test_first_wide_rows_cuts_ties_and_orders_text_last(spark):
    ids = ["7"] * 400 + ["3", "b", "a"]
    df = spark.createDataFrame([(i,) for i in ids], "review_id string").repartition(5)
    first = lambda n: sorted(
        r.review_id for r in
        ordering.first_wide_rows(df, n, ordering.review_key(), ["review_id"]).collect())
    assert first(20) == ["3"] + ["7"] * 19
    assert first(402) == ["3"] + ["7"] * 400 + ["a"]
    assert ordering.first_wide_rows(df.limit(0), 5, ordering.review_key(), ["review_id"]).count() == 0


def test_first_rows_with_one_hot_key(spark):
    df = spark.range(1000).selectExpr("'7' AS review_id").union(
        spark.range(5).selectExpr("string(id)")).repartition(5)
    got = ordering.first_rows(df, 20, ordering.review_order(), ["review_id"])
    assert sorted(r.review_id for r in got.collect()) == ["0", "1", "2", "3", "4"] + ["7"] * 15


def test_first_rows_per_group_with_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"t{i % 10}", str(i)) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "assunto string, review_id string").repartition(9)
    got = ordering.first_rows_per_group(df, 4, ["assunto"], ordering.review_order(), "pos", salts=3)
    expected = {}
    for topic, i in sorted(rows, key=lambda r: int(r[1])):
        expected.setdefault(topic, []).append(i)
    want = [(t, i, p + 1) for t, ids in expected.items() for p, i in enumerate(ids[:4])]
    assert sorted(tuples(got)) == sorted(want)
    assert "WindowGroupLimit" in plan(got)


@pytest.mark.parametrize("parts", [1, 5])
def test_numbered(spark, parts):
    """One number per row in the total order, texts of one script and first letter included."""
    rng = random.Random(3)
    rows = [(rng.randrange(4) / 2, rng.choice("漢字a") + "".join(rng.choice("漢字ção") for _ in range(4)) + str(i))
            for i in range(400)] + [(None, "x"), (0.5, None)]
    df = spark.createDataFrame(rows, "p double, w string").repartition(parts)
    got = ordering.numbered(df, [F.desc_nulls_last("p"), F.asc_nulls_first("w")], "n", start=0)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, (r[1] or "").encode()))
    assert tuples(got, "n") == [(n, p, w) for n, (p, w) in enumerate(order)]
    assert got.dtypes == [("n", "int"), *df.dtypes]


def test_numbering_is_spread(spark):
    """No task but the one that adds up partition counts sorts without a key."""
    got = ordering.numbered(spark.range(1000).toDF("w"), [F.asc("w")], "n")
    assert "SinglePartition" not in plan(got).split("BroadcastExchange")[0]
    assert got.filter("n <> w + 1").count() == 0


def test_numbered_empty(spark):
    df = spark.createDataFrame([], "w string")
    assert ordering.numbered(df, [F.asc("w")], "n").count() == 0


def test_strip_whitespace_of_any_kind(spark):
    value = " \t a b \r\n"
    assert one(spark, text.strip_whitespace(F.col("v")), v=("string", value)) == value.strip()
