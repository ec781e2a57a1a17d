import pytest
from pyspark.sql import functions as F

from tests.conftest import tuples
from vocspark import config
from vocspark.operators import clean, curate, parse


def test_rename_ignores_absent_columns(spark):
    df = spark.createDataFrame([("1", "x")], "_c0 string, other string")
    assert clean.rename(df).columns == ["review_id", "other"]


def test_cast_ints_gives_null_for_bad_text(spark):
    df = spark.createDataFrame([("5",), (" 5 ",), ("5.0",), ("x",), ("",), (None,)], "age string")
    got = [r.age for r in clean.cast_ints(df, ["age"]).collect()]
    assert got == [5, 5, None, None, None, None]


def raw(spark, rows):
    return spark.createDataFrame(
        rows, "review_id string, age string, title string, review_text string, rating string, "
        "recommended string, positive_feedback_count string")


def test_clean_reviews(spark):
    df = raw(spark, [
        ("1", "30", None, "fits", "5", "1", "0"),
        ("2", "x", "Nice", "  ", "5", "1", "0"),
        ("3", "x", "Nice", None, "5", "1", "0"),
        ("4", "41", "Nice", "\n", "n", None, "2"),
    ])
    got = tuples(clean.clean_reviews(df).select("review_id", "age", "rating", "texto_completo"),
                 "review_id")
    assert got == [("1", 30, 5, ". fits"), ("4", 41, None, "Nice. \n")]
    assert clean.clean_reviews(df.limit(0)).count() == 0


def test_bounded_sample(spark):
    df = spark.range(100).selectExpr("string(id) AS review_id").repartition(6)
    got = clean.bounded_sample(df, 7, partitions=3)
    assert sorted(int(r.review_id) for r in got.collect()) == list(range(7))
    assert got.rdd.getNumPartitions() == 3
    assert clean.bounded_sample(df, None).count() == 100
    assert clean.bounded_sample(df.limit(0), 7).count() == 0


def answered(spark, *answers):
    return spark.createDataFrame([(a,) for a in answers], "classificacao_json string")


def test_enrich(spark):
    df = answered(
        spark, '{"assunto":" Cor ","sentimento":" Muito POSITIVO "}', "{bad", None,
        '{"assunto":"preço","sentimento":"misto"}', '{"sentimento":"neutro"}')
    got = [(r.assunto, r.sentimento) for r in parse.enrich(df).collect()]
    assert got == [("cor", "positivo"), (None, "indefinido"), (None, "indefinido"),
                   ("preço", "indefinido"), (None, "neutro")]


@pytest.mark.parametrize("enforce, kept", [(False, ["1", "2"]), (True, ["1"])])
def test_classified_reviews_gate(spark, gold, enforce, kept):
    rows = [("1", "cor", "positivo"), ("2", "vestido", "neutro"), ("3", None, "positivo"),
            ("4", "cor", "indefinido")]
    labels = spark.createDataFrame(rows, "review_id string, assunto string, sentimento string")
    other = {c: F.lit(1) for c in gold.columns if c not in labels.columns}
    df = labels.withColumns(other).withColumn("embedding", F.array(F.lit(1.0)))
    got = curate.classified_reviews(df, enforce_domain=enforce)
    assert sorted(r.review_id for r in got.collect()) == kept
    assert tuple(got.columns) == config.CLASSIFIED_COLUMNS
