from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.conftest import tuples
from vocspark.operators import aggregate, quality, report


def test_reconcile(spark):
    def records(n):
        return spark.range(n).agg(F.count("*").alias("records"))

    a, b = spark.range(5).toDF("x"), spark.range(4).toDF("y")
    assert tuples(quality.reconcile_counts(records(5), a)) == [(5, 5, 5, True)]
    assert tuples(quality.reconcile_counts(records(5), b)) == [(5, 4, 4, False)]
    assert tuples(quality.reconcile_counts(records(4), b, written=5)) == [(4, 5, 4, False)]
    assert tuples(quality.reconcile_counts(records(0), b.limit(0))) == [(0, 0, 0, True)]
    assert quality.require_equal_counts(records(5), a, 5) == 5
    with pytest.raises(quality.CountMismatch, match="5 records, 4 rows were written, table has 4"):
        quality.require_equal_counts(records(5), b)


def test_blank_rules_differ(spark):
    df = spark.createDataFrame([(None,), ("",), ("   ",), ("\n",), ("a",)], "review_text string")
    assert tuples(quality.text_completeness(df)) == [(3, 2, 5)]
    assert tuples(quality.removed_rows(df)) == [(3, 2)]
    assert tuples(quality.text_completeness(df.limit(0))) == [(0, 0, 0)]


def test_embedding_profile(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,)], "embedding array<float>")
    assert tuples(quality.embedding_profile(df)) == [(1, 2, 2, 3)]
    assert tuples(quality.embedding_profile(df.limit(0))) == [(None, None, 0, 0)]


def test_domain_checks(spark):
    rows = [("cor", "positivo"), ("vestido", "neutro"), ("vestido", "indefinido"), (None, "neutro")]
    df = spark.createDataFrame(rows, "assunto string, sentimento string")
    assert tuples(quality.off_domain_topics(df)) == [("vestido", 2)]  # no row for NULL
    assert tuples(quality.unclassified_counts(df)) == [(1, 1)]


@pytest.mark.parametrize("ratings, coherent", [
    ((1, 3, 5), True), ((3, 3, 5), False), ((5, 3, 1), False), ((1, None, 5), False)])
def test_coherence(spark, ratings, coherent):
    rows = [(s, r) for s, r in zip(("negativo", "neutro", "positivo"), ratings)]
    df = spark.createDataFrame(rows, "sentimento string, rating int")
    assert quality.sentiment_coherence(df).first().coherent is coherent


def test_share_totals(spark):
    rows = [("a", 33.3), ("a", 33.3), ("a", 33.3), ("b", 50.0), ("b", 49.0)]
    df = spark.createDataFrame(rows, "assunto string, pct double")
    assert tuples(quality.share_totals(df), "assunto") == [("a", 99.9, True), ("b", 99.0, False)]


def test_header(gold):
    assert tuples(report.report_header(gold, date(2024, 3, 9))) == [
        ("09/03/2024", "20240309", 7, 4, 57.1, 4)]


def test_criticality_order_and_worst(gold, empty_gold):
    summary = aggregate.topic_summary(gold)
    assert [(r.rank, r.assunto, r.band) for r in report.criticality_bands(summary).orderBy("rank").collect()] == [
        (1, "estilo", "red"), (2, "cor", "red"), (3, "tecido", "green"), (4, "vestido", "green")]
    assert tuples(report.worst_topic(summary)) == [("estilo", 100.0, 1.5, 2, 7)]
    assert tuples(report.worst_topic(aggregate.topic_summary(empty_gold))) == []


def test_summary_lines(spark):
    text = "- um\n\n  * dois  \n• três\n**quatro** x\n1. cinco\n   \n\tseis\n-"
    df = spark.createDataFrame([("cor", 3, text)], "assunto string, qtd_negativos bigint, resumo string")
    assert [r[1:] for r in tuples(report.summary_lines(df), "pos")] == [
        (0, True, "um"), (1, True, "dois"), (2, True, "três"), (3, True, "quatro** x"),
        (4, False, "1. cinco"), (5, False, "seis"), (6, True, "")]


def test_summary_cards(spark):
    rows = [("cor", 1, "a"), ("preço", 2, "b")]
    df = spark.createDataFrame(rows, "assunto string, qtd_negativos bigint, resumo string")
    assert tuples(report.summary_cards(df), "rank") == [(1, "PREÇO", 2, "b"), (2, "COR", 1, "a")]
    assert report.summary_cards(df.filter(F.lit(False))).count() == 0
