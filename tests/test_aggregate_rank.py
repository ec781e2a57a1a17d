from pyspark.sql import functions as F

from tests.conftest import plan, tuples
from vocspark.operators import aggregate, rank


def test_topic_summary(gold):
    got = tuples(aggregate.topic_summary(gold), "assunto")
    assert got == [
        ("cor", 3, 1.5, 30.0, 66.7),  # the NULL rating is left out of the mean only
        ("estilo", 2, 1.5, 35.5, 100.0),
        ("tecido", 1, 3.0, 22.0, 0.0),
        ("vestido", 1, 5.0, None, 0.0),
    ]


def test_all_aggregates_from_one_table_of_cells(gold, empty_gold):
    for reviews in (gold, empty_gold):
        cells = aggregate.sentiment_cells(reviews)
        for made, want in (
            (aggregate.topic_sentiment_from_cells(cells), aggregate.topic_sentiment_counts(reviews)),
            (aggregate.department_sentiment_from_cells(cells), aggregate.department_sentiment(reviews)),
            (aggregate.topic_summary_from_cells(cells), aggregate.topic_summary(reviews)),
            (aggregate.report_kpis_from_cells(cells), aggregate.report_kpis(reviews)),
        ):
            assert sorted(tuples(made)) == sorted(tuples(want)) and made.dtypes == want.dtypes


def test_cells_scan_the_reviews_once(spark, gold, tmp_path):
    gold.write.parquet(str(tmp_path / "g"))
    text = plan(aggregate.sentiment_cells(spark.read.parquet(str(tmp_path / "g"))))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1
    assert "texto_completo" not in text


def test_in_order_numbers_missing_values_first(spark):
    df = spark.createDataFrame([("b", 1), (None, 2), ("a", 3)], "assunto string, qtd int")
    assert tuples(rank.in_order(df, "assunto"), "rank") == [(1, None, 2), (2, "a", 3), (3, "b", 1)]


def test_counts_agree(gold):
    total = gold.count()
    by_topic = aggregate.topic_sentiment_counts(gold)
    assert by_topic.agg(F.sum("qtd")).first()[0] == total
    assert aggregate.topic_counts(gold).agg(F.sum("qtd")).first()[0] == total
    departments = aggregate.department_sentiment(gold).agg(F.sum("qtd")).first()[0]
    assert departments == gold.filter("department_name IS NOT NULL").count()


def test_matrix_always_has_three_columns(gold):
    counts = aggregate.topic_sentiment_counts(gold.filter("sentimento = 'negativo'"))
    assert tuples(aggregate.sentiment_matrix(counts, "assunto"), "assunto") == [
        ("cor", 2, 0, 0), ("estilo", 2, 0, 0)]


def test_share(gold):
    shares = aggregate.topic_sentiment_share(aggregate.topic_sentiment_counts(gold))
    got = [r[:5] for r in tuples(shares.filter("assunto = 'cor'"), "sentimento")]
    assert got == [("cor", "negativo", 2, 3, 66.7), ("cor", "positivo", 1, 3, 33.3)]


def test_kpis(gold, empty_gold):
    assert tuples(aggregate.report_kpis(gold)) == [(7, 4, 57.1, 4)]
    assert tuples(aggregate.report_kpis(empty_gold)) == [(0, 0, 0.0, 0)]


def test_critical_topics_breaks_ties_by_name(gold, empty_gold):
    assert tuples(rank.critical_topics(gold, 1)) == [(1, "cor", 2)]
    assert tuples(rank.critical_topics(gold), "rank") == [(1, "cor", 2), (2, "estilo", 2)]
    assert tuples(rank.critical_topics(empty_gold)) == []


def test_topic_catalog(gold):
    assert tuples(rank.topic_catalog(gold), "ordinal") == [
        ("cor", 0), ("estilo", 1), ("tecido", 2), ("vestido", 3)]


def test_pain_ranking_flags_strictly_above_the_median(gold, empty_gold):
    got = tuples(rank.pain_ranking(aggregate.topic_summary(gold)), "rank")
    assert got == [(1, "estilo", 100.0, True), (2, "cor", 66.7, True),
                   (3, "tecido", 0.0, False), (4, "vestido", 0.0, False)]
    odd = aggregate.topic_summary(gold.filter("assunto <> 'vestido'"))
    assert [r.above_median for r in rank.pain_ranking(odd).orderBy("rank").collect()] == [
        True, False, False]
    assert rank.pain_ranking(aggregate.topic_summary(empty_gold)).count() == 0


def test_both_worst_topics(gold, empty_gold):
    assert rank.worst_topic_by_count(gold).first().assunto == "cor"
    assert rank.worst_topic_by_pct(aggregate.topic_summary(gold)).first().assunto == "estilo"
    assert rank.worst_topic_by_count(empty_gold).first().assunto is None


def test_drilldown(gold, empty_gold):
    ids = lambda df: [r.review_id for r in df.collect()]
    assert ids(rank.drilldown(gold, "cor")) == ["1", "2"]
    assert ids(rank.drilldown(gold, "cor", n=1)) == ["1"]
    assert ids(rank.drilldown(gold, "cor", "positivo")) == ["3"]
    assert ids(rank.drilldown(gold, rank.worst_topic_by_count(gold))) == ["1", "2"]
    assert ids(rank.drilldown(empty_gold, rank.worst_topic_by_count(empty_gold))) == []


def test_drilldown_filter_reaches_the_scan(spark, gold, tmp_path):
    gold.write.parquet(str(tmp_path / "g"))
    stored = spark.read.parquet(str(tmp_path / "g"))
    text = plan(rank.drilldown(stored, rank.worst_topic_by_count(stored)))
    assert "EqualTo(sentimento,negativo)" in text
    assert "EqualTo(assunto,ScalarSubquery" in text
    assert "clothing_id" not in text


def test_topic_review_samples(gold, empty_gold):
    got = rank.topic_review_samples(gold, topics=2, k=1)
    assert tuples(got.select("assunto", "pos", "review_id", "qtd_negativos"), "assunto") == [
        ("cor", 1, "1", 2), ("estilo", 1, "10", 2)]
    assert rank.topic_review_samples(empty_gold).count() == 0


def test_critical_negatives_are_all_there(gold):
    got = rank.critical_negatives(gold, topics=1)
    assert sorted(r.review_id for r in got.collect()) == ["1", "2"]
    assert {(r.assunto, r.qtd_negativos) for r in got.collect()} == {("cor", 2)}


def test_preview_orders_by_number(gold):
    assert [r.review_id for r in rank.preview(gold, 4).collect()] == ["1", "2", "3", "10"]
