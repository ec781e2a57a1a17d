"""Every registered query against its SQL twin, and figures known in advance."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import optimized, tuples
from tools.check import connect, rows_of
from vocspark.plans import fixtures as fx
from vocspark.plans import oracles
from vocspark.plans.queries import queries
from vocspark.sources import reviews_csv, scratch

SMALL, MIDDLE, LARGE = (f"/root/testdata/sf{s}" for s in ("0.001", "0.01", "0.1"))


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    return connect(SMALL)


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, key):
    df = entry.queries()[key](spark, SMALL)
    want = duck.sql(entry.oracle_sql()[key])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert set(queries()) == set(oracles.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 13


def test_known_figures(spark):
    q = queries()
    assert tuples(q["removed_rows"](spark, MIDDLE)) == [(80, 920)]
    assert tuples(q["unclassified_counts"](spark, MIDDLE)) == [(80, 80)]
    assert tuples(q["off_domain_topics"](spark, MIDDLE)) == [("vestido", 40)]
    assert fx.gold(spark, MIDDLE).count() == 800
    assert q["semantic_join"](spark, MIDDLE).count() == 400
    assert tuples(q["worst_topic"](spark, MIDDLE))[0][:2] == ("estilo", 85.0)
    assert [r[1:] for r in tuples(q["critical_topics"](spark, MIDDLE), "rank")] == [
        ("estilo", 51), ("cor", 46), ("outro", 34), ("tecido", 32), ("qualidade", 25)]
    assert [r[1:] for r in tuples(q["critical_topics"](spark, SMALL), "rank")] == [
        ("estilo", 10), ("cor", 8), ("encolhimento", 7), ("outro", 7), ("tecido", 6)]
    assert tuples(q["sentiment_coherence"](spark, MIDDLE)) == [(1.48, 3.0, 4.26, True)]


def test_totals_agree(spark):
    q = queries()
    total = fx.gold(spark, LARGE).count()
    counted = q["topic_sentiment_counts"](spark, LARGE).agg(F.sum("qtd")).first()[0]
    cells = F.col("negativo") + F.col("neutro") + F.col("positivo")
    in_matrix = q["topic_sentiment_matrix"](spark, LARGE).agg(F.sum(cells)).first()[0]
    departments = q["department_sentiment"](spark, LARGE).agg(F.sum("qtd")).first()[0]
    known = fx.gold(spark, LARGE).filter("department_name IS NOT NULL").count()
    assert counted == in_matrix == total and departments == known


def test_unused_label_join_is_left_out(spark):
    assert "labels" not in optimized(queries()["topic_summary"](spark, SMALL))
    assert "Join" not in optimized(queries()["topic_summary"](spark, SMALL))


def test_audit_columns_reads_no_larger_files_from_larger_tables(spark):
    made = len(scratch._made)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        splits = fx.table(spark, MIDDLE, "documents").rdd.getNumPartitions()
        audited = queries()["audit_columns"](spark, MIDDLE)
        assert audited.filter("own_file AND has_ts").count() == audited.count() == 2000
        folder = scratch._made[made]
        files = [f for f in os.listdir(folder) if f.endswith(".csv")]
        assert splits > 8 and len(files) == 2 * splits
        lines = reviews_csv._lines(spark, folder, None)
        assert lines.rdd.getNumPartitions() >= 2 * len(files)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
