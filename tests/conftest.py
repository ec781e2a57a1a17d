import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def gold(spark):
    """Classified reviews: topic, sentiment, rating, age, department."""
    rows = [
        ("1", "cor", "negativo", 1, 20, "Tops"),
        ("2", "cor", "negativo", 2, 30, "Tops"),
        ("3", "cor", "positivo", None, 40, None),
        ("10", "estilo", "negativo", 2, 50, "Dresses"),
        ("11", "estilo", "negativo", 1, 21, "Dresses"),
        ("12", "tecido", "neutro", 3, 22, "Tops"),
        ("13", "vestido", "positivo", 5, None, "Tops"),
    ]
    base = spark.createDataFrame(
        rows, "review_id string, assunto string, sentimento string, rating int, age int, "
        "department_name string")
    return base.selectExpr(
        "review_id", "concat('texto ', review_id) AS texto_completo", "assunto", "sentimento",
        "rating", "0 AS positive_feedback_count", "age", "1 AS recommended",
        "'c' AS clothing_id", "'d' AS division_name", "department_name", "'k' AS class_name")


@pytest.fixture()
def empty_gold(gold):
    return gold.limit(0)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def tuples(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
