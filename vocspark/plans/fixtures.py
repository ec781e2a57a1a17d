"""Reviews derived from the test tables (rules in FIXTURES.md), whole tables always."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocspark import config
from vocspark.operators.aggregate import topic_summary
from vocspark.operators.clean import clean_reviews
from vocspark.operators.curate import classified_reviews
from vocspark.operators.parse import enrich

RAW_COLUMNS = (
    "review_id", "clothing_id", "age", "title", "review_text", "rating", "recommended",
    "positive_feedback_count", "division_name", "department_name", "class_name",
)
CSV_HEADERS = (
    "_c0", "Clothing ID", "Age", "Title", "Review Text", "Rating", "Recommended IND",
    "Positive Feedback Count", "Division Name", "Department Name", "Class Name",
)

# Word lists of the lexicon stand-in.
LEXICON = (
    ("the", "caimento", 1), ("and", "tamanho", 1), ("of", "conforto", 1),
    ("de", "qualidade", 1), ("la", "tecido", 1), ("des", "cor", 1), ("was", "estilo", 1),
)
POLARITY = (("with", 1), ("for", 1), ("was", -1), ("from", -1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Topic and sentiment of a document, and what the model answered for it.
_PLACE = "int(doc_id * 5 % 12)"
_TOPIC = f"element_at(array({', '.join(repr(t) for t in config.TOPICS)}), {_PLACE} + 1)"
_SENTIMENT = f"""
    CASE WHEN (doc_id * 3 + 1) % 7 < {_PLACE} % 7 THEN 'negativo'
         WHEN (doc_id * 3 + 1) % 7 = {_PLACE} % 7 THEN 'neutro'
         ELSE 'positivo' END"""
_ANSWER = """
    if(doc_id % 23 = 0, '{bad', concat(
        '{"assunto":',
        CASE doc_id % 23 WHEN 1 THEN '"vestido"' WHEN 2 THEN '" Cor "' WHEN 4 THEN 'null'
                         ELSE concat('"', topic, '"') END,
        ',"sentimento":"',
        CASE doc_id % 23 WHEN 1 THEN 'positivo' WHEN 2 THEN 'Muito Positivo' WHEN 3 THEN 'misto'
                         ELSE sentiment END,
        '"}'))"""
_REVIEW = {
    "review_id": "string(doc_id)",
    "clothing_id": "string(doc_id % 100)",
    "age": "string(18 + doc_id * 7 % 60)",
    "title": "if(doc_id % 4 = 0, NULL, source)",
    "review_text": "CASE doc_id % 25 WHEN 0 THEN NULL WHEN 1 THEN '   ' ELSE text END",
    "rating": """
        CASE WHEN doc_id % 50 = 7 THEN 'x'
             WHEN sentiment = 'negativo' THEN string(1 + doc_id % 2)
             WHEN sentiment = 'neutro' THEN '3'
             ELSE string(4 + doc_id % 2) END""",
    "recommended": "string(quality)",
    "positive_feedback_count": "string(n_chars % 30)",
    "division_name": "lang",
    "department_name": "if(doc_id % 20 = 3, NULL, lang)",
    "class_name": "source",
    "classificacao_json": _ANSWER,
}


def answered_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw reviews, each with the text a model answered for it.

    The labels are grouped by document so that the optimizer knows the join adds no
    rows and leaves it out of every query that does not read `recommended`.
    """
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    documents = table(spark, sf_dir, "documents").selectExpr(
        "*", f"{_TOPIC} AS topic", f"{_SENTIMENT} AS sentiment"
    )
    return documents.join(labels, "doc_id", "left").selectExpr(
        *(f"{rule} AS {name}" for name, rule in _REVIEW.items())
    )


def reviews_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answered_reviews(spark, sf_dir).select(*RAW_COLUMNS)


def csv_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw reviews under the headers of the source file."""
    return reviews_raw(spark, sf_dir).toDF(*CSV_HEADERS)


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_reviews(answered_reviews(spark, sf_dir))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(cleaned(spark, sf_dir))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified_reviews(enriched(spark, sf_dir))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_summary(gold(spark, sf_dir))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("review_id"), "embedding", "label"
    )
