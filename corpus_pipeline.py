"""A training corpus from raw documents: language, copies, near copies, mixture, packing."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocspark.llm import exact_dedup, language_id, mixing, near_dedup, packing
from vocspark.llm.common import documents, stored
from vocspark.llm.registry import id_fold

MIN_SCORE = 0.5


def keep_known_language(
    spark: SparkSession, docs: DataFrame, sf_dir: str, languages: Collection[str] | None = None,
    min_score: float = MIN_SCORE,
) -> DataFrame:
    """Documents whose predicted language is one of `languages` (null: any that was learnt).

    Rejected are texts without a letter, texts of another language, and texts whose best language has a
    posterior under `min_score`. Where no row is labelled, the model knows no language: then only
    the texts without a letter go. Null and empty texts go; repeated rows and ties (the first language
    by code point) are judged like any other.
    """
    model = language_id.train(docs.filter(id_fold(4) != 2))
    if model[0]:
        wanted = F.col("lang_pred").isin(*(languages or model[0])) & (F.col("score") >= min_score)
    else:
        wanted = F.coalesce(F.col("row.text"), F.lit("")).rlike(r"\p{L}")
    return language_id.identify(docs, model).filter(wanted).select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for A-Z case, the row with the largest doc_id; null texts count as empty."""
    return exact_dedup.exact_dedup(docs).filter("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per group that SimHash fingerprints of 3-word shingles link within two bits.

    The smallest doc_id stays; null and empty texts share one fingerprint; of repeated rows one stays.
    """
    return near_dedup.keep_one(docs, near_dedup.near_dedup(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order; one row per time the mixture takes a document.

    A null source is one of its own; null texts have no words and are taken by their place.
    """
    return mixing.training_stream(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences; a null text has its end token alone, copies are packed each."""
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

# The language model and the fingerprints have no SQL form; tests hold stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
