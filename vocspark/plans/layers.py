"""The layered job: review file -> bronze -> silver -> gold tables.

Each stage reads the tables of the stage before and writes its own, so a model is
asked once per review and a failed stage is repeated alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vocspark import config
from vocspark.config import Layout
from vocspark.operators import aggregate, quality, rank
from vocspark.operators.clean import bounded_sample, clean_reviews
from vocspark.operators.curate import classified_reviews
from vocspark.operators.parse import enrich
from vocspark.sources import answers, reviews_csv
from vocspark.sources.tables import create_schemas, drop_tables, spread, write_table

Job = Callable[[DataFrame], DataFrame]
MALFORMED = "_malformed_record"


@dataclass(frozen=True)
class Models:
    """The three model jobs, each a function from a frame to a frame.

    `embed` adds `embedding`, `classify` adds `classificacao_json`, `summarise` turns
    the negative reviews of the critical topics into `assunto, qtd_negativos, resumo`. The versions name
    model and prompt: a resumed run asks all texts again when a version has changed.
    """

    embed: Job
    classify: Job
    summarise: Job
    embed_version: str = ""
    classify_version: str = ""


def bronze(
    spark: SparkSession,
    path: str,
    layout: Layout = Layout(),
    source_file: str | None = None,
    split_files: bool = False,
    allow_malformed: bool = False,
) -> DataFrame:
    """Load the files as they are, with safe names, load time and each row's file name.

    The write itself observes how many rows it gets and how many of them had more or fewer fields than the
    header; those fail the load unless `allow_malformed`. The number of rows must also be
    the number of records that the files' text holds, which is counted without the CSV reader.
    """
    read = reviews_csv.read_reviews(spark, path, split_files, reviews_csv.SOURCE_FILE, MALFORMED)
    seen = Observation("bronze")
    observed = read.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count(F.col(MALFORMED)).alias("malformed")).drop(MALFORMED)
    audited = reviews_csv.add_audit(reviews_csv.sanitize_names(observed), source_file)
    table = write_table(audited, layout.table("bronze", "reviews"), layout)
    if seen.get["malformed"] and not allow_malformed:
        raise quality.CountMismatch(f"{seen.get['malformed']} records do not have the header's number of fields")
    quality.require_equal_counts(reviews_csv.record_count(spark, path), table, seen.get["rows"])
    return table


def silver_clean(
    spark: SparkSession,
    layout: Layout = Layout(),
    sample: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    cleaned = clean_reviews(spark.table(layout.table("bronze", "reviews")))
    wanted = bounded_sample(cleaned, sample, partitions)
    return write_table(
        wanted, layout.table("silver", "reviews_limpo"), layout, bucket_by="review_id"
    )


def silver_embeddings(
    spark: SparkSession, embed: Job, layout: Layout = Layout(), resume: bool = False, version: str = ""
) -> DataFrame:
    return _model_stage(
        spark, embed, "embedding", "reviews_limpo", "reviews_embeddings", layout, resume, version)


def silver_responses(
    spark: SparkSession, classify: Job, layout: Layout = Layout(), resume: bool = False, version: str = ""
) -> DataFrame:
    return _model_stage(
        spark, classify, "classificacao_json", "reviews_embeddings", "reviews_classified_raw", layout, resume,
        version)


def _model_stage(
    spark: SparkSession, job: Job, out: str, source: str, target: str, layout: Layout, resume: bool, version: str
) -> DataFrame:
    """Run a model job from one silver table into another.

    With `resume`, answers go through a journal table: only texts without an answer there are asked,
    slice by slice, and the job sees the text column alone. The journal starts with the answers
    of the target table, where a run without it has left one.
    """
    scan, name = spark.table(layout.table("silver", source)), layout.table("silver", target)
    journal = f"{name}_answers"
    if resume:
        if spark.catalog.tableExists(name) and not spark.catalog.tableExists(journal):
            answers.start_journal(spark.table(name), out, journal, layout, version)
        rows = answers.with_answers(scan, job, out, journal, layout, version)
    else:
        rows = job(spread(scan, scan))  # a sample or a single file would keep one core busy
    return write_table(rows, name, layout, bucket_by="review_id")


def silver_enriched(spark: SparkSession, layout: Layout = Layout()) -> DataFrame:
    answered = spark.table(layout.table("silver", "reviews_classified_raw"))
    return write_table(
        enrich(answered), layout.table("silver", "reviews_enriched"), layout, bucket_by="review_id"
    )


def gold_reviews(
    spark: SparkSession, layout: Layout = Layout(), enforce_domain: bool = False
) -> DataFrame:
    enriched = spark.table(layout.table("silver", "reviews_enriched"))
    return write_table(
        classified_reviews(enriched, enforce_domain),
        layout.table("gold", "reviews_classified"),
        layout,
        bucket_by="review_id",
    )


def gold_aggregates(spark: SparkSession, layout: Layout = Layout()) -> dict[str, DataFrame]:
    """All aggregates from one scan of the classified reviews, by way of a small table of cells."""
    gold = spark.table(layout.table("gold", "reviews_classified"))
    cells = write_table(aggregate.sentiment_cells(gold), layout.table("gold", "celulas"), layout)
    frames = {
        "sentimento_por_assunto": aggregate.topic_sentiment_from_cells(cells),
        "assunto_resumo": aggregate.topic_summary_from_cells(cells),
        "sentimento_por_departamento": aggregate.department_sentiment_from_cells(cells),
        "indicadores": aggregate.report_kpis_from_cells(cells),
    }
    return {
        name: write_table(df, layout.table("gold", name), layout) for name, df in frames.items()
    }


def gold_summaries(
    spark: SparkSession,
    summarise: Job,
    layout: Layout = Layout(),
    topics: int = config.TOP_TOPICS,
) -> DataFrame:
    gold = spark.table(layout.table("gold", "reviews_classified"))
    summaries = summarise(rank.critical_negatives(gold, topics))
    return write_table(summaries, layout.table("gold", "resumo_executivo"), layout)


def drop_intermediates(spark: SparkSession, layout: Layout = Layout()) -> None:
    names = ("reviews_limpo", "reviews_classified_raw")
    drop_tables(spark, *(layout.table("silver", n) for n in names))


def run(
    spark: SparkSession,
    path: str,
    models: Models,
    layout: Layout = Layout(),
    sample: int | None = None,
    partitions: int | None = None,
    split_files: bool = False,
    resume: bool = False,
) -> None:
    """All stages in order."""
    create_schemas(spark, layout)
    bronze(spark, path, layout, split_files=split_files)
    silver_clean(spark, layout, sample, partitions)
    silver_embeddings(spark, models.embed, layout, resume, models.embed_version)
    silver_responses(spark, models.classify, layout, resume, models.classify_version)
    silver_enriched(spark, layout)
    gold_reviews(spark, layout)
    gold_aggregates(spark, layout)
    gold_summaries(spark, models.summarise, layout)
