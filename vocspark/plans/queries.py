"""One query per operator, each over whole tables of a data folder."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import date
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocspark import config
from vocspark.functions.labels import json_field
from vocspark.functions.text import has_text
from vocspark.operators import aggregate, clean, infer, models, parse, quality, rank, report, semantic
from vocspark.plans import fixtures as fx
from vocspark.plans import layers
from vocspark.sources import answers, reviews_csv
from vocspark.sources.scratch import shared_folder
from vocspark.sources.tables import create_schemas, spread, write_table

Query = Callable[[SparkSession, str], DataFrame]

REPORT_DAY = date(2024, 3, 9)
BOUNDED_SAMPLE = 300
HASH_DIM = 64


# ---- sources and tables ----------------------------------------------------

def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "csv")
    reviews_csv.write_csv(fx.reviews_raw(spark, sf_dir), path)
    return reviews_csv.read_csv(spark, path)


def csv_split_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "csv")
    reviews_csv.write_csv(fx.reviews_raw(spark, sf_dir), path)
    return reviews_csv.read_large_csv(spark, path)


def sanitized_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews_csv.sanitize_names(fx.csv_reviews(spark, sf_dir))


def audit_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's own file, by both readers: a file's rows are as many as the records in its text.

    One task reads a file, so there are more files where the documents have more splits.
    """
    path = shared_folder(spark, "csv")
    files = max(4, 2 * fx.table(spark, sf_dir, "documents").rdd.getNumPartitions())
    reviews_csv.write_csv(fx.csv_reviews(spark, sf_dir).repartition(files, "_c0"), path)
    counted = reviews_csv.file_records(spark, path).select(
        F.element_at(F.split("file", "/"), -1).alias("_source_file"), "records")
    found = []
    for split_files in (False, True):
        read = reviews_csv.read_reviews(spark, path, split_files, reviews_csv.SOURCE_FILE)
        audited = reviews_csv.add_audit(read).withColumn(
            "rows", F.count(F.lit(1)).over(Window.partitionBy("_source_file")))
        found.append(audited.join(counted, "_source_file", "left").select(
            F.lit(split_files).alias("split_files"), F.col("_c0").alias("review_id"),
            (F.col("rows") == F.col("records")).alias("own_file"),
            F.col("_ingest_timestamp").isNotNull().alias("has_ts")))
    return found[0].unionByName(found[1])


def table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save a narrow table, replace it by one with another schema, and scan it by name."""
    layout = _scratch_layout(spark)
    name = layout.table("gold", "reviews_classified")
    gold = fx.gold(spark, sf_dir)
    write_table(aggregate.topic_counts(gold), name, layout)
    return write_table(gold, name, layout)


def _scratch_layout(spark: SparkSession) -> config.Layout:
    """Schemas of their own, in a fresh shared folder."""
    folder = shared_folder(spark, "tables")
    run = folder.rsplit("-", 1)[1]
    layout = config.Layout(
        f"bronze_{run}", f"silver_{run}", f"gold_{run}", location=folder
    )
    create_schemas(spark, layout)
    return layout


def tables_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The silver tables before the intermediates are dropped, and which of them are left."""
    layout = _scratch_layout(spark)
    for name in ("reviews_limpo", "reviews_classified_raw", "reviews_enriched"):
        write_table(fx.enriched(spark, sf_dir).select("review_id", "assunto"), layout.table("silver", name), layout)
    before = {t.name: spark.table(layout.table("silver", t.name)).count() for t in spark.catalog.listTables(layout.silver)}
    layers.drop_intermediates(spark, layout)
    left = {t.name for t in spark.catalog.listTables(layout.silver)}
    rows = [(name, rows, name in left) for name, rows in before.items()]
    return spark.createDataFrame(rows, "table_name string, rows long, is_left boolean")


def layered_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review file to topic summary through all stored layers, with the word-list classifier."""
    path = shared_folder(spark, "csv")
    reviews_csv.write_csv(fx.csv_reviews(spark, sf_dir), path)
    models_used = layers.Models(
        embed=partial(infer.embed_hashed, dim=HASH_DIM),
        classify=partial(infer.classify_lexicon, lexicon=fx.LEXICON, polarity=fx.POLARITY),
        summarise=infer.summarise_extractive,
    )
    layout = _scratch_layout(spark)
    layers.run(spark, path, models_used, layout, sample=None)
    return spark.table(layout.table("gold", "assunto_resumo"))


def reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "csv")
    reviews_csv.write_csv(fx.csv_reviews(spark, sf_dir), path)
    table_path = shared_folder(spark, "bronze")
    reviews_csv.sanitize_names(reviews_csv.read_csv(spark, path)).write.parquet(table_path)
    return quality.reconcile_counts(reviews_csv.record_count(spark, path), spark.read.parquet(table_path))


# ---- cleaning --------------------------------------------------------------

def rename_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.cast_ints(clean.rename(sanitized_columns(spark, sf_dir)))


def nonblank_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_blank(fx.reviews_raw(spark, sf_dir)).select("review_id", "review_text")


def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.add_full_text(fx.reviews_raw(spark, sf_dir)).select("review_id", "texto_completo")


def bounded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = clean.drop_blank(fx.reviews_raw(spark, sf_dir))
    return clean.bounded_sample(kept.select("review_id"), BOUNDED_SAMPLE)


# ---- model jobs ------------------------------------------------------------

def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.cleaned(spark, sf_dir).select("review_id", "texto_completo")


def _spread_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_texts(spark, sf_dir), fx.table(spark, sf_dir, "documents"))


def embed_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.embedding_cells(infer.embed_hashed(_spread_texts(spark, sf_dir), HASH_DIM))


def shape_model() -> models.Model:
    """A model stand-in: length and line count of the text."""
    return lambda texts: [[float(len(t)), float(t.count("\n"))] for t in texts]


def embed_callable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.embedding_cells(models.embed_with_model(_spread_texts(spark, sf_dir), shape_model))


def _prompts(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    prompt = models.closed_topic_prompt(template=template).alias("prompt")
    return _texts(spark, sf_dir).select("review_id", prompt)


def classification_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir, config.CLOSED_TOPIC_PROMPT)


def most_relevant_topic_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir, config.MOST_RELEVANT_TOPIC_PROMPT)


def open_topic_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir, config.OPEN_TOPIC_PROMPT)


def classify_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = infer.classify_lexicon(_spread_texts(spark, sf_dir), fx.LEXICON, fx.POLARITY)
    return parse.enrich(answered).select("review_id", "assunto", "sentimento")


def length_model() -> models.Model:
    """A model stand-in whose answer depends on the length of the prompt."""

    def answer(prompt: str) -> str:
        return json.dumps({
            "assunto": config.TOPICS[len(prompt) % len(config.TOPICS)],
            "sentimento": config.SENTIMENTS[len(prompt) % len(config.SENTIMENTS)],
        })

    return lambda prompts: [answer(p) for p in prompts]


def tagging_model(run: int) -> models.ModelFactory:
    """A model stand-in: the run that asked, and the length of the text."""
    return lambda: lambda texts: [f"{run}:{len(t)}" for t in texts]


def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a second run, which asks only what the first one has not asked.

    The first run saw the classified reviews, where a title was missing under a shorter text, and the
    blank reviews, which are gone by the second.
    """
    layout = _scratch_layout(spark)
    blank = fx.reviews_raw(spark, sf_dir).filter(~has_text("review_text"))
    earlier = fx.gold(spark, sf_dir).select(
        "review_id", F.regexp_replace("texto_completo", r"^\. ", "").alias("texto_completo"))
    earlier = earlier.unionByName(
        blank.select("review_id", F.coalesce("title", F.lit("")).alias("texto_completo")))
    name = layout.table("silver", "reviews_answered")
    for run, reviews in enumerate((earlier, _texts(spark, sf_dir)), 1):
        ask = partial(models.apply_model, make_model=tagging_model(run), text="texto_completo", out="answer",
                      out_type="string")
        stored = write_table(reviews, layout.table("silver", "reviews_limpo"), layout)
        answered = answers.with_answers(stored, ask, "answer", f"{name}_answers", layout, slices=4)
        write_table(answered.select("review_id", "answer"), name, layout)
    return spark.table(name)


def classify_callable(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = models.classify_with_model(_spread_texts(spark, sf_dir), length_model)
    return parse.enrich(answered).select("review_id", "assunto", "sentimento")


# ---- responses -------------------------------------------------------------

def parsed_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse.parse_response(fx.answered_reviews(spark, sf_dir))
    return parsed.select("review_id", "assunto", "sentimento")


def normalised_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.enrich(fx.answered_reviews(spark, sf_dir)).select("review_id", "sentimento")


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.table(spark, sf_dir, "events")
    return events.select("event_id", json_field("props", "k").alias("k"))


# ---- quality ---------------------------------------------------------------

def embedding_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.embedding_profile(fx.embeddings(spark, sf_dir))


def share_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.share_totals(topic_sentiment_share(spark, sf_dir))


# ---- aggregates and rankings -----------------------------------------------

def sentiment_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = aggregate.sentiment_distribution(fx.enriched(spark, sf_dir))
    return rank.ranked(counts, [F.desc("count"), F.asc("sentimento")])


def topic_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = aggregate.topic_distribution(fx.enriched(spark, sf_dir))
    return rank.top(counts, 15, [F.desc("count"), F.asc_nulls_last("assunto")])


def rating_by_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = aggregate.rating_by_sentiment(fx.enriched(spark, sf_dir))
    return rank.ranked(means, [F.asc("rating_medio"), F.asc("sentimento")])


def topic_sentiment_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.topic_sentiment_share(
        aggregate.topic_sentiment_counts(fx.gold(spark, sf_dir))
    )


def topic_sentiment_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = aggregate.topic_sentiment_counts(fx.gold(spark, sf_dir))
    return aggregate.sentiment_matrix(counts, "assunto")


def department_sentiment_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = aggregate.department_sentiment(fx.gold(spark, sf_dir))
    return aggregate.sentiment_matrix(counts, "department_name")


def ordered_topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.in_order(aggregate.topic_counts(fx.gold(spark, sf_dir)), "assunto")


def ordered_topic_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = aggregate.topic_sentiment_counts(fx.gold(spark, sf_dir))
    return rank.in_order(counts, "assunto", "sentimento")


def ordered_department_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = aggregate.department_sentiment(fx.gold(spark, sf_dir))
    return rank.in_order(counts, "department_name", "sentimento")


def ordered_topic_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.in_order(topic_sentiment_share(spark, sf_dir), "assunto", "sentimento")


def ordered_topic_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.in_order(topic_sentiment_matrix(spark, sf_dir), "assunto")


def gold_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stored aggregates of the job, one below the other, from one scan of the stored reviews."""
    layout = _scratch_layout(spark)
    write_table(fx.gold(spark, sf_dir), layout.table("gold", "reviews_classified"), layout)
    stored = layers.gold_aggregates(spark, layout)
    empty = {"assunto": "string", "department_name": "string", "sentimento": "string", "qtd": "bigint",
             "total_reviews": "bigint", "rating_medio": "double", "idade_media": "double", "pct_negativo": "double",
             "total_negativos": "bigint", "pct_negativo_geral": "double", "assuntos": "bigint"}
    below = [
        frame.select(F.lit(name).alias("tabela"), *(
            F.col(c) if c in frame.columns else F.lit(None).cast(t).alias(c) for c, t in empty.items()))
        for name, frame in stored.items()
    ]
    return reduce(DataFrame.unionByName, below)


def drilldown_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = fx.gold(spark, sf_dir)
    return rank.drilldown(gold, rank.worst_topic_by_count(gold))


def drilldown_by_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = fx.gold(spark, sf_dir)
    return rank.drilldown(gold, rank.worst_topic_by_pct(aggregate.topic_summary(gold)))


def topic_review_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = rank.topic_review_samples(fx.gold(spark, sf_dir))
    return samples.select("assunto", "pos", "review_id")


# ---- summaries and report --------------------------------------------------

def summary_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = rank.topic_review_samples(fx.gold(spark, sf_dir))
    return models.summary_prompts(samples).select("assunto", "prompt")


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.summarise_extractive(rank.critical_negatives(fx.gold(spark, sf_dir)))


def executive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.ordered_summaries(_summaries(spark, sf_dir))


def counting_summariser(max_tokens: int) -> models.Model:
    """A model stand-in: reports the length of its prompt and its token limit."""
    return lambda prompts: [f"- {len(p)} caracteres\nLimite: {max_tokens}" for p in prompts]


def executive_summary_callable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.summarise_with_model(rank.critical_negatives(fx.gold(spark, sf_dir)), counting_summariser)


def summary_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary_cards(_summaries(spark, sf_dir))


def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary_lines(_summaries(spark, sf_dir))


def marking_summariser(max_tokens: int) -> models.Model:
    """A model stand-in that marks its lines in every way models do."""
    lines = "* {n} caracteres\n\n  • Limite: {limit}\n**{n}** em negrito\n1. primeiro\n- - {n} -\nfim * {n}"
    return lambda prompts: [lines.format(n=len(p), limit=max_tokens) for p in prompts]


def summary_lines_callable(spark: SparkSession, sf_dir: str) -> DataFrame:
    negatives = rank.critical_negatives(fx.gold(spark, sf_dir))
    return report.summary_lines(models.summarise_with_model(negatives, marking_summariser))


def report_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_header(fx.gold(spark, sf_dir), REPORT_DAY)


# ---- semantic map ----------------------------------------------------------

def semantic_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = semantic.semantic_join(fx.embeddings(spark, sf_dir), fx.gold(spark, sf_dir))
    return joined.select("review_id", "assunto", "sentimento", "label")


def embedding_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = semantic.semantic_join(fx.embeddings(spark, sf_dir), fx.gold(spark, sf_dir))
    found = semantic.moments(joined)
    cells = found.select("i", "n", "total", F.posexplode("products").alias("j", "product"))
    return cells.filter("i <= j").select(
        "i", "j", "n", F.round("total", 6).alias("total"), F.round("product", 6).alias("product"))


def semantic_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = semantic.semantic_join(fx.embeddings(spark, sf_dir), fx.gold(spark, sf_dir))
    return semantic.semantic_map(joined).select(
        "review_id", "assunto", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def _over(view: Query, operator: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(view(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {
        "csv_roundtrip": csv_roundtrip,
        "csv_split_roundtrip": csv_split_roundtrip,
        "sanitized_columns": sanitized_columns,
        "audit_columns": audit_columns,
        "table_roundtrip": table_roundtrip,
        "tables_dropped": tables_dropped,
        "layered_run": layered_run,
        "preview_rows": _over(fx.gold, rank.preview),
        "rename_cast": rename_cast,
        "nonblank_reviews": nonblank_reviews,
        "full_text": full_text,
        "bounded_sample": bounded_sample,
        "embed_hashed": embed_hashed,
        "embed_callable": embed_callable,
        "classification_prompts": classification_prompts,
        "most_relevant_topic_prompts": most_relevant_topic_prompts,
        "open_topic_prompts": open_topic_prompts,
        "classify_lexicon": classify_lexicon,
        "classify_callable": classify_callable,
        "resumed_run": resumed_run,
        "parsed_response": parsed_response,
        "normalised_sentiment": normalised_sentiment,
        "event_props": event_props,
        "reviews_classified": fx.gold,
        "drilldown_by_count": drilldown_by_count,
        "drilldown_by_pct": drilldown_by_pct,
        "topic_sentiment_counts": _over(fx.gold, aggregate.topic_sentiment_counts),
        "topic_summary": fx.summary,
        "department_sentiment": _over(fx.gold, aggregate.department_sentiment),
        "topic_counts": _over(fx.gold, aggregate.topic_counts),
        "sentiment_distribution": sentiment_distribution,
        "topic_top15": topic_top15,
        "rating_by_sentiment": rating_by_sentiment,
        "topic_sentiment_share": topic_sentiment_share,
        "topic_sentiment_matrix": topic_sentiment_matrix,
        "department_sentiment_matrix": department_sentiment_matrix,
        "ordered_topic_counts": ordered_topic_counts,
        "ordered_topic_sentiment": ordered_topic_sentiment,
        "ordered_department_sentiment": ordered_department_sentiment,
        "ordered_topic_share": ordered_topic_share,
        "ordered_topic_matrix": ordered_topic_matrix,
        "gold_aggregates": gold_aggregates,
        "topic_catalog": _over(fx.gold, rank.topic_catalog),
        "critical_topics": _over(fx.gold, rank.critical_topics),
        "topic_review_samples": topic_review_samples,
        "summary_prompts": summary_prompts,
        "executive_summary": executive_summary,
        "executive_summary_callable": executive_summary_callable,
        "summary_cards": summary_cards,
        "summary_lines": summary_lines,
        "summary_lines_callable": summary_lines_callable,
        "pain_ranking": _over(fx.summary, rank.pain_ranking),
        "criticality_bands": _over(fx.summary, report.criticality_bands),
        "worst_topic": _over(fx.summary, report.worst_topic),
        "report_kpis": _over(fx.gold, aggregate.report_kpis),
        "report_header": report_header,
        "semantic_join": semantic_join,
        "embedding_moments": embedding_moments,
        "semantic_map": semantic_map,
        "reconcile_counts": reconcile_counts,
        "text_completeness": _over(fx.reviews_raw, quality.text_completeness),
        "removed_rows": _over(fx.reviews_raw, quality.removed_rows),
        "embedding_profile": embedding_profile,
        "off_domain_topics": _over(fx.enriched, quality.off_domain_topics),
        "unclassified_counts": _over(fx.enriched, quality.unclassified_counts),
        "sentiment_coherence": _over(fx.enriched, quality.sentiment_coherence),
        "share_totals": share_totals,
    }
