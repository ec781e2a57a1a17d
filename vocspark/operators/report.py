"""Data sets of the executive report; the markup is left to the caller."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark.functions.labels import band
from vocspark.functions.ordering import numbered
from vocspark.functions.text import strip_whitespace
from vocspark.operators.aggregate import report_kpis
from vocspark.operators.rank import ranked, worst_first


def report_header(gold: DataFrame, day: date) -> DataFrame:
    """One row: report date, file stamp and the headline figures."""
    on = F.lit(day)
    return report_kpis(gold).select(
        F.date_format(on, "dd/MM/yyyy").alias("report_date"),
        F.date_format(on, "yyyyMMdd").alias("file_stamp"),
        "*",
    )


def criticality_bands(summary: DataFrame) -> DataFrame:
    """Topic summary with its band and rank, worst topic first."""
    return numbered(summary.withColumn("band", band(F.col("pct_negativo"))), worst_first(), "rank")


def ordered_summaries(summaries: DataFrame) -> DataFrame:
    """The summaries, one per critical topic, with their rank: most negatives first."""
    return ranked(summaries, [F.desc("qtd_negativos"), F.asc("assunto")])


def summary_cards(summaries: DataFrame) -> DataFrame:
    """Rank, heading, number of negative reviews and text."""
    return ordered_summaries(summaries).select(
        "rank", F.upper("assunto").alias("heading"), "qtd_negativos", "resumo")


def summary_lines(summaries: DataFrame) -> DataFrame:
    """Non-blank lines of each summary in order, bullets marked and stripped of their sign."""
    lines = F.transform(F.split("resumo", "\n"), strip_whitespace)
    shown = F.filter(lines, lambda line: line != "")
    out = summaries.select("assunto", F.posexplode(shown).alias("pos", "line"))
    bullet = F.col("line").rlike(r"^[-*•]")
    return out.select(
        "assunto",
        "pos",
        bullet.alias("is_bullet"),
        F.when(bullet, strip_whitespace(F.regexp_replace("line", r"^[-*• ]+", "")))
        .otherwise(F.col("line"))
        .alias("line"),
    )


def worst_topic(summary: DataFrame) -> DataFrame:
    """The topic with the highest negative share, beside the number of all reviews."""
    order = F.struct(-F.col("pct_negativo"), F.col("assunto"))
    shown = F.struct("assunto", "pct_negativo", "rating_medio", "total_reviews")
    one = summary.agg(
        F.min_by(shown, order).alias("worst"), F.sum("total_reviews").alias("grand_total")
    )
    return one.filter(F.col("worst").isNotNull()).select("worst.*", "grand_total")
