"""Model responses (JSON text) -> topic and sentiment columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark.functions.labels import canonical, json_field, sentiment_label


def parse_response(df: DataFrame, response: str = "classificacao_json") -> DataFrame:
    """Topic and sentiment as the model spelled them, trimmed and in lower case."""
    return df.withColumns(
        {name: canonical(json_field(response, name)) for name in ("assunto", "sentimento")}
    )


def normalise_sentiment(df: DataFrame) -> DataFrame:
    return df.withColumn("sentimento", sentiment_label(F.col("sentimento")))


def enrich(df: DataFrame, response: str = "classificacao_json") -> DataFrame:
    return normalise_sentiment(parse_response(df, response))
