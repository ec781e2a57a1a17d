"""Batch inference with a callable supplied by the user.

A model is given as a factory: `make_model()` runs once per task and returns
`fn(list[str]) -> list`, one result per input and in the same order. Only the text
column travels to Python, in Arrow batches; all other columns stay in the JVM. An
exception, a result of another length or a missing result for a text fails the task, so no
row is lost quietly; only a missing text may have a missing result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspark import config
from vocspark.operators.rank import review_samples

Model = Callable[[list[str]], Sequence]
ModelFactory = Callable[[], Model]


def apply_model(
    df: DataFrame,
    make_model: ModelFactory,
    text: str,
    out: str,
    out_type: str,
    batch_size: int = 256,
) -> DataFrame:
    """Add the model's result for each row.

    The function is marked nondeterministic, which keeps the optimizer from calling
    it twice or moving filters past it. Write the result to a table before reading
    it more than once.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for texts in batches:
            results: list = []
            for start in range(0, len(texts), batch_size):
                asked = texts.iloc[start : start + batch_size].tolist()
                got = list(model(asked))
                if len(got) != len(asked):
                    raise ValueError(f"model returned {len(got)} results for {len(asked)} texts")
                if any(a is not None and r is None for a, r in zip(asked, got)):
                    raise ValueError("model returned no result for a text")
                results.extend(got)
            yield pd.Series(results, index=texts.index, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    call = F.pandas_udf(run, out_type).asNondeterministic()
    return df.withColumn(out, call(F.col(text)))


def embed_with_model(
    df: DataFrame, make_model: ModelFactory, text: str = "texto_completo", batch_size: int = 256
) -> DataFrame:
    return apply_model(df, make_model, text, "embedding", "array<float>", batch_size)


def closed_topic_prompt(
    text: str | Column = "texto_completo",
    template: str = config.CLOSED_TOPIC_PROMPT,
    topics: Sequence[str] = config.TOPICS,
) -> Column:
    """The template with the topic list, one topic per line, followed by the text."""
    listed = "\n".join(f"- {t}" for t in topics)
    body = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit(template.replace("<assuntos>", listed)), body)


def open_topic_prompt(text: str | Column = "texto_completo") -> Column:
    return closed_topic_prompt(text, config.OPEN_TOPIC_PROMPT)


def classify_with_model(
    df: DataFrame,
    make_model: ModelFactory,
    prompt: Column | None = None,
    batch_size: int = 256,
) -> DataFrame:
    """Ask for topic and sentiment in one call; the answer is kept as JSON text."""
    asked = df.withColumn("_prompt", closed_topic_prompt() if prompt is None else prompt)
    out = apply_model(asked, make_model, "_prompt", "classificacao_json", "string", batch_size)
    return out.drop("_prompt")


def summary_prompts(samples: DataFrame, template: str = config.SUMMARY_PROMPT) -> DataFrame:
    """One prompt per topic holding its sampled reviews in order.

    `samples` carries at most k reviews per topic, so the collected lists are bounded.
    """
    before, rest = template.split("<assunto>")
    between, after = rest.split("<avaliacoes>")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "texto_completo")))
    texts = F.array_join(F.transform(ordered, lambda r: r.texto_completo), config.REVIEW_SEPARATOR)
    prompt = F.concat(F.lit(before), F.col("assunto"), F.lit(between), texts, F.lit(after))
    return samples.groupBy("assunto", "qtd_negativos").agg(prompt.alias("prompt"))


def summarise_with_model(
    negatives: DataFrame,
    make_model: Callable[[int], Model],
    max_tokens: int = config.SUMMARY_MAX_TOKENS,
    at_once: int = config.TOP_TOPICS,
    k: int = config.REVIEWS_PER_SUMMARY,
) -> DataFrame:
    """Summaries written by a model from a prompt with the first k reviews of each topic.

    `at_once` topics are asked side by side; `make_model` is given the token limit.
    """
    prompts = summary_prompts(review_samples(negatives, k)).repartition(at_once)
    answered = apply_model(prompts, lambda: make_model(max_tokens), "prompt", "resumo", "string")
    return answered.select("assunto", "qtd_negativos", "resumo")
