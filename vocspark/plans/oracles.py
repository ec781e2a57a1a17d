"""The same results stated independently as DuckDB SQL over the test tables."""

from __future__ import annotations

from vocspark import config
from vocspark.plans import fixtures as fx
from vocspark.plans.queries import BOUNDED_SAMPLE, HASH_DIM, REPORT_DAY


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows) -> str:
    def cell(x):
        return _text(x) if isinstance(x, str) else str(x)

    return ", ".join("(" + ", ".join(cell(x) for x in row) + ")" for row in rows)


def _power(name: str, matrix: str) -> str:
    """A symmetric matrix squared over and over, kept at trace 1."""
    squared = "list_transform(m, lambda a: list_transform(m, lambda b: list_inner_product(a, b)))"
    return f"""{name} AS (
        SELECT 0 AS step, m FROM {matrix}
        UNION ALL
        SELECT step + 1, list_transform(s, lambda line: list_transform(line, lambda x: x / trace))
        FROM (SELECT step, s, list_sum(list_transform(range(1, len(s) + 1), lambda i: s[i][i])) AS trace
              FROM (SELECT step, {squared} AS s FROM {name} WHERE step < 24)))"""


def _axis(name: str, power: str) -> str:
    """The direction that is left: a column of v v', scaled by the largest entry of its diagonal."""
    return f"""{name} AS (
        SELECT list_transform(m[k], lambda x: x / sqrt(m[k][k])) AS v
        FROM (SELECT m, list_position(diagonal, list_max(diagonal)) AS k
              FROM (SELECT m, list_transform(range(1, len(m) + 1), lambda i: m[i][i]) AS diagonal
                    FROM {power} WHERE step = 24)))"""


_CTES = {
    "topic_list": f"""topic_list(place, topic) AS (
        VALUES {_values(enumerate(config.TOPICS))})""",
    "placed": """placed AS (
        SELECT d.*, t.topic, t.place % 7 AS cut, (d.doc_id * 3 + 1) % 7 AS k
        FROM documents d JOIN topic_list t ON t.place = (d.doc_id * 5) % 12)""",
    "felt": """felt AS (
        SELECT *, CASE WHEN k < cut THEN 'negativo' WHEN k = cut THEN 'neutro'
                       ELSE 'positivo' END AS sent
        FROM placed)""",
    "reviews_raw": """reviews_raw AS (
        SELECT doc_id::VARCHAR AS review_id,
               (doc_id % 100)::VARCHAR AS clothing_id,
               (18 + (doc_id * 7) % 60)::VARCHAR AS age,
               CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS title,
               CASE WHEN doc_id % 25 = 0 THEN NULL WHEN doc_id % 25 = 1 THEN '   '
                    ELSE text END AS review_text,
               CASE WHEN doc_id % 50 = 7 THEN 'x'
                    WHEN sent = 'negativo' THEN (1 + doc_id % 2)::VARCHAR
                    WHEN sent = 'neutro' THEN '3'
                    ELSE (4 + doc_id % 2)::VARCHAR END AS rating,
               quality::VARCHAR AS recommended,
               (n_chars % 30)::VARCHAR AS positive_feedback_count,
               lang AS division_name,
               CASE WHEN doc_id % 20 = 3 THEN NULL ELSE lang END AS department_name,
               source AS class_name
        FROM felt LEFT JOIN labels USING (doc_id))""",
    "responses": """responses AS (
        SELECT doc_id::VARCHAR AS review_id,
               CASE doc_id % 23
                   WHEN 0 THEN '{bad'
                   WHEN 1 THEN '{"assunto":"vestido","sentimento":"positivo"}'
                   WHEN 2 THEN '{"assunto":" Cor ","sentimento":"Muito Positivo"}'
                   WHEN 3 THEN '{"assunto":"' || topic || '","sentimento":"misto"}'
                   WHEN 4 THEN '{"assunto":null,"sentimento":"' || sent || '"}'
                   ELSE '{"assunto":"' || topic || '","sentimento":"' || sent || '"}'
               END AS resp
        FROM felt)""",
    "answers": """answers AS (
        SELECT review_id, CASE WHEN json_valid(resp) THEN resp END AS answer FROM responses)""",
    "parsed": """parsed AS (
        SELECT review_id,
               lower(trim(json_extract_string(answer, '$.assunto'), ' ')) AS assunto,
               lower(trim(json_extract_string(answer, '$.sentimento'), ' ')) AS said
        FROM answers)""",
    "labelled": """labelled AS (
        SELECT review_id, assunto,
               CASE WHEN said LIKE '%positiv%' THEN 'positivo'
                    WHEN said LIKE '%negativ%' THEN 'negativo'
                    WHEN said LIKE '%neutr%' THEN 'neutro'
                    ELSE 'indefinido' END AS sentimento
        FROM parsed)""",
    "typed": """typed AS (
        SELECT * REPLACE (
            TRY_CAST(age AS INTEGER) AS age, TRY_CAST(rating AS INTEGER) AS rating,
            TRY_CAST(recommended AS INTEGER) AS recommended,
            TRY_CAST(positive_feedback_count AS INTEGER) AS positive_feedback_count)
        FROM reviews_raw)""",
    "cleaned": """cleaned AS (
        SELECT *, trim(coalesce(title, '') || '. ' || review_text, ' ') AS texto_completo
        FROM typed WHERE trim(review_text, ' ') <> '')""",
    "enriched": """enriched AS (
        SELECT cleaned.*, assunto, sentimento FROM cleaned JOIN labelled USING (review_id))""",
    "gold": f"""gold AS (
        SELECT {", ".join(config.CLASSIFIED_COLUMNS)}
        FROM enriched WHERE assunto IS NOT NULL AND sentimento <> 'indefinido')""",
    "counts": """counts AS (
        SELECT assunto, sentimento, count(*) AS qtd FROM gold GROUP BY ALL)""",
    "departments": """departments AS (
        SELECT department_name, sentimento, count(*) AS qtd
        FROM gold WHERE department_name IS NOT NULL GROUP BY ALL)""",
    "summary": """summary AS (
        SELECT assunto, count(*) AS total_reviews,
               round(avg(rating)::DECIMAL(18, 6), 2)::DOUBLE AS rating_medio,
               round(avg(age)::DECIMAL(18, 6), 1)::DOUBLE AS idade_media,
               round((avg((sentimento = 'negativo')::INT) * 100)::DECIMAL(18, 6), 1)::DOUBLE
                   AS pct_negativo
        FROM gold GROUP BY assunto)""",
    "shares": """shares AS (
        SELECT *, round((qtd / total * 100)::DECIMAL(18, 6), 1)::DOUBLE AS pct
        FROM (SELECT *, (sum(qtd) OVER (PARTITION BY assunto))::BIGINT AS total FROM counts))""",
    "critical": f"""critical AS (
        SELECT row_number() OVER (ORDER BY qtd_negativos DESC, assunto)::INT AS rank, *
        FROM (SELECT assunto, count(*) AS qtd_negativos
              FROM gold WHERE sentimento = 'negativo' GROUP BY assunto)
        ORDER BY rank LIMIT {config.TOP_TOPICS})""",
    "negatives": """negatives AS (
        SELECT g.assunto, qtd_negativos, review_id, texto_completo,
               row_number() OVER (PARTITION BY g.assunto ORDER BY review_id::BIGINT)::INT AS pos
        FROM gold g JOIN critical c ON c.assunto = g.assunto
        WHERE sentimento = 'negativo')""",
    "samples": f"""samples AS (
        SELECT * FROM negatives WHERE pos <= {config.REVIEWS_PER_SUMMARY})""",
    "prompts": f"""prompts AS (
        SELECT assunto, any_value(qtd_negativos) AS qtd_negativos,
               replace(replace({_text(config.SUMMARY_PROMPT)}, '<assunto>', assunto),
                       '<avaliacoes>',
                       string_agg(texto_completo, chr(10) || '- ' ORDER BY pos)) AS prompt
        FROM samples GROUP BY assunto)""",
    "negative_words": r"""negative_words AS (
        SELECT assunto, token, count(*) AS n FROM (
            SELECT DISTINCT assunto, review_id, token FROM (
                SELECT assunto, review_id,
                       unnest(regexp_split_to_array(lower(texto_completo), '[^\p{L}]+')) AS token
                FROM negatives)
            WHERE length(token) >= 4)
        GROUP BY ALL)""",
    "summaries": """summaries AS (
        SELECT c.assunto, c.qtd_negativos,
               coalesce(b.lines || chr(10), '') || 'Revisar: ' || c.assunto AS resumo
        FROM critical c LEFT JOIN (
            SELECT assunto, string_agg('- ' || token, chr(10) ORDER BY place) AS lines
            FROM (SELECT *, row_number() OVER (PARTITION BY assunto ORDER BY n DESC, token) AS place
                  FROM negative_words)
            WHERE place <= 3 GROUP BY assunto) b ON b.assunto = c.assunto)""",
    "kpis": """kpis AS (
        SELECT count(*) AS total_reviews,
               count(*) FILTER (sentimento = 'negativo') AS total_negativos,
               CASE WHEN count(*) > 0 THEN
                   round((count(*) FILTER (sentimento = 'negativo') / count(*) * 100)
                         ::DECIMAL(18, 6), 1)::DOUBLE ELSE 0.0 END AS pct_negativo_geral,
               count(DISTINCT assunto) AS assuntos
        FROM gold)""",
    "words": r"""words AS (
        SELECT review_id, token FROM (
            SELECT review_id,
                   unnest(regexp_split_to_array(lower(texto_completo), '[^\p{L}]+')) AS token
            FROM cleaned)
        WHERE token <> '')""",
    "scores": f"""scores AS (
        SELECT review_id, topic, place, sum(weight) AS score
        FROM words
        JOIN (VALUES {_values(fx.LEXICON)}) lexicon(token, topic, weight) USING (token)
        JOIN topic_list USING (topic)
        GROUP BY ALL)""",
    "balance": f"""balance AS (
        SELECT review_id, sum(sign) AS total
        FROM words JOIN (VALUES {_values(fx.POLARITY)}) polarity(token, sign) USING (token)
        GROUP BY review_id)""",
    "by_words": """by_words AS (
        SELECT review_id, coalesce(topic, 'outro') AS assunto,
               CASE WHEN total > 0 THEN 'positivo' WHEN total < 0 THEN 'negativo'
                    ELSE 'neutro' END AS sentimento
        FROM cleaned
        LEFT JOIN (SELECT review_id, arg_max(topic, (score, -place)) AS topic
                   FROM scores GROUP BY review_id) USING (review_id)
        LEFT JOIN balance USING (review_id))""",
}
_CTES |= {
    "vectors": """vectors AS (
        SELECT review_id, assunto, embedding::DOUBLE[] AS v
        FROM embeddings JOIN gold ON review_id = vec_id::VARCHAR)""",
    "places": """places AS (
        SELECT review_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM vectors)""",
    "products": """products AS (
        SELECT a.i, b.i AS j, count(*) AS n, sum(a.x) AS total, sum(b.x) AS other, sum(a.x * b.x) AS product
        FROM places a JOIN places b USING (review_id) GROUP BY a.i, b.i)""",
    # the covariance matrix, and its first two axes by squaring a matrix until one direction is left
    "covariance": """covariance AS (
        SELECT list(line ORDER BY i) AS m FROM (
            SELECT i, list((product - total * other / n) / (n - 1) ORDER BY j) AS line
            FROM products GROUP BY i))""",
    "power_1": _power("power_1", "covariance"),
    "axis_1": _axis("axis_1", "power_1"),
    "deflated": """deflated AS (
        SELECT list_transform(range(1, len(v) + 1), lambda i: list_transform(range(1, len(v) + 1), lambda j:
                   m[i][j] - variance * v[i] * v[j])) AS m
        FROM (SELECT m, v, list_inner_product(v, list_transform(m, lambda line: list_inner_product(line, v)))
                  AS variance
              FROM covariance, axis_1))""",
    "power_2": _power("power_2", "deflated"),
    "axis_2": _axis("axis_2", "power_2"),
}
_ORDER = list(_CTES)
_NEEDS = {
    "placed": ["topic_list"],
    "felt": ["placed"],
    "reviews_raw": ["felt"],
    "responses": ["felt"],
    "answers": ["responses"],
    "parsed": ["answers"],
    "labelled": ["parsed"],
    "typed": ["reviews_raw"],
    "cleaned": ["typed"],
    "enriched": ["cleaned", "labelled"],
    "gold": ["enriched"],
    "counts": ["gold"],
    "departments": ["gold"],
    "summary": ["gold"],
    "shares": ["counts"],
    "critical": ["gold"],
    "negatives": ["critical"],
    "samples": ["negatives"],
    "prompts": ["samples"],
    "negative_words": ["negatives"],
    "summaries": ["negative_words"],
    "kpis": ["gold"],
    "vectors": ["gold"],
    "places": ["vectors"],
    "products": ["places"],
    "covariance": ["products"],
    "power_1": ["covariance"],
    "axis_1": ["power_1"],
    "deflated": ["axis_1"],
    "power_2": ["deflated"],
    "axis_2": ["power_2"],
    "words": ["cleaned"],
    "scores": ["words", "topic_list"],
    "balance": ["words"],
    "by_words": ["scores", "balance"],
}


def _with(view: str, select: str) -> str:
    """The query preceded by the views it needs, innermost first."""
    return _with_all([view], select)


def _with_all(views: list[str], select: str) -> str:
    needed, open_views = set(), [*views]
    while open_views:
        name = open_views.pop()
        if name not in needed:
            needed.add(name)
            open_views.extend(_NEEDS.get(name, []))
    return "WITH RECURSIVE " + ",\n".join(_CTES[n] for n in _ORDER if n in needed) + "\n" + select


def _prompt(template: str) -> str:
    listed = "\n".join(f"- {t}" for t in config.TOPICS)
    return _with("cleaned", f"""
        SELECT review_id, {_text(template.replace("<assuntos>", listed))} || texto_completo AS prompt
        FROM cleaned""")


def _drilldown(worst: str, view: str) -> str:
    return _with(view, f"""
        SELECT review_id, texto_completo, rating, age, department_name FROM gold
        WHERE sentimento = 'negativo' AND assunto = ({worst})
        ORDER BY review_id::BIGINT LIMIT 10""")


def _matrix(key: str, view: str) -> str:
    return _with(view, _cells(key, view))


def _pick(names: tuple[str, ...], values: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"CASE {values} {whens} END"


_RAW_AS_HEADERS = ", ".join(
    f'{c} AS "{h.replace(" ", "_")}"' for c, h in zip(fx.RAW_COLUMNS, fx.CSV_HEADERS)
)
_PROMPT_LENGTH = (
    "length(" + _text(config.CLOSED_TOPIC_PROMPT.replace(
        "<assuntos>", "\n".join(f"- {t}" for t in config.TOPICS))) + " || texto_completo)"
)


_MOST_NEGATIVES = "row_number() OVER (ORDER BY qtd_negativos DESC, assunto)::INT AS rank"


def _in_order(view: str, select: str, *keys: str) -> str:
    """`select`'s rows numbered by the keys."""
    return _with(view, f"""
        SELECT row_number() OVER (ORDER BY {", ".join(f"{k} NULLS FIRST" for k in keys)})::INT AS rank, *
        FROM ({select})""")


def _cells(key: str, view: str) -> str:
    cells = ", ".join(
        f"coalesce(sum(qtd) FILTER (sentimento = '{s}'), 0)::BIGINT AS {s}"
        for s in config.SENTIMENTS
    )
    return f"SELECT {key}, {cells} FROM {view} GROUP BY {key}"


def oracle_sql() -> dict[str, str]:
    raw_names = ", ".join(fx.RAW_COLUMNS)
    return {
        "csv_roundtrip": _with("reviews_raw", f"SELECT {raw_names} FROM reviews_raw"),
        "csv_split_roundtrip": _with("reviews_raw", f"SELECT {raw_names} FROM reviews_raw"),
        "sanitized_columns": _with("reviews_raw", f"SELECT {_RAW_AS_HEADERS} FROM reviews_raw"),
        "audit_columns": _with("reviews_raw", """
            SELECT split_files, review_id, TRUE AS own_file, TRUE AS has_ts
            FROM reviews_raw, (VALUES (FALSE), (TRUE)) readers(split_files)"""),
        "table_roundtrip": _with("gold", "SELECT * FROM gold"),
        "tables_dropped": _with("enriched", """
            SELECT table_name, (SELECT count(*) FROM enriched) AS rows, is_left
            FROM (VALUES ('reviews_limpo', FALSE), ('reviews_classified_raw', FALSE), ('reviews_enriched', TRUE))
                tables(table_name, is_left)"""),
        "layered_run": _with("by_words", """
            SELECT w.assunto, count(*) AS total_reviews,
                   round(avg(rating)::DECIMAL(18, 6), 2)::DOUBLE AS rating_medio,
                   round(avg(age)::DECIMAL(18, 6), 1)::DOUBLE AS idade_media,
                   round((avg((w.sentimento = 'negativo')::INT) * 100)::DECIMAL(18, 6), 1)::DOUBLE
                       AS pct_negativo
            FROM cleaned JOIN by_words w USING (review_id) GROUP BY w.assunto"""),
        "preview_rows": _with("gold", """
            SELECT review_id, texto_completo, assunto, sentimento, rating, department_name
            FROM gold ORDER BY review_id::BIGINT LIMIT 10"""),
        "rename_cast": _with("typed", f"SELECT {raw_names} FROM typed"),
        "nonblank_reviews": _with("reviews_raw", """
            SELECT review_id, review_text FROM reviews_raw WHERE trim(review_text, ' ') <> ''"""),
        "full_text": _with("reviews_raw", """
            SELECT review_id,
                   trim(concat_ws('. ', coalesce(title, ''), review_text), ' ') AS texto_completo
            FROM reviews_raw"""),
        "bounded_sample": _with("cleaned", f"""
            SELECT review_id FROM cleaned ORDER BY review_id::BIGINT LIMIT {BOUNDED_SAMPLE}"""),
        "embed_hashed": _with("words", f"""
            , hits AS (
                SELECT review_id, ('0x' || substr(md5(token), 1, 8))::BIGINT % {HASH_DIM} AS bucket,
                       count(*) AS n
                FROM words GROUP BY ALL),
            lengths AS (SELECT review_id, sqrt(sum(n * n)) AS norm FROM hits GROUP BY review_id),
            cells AS (
                SELECT review_id, bucket
                FROM cleaned CROSS JOIN (SELECT unnest(range({HASH_DIM})) AS bucket))
            SELECT review_id, bucket::INT AS bucket,
                   coalesce(round(n / norm, 6), 0)::FLOAT::DOUBLE AS value
            FROM cells LEFT JOIN hits USING (review_id, bucket)
                       LEFT JOIN lengths USING (review_id)""".lstrip()),
        "embed_callable": _with("cleaned", """
            SELECT review_id, 0 AS bucket, length(texto_completo)::DOUBLE AS value FROM cleaned
            UNION ALL
            SELECT review_id, 1,
                   (length(texto_completo) - length(replace(texto_completo, chr(10), '')))::DOUBLE
            FROM cleaned"""),
        "classification_prompts": _prompt(config.CLOSED_TOPIC_PROMPT),
        "most_relevant_topic_prompts": _prompt(config.MOST_RELEVANT_TOPIC_PROMPT),
        "open_topic_prompts": _prompt(config.OPEN_TOPIC_PROMPT),
        "classify_lexicon": _with("by_words", "SELECT * FROM by_words"),
        "classify_callable": _with("cleaned", f"""
            SELECT review_id,
                   {_pick(config.TOPICS, f"{_PROMPT_LENGTH} % {len(config.TOPICS)}")} AS assunto,
                   {_pick(config.SENTIMENTS, f"{_PROMPT_LENGTH} % {len(config.SENTIMENTS)}")}
                       AS sentimento
            FROM cleaned"""),
        "resumed_run": _with("gold", r"""
            , earlier AS (
                SELECT regexp_replace(texto_completo, '^\. ', '') AS t FROM gold
                UNION SELECT coalesce(title, '') FROM reviews_raw
                WHERE trim(coalesce(review_text, ''), ' ') = '')
            SELECT review_id,
                   CASE WHEN texto_completo IN (SELECT t FROM earlier) THEN '1:' ELSE '2:' END
                   || length(texto_completo) AS answer
            FROM cleaned""".lstrip()),
        "parsed_response": _with("parsed", """
            SELECT review_id, assunto, said AS sentimento FROM parsed"""),
        "normalised_sentiment": _with("labelled", "SELECT review_id, sentimento FROM labelled"),
        "event_props": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
        "reviews_classified": _with("gold", "SELECT * FROM gold"),
        "drilldown_by_count": _drilldown(
            "SELECT assunto FROM critical WHERE rank = 1", "critical"),
        "drilldown_by_pct": _drilldown(
            "SELECT assunto FROM summary ORDER BY pct_negativo DESC, assunto LIMIT 1", "summary"),
        "topic_sentiment_counts": _with("counts", "SELECT * FROM counts"),
        "topic_summary": _with("summary", "SELECT * FROM summary"),
        "department_sentiment": _with("departments", "SELECT * FROM departments"),
        "topic_counts": _with("gold", "SELECT assunto, count(*) AS qtd FROM gold GROUP BY assunto"),
        "sentiment_distribution": _with("enriched", """
            SELECT row_number() OVER (ORDER BY "count" DESC, sentimento)::INT AS rank, *
            FROM (SELECT sentimento, count(*) AS "count" FROM enriched GROUP BY sentimento)"""),
        "topic_top15": _with("enriched", """
            SELECT row_number() OVER (ORDER BY "count" DESC, assunto NULLS LAST)::INT AS rank, *
            FROM (SELECT assunto, count(*) AS "count" FROM enriched GROUP BY assunto)
            ORDER BY rank LIMIT 15"""),
        "rating_by_sentiment": _with("enriched", """
            SELECT row_number() OVER (ORDER BY rating_medio NULLS FIRST, sentimento)::INT AS rank, *
            FROM (SELECT sentimento, round(avg(rating)::DECIMAL(18, 6), 2)::DOUBLE AS rating_medio,
                         count(*) AS qtd
                  FROM enriched GROUP BY sentimento)"""),
        "topic_sentiment_share": _with("shares", "SELECT * FROM shares"),
        "topic_sentiment_matrix": _matrix("assunto", "counts"),
        "department_sentiment_matrix": _matrix("department_name", "departments"),
        "ordered_topic_counts": _in_order(
            "gold", "SELECT assunto, count(*) AS qtd FROM gold GROUP BY assunto", "assunto"),
        "ordered_topic_sentiment": _in_order("counts", "SELECT * FROM counts", "assunto", "sentimento"),
        "ordered_department_sentiment": _in_order(
            "departments", "SELECT * FROM departments", "department_name", "sentimento"),
        "ordered_topic_share": _in_order("shares", "SELECT * FROM shares", "assunto", "sentimento"),
        "ordered_topic_matrix": _in_order("counts", _cells("assunto", "counts"), "assunto"),
        "gold_aggregates": _with_all(["counts", "summary", "departments", "kpis"], """
            SELECT 'sentimento_por_assunto' AS tabela, assunto, NULL AS department_name, sentimento, qtd,
                   NULL AS total_reviews, NULL AS rating_medio, NULL AS idade_media, NULL AS pct_negativo,
                   NULL AS total_negativos, NULL AS pct_negativo_geral, NULL AS assuntos FROM counts
            UNION ALL
            SELECT 'assunto_resumo', assunto, NULL, NULL, NULL, total_reviews, rating_medio, idade_media,
                   pct_negativo, NULL, NULL, NULL FROM summary
            UNION ALL
            SELECT 'sentimento_por_departamento', NULL, department_name, sentimento, qtd, NULL, NULL, NULL,
                   NULL, NULL, NULL, NULL FROM departments
            UNION ALL
            SELECT 'indicadores', NULL, NULL, NULL, NULL, total_reviews, NULL, NULL, NULL, total_negativos,
                   pct_negativo_geral, assuntos FROM kpis"""),
        "topic_catalog": _with("gold", """
            SELECT assunto, (row_number() OVER (ORDER BY assunto) - 1)::INT AS ordinal
            FROM (SELECT DISTINCT assunto FROM gold)"""),
        "critical_topics": _with("critical", "SELECT * FROM critical"),
        "topic_review_samples": _with("samples", "SELECT assunto, pos, review_id FROM samples"),
        "summary_prompts": _with("prompts", "SELECT assunto, prompt FROM prompts"),
        "executive_summary": _with("summaries", f"SELECT {_MOST_NEGATIVES}, * FROM summaries"),
        "executive_summary_callable": _with("prompts", f"""
            SELECT assunto, qtd_negativos,
                   '- ' || length(prompt) || ' caracteres' || chr(10)
                   || 'Limite: {config.SUMMARY_MAX_TOKENS}' AS resumo
            FROM prompts"""),
        "summary_cards": _with("summaries", f"""
            SELECT {_MOST_NEGATIVES}, upper(assunto) AS heading, qtd_negativos, resumo FROM summaries"""),
        "summary_lines_callable": _with("prompts", f"""
            SELECT assunto, pos::INT AS pos, is_bullet, line FROM (
                SELECT assunto, length(prompt)::VARCHAR AS n FROM prompts), LATERAL (VALUES
                (0, TRUE, n || ' caracteres'), (1, TRUE, 'Limite: {config.SUMMARY_MAX_TOKENS}'),
                (2, TRUE, n || '** em negrito'), (3, FALSE, '1. primeiro'), (4, TRUE, n || ' -'),
                (5, FALSE, 'fim * ' || n)) lines(pos, is_bullet, line)"""),
        "summary_lines": _with("summaries", r"""
            SELECT assunto, (place - 1)::INT AS pos, line LIKE '-%' AS is_bullet,
                   CASE WHEN line LIKE '-%' THEN regexp_replace(line, '^[-*•\s]+', '')
                        ELSE line END AS line
            FROM (SELECT assunto, unnest(string_split(resumo, chr(10))) AS line,
                         generate_subscripts(string_split(resumo, chr(10)), 1) AS place
                  FROM summaries)"""),
        "pain_ranking": _with("summary", """
            SELECT row_number() OVER (ORDER BY pct_negativo DESC, assunto)::INT AS rank,
                   assunto, pct_negativo,
                   pct_negativo > (SELECT median(pct_negativo) FROM summary) AS above_median
            FROM summary"""),
        "criticality_bands": _with("summary", """
            SELECT row_number() OVER (ORDER BY pct_negativo DESC, assunto)::INT AS rank, *,
                   CASE WHEN pct_negativo >= 50 THEN 'red' WHEN pct_negativo >= 25 THEN 'amber'
                           ELSE 'green' END AS band
            FROM summary"""),
        "worst_topic": _with("summary", """
            SELECT assunto, pct_negativo, rating_medio, total_reviews,
                   (SELECT count(*) FROM gold) AS grand_total
            FROM summary ORDER BY pct_negativo DESC, assunto LIMIT 1"""),
        "report_kpis": _with("kpis", "SELECT * FROM kpis"),
        "report_header": _with("kpis", f"""
            SELECT '{REPORT_DAY:%d/%m/%Y}' AS report_date, '{REPORT_DAY:%Y%m%d}' AS file_stamp, *
            FROM kpis"""),
        "semantic_join": _with("gold", """
            SELECT review_id, assunto, sentimento, label
            FROM embeddings JOIN gold ON review_id = vec_id::VARCHAR"""),
        "embedding_moments": _with("products", """
            SELECT i::INT AS i, j::INT AS j, n, round(total, 6) AS total, round(product, 6) AS product
            FROM products WHERE i <= j"""),
        "semantic_map": _with("axis_2", """
            SELECT review_id, assunto, round(list_inner_product(vectors.v, axis_1.v), 4) AS x,
                   round(list_inner_product(vectors.v, axis_2.v), 4) AS y
            FROM vectors, axis_1, axis_2"""),
        "reconcile_counts": """
            SELECT count(*) AS source_rows, count(*) AS written_rows, count(*) AS table_rows, TRUE AS passed
            FROM documents""",
        "text_completeness": _with("reviews_raw", """
            SELECT count(*) FILTER (review_text <> '') AS with_text,
                   count(*) FILTER (coalesce(review_text, '') = '') AS without_text,
                   count(*) AS total
            FROM reviews_raw"""),
        "removed_rows": _with("reviews_raw", """
            SELECT count(*) FILTER (trim(coalesce(review_text, ''), ' ') = '') AS removed,
                   count(*) FILTER (trim(coalesce(review_text, ''), ' ') <> '') AS kept
            FROM reviews_raw"""),
        "embedding_profile": """
            SELECT min(len(embedding))::INT AS min_dim, max(len(embedding))::INT AS max_dim,
                   count(embedding) AS with_embedding, count(*) AS total
            FROM embeddings""",
        "off_domain_topics": _with("enriched", """
            SELECT assunto, count(*) AS "count" FROM enriched
            WHERE assunto NOT IN (SELECT topic FROM topic_list) GROUP BY assunto"""),
        "unclassified_counts": _with("enriched", """
            SELECT count(*) FILTER (sentimento = 'indefinido') AS indefinidos,
                   count(*) FILTER (assunto IS NULL) AS sem_assunto
            FROM enriched"""),
        "sentiment_coherence": _with("enriched", """
            SELECT *, coalesce(negativo < neutro AND neutro < positivo, FALSE) AS coherent
            FROM (SELECT round((avg(rating) FILTER (sentimento = 'negativo'))
                               ::DECIMAL(18, 6), 2)::DOUBLE AS negativo,
                         round((avg(rating) FILTER (sentimento = 'neutro'))
                               ::DECIMAL(18, 6), 2)::DOUBLE AS neutro,
                         round((avg(rating) FILTER (sentimento = 'positivo'))
                               ::DECIMAL(18, 6), 2)::DOUBLE AS positivo
                  FROM enriched)"""),
        "share_totals": _with("shares", """
            SELECT assunto, round(sum(pct), 1) AS total_pct,
                   round(abs(round(sum(pct), 1) - 100), 1) <= 0.2 AS ok
            FROM shares GROUP BY assunto"""),
    }
