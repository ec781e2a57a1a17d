"""Parameters and domain values shared by every stage."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values ----------------------------------------------------------
# These define the data contract: topic list, label spellings, column names and
# prompt texts have to stay exactly as they are for results to be comparable.

TOPICS = (
    "caimento", "tamanho", "conforto", "qualidade", "tecido", "cor",
    "estilo", "comprimento", "preco", "transparencia", "encolhimento", "outro",
)
FALLBACK_TOPIC = "outro"

NEGATIVE, NEUTRAL, POSITIVE = "negativo", "neutro", "positivo"
SENTIMENTS = (NEGATIVE, NEUTRAL, POSITIVE)
UNDEFINED = "indefinido"

# Substring -> label, first match wins.
SENTIMENT_RULES = (
    ("positiv", POSITIVE),
    ("negativ", NEGATIVE),
    ("neutr", NEUTRAL),
)

# Characters a column name may not hold; each becomes an underscore.
FORBIDDEN_NAME_CHARS = " ,;{}()\n\t="

# Sanitised source name -> working name. A blank header arrives as `_c0`.
RENAMES = {
    "_c0": "review_id",
    "Clothing_ID": "clothing_id",
    "Age": "age",
    "Title": "title",
    "Review_Text": "review_text",
    "Rating": "rating",
    "Recommended_IND": "recommended",
    "Positive_Feedback_Count": "positive_feedback_count",
    "Division_Name": "division_name",
    "Department_Name": "department_name",
    "Class_Name": "class_name",
}

INT_COLUMNS = ("age", "rating", "recommended", "positive_feedback_count")

CLASSIFIED_COLUMNS = (
    "review_id", "texto_completo", "assunto", "sentimento", "rating",
    "positive_feedback_count", "age", "recommended", "clothing_id",
    "division_name", "department_name", "class_name",
)

# Lower bound (inclusive, % negative) -> band, highest first.
CRITICALITY_BANDS = ((50.0, "red"), (25.0, "amber"))
CRITICALITY_DEFAULT = "green"

# Prompt texts. `<assuntos>`, `<assunto>` and `<avaliacoes>` are filled in per call.
CLOSED_TOPIC_PROMPT = (
    "Você classifica avaliações de roupas. Responda APENAS com um JSON válido, "
    'sem texto extra, no formato: {"assunto": "...", "sentimento": "..."}.\n\n'
    'O campo "assunto" DEVE ser EXATAMENTE um destes valores:\n'
    "<assuntos>\n\n"
    "Regras: escolha UM único assunto da lista acima, exatamente como escrito "
    '(minúsculas, sem acento). Se não encaixar, use "outro". '
    "NÃO invente assuntos fora da lista. NÃO use o tipo de peça como assunto.\n\n"
    'O campo "sentimento" deve ser: positivo, negativo ou neutro.\n\n'
    "Avaliação: "
)
MOST_RELEVANT_TOPIC_PROMPT = (
    "Você classifica avaliações de roupas. Responda APENAS com um JSON válido, "
    'sem texto extra, no formato: {"assunto": "...", "sentimento": "..."}.\n\n'
    'O campo "assunto" DEVE ser EXATAMENTE um destes valores (escolha o mais relevante):\n'
    "<assuntos>\n\n"
    "Regras: escolha UM único assunto da lista acima, exatamente como escrito "
    '(minúsculas, sem acento). Se não encaixar em nenhum, use "outro". '
    "NÃO invente assuntos fora da lista. NÃO use o tipo de peça como assunto.\n\n"
    'O campo "sentimento" deve ser: positivo, negativo ou neutro.\n\n'
    "Avaliação: "
)
OPEN_TOPIC_PROMPT = (
    "Analise esta avaliação de roupa e responda APENAS com um JSON válido, sem texto extra, no formato: "
    '{"assunto": "...", "sentimento": "..."}. '
    "Regras: "
    '"assunto" = o tema principal do comentário, geralmente um problema ou aspecto avaliado '
    "(ex: caimento, tamanho, qualidade do tecido, cor, conforto, defeito, preço). Use 1 a 3 palavras. "
    '"sentimento" = positivo, negativo ou neutro. '
    "Responda em português. Avaliação: "
)
SUMMARY_PROMPT = (
    "Você é um analista de voz do cliente. Abaixo estão avaliações NEGATIVAS "
    "de clientes sobre o assunto '<assunto>' em uma loja de roupas.\n\n"
    "Avaliações:\n- <avaliacoes>\n\n"
    "Sintetize em no máximo 3 bullets os principais problemas relatados. "
    "Depois, sugira 1 ação concreta para a empresa. "
    "Responda em português, de forma objetiva e executiva."
)
REVIEW_SEPARATOR = "\n- "
# ---- end of fixed values ---------------------------------------------------

TOP_TOPICS = 5
REVIEWS_PER_SUMMARY = 15
SUMMARY_MAX_TOKENS = 300
EMBEDDING_DIM = 1024


@dataclass(frozen=True)
class Layout:
    """Where the tables of each layer live and how they are stored."""

    bronze: str = "bronze"
    silver: str = "silver"
    gold: str = "gold"
    fmt: str = "parquet"
    location: str | None = None  # base folder of the schemas; None = the warehouse
    buckets: int | None = None  # bucket review-grain tables on review_id
    options: dict[str, str] = field(default_factory=dict)

    def table(self, layer: str, name: str) -> str:
        return f"{getattr(self, layer)}.{name}"
