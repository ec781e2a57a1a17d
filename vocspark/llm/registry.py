"""The ten operators' queries over whole tables, and their SQL twins where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocspark.llm import (
    context_tree, exact_dedup, fingerprints, language_id, licenses, merkle, mixing, near_dedup, packing, periodic,
    signature_tree, simple8b, token_counts,
)
from vocspark.llm.common import ascii_lower, documents
from vocspark.sources.scratch import shared_folder

TOKEN_LIMIT = 512


def id_fold(folds: int):
    """crc32 of the doc_id as text, modulo `folds`; a null id counts as the empty text."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds


def hex64(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in training order, with the positions of their first and second copy."""
    mixed = mixing.mix(documents(spark, sf_dir), keep=["doc_id"])
    first = F.get("positions", F.lit(0))
    ordered = mixed.repartitionByRange(first.asc_nulls_last(), F.col("row.doc_id"))
    return ordered.sortWithinPartitions(first.asc_nulls_last(), F.col("row.doc_id")).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken",
        F.round(first, 9).alias("first_position"),
        F.round(F.get("positions", F.lit(1)), 9).alias("second_position"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of `documents`; a null text is empty, repeated rows are counted each, null ids stay null."""
    counted = token_counts.token_counts(documents(spark, sf_dir))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; null texts are empty, rows of one doc_id and equal text are one."""
    made = fingerprints.edited_fingerprints(documents(spark, sf_dir))
    return made.select(
        "doc_id", "n_chars", "edited_sha256", hex64("fp").alias("fingerprint"),
        hex64("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and template found; null, empty and short texts match nothing."""
    return licenses.scan_licenses(documents(spark, sf_dir))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row; null and empty texts have fingerprint zero and link like any other."""
    return near_dedup.near_dedup(documents(spark, sf_dir)).select(
        "doc_id", hex64("fp").alias("fingerprint"), "component_id")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; null counts as empty, rows of one doc_id and equal text are one."""
    marked = exact_dedup.exact_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return marked.select(
        F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece; a null text is its end id alone, repeated rows are packed each."""
    return packing.pack(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row; texts that are null or without a letter are `und`, ties go to the first language."""
    docs = documents(spark, sf_dir)
    model = language_id.train(docs.filter(id_fold(4) != 2))
    return language_id.identify(docs.select("doc_id", "text"), model).select(
        F.col("row.doc_id").alias("doc_id"), "lang_pred", "score").select(
        "doc_id", (id_fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row; a null or blank text is its end alone, a null id falls into a fold as the empty text."""
    return context_tree.score_texts(documents(spark, sf_dir), id_fold(10) != 0)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row as read back from the files; null ids come first, a null text is its end id alone."""
    path = shared_folder(spark, "token-ids")
    simple8b.write_ids(documents(spark, sf_dir), path)
    return simple8b.read_ids(spark, path)


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the size of its set of 5-word shingles and its component of similar sets."""
    return signature_tree.jaccard_join(documents(spark, sf_dir))


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth text, by hash of its id (null: the empty text), goes on periodically from some word."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // period)
    return words[:a] + (words[a:a + period] * times)[:n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; runs of texts that `planted_period` may have changed."""
    return periodic.periodic_runs(documents(spark, sf_dir), planted_period).drop("runs", "collapsed")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document, by hash of its id, is verified with its A-Z lower-cased: a tampered text."""
    tampered = F.when((id_fold(3) == 0) & F.col("text").isNotNull(), ascii_lower("text")).otherwise(F.col("text"))
    return merkle.manifest(documents(spark, sf_dir), tampered).drop("path")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, sum(size) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS turn,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT a.source, a.source_size, a.weight,
         (1.5::DOUBLE * (SELECT sum(source_size) FROM sources)
          - coalesce(sum(b.source_size * 2) FILTER (WHERE b.source_size * 1.0 / b.weight < a.source_size * 1.0 / a.weight), 0))
         / sum(b.weight) FILTER (WHERE b.source_size * 1.0 / b.weight >= a.source_size * 1.0 / a.weight) AS level
  FROM sources a, sources b GROUP BY ALL),
targets AS (
  SELECT source, source_size,
         least(CAST(source_size * 2 AS DOUBLE), weight * coalesce(
           (SELECT min_by(level, source_size * 1.0 / weight) FROM levels WHERE level * weight < source_size * 2),
           CAST('inf' AS DOUBLE))) AS target
  FROM levels),
placed AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (
    PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + size / 2.0 AS middle
  FROM sized),
scheduled AS (
  SELECT doc_id, size, s.source_size, target, middle, [1.5, 0.5, 1.0][turn]::DOUBLE AS a, [0.5, 1.5, 1.0][turn]::DOUBLE AS b
  FROM placed JOIN targets t ON placed.source IS NOT DISTINCT FROM t.source
    JOIN sources s ON s.source IS NOT DISTINCT FROM t.source),
curves AS (
  SELECT *, middle / target * (a + b) AS area_1, (middle + source_size) / target * (a + b) AS area_2 FROM scheduled)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * ((middle < target)::INT + (middle + source_size < target)::INT) AS BIGINT) AS taken,
       CASE WHEN middle < target THEN
         round(least(coalesce(area_1 / (a + sqrt(greatest(a * a + (b - a) * area_1, 0))), 0), 1), 9) END AS first_position,
       CASE WHEN middle + source_size < target THEN
         round(least(coalesce(area_2 / (a + sqrt(greatest(a * a + (b - a) * area_2, 0))), 0), 1), 9) END AS second_position
FROM curves
"""

# crc32 of a decimal id, a byte and then a bit at a time
CRC32 = """(
  SELECT xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(
    string_split(coalesce(CAST({id} AS VARCHAR), ''), ''), lambda c: ascii(c)::UBIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
      lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT))"""

OP11_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s
  FROM texts),
distinct_sets AS (SELECT min(doc_id) AS d, len(s) AS n, s FROM sets WHERE len(s) > 0 GROUP BY s),
grams AS (SELECT d, n, hash(g) AS g FROM (SELECT d, n, unnest(s) AS g FROM distinct_sets)),
pairs AS (
  SELECT a.d AS u, b.d AS v, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM grams a JOIN grams b ON a.g = b.g AND a.d < b.d GROUP BY a.d, b.d),
links AS (SELECT u, v FROM pairs WHERE 100 * c >= 80 * (na + nb - c)),
arcs AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(d, r) AS (
  SELECT d, d FROM distinct_sets UNION SELECT a.v, reach.r FROM reach JOIN arcs a ON a.u = reach.d),
found AS (SELECT d, min(r) AS c FROM reach GROUP BY d)
SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles, coalesce(f.c, t.doc_id) AS component_id
FROM sets t LEFT JOIN distinct_sets x ON x.s = t.s LEFT JOIN found f ON f.d = x.d
"""

OP13_SQL = """
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    CASE WHEN @CRC % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
         ELSE text END AS claimed
  FROM documents),
leaves AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(claimed) || ':' || claimed, '-')) AS claim FROM base),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, n FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 7) // 8
  FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 8),
subroots AS (
  SELECT tree, digest AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS pos,
         count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, subroot AS digest, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 7) // 8
  FROM tops WHERE n > 1 GROUP BY level, pos // 8),
hops AS (
  SELECT p.doc_id, p.tree, p.pos, s.level,
         coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (WHERE s.pos < p.pos // CAST(8 ** s.level AS BIGINT)), '') AS l,
         coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (WHERE s.pos > p.pos // CAST(8 ** s.level AS BIGINT)), '') AS r
  FROM placed p JOIN nodes s ON s.tree = p.tree AND s.n > 1
    AND s.pos // 8 = p.pos // CAST(8 ** (s.level + 1) AS BIGINT)
  GROUP BY ALL
  UNION ALL
  SELECT p.doc_id, p.tree, p.pos, b.height + s.level,
         coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (WHERE s.pos < b.pos // CAST(8 ** s.level AS BIGINT)), ''),
         coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (WHERE s.pos > b.pos // CAST(8 ** s.level AS BIGINT)), '')
  FROM placed p JOIN subroots b ON b.tree = p.tree
    JOIN tops s ON s.n > 1 AND s.pos // 8 = b.pos // CAST(8 ** (s.level + 1) AS BIGINT)
  GROUP BY ALL),
proofs AS (
  SELECT tree, pos, sha256(string_agg(l || r, '' ORDER BY level)) AS proof FROM hops GROUP BY ALL),
folds AS (
  SELECT tree, pos, 0 AS level, claim AS digest FROM placed
  UNION ALL
  SELECT f.tree, f.pos, f.level + 1, sha256(h.l || f.digest || h.r)
  FROM folds f JOIN hops h ON h.tree = f.tree AND h.pos = f.pos AND h.level = f.level),
ends AS (SELECT tree, pos, max_by(digest, level) AS folded FROM folds GROUP BY ALL)
SELECT p.doc_id, p.leaf, b.subroot, t.digest AS root, coalesce(proof, sha256('')) AS proof_sha256,
       folded AS folded_root, folded = t.digest AS verified
FROM placed p JOIN subroots b ON b.tree = p.tree JOIN ends e ON e.tree = p.tree AND e.pos = p.pos
  JOIN (SELECT digest FROM tops WHERE n = 1) t ON true
  LEFT JOIN proofs q ON q.tree = p.tree AND q.pos = p.pos
""".replace("@CRC", CRC32.format(id="doc_id"))

OP6_SQL = """
WITH normal AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM normal
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_mix_sources, op2_token_counts, op3_fingerprints, op4_license_scan, op5_near_dedup,
        op6_exact_dedup, op7_pack, op8_language_id, op9_lm_score, op10_token_files,
        op11_ngram_jaccard_join, op12_periodic_runs, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op6_exact_dedup": OP6_SQL, "op11_ngram_jaccard_join": OP11_SQL,
            "op13_merkle_manifest": OP13_SQL}
