"""The queries of this subpackage, one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_topk, html_extract, language_id, license_scan, line_dedup, lm_scoring, mixing, near_dedup, packing, quality_rules
from .shared import tokenizer_file


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    pieces = packing.encode(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))
    return packing.pack(pieces)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.train_and_score(_table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(_table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.learn_and_predict(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.report(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_exact", "n_near", F.length("text").cast("long").alias("n_chars_left"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    return exact_topk.top_k(vectors, F.col("id") % 50 == 0)


ORACLES: dict[str, str] = {}

ORACLES["op3_line_dedup"] = r"""
WITH o AS (
    SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos
    FROM documents
), l AS (
    SELECT doc_id, pos, raw, trim(lower(raw), ' ') AS line FROM o
), d AS (
    SELECT line, min({'d': doc_id, 'p': pos}) AS first, length(line) AS n FROM l WHERE length(line) >= 20 GROUP BY line
), x AS (
    SELECT line, first, n AS goal, 1 AS side, left(line, n // 2 - 1) AS part FROM d
    UNION ALL SELECT line, first, n, 2, right(line, n // 2 - 1) FROM d
), y AS (
    SELECT line, first, n + g AS goal, 1 AS side, left(line, (n + g) // 2 - 1) AS part FROM d, (VALUES (-1), (0), (1)) v(g)
    UNION ALL SELECT line, first, n + g, 2, right(line, (n + g) // 2 - 1) FROM d, (VALUES (-1), (0), (1)) v(g)
), e AS (
    SELECT DISTINCT y.line FROM x JOIN y USING (goal, side, part)
    WHERE x.first < y.first AND levenshtein(x.line, y.line) = 1
), j AS (
    SELECT l.doc_id, l.pos, l.raw,
        d.line IS NOT NULL AND {'d': l.doc_id, 'p': l.pos} <> d.first AS later,
        e.line IS NOT NULL AS near
    FROM l LEFT JOIN d ON l.line = d.line LEFT JOIN e ON l.line = e.line
), r AS (
    SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count_if(later) AS BIGINT) AS n_exact,
        CAST(count_if(near AND NOT later) AS BIGINT) AS n_near,
        coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT later AND NOT near), '') AS text
    FROM j GROUP BY doc_id
)
SELECT doc_id, n_lines, n_exact, n_near, CAST(length(text) AS BIGINT) AS n_chars_left, md5(text) AS text_md5 FROM r
"""

ORACLES["op4_mix"] = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        md5(CAST(doc_id AS VARCHAR)) AS k
    FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
    SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s
), r AS (
    SELECT *, (sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER before, 0)) / sum(weight) OVER after AS level
    FROM w
    WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        after AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), o AS (
    SELECT min_by(level, source_size / weight) AS open_level FROM r WHERE level * weight < 3 * source_size
), t AS (
    SELECT source, source_size,
        CASE WHEN level * weight >= 3 * source_size OR open_level IS NULL THEN 3.0 * source_size ELSE open_level * weight END AS target
    FROM r, o
), p AS (
    SELECT doc_id, d.source, size, source_size, CAST(target AS DOUBLE) AS target,
        CAST(floor(CAST(target AS DOUBLE)) AS BIGINT) - CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target,
    CAST(least(greatest(first, 0), size) + least(greatest(first - source_size, 0), size)
        + least(greatest(first - 2 * source_size, 0), size) AS BIGINT) AS taken
FROM p
"""

ORACLES["op10_topk"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM p
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_lm_score": op2_lm_score,
    "op3_line_dedup": op3_line_dedup,
    "op4_mix": op4_mix,
    "op5_near_dedup": op5_near_dedup,
    "op6_licenses": op6_licenses,
    "op7_quality": op7_quality,
    "op8_main_text": op8_main_text,
    "op9_language": op9_language,
    "op10_topk": op10_topk,
}
