"""Queries of the training-data operators over the driver's tables, and the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raretide.llm.decontam import decontaminate
from raretide.llm.exact_dedup import exact_dedup
from raretide.llm import conversations, licenses, line_dedup, url_filter
from raretide.llm.langid import identify, identify_pages
from raretide.llm.minhash import near_duplicates
from raretide.llm.packing import pack
from raretide.llm.quality import grade_quality
from raretide.llm.substring import drop_repeated_passages
from raretide.llm.toxicity import score_toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade_quality(_documents(spark, sf_dir), _labels(spark, sf_dir)).drop("tails")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over documents: the lang column is the declared tag, the source the host; they have no address."""
    return identify(_documents(spark, sf_dir), declared=F.col("lang"), host=F.col("source"))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with all its evidence: markup language, address suffix and host of raw pages."""
    return identify_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, sf_dir))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_passages(_documents(spark, sf_dir)).drop("kept_text")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.repair_conversations(conversations.damaged(turns), turns)


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_licenses": op3_licenses,
    "op4_language": op4_language,
    "language_of_pages": language_of_pages,
    "op5_minhash": op5_minhash,
    "op6_line_dedup": op6_line_dedup,
    "op7_substring": op7_substring,
    "op8_packing": op8_packing,
    "op9_decontam": op9_decontam,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_conversations": op11_conversations,
    "op12_urls": op12_urls,
}

ORACLES: dict[str, str] = {
    "op3_licenses": licenses.oracle_sql(),
    "op5_minhash": """
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
        items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
        links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        reach(node, seen) AS (SELECT doc_id, doc_id FROM sets UNION SELECT l.b, r.seen FROM reach r JOIN links l ON l.a = r.node)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.seen) AS component_id, s.doc_id = min(r.seen) AS kept
        FROM sets s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id, len(s.s)
    """,
    "op6_line_dedup": line_dedup.oracle_sql(),
    "op7_substring": """
        WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        runs AS (SELECT doc_id, s, array_to_string(w[s:s + 49], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM words)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY x) AS d FROM runs) WHERE d < doc_id),
        stay AS (SELECT w.doc_id, string_agg(w.t, ' ' ORDER BY w.i) AS kept, count(*) AS n
                 FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM words) w ANTI JOIN gone g USING (doc_id, i) GROUP BY w.doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(s.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
        FROM words d LEFT JOIN stay s USING (doc_id)
    """,
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_conversations": conversations.oracle_sql(),
    "op12_urls": url_filter.oracle_sql(),
}
