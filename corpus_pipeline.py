"""The corpus pipeline: language, lines, near-duplicates, benchmark leaks, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over what its predecessor kept. All but the last return the
columns of documents. Stages are written as Parquet and read again between one another by whoever runs them; run()
does so in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raretide.llm.decontam import without_leaks
from raretide.llm.langid import without_unknown_languages
from raretide.llm.line_dedup import without_repeated_lines
from raretide.llm.minhash import without_near_duplicates
from raretide.llm.packing import pack
from raretide.llm.workspace import Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    return without_unknown_languages(docs, declared=F.col("lang"), host=F.col("source")).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are cut from the texts; documents stay."""
    return without_repeated_lines(docs, length_col="n_chars").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest identifier."""
    return without_near_duplicates(docs).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, mixed by source."""
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "source", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Latent retrieval and the tokenizer are not expressible in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Workspace(spark, "pipeline") as work:
        for name, stage in STAGES:
            after = stage(spark, docs, sf_dir)
            docs = work.keep(after) if name == STAGES[-1][0] else work.table(after, name)
    return docs
