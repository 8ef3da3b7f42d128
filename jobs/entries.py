"""The jobs as registered queries: run twice into one new folder, then read back; with the SQL of the whole output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import text_library, topup
from jobs.common import own_folder


def job1_topup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = own_folder(spark, "job1-topup")
    for _ in range(2):
        topup.run(spark, f"{sf_dir}/lineitem.parquet", f"{out}/out", f"{out}/checkpoint")
    return topup.read_report(spark, f"{out}/out")


def job2_text_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = own_folder(spark, "job2-text-library")
    for _ in range(2):
        text_library.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out)
    return text_library.read_library(spark, out)


QUERIES = {"job1_topup": job1_topup, "job2_text_library": job2_text_library}

ORACLES = {
    "job1_topup": """
        WITH shots AS (SELECT coalesce(l_linestatus, '') AS run, CAST(l_quantity AS INTEGER) AS w, coalesce(l_returnflag = 'R', FALSE) AS fail,
                              concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS name FROM lineitem WHERE l_quantity IS NOT NULL),
        bins AS (SELECT run, w, count(*) AS t, count(*) FILTER (fail) AS f FROM shots GROUP BY run, w),
        kept AS (SELECT run, w, name, row_number() OVER (PARTITION BY run, w ORDER BY md5(name), name) AS place FROM shots WHERE fail QUALIFY place <= 200),
        lists AS (SELECT run, w, count(*) AS specimens, md5(string_agg(name, ',' ORDER BY place)) AS listed FROM kept GROUP BY run, w)
        SELECT w, t, f, f < 100 AND t < 100000 AS open, coalesce(specimens, 0) AS specimens, listed, run FROM bins LEFT JOIN lists USING (run, w)
    """,
    "job2_text_library": """
        WITH known AS (SELECT doc_id, max(toxic) = 1 AS fail FROM labels WHERE toxic IS NOT NULL GROUP BY doc_id),
        shots AS (SELECT row_number() OVER () AS row, * FROM (SELECT DISTINCT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, fail FROM documents JOIN known USING (doc_id))),
        words AS (SELECT row, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS word FROM shots),
        odd AS (SELECT row, word FROM words GROUP BY row, word HAVING count(*) % 2 = 1),
        support AS (SELECT row, count(*) AS w, string_agg(word, ' ' ORDER BY word) AS words FROM odd GROUP BY row)
        SELECT md5(coalesce(words, '')) AS name, max(coalesce(w, 0)) AS w, min(doc_id) AS doc_id, min_by(source, (doc_id, source)) AS source, count(*) AS t, count(*) FILTER (fail) AS f, lang
        FROM shots LEFT JOIN support USING (row) GROUP BY lang, md5(coalesce(words, ''))
    """,
}
