"""Build the library of failing texts: distinct word supports with provenance, and the failure spectrum by weight.

    python -m jobs.text_library --documents TABLE --labels TABLE --out FOLDER --config jobs/text_library.json

A labelled document is a shot: its configuration is its words, of which those that occur an odd number of times stay (even
ones cancel, as mechanisms do), the number of these is its weight, and it fails where ``toxic`` is 1. Documents of one
language with one support are one entry, whose provenance is the smallest document that has it:

    out/library/lang=L   name (a digest of the support), w, doc_id, source, t, f: documents with the support, failing ones
    out/spectrum/lang=L  band (weights from band * width), t, f, kinds, split: supports, and those that fail only at times

Each run replaces the whole output, so a run that was stopped is mended by the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, main
SETTINGS = "band int"
LIBRARY = "name string, w long, doc_id long, source string, t long, f long, lang string"
SPECTRUM = "band long, t long, f long, kinds long, split long, lang string"


def _odd(words: Column) -> Column:
    """The values of odd number in an array, ascending: runs of equal ones in the sorted array, found in one walk over it."""

    def runs(a: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(a)), lambda i: (i == 0) | (i == F.size(a)) | (F.get(a, i) != F.get(a, i - 1)))
        return F.transform(F.array(starts), lambda s: F.transform(F.filter(F.transform(s, lambda at, j: F.struct(at.alias("at"), (F.get(s, j + 1) - at).alias("n"))), lambda r: r["n"] % 2 == 1), lambda r: F.get(a, r["at"])))

    return F.flatten(F.flatten(F.transform(F.array(F.array_sort(words)), runs)))


def shots_of(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """row, doc_id, lang, source, w, name, fail of documents with a label; of several labels of one document the largest counts.

    w and name are of the words of odd number, in order: how many, and a digest. A text without any has weight 0 and the
    empty support. They are made where a text is read, so that no text or word is shuffled.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg((F.max("toxic") == 1).alias("fail"))
    whole = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    odd = whole.withColumn("odd", _odd(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")))
    # a row that repeats is one shot
    row = F.sha2(F.concat_ws("\x00", F.col("doc_id").cast("string"), "lang", "source", "text").cast("binary"), 256)
    shots = odd.select(row.alias("row"), "doc_id", "lang", "source", F.size("odd").cast("long").alias("w"), F.md5(F.array_join("odd", " ")).alias("name"))
    return shots.join(known, "doc_id").dropDuplicates(["row"])


def library(documents: DataFrame, labels: DataFrame) -> DataFrame:
    both = shots_of(documents, labels)
    first = F.min(F.struct("doc_id", "source"))
    entries = both.groupBy("lang", "name").agg(F.max("w").alias("w"), first.alias("first"), F.count(F.lit(1)).alias("t"), F.count_if("fail").alias("f"))
    return entries.select("name", "w", "first.doc_id", "first.source", "t", "f", "lang")


def spectrum(entries: DataFrame, band: int) -> DataFrame:
    """The library summed over bands of weight."""
    by_band = entries.groupBy("lang", F.floor(F.col("w") / band).alias("band"))
    return by_band.agg(F.sum("t").alias("t"), F.sum("f").alias("f"), F.count(F.lit(1)).alias("kinds"), F.count_if((F.col("f") > 0) & (F.col("f") < F.col("t"))).alias("split")).select("band", "t", "f", "kinds", "split", "lang")


def run(spark: SparkSession, documents: str, labels: str, out: str, *, band: int = 25) -> None:
    """Write library and spectrum of the tables at ``documents`` and ``labels`` (Parquet) under ``out``.

    Null texts, languages and sources count as empty; documents without an identifier or a label are no shots. Empty
    tables give empty outputs.
    """
    docs = spark.read.parquet(documents)
    library(docs.select("doc_id", "text", "lang", "source"), spark.read.parquet(labels)).write.mode("overwrite").partitionBy("lang").parquet(f"{out}/library")
    LOG.info("%d documents read from %s, %d supports written to %s/library", docs.count(), documents, read_library(spark, out).count(), out)
    spectrum(read_library(spark, out), band).write.mode("overwrite").partitionBy("lang").parquet(f"{out}/spectrum")
    LOG.info("%d bands written to %s/spectrum", read_spectrum(spark, out).count(), out)


def read_library(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(LIBRARY).parquet(f"{out}/library").withColumn("lang", F.coalesce("lang", F.lit("")))


def read_spectrum(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SPECTRUM).parquet(f"{out}/spectrum").withColumn("lang", F.coalesce("lang", F.lit("")))


if __name__ == "__main__":
    main(run, SETTINGS, ("documents", "labels", "out"), __doc__.splitlines()[0])
