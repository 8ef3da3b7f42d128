"""Top up a study's failure spectrum with the shot files that have arrived since the last run.

    python -m jobs.topup --shots FOLDER --out FOLDER --checkpoint FOLDER --config jobs/topup.json

Shots are rows of lineitem: run (line status), weight (quantity), failure (returned). A file stream takes each file once;
its checkpoint is the mark. What a micro-batch adds is written under the batch's number, and a batch that runs again
after a crash has the same files and the same number, so that it replaces its own partitions and nothing counts twice:

    out/bins/batch=N/run=R       w, t, f
    out/specimens/batch=N/run=R  w, lot, name: the failing shots of the smallest lots, at most ``keep`` a weight
    out/report/run=R             w, t, f, open, specimens, listed: what the batches so far add up to

The smallest lots of all are among the smallest of each batch, so a weight's specimens are the same in whatever order
files come, and a batch never keeps more than ``keep`` of them. A bin is ``open`` while it has fewer than ``target``
failures and fewer than ``cap`` trials: the next shots to take are there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobs.common import LOG, main
from raretide.operators.spectrum import failure_spectrum

SETTINGS = "target long, cap long, keep int, files_per_batch int"
BINS = "w int, t long, f long, batch long, run string"
SPECIMENS = "w int, lot string, name string, batch long, run string"
REPORT = "w int, t long, f long, open boolean, specimens long, listed string, run string"


def shots_of(rows: DataFrame) -> DataFrame:
    """run, w, fail, name of each shot. Without a weight a row is no shot; without a flag it did not fail."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")))
    fail = F.coalesce(F.col("l_returnflag") == "R", F.lit(False))
    return rows.select(F.coalesce("l_linestatus", F.lit("")).alias("run"), F.col("l_quantity").cast("int").alias("w"), fail.alias("fail"), name.alias("name")).filter("w IS NOT NULL")


def _smallest(specimens: DataFrame, keep: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("run", "w").orderBy("lot", "name"))
    return specimens.withColumn("place", place).filter(F.col("place") <= keep)


def _write(df: DataFrame, folder: str, by: list[str]) -> None:
    """Replace the partitions that df has rows for, in one job that Spark commits."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(folder)


def _read(spark: SparkSession, schema: str, folder: str) -> DataFrame:
    """An empty run is written as the partition that stands for null."""
    return spark.read.schema(schema).parquet(folder).withColumn("run", F.coalesce("run", F.lit("")))


def add_bins(shots: DataFrame, out: str, number: int) -> None:
    """The batch's trials and failures."""
    _write(failure_spectrum(shots, ["run"]).withColumn("batch", F.lit(number).cast("long")), f"{out}/bins", ["batch", "run"])


def add_specimens(shots: DataFrame, out: str, number: int, keep: int) -> None:
    failed = shots.filter("fail").select("run", "w", F.md5(F.col("name")).alias("lot"), "name")
    _write(_smallest(failed, keep).select("w", "lot", "name", F.lit(number).cast("long").alias("batch"), "run"), f"{out}/specimens", ["batch", "run"])


def report(spark: SparkSession, out: str, target: int, cap: int, keep: int) -> DataFrame:
    """What the batches add up to: one row for each run and weight."""
    bins = _read(spark, BINS, f"{out}/bins").groupBy("run", "w").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
    least = _smallest(_read(spark, SPECIMENS, f"{out}/specimens"), keep)
    names = F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda s: s["name"])
    kept = least.groupBy("run", "w").agg(F.count(F.lit(1)).alias("specimens"), F.md5(F.array_join(names, ",")).alias("listed"))
    return bins.join(kept, ["run", "w"], "left").select("w", "t", "f", ((F.col("f") < target) & (F.col("t") < cap)).alias("open"), F.coalesce("specimens", F.lit(0)).alias("specimens"), "listed", "run")


def run(spark: SparkSession, shots: str, out: str, checkpoint: str, *, target: int = 100, cap: int = 100000, keep: int = 200, files_per_batch: int = 1000) -> None:
    """Take the files of ``shots`` that the checkpoint has not met, then write the report anew.

    No new file: only the report is written, the same as before. An empty file adds nothing. A file's rows count once for
    each file that holds them. Null weights are passed over, null flags count as no failure, a null run is an empty one.
    """
    schema = spark.read.parquet(shots).schema
    place = shots if any(c in shots for c in "*?[{") else f"{shots[:-1]}[{shots[-1]}]"  # a pattern may be a folder or a single file
    # files are taken however old they are when they come
    # so that there is something to add up where no shot has come yet
    for name, kind, by in (("bins", BINS, ["batch", "run"]), ("specimens", SPECIMENS, ["batch", "run"]), ("report", REPORT, ["run"])):
        spark.createDataFrame([], kind).write.mode("append").partitionBy(*by).parquet(f"{out}/{name}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", "36500d").parquet(place)

    def add(batch: DataFrame, number: int) -> None:
        rows = shots_of(batch)
        add_bins(rows, out, number)
        add_specimens(rows, out, number, keep)
        read = _read(batch.sparkSession, BINS, f"{out}/bins").filter(F.col("batch") == number).agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]
        LOG.info("batch %d: %d shots read from %s, bins and specimens written to %s", number, read, shots, out)

    query = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add).trigger(availableNow=True).start()
    query.awaitTermination()
    _write(report(spark, out, target, cap, keep), f"{out}/report", ["run"])
    LOG.info("report of %d bins written to %s/report", read_report(spark, out).count(), out)


def read_report(spark: SparkSession, out: str) -> DataFrame:
    return _read(spark, REPORT, f"{out}/report")


if __name__ == "__main__":
    main(run, SETTINGS, ("shots", "out", "checkpoint"), __doc__.splitlines()[0])
