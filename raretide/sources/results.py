"""Results of runs: spectra as parallel arrays, ragged named arrays, folders of records with optional parts, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A manifest: its entries' fields; others are dropped.
MANIFEST = "array<struct<path:string,cpus:bigint,time:string,mem:string>>"


def payload(spec: DataFrame, by: Sequence[str]) -> DataFrame:
    """by and w, t, f -> by, weights, trials, failures: a spectrum's bins as parallel arrays, ascending in w.

    A spectrum has as many bins as a circuit has weights, whatever the number of shots.
    """
    bins = F.array_sort(F.collect_list(F.struct("w", "t", "f")))
    return spec.groupBy(*by).agg(bins.alias("bins")).select(*by, F.col("bins.w").alias("weights"), F.col("bins.t").alias("trials"), F.col("bins.f").alias("failures"))


def unpacked(rows: DataFrame, by: Sequence[str], block: str | None = None) -> DataFrame:
    """by, w, t, f of payloads, or of the struct ``block`` that holds one; its further fields are dropped.

    Arrays of unequal lengths give nulls, a null block gives no row.
    """
    at = lambda name: F.col(f"{block}.{name}" if block else name)
    zipped = F.arrays_zip(at("weights"), at("trials"), at("failures"))
    rows = rows.select(*by, F.explode(zipped).alias("bin"))
    names = rows.schema["bin"].dataType.fieldNames()
    return rows.select(*by, *(F.col("bin").getField(old).alias(new) for old, new in zip(names, ("w", "t", "f"))))


def named_arrays(rows: DataFrame, key: str) -> DataFrame:
    """key, name, place (from 0), value: the array columns of rows in long form; null and empty arrays give no row."""
    arrays = [f.name for f in rows.schema.fields if f.dataType.typeName() == "array"]
    entries = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("array<double>").alias("values")) for n in arrays))
    named = rows.select(key, F.explode(entries).alias("e"))
    return named.select(key, F.col("e.name").alias("name"), F.posexplode("e.values").alias("place", "value"))


def write_arrays(rows: DataFrame, folder: str) -> None:
    """Ragged named arrays, one row a run. Replaces the folder: the old files go before the new ones are committed."""
    rows.write.mode("overwrite").parquet(folder)


def read_arrays(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """key, name, place, value of what write_arrays wrote."""
    return named_arrays(spark.read.parquet(folder), key)


def run_parts(spark: SparkSession, root: str, needed: Sequence[str] = ("config", "spectrum"), others: Sequence[str] = ("distance", "onset", "ansatz_fit", "splitting")) -> DataFrame:
    """run and the text of each part (``<run>/<part>.json``) of every folder under root; parts that are absent are null.

    A run without one of the ``needed`` parts ends the query. Valid in the middle of a run: parts may still come.
    """
    files = spark.read.text(f"{root}/*/*.json", wholetext=True)
    place = F.col("_metadata.file_path")
    parts = files.select(F.regexp_extract(place, r"([^/]+)/[^/]+$", 1).alias("run"), F.regexp_extract(place, r"([^/]+)\.json$", 1).alias("part"), "value")
    runs = parts.groupBy("run").agg(*(F.max(F.when(F.col("part") == n, F.col("value"))).alias(n) for n in (*needed, *others)))
    missing = F.array_compact(F.array(*(F.when(F.col(n).isNull(), F.lit(n)) for n in needed)))
    why = F.concat(F.lit("run "), F.col("run"), F.lit(" lacks "), F.array_join(missing, ", "))
    first = F.when(F.size(missing) > 0, F.raise_error(why)).otherwise(F.col(needed[0])).alias(needed[0])
    return runs.select("run", first, *needed[1:], *others)


def manifest(rows: DataFrame, text: str) -> DataFrame:
    """The rows with place (from 0), path, cpus, time and mem of the entries in a JSON array; one row for each entry."""
    listed = rows.withColumn("entries", F.from_json(text, MANIFEST))
    return listed.select("*", F.posexplode("entries").alias("place", "entry")).select(*rows.columns, "place", "entry.*")


def output_folder(base: Column, isolate: Column, ablate: Column) -> Column:
    """Where a run writes: the base, with the channel that is kept alone or left out; both at once are an error."""
    one = F.when(isolate.isNotNull(), F.concat(base, F.lit("__iso_"), isolate)).when(ablate.isNotNull(), F.concat(base, F.lit("__abl_"), ablate)).otherwise(base)
    return F.when(isolate.isNotNull() & ablate.isNotNull(), F.raise_error(F.lit("a channel is kept alone or left out, not both"))).otherwise(one)
