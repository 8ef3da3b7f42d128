"""Failure spectra kept up to date from a stream of shot files: additive merge of each micro-batch's counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raretide.operators.spectrum import failure_spectrum


def spectrum_stream(spark: SparkSession, path: str, schema: T.StructType, shots, out: str, checkpoint: str, trigger: dict[str, str] | None = None) -> DataFrame:
    """Run the stream over the files of ``path`` to its end and return the spectrum.

    ``shots`` maps the source rows to (w, fail). Counts of a batch are written under its number, so that a batch that
    runs again after a failure replaces its own counts; reading adds the batches up.
    """
    source = spark.readStream.schema(schema).options(**(trigger or {})).parquet(path)

    def add(batch: DataFrame, number: int) -> None:
        failure_spectrum(shots(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add).trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.schema("w int, t long, f long").parquet(out)
    return parts.groupBy("w").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
