"""Partitions whose number grows with a table, so that what one task sorts or aggregates does not."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a partition.
ROWS = 1 << 18


def count(table: DataFrame, rows: int = ROWS) -> int:
    """Partitions of about ``rows`` rows for a table, one for each core at least. Of a Parquet table only footers are read."""
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // rows))


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows of equal keys in one of ``parts`` partitions; without a number df as it is."""
    return df.repartition(parts, *keys) if parts else df
