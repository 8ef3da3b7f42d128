"""Labelled documents for fitting a classifier: all of them, or a bounded sample for the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def held_out(id_col: Column) -> Column:
    """Rows whose crc32(identifier as text) is divisible by 5: never learnt from. A null identifier is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: Column, per_class: int, classes: int, *, id_col: str = "doc_id", text_col: str = "text", more: dict[str, Column] | None = None, longest: int = 1 << 15) -> list:
    """Rows (doc_id, y, text, ...) of at most ``per_class`` documents of each of ``classes`` grades, held-out ones apart.

    The sample is the documents of the smallest hashes of the identifier, one row of each (the one of the smallest text),
    without those of more than ``longest`` characters: at most classes * per_class rows of that size reach the driver,
    however often an identifier is repeated. A document with several labels takes the largest.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), label.cast("int").alias("y")).filter("y IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    picked = None
    for k in range(classes):
        part = known.filter(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(c.alias(n) for n, c in (more or {}).items()))
    rows = rows.join(F.broadcast(picked), "doc_id").filter(F.coalesce(F.length("text"), F.lit(0)) <= longest)
    # the limit reaches below the shuffle: of a repeated identifier every task keeps one row
    first = W.partitionBy("doc_id").orderBy("text", *(more or {}))
    rows = rows.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
    return rows.orderBy("doc_id").collect()


#: Bits for a labelled identifier in the maps that keep other documents out of the shuffle, and the most maps (4 KB each).
BITS, MAPS = 32, 4096


def candidates(docs: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """Rows of docs whose doc_id may be one of the ``n`` or fewer of known: all that are, and few others (a 32nd below 4 million)."""
    maps = min(1 + n * BITS // (1 << 15), MAPS)
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(maps << 15))
    at = F.bitmap_bit_position(spot)
    bits = known.groupBy(F.bitmap_bucket_number(spot).alias("map")).agg(F.bitmap_construct_agg(at).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = docs.withColumn("map", F.bitmap_bucket_number(spot)).join(F.broadcast(bits), "map")
    return found.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(docs.columns)


def everything(docs: DataFrame, labels: DataFrame, label: Column, blocks: int, tasks: int, n: int, *, id_col: str = "doc_id", text_col: str = "text", more: dict[str, Column] | None = None) -> DataFrame:
    """block, doc_id, y, text, ...: all labelled documents but the held-out ones, one row of each (the one of the smallest text).

    Blocks are dealt by the identifier's hash over ``tasks`` partitions, in the one shuffle that also brings a document, its
    repetitions and its labels (``n`` in all or fewer) together, so that no text is moved twice.
    """
    kind = docs.select(id_col).union(labels.select(id_col)).schema[0].dataType  # that a join would compare in
    name = F.col(id_col).cast(kind).alias("doc_id")
    known = labels.select(name, label.cast("int").alias("y")).filter("y IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    rows = docs.select(name, F.struct(F.col(text_col).alias("text"), *(c.alias(k) for k, c in (more or {}).items())).alias("row"))
    rows = candidates(rows.filter("doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))), known, n)
    both = rows.unionByName(known, allowMissingColumns=True).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    both = both.repartitionById(tasks, "block").groupBy("block", "doc_id").agg(F.max("y").alias("y"), F.min("row").alias("row"))
    return both.filter("y IS NOT NULL AND row IS NOT NULL").select("block", "doc_id", "y", "row.*")


def first(rows: DataFrame, per_class: int, classes: int, *, longest: int = 1 << 15) -> DataFrame:
    """Of each class at most ``per_class`` rows of at most ``longest`` characters, those of the smallest hashes.

    Every task offers its smallest, so that only identifiers are ordered, and texts are taken for those that remain.
    """
    short = rows.filter(F.coalesce(F.length("text"), F.lit(0)) <= longest)
    picked = None
    for k in range(classes):
        part = short.filter(F.col("y") == k).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    return rows.join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text")
