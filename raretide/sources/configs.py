"""Study configurations: JSON or flat ``key: value`` text to typed records; keys that the record lacks are reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def records(rows: DataFrame, text: str, schema: str, given: dict[str, object] | None = None) -> DataFrame:
    """The rows with ``record`` (struct of schema) and ``unknown`` (keys outside it, ascending) of a JSON column.

    Fields that a text lacks take their value of ``given``, else null. A null text or one that is no object has a null record.
    """
    fields = StructType.fromDDL(schema).fields
    read = rows.withColumn("record", F.from_json(text, schema)).withColumn("keys", F.json_object_keys(text))
    with_given = F.struct(*(F.coalesce(F.col("record")[f.name], F.lit((given or {}).get(f.name)).cast(f.dataType)).alias(f.name) for f in fields))
    out = read.withColumn("record", F.when(F.col("keys").isNotNull(), with_given))
    return out.withColumn("unknown", F.array_sort(F.array_except("keys", F.array(*(F.lit(f.name) for f in fields))))).drop("keys")


def strict(read: DataFrame) -> DataFrame:
    """records without ``unknown``; a row with unknown keys, or without a record, ends the query."""
    wrong = F.col("record").isNull() | (F.size("unknown") > 0)
    why = F.concat(F.lit("not a configuration, unknown keys: "), F.coalesce(F.array_join("unknown", ", "), F.lit("no object")))
    return read.withColumn("record", F.when(wrong, F.raise_error(why)).otherwise(F.col("record"))).drop("unknown")


def flat(text: Column) -> Column:
    """``key: value`` lines as a map of strings; comments after ``#`` and empty lines are passed over, the last entry wins."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda s: F.trim(F.regexp_replace(s, r"(^|\s)#.*$", ""))), lambda s: s.contains(":"))
    pairs = F.transform(lines, lambda s: F.struct(F.regexp_extract(s, r"^([^:]*?)\s*:", 1).alias("key"), F.regexp_extract(s, r"^[^:]*:\s*(.*)$", 1).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.filter(pairs, lambda q, j: j > i), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)
