"""Configurations: typed records, unknown keys, flat text."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from raretide.sources import configs

SCHEMA = "p double, shots long"


def _read(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return configs.records(rows, "t", SCHEMA, {"shots": 7})


def test_records_and_unknown_keys(spark):
    read = {r.i: r for r in _read(spark, '{"p": 0.1}', '{"z": 1, "shots": 3, "a": 2}', None, "[1]", "{}").collect()}
    assert (read[0].record.p, read[0].record.shots, read[0].unknown) == (0.1, 7, [])
    assert (read[1].record.p, read[1].record.shots, read[1].unknown) == (None, 3, ["a", "z"])
    assert read[2].record is None and read[3].record is None
    assert (read[4].record.p, read[4].record.shots) == (None, 7)


def test_strict_records(spark):
    assert configs.strict(_read(spark, '{"p": 0.1}')).first().record.p == 0.1
    for bad in ('{"q": 1}', None):
        with pytest.raises(PySparkException, match="not a configuration"):
            configs.strict(_read(spark, bad)).collect()


def test_flat_text(spark):
    text = "p: 0.1  # rate\n\n# all: comment\nlabel: a:b\np: 0.2\nempty:\nno entry"
    rows = spark.createDataFrame([(text,), (None,)], "t string")
    assert [r.m for r in rows.select(configs.flat(F.col("t")).alias("m")).collect()] == [{"p": "0.2", "label": "a:b", "empty": ""}, {}]
