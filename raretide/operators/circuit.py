"""Instruction streams: channels of noise by their neighbours, filters by channel, schedules by layer.

A stream is circuit, seq, name; windows are over one circuit, so that any number of circuits spreads over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def _in_circuit():
    return W.partitionBy("circuit").orderBy("seq")


def channel(noise: Column, before: Column, after: Column, gate: str, measure: str, reset: str) -> Column:
    """cz after a gate, meas before a measurement, prep after a reset; else idle, beside a gate or not."""
    kind = F.when(before == gate, "cz").when(after == measure, "meas").when(before == reset, "prep").when(after == gate, "gate_idle").when(before == measure, "meas_idle").otherwise("idle")
    return F.when(noise, kind)


def classified(stream: DataFrame, noise: str, gate: str, measure: str, reset: str) -> DataFrame:
    """The stream with the channel of each noise instruction, null for others."""
    return stream.withColumn("channel", channel(F.col("name") == noise, F.lag("name").over(_in_circuit()), F.lead("name").over(_in_circuit()), gate, measure, reset))


def only_channel(stream: DataFrame, wanted: str, **names: str) -> DataFrame:
    """All instructions but the noise of other channels."""
    return classified(stream, **names).filter(F.col("channel").isNull() | (F.col("channel") == wanted))


def layers(stream: DataFrame, tick: str) -> DataFrame:
    """The number of ticks up to and with each instruction."""
    return stream.withColumn("layer", F.sum(F.when(F.col("name") == tick, 1).otherwise(0)).over(_in_circuit()))
