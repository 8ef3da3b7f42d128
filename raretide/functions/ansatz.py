"""Failure-fraction curves over weights as column expressions: saturating at a, f0 near the onset w0, zero below it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sharpness of the change between two exponents (a fixed value).
SHARPNESS = 2.0


def saturating(w: Column, w0: float, f0: float, a: float, growth: Column) -> Column:
    """a (1 - exp(-f0 / a * growth)), 0 below the onset."""
    return F.when(w < w0, F.lit(0.0)).otherwise(a * (1 - F.exp(-f0 / a * growth)))


def onset_power(w: Column, w0: float, f0: float, a: float) -> Column:
    """Two parameters: the exponent is the onset itself."""
    return saturating(w, w0, f0, a, F.pow(w / w0, F.lit(float(w0))))


def two_powers(w: Column, w0: float, f0: float, a: float, first: float, second: float, turn: float) -> Column:
    """Five parameters: the exponent goes from ``first`` to ``second`` around the weight ``turn``."""
    bend = (1 + F.pow(w / turn, F.lit(SHARPNESS))) / (1 + (w0 / turn) ** SHARPNESS)
    return saturating(w, w0, f0, a, F.pow(w / w0, F.lit(float(first))) * F.pow(bend, F.lit((second - first) / SHARPNESS)))
