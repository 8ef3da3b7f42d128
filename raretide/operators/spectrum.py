"""Failure spectra: building, filling, pooling, reweighting to physical rates, and ratios of two spectra.

A spectrum is a table w, t (trials), f (failures). Rates are a table p. N is the number of expanded columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from raretide.functions.numeric import binomial_weight, clipped, log_choose, per_round, rate


def failure_spectrum(shots: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Shots (w, fail, ...) -> trials and failures of each weight; one hash aggregate with a map-side combine."""
    return shots.groupBy(*(by or []), "w").agg(F.count(F.lit(1)).alias("t"), F.count(F.when(F.col("fail"), 1)).alias("f"))


def _over(by: list[str] | None):
    return W.partitionBy(*by).orderBy("w") if by else W.orderBy("w")


def fill(spec: DataFrame, by: list[str] | None = None, only_gap: int | None = None) -> DataFrame:
    """Every integer weight between neighbouring bins gets the pooled counts of both.

    ``only_gap=2`` is the older rule that fills single missing weights only.
    """
    keys, over = by or [], _over(by)
    ahead = spec.select(*keys, "w", "t", "f", *(F.lead(c).over(over).alias(f"{c}2") for c in ("w", "t", "f")))
    gap = F.col("w2") - F.col("w")
    missing = ahead.filter(gap == only_gap if only_gap else gap > 1)
    added = missing.select(*keys, F.explode(F.sequence(F.col("w") + 1, F.col("w2") - 1)).alias("w"), (F.col("t") + F.col("t2")).alias("t"), (F.col("f") + F.col("f2")).alias("f"))
    return spec.select(*keys, "w", "t", "f").unionByName(added)


def decimate(spec: DataFrame, stride: int, dense: int) -> DataFrame:
    """Weights below ``dense``, every ``stride``-th from the first, and the last."""
    whole = W.partitionBy()
    keep = (F.col("w") < dense) | (F.pmod(F.col("w") - F.min("w").over(whole), F.lit(stride)) == 0) | (F.col("w") == F.max("w").over(whole))
    return spec.withColumn("keep", keep).filter("keep").drop("keep")


def pool(*specs: DataFrame, constants: list[tuple] | None = None) -> DataFrame:
    """Sum of trials and failures by weight; spectra of different (n_expanded, q_base, p_ref) do not pool."""
    if constants and len(set(constants)) > 1:
        raise ValueError(f"spectra differ in (n_expanded, q_base, p_ref): {sorted(set(constants))}")
    out = specs[0]
    for s in specs[1:]:
        out = out.unionByName(s)
    return out.groupBy("w").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))


def weights_at(spec: DataFrame, grid: DataFrame, n: int, q_base: float = 1.0, p_ref: float = 1.0) -> DataFrame:
    """Each bin at each rate, with b = the binomial weight. The grid is a few rows and is broadcast."""
    q = clipped(F.lit(q_base) * F.col("p") / F.lit(p_ref))
    return log_choose(spec, n).join(F.broadcast(grid), F.lit(True)).withColumn("b", binomial_weight(F.col("log_c"), F.col("w"), n, q)).drop("log_c")


def _ler() -> Column:
    return F.sum(rate(F.col("f"), F.col("t")) * F.col("b"))


def _se() -> Column:
    r = rate(F.col("f"), F.col("t"))
    return F.sqrt(F.sum(F.when(F.col("t") == 0, 0.0).otherwise(F.pow(F.sqrt(r * (1 - r) / F.col("t")) * F.col("b"), 2))))


def reweight(spec: DataFrame, grid: DataFrame, n: int, by: list[str] | None = None, **rates) -> DataFrame:
    """ler(p) = sum over w of f(w) b(w; p), and its standard error."""
    return weights_at(spec, grid, n, **rates).groupBy(*(by or []), "p").agg(_ler().alias("ler"), _se().alias("ler_se"))


def with_headroom(spec: DataFrame, grid: DataFrame, n: int, by: list[str] | None = None, filled: bool = True, **rates) -> DataFrame:
    """Value, error and headroom: what bins without a failure could add if they had min(3, t)."""
    at = weights_at(fill(spec, by) if filled else spec, grid, n, **rates)
    could = F.when((F.col("f") == 0) & (F.col("t") > 0), F.least(F.lit(3), F.col("t")) / F.col("t") * F.col("b")).otherwise(0.0)
    return at.groupBy(*(by or []), "p").agg(_ler().alias("ler"), _se().alias("ler_se"), F.sum(could).alias("headroom"))


def eps(stats: DataFrame, rounds: int) -> DataFrame:
    """Per-round rates with the error and headroom carried over by the derivative."""
    slope = F.pow(1 - F.least(F.greatest(F.col("ler"), F.lit(0.0)), F.lit(1 - 1e-12)), F.lit(1.0 / rounds - 1)) / rounds
    e = per_round(F.col("ler"), rounds)
    high = per_round(F.col("ler") + F.col("headroom"), rounds)
    return stats.withColumns({"eps": e, "eps_se": slope * F.col("ler_se"), "eps_headroom": high - e})


def mass_window(spec: DataFrame, n: int, sigmas: float = 3.0) -> DataFrame:
    """The largest rate whose mean + sigmas * sqrt(mean) stays within the measured weights."""
    top = F.max("w")
    root = (-F.lit(sigmas) + F.sqrt(F.lit(sigmas * sigmas) + 4 * top)) / 2
    return spec.agg(top.cast("long").alias("w_max"), (root * root / n).alias("p_max"))


def zero_bins(spec: DataFrame) -> DataFrame:
    return spec.agg(F.avg(F.when(F.col("f") == 0, 1.0).otherwise(0.0)).alias("zero_fraction"), F.count(F.lit(1)).alias("bins"))


def rule_of_three(spec: DataFrame, grid: DataFrame, n: int, w0: int) -> DataFrame:
    """Upper bound of what bins without a failure, from weight w0 on, contribute: 3 / t each."""
    at = weights_at(spec.filter((F.col("f") == 0) & (F.col("w") >= w0) & (F.col("t") > 0)), grid, n)
    return at.groupBy("p").agg(F.sum(3 / F.col("t") * F.col("b")).alias("upper"))


def weight_cdf(spec: DataFrame, grid: DataFrame, n: int) -> DataFrame:
    """The share of each rate's failing weight up to w."""
    at = weights_at(spec, grid, n).withColumn("g", rate(F.col("f"), F.col("t")) * F.col("b"))
    return at.select("p", "w", (F.sum("g").over(W.partitionBy("p").orderBy("w")) / F.sum("g").over(W.partitionBy("p"))).alias("cdf"))


def weight_percentiles(spec: DataFrame, grid: DataFrame, n: int, quantiles: list[float]) -> DataFrame:
    """Weights at which the interpolated cumulative share reaches each quantile."""
    over = W.partitionBy("p").orderBy("w")
    steps = weight_cdf(spec, grid, n).select("p", "w", "cdf", F.lag("w").over(over).alias("w1"), F.lag("cdf").over(over).alias("c1"))
    asked = steps.select("*", F.explode(F.array(*(F.lit(q) for q in quantiles))).alias("q"))
    hit = asked.filter("cdf >= q AND (c1 IS NULL OR c1 < q)")
    at = F.when(F.col("c1").isNull(), F.col("w").cast("double")).otherwise(F.col("w1") + (F.col("q") - F.col("c1")) / (F.col("cdf") - F.col("c1")) * (F.col("w") - F.col("w1")))
    return hit.select("p", "q", at.alias("weight"))


def inv_lambda(small: DataFrame, large: DataFrame) -> DataFrame:
    """1 / Lambda = eps_large / eps_small on the rates of both, with error and interval."""
    s = small.select("p", F.col("eps").alias("es"), F.col("eps_se").alias("ss"), F.col("eps_headroom").alias("hs"))
    joined = large.select("p", F.col("eps").alias("el"), F.col("eps_se").alias("sl"), F.col("eps_headroom").alias("hl")).join(s, "p")
    r = F.col("el") / F.col("es")
    return joined.select("p", r.alias("inv_lambda"), (r * F.hypot(F.col("sl") / F.col("el"), F.col("ss") / F.col("es"))).alias("sigma"), (F.col("el") / (F.col("es") + F.col("hs"))).alias("lo"), ((F.col("el") + F.col("hl")) / F.col("es")).alias("hi"))


def crossing(curve: DataFrame) -> DataFrame:
    """p, y1, y2 -> the last sign change of ln y1 - ln y2, interpolated in logarithms; a zero counts as a change."""
    floor = F.lit(1e-300)
    d = curve.select("p", (F.log(F.greatest("y1", floor)) - F.log(F.greatest("y2", floor))).alias("d"))
    over = W.orderBy("p")
    steps = d.select("p", "d", F.lag("p").over(over).alias("p0"), F.lag("d").over(over).alias("d0")).filter(F.signum("d0") != F.signum("d"))
    last = steps.agg(F.max_by(F.struct("p0", "p", "d0", "d"), "p").alias("s"))
    part = F.when(F.col("s.d") == F.col("s.d0"), 0.0).otherwise(F.col("s.d0") / (F.col("s.d0") - F.col("s.d")))
    return last.select(F.exp(F.log("s.p0") + part * (F.log("s.p") - F.log("s.p0"))).alias("crossing"))


def verdict(contribution: Column, sigma: Column, lo: Column, hi: Column) -> Column:
    """Two standard errors first, then whether the interval holds zero."""
    return F.when(F.abs(contribution) < 2 * sigma, "consistent with zero").when((lo < 0) & (hi > 0), "unresolved").otherwise("resolved")
