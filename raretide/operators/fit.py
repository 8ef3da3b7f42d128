"""Fits of failure spectra by weighted least squares in logarithms, and bootstrap bands of what they extrapolate to."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def three_parameter(w: np.ndarray, w0: float, f0: float, gamma: float, a: float) -> np.ndarray:
    w = np.asarray(w, float)
    return np.where(w < w0, 0.0, a * (1 - np.exp(-(f0 / a) * (np.maximum(w, 1e-9) / w0) ** gamma)))


def least_squares(residual, start: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Levenberg-Marquardt with a numeric Jacobian. Returns the parameters and the cost."""
    x, damp = np.array(start, float), 1e-2
    r = residual(x)
    cost = float(r @ r)
    for _ in range(rounds):
        step = 1e-6 * np.maximum(1, np.abs(x))
        j = np.stack([(residual(x + d) - r) / s for d, s in zip(np.diag(step), step, strict=True)], axis=1)
        g, hess = j.T @ r, j.T @ j
        try:
            move = np.linalg.solve(hess + damp * np.diag(np.maximum(np.diag(hess), 1e-12)), -g)
        except np.linalg.LinAlgError:
            damp *= 10
            continue
        trial = residual(x + move)
        new = float(trial @ trial)
        if np.isfinite(new) and new < cost:
            done = cost - new < 1e-12 * max(cost, 1e-12)
            x, r, cost, damp = x + move, trial, new, max(damp / 5, 1e-12)
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return x, cost


def fit_three(w: np.ndarray, t: np.ndarray, f: np.ndarray, w0: float, start: tuple | None = None) -> dict:
    """f0, gamma and a of the spectrum; bins without a failure are left out. Too few bins are an error text."""
    use = (f > 0) & (w >= w0)
    if use.sum() < 3:
        return {"f0": None, "gamma": None, "a": None, "cost": None, "points": int(use.sum()), "error": "fewer than three bins with failures"}
    w, rate = w[use].astype(float), f[use] / t[use]
    sigma = np.sqrt(np.maximum(1 - rate, 1e-6) / f[use])  # of ln rate

    def residual(x):
        f0, gamma, z = np.clip(x, (-60, -5, -30), (30, 4, 30))
        with np.errstate(over="ignore"):
            return (np.log(np.maximum(three_parameter(w, w0, np.exp(f0), np.exp(gamma), 1 / (1 + np.exp(-z))), 1e-300)) - np.log(rate)) / sigma

    grid = [start] if start else [(np.log(f0), np.log(g), 0.0) for f0 in (1e-4, 1e-2, 0.1) for g in (0.5, 2.0, 4.0)]
    x, cost = min((least_squares(residual, np.array(s)) for s in grid), key=lambda p: p[1])
    x = np.clip(x, (-60, -5, -30), (30, 4, 30))
    return {"f0": float(np.exp(x[0])), "gamma": float(np.exp(x[1])), "a": float(1 / (1 + np.exp(-x[2]))), "cost": cost / 2, "points": int(use.sum()), "error": None}


def fit_pinned(w: np.ndarray, t: np.ndarray, f: np.ndarray, w0: float, f0: float, a: float = 0.5) -> dict:
    """gamma with its standard error, where the onset's exact fraction f0 and the saturation a are known.

    Bins without a failure are left out, and those below the onset. Too few bins are an error text.
    """
    use = (f > 0) & (w > w0)
    if use.sum() < 2:
        return {"gamma": None, "gamma_se": None, "cost": None, "points": int(use.sum()), "error": "fewer than two bins with failures"}
    w, rate = w[use].astype(float), f[use] / t[use]
    sigma = np.sqrt(np.maximum(1 - rate, 1e-6) / f[use])

    def residual(x):
        return (np.log(np.maximum(three_parameter(w, w0, f0, np.exp(np.clip(x[0], -5, 4)), a), 1e-300)) - np.log(rate)) / sigma

    x, cost = min((least_squares(residual, np.array([np.log(g)])) for g in (0.5, 2.0, 4.0)), key=lambda p: p[1])
    slope = (residual(x + 1e-6) - residual(x - 1e-6)) / 2e-6
    gamma = float(np.exp(np.clip(x[0], -5, 4)))
    return {"gamma": gamma, "gamma_se": gamma / float(np.sqrt(max(slope @ slope, 1e-300))), "cost": cost / 2, "points": int(use.sum()), "error": None}


def errors_of(fit: dict, w: np.ndarray, t: np.ndarray, f: np.ndarray, w0: float, free: tuple[str, ...] = ("f0", "gamma", "a")) -> np.ndarray | None:
    """Covariance of the free parameters, (J'J)^-1 times the residual variance, over bins with failures from the onset on.

    J holds central differences of the weighted residuals of ln rate. None where no bin is left over to tell the variance
    from, or where the bins do not tell the parameters apart.
    """
    use = (f > 0) & (w >= w0)
    if use.sum() <= len(free):
        return None
    w, rate = w[use].astype(float), f[use] / t[use]
    sigma = np.sqrt(np.maximum(1 - rate, 1e-6) / f[use])
    at = {k: fit[k] for k in ("f0", "gamma", "a")}
    residual = lambda p: (np.log(np.maximum(three_parameter(w, w0, **p), 1e-300)) - np.log(rate)) / sigma
    steps = {k: 1e-5 * max(abs(at[k]), 1e-12) for k in free}
    j = np.stack([(residual(at | {k: at[k] + h}) - residual(at | {k: at[k] - h})) / (2 * h) for k, h in steps.items()], axis=1)
    size = np.linalg.norm(j, axis=0)
    if not np.isfinite(size).all() or (size == 0).any() or np.linalg.cond(j / size) > 1e7:
        return None
    r = residual(at)
    return np.linalg.inv((j / size).T @ (j / size)) / np.outer(size, size) * float(r @ r) / (len(r) - len(free))


def fit_with_errors(spec: DataFrame, by: list[str]) -> DataFrame:
    """by, w, t, f, w0, f0 -> by, f0, gamma, a, f0_se, gamma_se, a_se, cost, points, error: one fit for each group.

    A group with a pinned f0 fits gamma alone, with a = 1/2; one where f0 is null fits all three. Pinned parameters and
    those that the bins do not determine have no standard error; a group with too few bins has an error text and no
    parameters, as has one without an onset. w0 and f0 are the same in all rows of a group.
    """
    types = dict(spec.dtypes)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        w, t, f = (rows[c].to_numpy() for c in "wtf")
        w0, f0 = rows["w0"].iloc[0], rows["f0"].iloc[0]
        out = dict.fromkeys(("f0", "gamma", "a", "f0_se", "gamma_se", "a_se", "cost"))
        if pd.isna(w0):
            return pd.DataFrame([{**dict(zip(by, key)), **out, "points": 0, "error": "no onset"}])
        free = ("f0", "gamma", "a") if pd.isna(f0) else ("gamma",)
        got = fit_three(w, t, f, w0) if pd.isna(f0) else {"f0": float(f0), "a": 0.5} | fit_pinned(w, t, f, w0, float(f0))
        out |= {k: got.get(k) for k in out if k in got and k != "gamma_se"} if got["error"] is None else {}
        use = w > w0 if len(free) == 1 else w >= w0  # the onset's own bin says nothing of gamma
        cov = None if got["error"] else errors_of(out, w[use], t[use], f[use], w0, free)
        if cov is not None:
            out |= {f"{k}_se": float(np.sqrt(v)) for k, v in zip(free, np.diag(cov))}
        return pd.DataFrame([{**dict(zip(by, key)), **out, "points": got["points"], "error": got["error"]}])

    keys = ", ".join(f"{c} {types[c]}" for c in by)
    return spec.groupBy(*by).applyInPandas(run, f"{keys}, f0 double, gamma double, a double, f0_se double, gamma_se double, a_se double, cost double, points int, error string")


def fit_spectra(spec: DataFrame, by: str, w0: float) -> DataFrame:
    """by, w, t, f -> one fit for each group; groups are independent tasks of as many rows as they have weights."""
    kind = spec.schema[by].dataType.simpleString()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{by: key[0], **fit_three(rows.w.to_numpy(), rows.t.to_numpy(), rows.f.to_numpy(), w0)}])

    return spec.groupBy(by).applyInPandas(run, f"{by} {kind}, f0 double, gamma double, a double, cost double, points int, error string")


def bootstrap(spec: DataFrame, p: list[float], n: int, w0: float, draws: int, seed: int) -> DataFrame:
    """p, lo, mid, hi: percentiles of the extrapolated rate over binomial resamples of the failures, warm-started."""
    from math import lgamma

    w_all = np.arange(int(np.ceil(w0)), n + 1)
    log_c = np.array([lgamma(n + 1) - lgamma(w + 1) - lgamma(n - w + 1) for w in w_all])
    copies = spec.join(spec.sparkSession.range(draws).select(F.col("id").alias("draw")), F.lit(True))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("w")
        w, t, f = (rows[c].to_numpy() for c in "wtf")
        first = fit_three(w, t, f, w0)
        if first["error"]:
            return pd.DataFrame({"draw": [], "p": [], "ler": []})
        again = np.random.default_rng([seed, int(key[0])]).binomial(t, f / t)
        x = fit_three(w, t, again, w0, (np.log(first["f0"]), np.log(first["gamma"]), float(np.log(first["a"] / (1 - first["a"] + 1e-12)))))
        if x["error"]:
            return pd.DataFrame({"draw": [], "p": [], "ler": []})
        curve = three_parameter(w_all, w0, x["f0"], x["gamma"], x["a"])
        return pd.DataFrame({"draw": key[0], "p": p, "ler": [float((curve * np.exp(log_c + w_all * np.log(q) + (n - w_all) * np.log1p(-q))).sum()) for q in p]})

    fits = copies.groupBy("draw").applyInPandas(run, "draw long, p double, ler double")
    return fits.groupBy("p").agg(*(F.percentile("ler", F.lit(q)).alias(a) for q, a in ((0.05, "lo"), (0.5, "mid"), (0.95, "hi"))))
