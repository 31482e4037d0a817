"""Histograms, divergences, drift severity, out-of-distribution scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..config import DEFAULT, Drift


def histogram(df: DataFrame, by: list[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """by, bin, n, p: values clipped to the bounds, equal widths, last bin closed; every bin is there for every group."""
    width = (hi - lo if hi > lo else 1.0) / bins
    x = F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(value)))
    counts = df.groupBy(*by, F.least(F.floor((x - lo) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    spine = totals.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return spine.join(counts, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("p"))


def kl(p: Column, q: Column, eps: float = DEFAULT.drift.epsilon) -> Column:
    """Sum over bins of p ln(p / q); bins with p of eps or less don't count, q is at least eps, the sum at least 0."""
    return F.greatest(F.lit(0.0), F.sum(F.when(p > eps, p * F.log(p / F.greatest(q, F.lit(eps)))).otherwise(0.0)))


def psi(e: Column, a: Column, eps: float = DEFAULT.drift.epsilon) -> Column:
    x, y = F.greatest(e, F.lit(eps)), F.greatest(a, F.lit(eps))
    return F.sum((y - x) * F.log(y / x))


def severity(k: Column, s: Column, d: Drift = DEFAULT.drift) -> Column:
    return F.when((k >= d.kl[1]) | (s >= d.psi[1]), "critical").when((k >= d.kl[0]) | (s >= d.psi[0]), "warning").otherwise("none")


def statistics(value: str) -> dict[str, Column]:
    q = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    return {"mean": F.avg(value), "std": F.stddev_pop(value), "lo": F.min(value), "hi": F.max(value)} | {k: F.percentile(value, v) for k, v in q.items()}


def moments(df: DataFrame, vector: str, dim: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and covariance (population) of vectors, by one aggregation of dim * (dim + 1) / 2 sums."""
    pairs = [(i, j) for i in range(dim) for j in range(i, dim)]
    x = [F.col(vector)[i].cast("double") for i in range(dim)]
    row = df.agg(F.count("*"), *(F.sum(c) for c in x), *(F.sum(x[i] * x[j]) for i, j in pairs)).first()
    n, mean = row[0], np.array(row[1 : dim + 1]) / row[0]
    cov = np.zeros((dim, dim))
    for (i, j), s in zip(pairs, row[dim + 1 :], strict=True):
        cov[i, j] = cov[j, i] = s / n - mean[i] * mean[j]
    return mean, cov, n


def shrunk_precision(df: DataFrame, vector: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and inverse of the covariance, shrunk towards a multiple of the identity by the estimator of Ledoit and Wolf (2004)."""
    mean, cov, n = moments(df, vector, dim)
    mu = np.trace(cov) / dim
    x = F.transform(F.arrays_zip(F.col(vector).alias("x"), F.lit(mean.tolist()).cast("array<double>").alias("m")), lambda p: p["x"].cast("double") - p["m"])
    fourth = df.select(F.aggregate(x, F.lit(0.0), lambda a, c: a + c * c).alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0] / n
    spread = ((cov - mu * np.eye(dim)) ** 2).sum()
    noise = min(max(fourth - (cov**2).sum(), 0.0) / n, spread)
    share = noise / spread if spread > 0 else 0.0
    return mean, np.linalg.inv((1 - share) * cov + share * mu * np.eye(dim))


def mahalanobis(vector: Column, mean: np.ndarray, precision: np.ndarray) -> Column:
    """Distance of a vector; the precision's factor is a literal of dim * dim numbers."""
    half = np.linalg.cholesky(precision).T
    d = F.zip_with(vector.cast("array<double>"), F.lit(mean.tolist()).cast("array<double>"), lambda x, m: x - m)
    rows = F.array(*(F.lit(r.tolist()).cast("array<double>") for r in half))
    dots = F.transform(rows, lambda r: F.aggregate(F.zip_with(r, d, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))
    return F.sqrt(F.aggregate(dots, F.lit(0.0), lambda a, x: a + x * x))


def diagonal(vector: Column, mean: Sequence[float], variance: Sequence[float]) -> Column:
    """Distance of a vector by the variances alone, over the components that it has; null without any. The sum goes over arrays, so the expression has a fixed size."""
    m, v = (F.lit([float(c) for c in x]).cast("array<double>") for x in (mean, variance))
    d = F.zip_with(vector.cast("array<double>"), m, lambda x, c: x - c)
    terms = F.filter(F.zip_with(d, v, lambda x, c: x * x / c), lambda t: t.isNotNull())
    return F.when(F.size(terms) > 0, F.sqrt(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def score_trend(score: Column, by: WindowSpec, window: int = 3, threshold: float = 2.0) -> Column:
    """How the score of each row stands to the first of the last `window` ones; by: partition and order of a history."""
    near = by.rowsBetween(1 - window, 0)
    delta = score - F.first(score).over(near)
    return F.when(F.count(score).over(near) < 2, "insufficient_data").when(delta > threshold, "improving").when(delta < -threshold, "degrading").otherwise("stable")
