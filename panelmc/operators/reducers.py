"""Reducers over realizations: exact, by keys or over all rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmc.operators.ordered import ACCURACY, beside, pinned, reached

#: Bands of a time history.
BANDS = (5.0, 25.0, 50.0, 75.0, 95.0)


def guarded(x: Column) -> Column:
    """0 where there is nothing to reduce."""
    return F.coalesce(x, F.lit(0.0))


def summary(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, mean, std (of n - 1; 0 under two rows), low, high, total."""
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"), guarded(F.avg(v)).alias("mean"), guarded(F.stddev_samp(v)).alias("std"), guarded(F.min(v)).alias("low"), guarded(F.max(v)).alias("high"), guarded(F.sum(v)).alias("total")
    )


def percentiles(df: DataFrame, value: str, percents: Sequence[float] = BANDS, keys: Sequence[str] = ()) -> DataFrame:
    """p<percent> for each percent: the value in place round(p / 100 * (n - 1)), half up, of the sorted values."""
    targets = {f"p{p:g}".replace(".", "_"): F.floor(F.lit(p / 100) * (F.col("_all") - 1) + 0.5) + 1 for p in percents}
    near = sorted({min(1.0, max(0.0, p / 100 + d)) for p in percents for d in (-2 / ACCURACY, 2 / ACCURACY)})
    return reached(df, F.col(value).cast("double"), F.lit(1), targets, near, keys)


def tail_mean(df: DataFrame, value: str, percent: float, keys: Sequence[str] = (), name: str = "cte") -> DataFrame:
    """Mean of the values at and above a percentile."""
    at = percentiles(df, value, [percent], keys).toDF(*keys, "_at")
    rows = beside(df, pinned(at), keys) if keys else df.withColumn("_at", F.lit(at.first()[0]))
    return rows.where(F.col(value) >= F.col("_at")).groupBy(*keys).agg(guarded(F.avg(value)).alias(name))


def cumulative_prob(value: Column, at: float) -> Column:
    return guarded(F.avg(F.when(value <= at, 1.0).otherwise(0.0)))


def exceedance(value: Column, at: float) -> Column:
    return guarded(F.avg(F.when(value > at, 1.0).otherwise(0.0)))


def weighted(df: DataFrame, value: str, weight: str, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted mean and population deviation."""
    v, w = F.col(value).cast("double"), F.col(weight).cast("double")
    sums = df.groupBy(*keys).agg(F.sum(w).alias("_w"), F.sum(w * v).alias("_wv"), F.sum(w * v * v).alias("_wvv"), F.avg(v).alias("_m"))
    mean = F.when(F.col("_w") > 0, F.col("_wv") / F.col("_w")).otherwise(F.col("_m"))
    var = F.when(F.col("_w") > 0, F.greatest(F.lit(0.0), F.col("_wvv") / F.col("_w") - mean * mean)).otherwise(F.lit(0.0))
    return sums.select(*keys, mean.alias("weighted_mean"), F.sqrt(var).alias("weighted_std"))


def weighted_percentile(df: DataFrame, value: str, weight: str, percent: float, keys: Sequence[str] = (), name: str = "weighted_percentile") -> DataFrame:
    """The first value whose running weight reaches the percentage of all weight."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    # weight may lie anywhere among the places, so edges are even; two rounds leave one row in 170
    return reached(df, F.col(value), w, {name: F.col("_all") * (percent / 100) - 1e-12}, [i / 13 for i in range(1, 13)], keys, 2)


def shape(value: str) -> dict[str, Column]:
    """Population skewness and excess kurtosis; 0 without spread."""
    v = F.col(value).cast("double")
    flat = F.stddev_pop(v) > 0
    return {"skewness": F.when(flat, F.skewness(v)).otherwise(0.0), "excess_kurtosis": F.when(flat, F.kurtosis(v)).otherwise(0.0)}


def pair(x: str, y: str) -> dict[str, Column]:
    """Covariance (of n - 1), correlation and beta of y on x; 0 where a variance is."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    cov, va, vb = guarded(F.covar_samp(a, b)), guarded(F.var_samp(a)), guarded(F.var_samp(b))
    return {"covariance": cov, "correlation": F.when((va > 0) & (vb > 0), cov / F.sqrt(F.when((va > 0) & (vb > 0), va * vb))).otherwise(0.0), "beta": F.when(va > 0, cov / F.when(va > 0, va)).otherwise(0.0)}


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """n, means and covariances (of n - 1) of a few columns: one row of sums comes to the driver."""
    cs = [F.col(c).cast("double") for c in columns]
    k = len(cs)
    row = df.agg(F.count("*"), *[F.avg(c) for c in cs], *[F.covar_samp(cs[i], cs[j]) for i in range(k) for j in range(i, k)]).first()
    cov, it = np.zeros((k, k)), iter(row[1 + k :])
    for i in range(k):
        for j in range(i, k):
            cov[i, j] = cov[j, i] = next(it) or 0.0
    return row[0], np.array([m or 0.0 for m in row[1 : 1 + k]]), cov


def slopes(df: DataFrame, y: str, xs: Sequence[str]) -> list[float]:
    """Least-squares slopes of y on xs; all 0 if xs are dependent."""
    _, _, cov = moments(df, [*xs, y])
    a, b = cov[:-1, :-1], cov[:-1, -1]
    if abs(np.linalg.det(a)) < 1e-12:
        return [0.0] * len(xs)
    return np.linalg.solve(a, b).tolist()


def split_beta(df: DataFrame, x: str, y: str, fold: Column, folds: int) -> DataFrame:
    """Of each fold the beta of y on x over all other folds: sums by fold, then totals less the fold's own."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    own = df.groupBy(fold.alias("fold")).agg(F.count("*").alias("n"), F.sum(a).alias("x"), F.sum(b).alias("y"), F.sum(a * a).alias("xx"), F.sum(a * b).alias("xy"))
    # `folds` rows
    total = own.agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "x", "y", "xx", "xy")]).first()
    n, sx, sy, sxx, sxy = (F.lit(total[f"all_{c}"]) - F.col(c) for c in ("n", "x", "y", "xx", "xy"))
    return own.select("fold", F.when(sxx - sx * sx / n > 0, (sxy - sx * sy / n) / (sxx - sx * sx / n)).otherwise(0.0).alias("beta")).where(F.col("fold") < folds)


HISTOGRAM = "bin int, left double, right double, pdf double, cdf double, ccdf double"


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin, left, right, pdf, cdf, ccdf of equal-width bins; the last one holds its right end, and values without spread have a width of 1; without values there are no rows."""
    v = F.col(value).cast("double")
    lo, hi, n = df.agg(F.min(v), F.max(v), F.count(v)).first()
    if not n:
        return df.sparkSession.createDataFrame([], HISTOGRAM)
    width = (hi - lo) / bins if hi > lo else 1.0
    counts = {r.bin: r["count"] for r in df.where(v.isNotNull()).select(F.least(F.floor((v - lo) / width), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").count().collect()}
    rows, so_far = [], 0
    for i in range(bins):
        so_far += counts.get(i, 0)
        rows.append((i, lo + i * width, lo + (i + 1) * width, counts.get(i, 0) / (n * width), so_far / n, 1 - so_far / n))
    return df.sparkSession.createDataFrame(rows, HISTOGRAM)


def final_stats(df: DataFrame, value: str, keys: Sequence[str] = (), confidence: float = 0.95, cte: float = 95.0) -> DataFrame:
    """mean, std, half width and ends of the mean's confidence interval (normal), skewness, excess kurtosis and tail mean."""
    z = _normal_quantile(0.5 + confidence / 2)
    rows = df.groupBy(*keys).agg(F.count(value).alias("n"), guarded(F.avg(value)).alias("mean"), guarded(F.stddev_samp(value)).alias("std"), *[c.alias(k) for k, c in shape(value).items()])
    half = z * F.col("std") / F.sqrt(F.col("n"))
    tail = tail_mean(df, value, cte, keys)
    out = rows.join(tail, list(keys)) if keys else rows.withColumn("cte", F.lit(tail.first()[0]))
    return out.withColumn("ci_half_width", half).withColumn("ci_lower", F.col("mean") - half).withColumn("ci_upper", F.col("mean") + half)


def _normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def objective(values: Column, order: Column, how: str) -> Column:
    """One number of a run: mean, peak, valley, sum, first."""
    return {"mean": F.avg(values), "peak": F.max(values), "valley": F.min(values), "sum": F.sum(values), "first": F.min_by(values, order)}[how]


def effective_steps(period: float, dt: float) -> int:
    return max(1, math.floor(period / dt + 0.5))
