"""Sampling designs over realizations: strata, induced rank correlation, copulas, importance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmc.functions import rng
from panelmc.functions.dists import norm_ppf
from panelmc.operators.ordered import placed
from panelmc.operators.reducers import moments


def strata(df: DataFrame, seed: int, element: str, n: int, name: str) -> DataFrame:
    """df (column real, n rows) with a Latin hypercube uniform: one in each n-th of the unit interval, in an order that a hash gives."""
    rows = placed(df.withColumn("_o", rng.uniform(seed, element, slot=1)), "_o", ["real"], "_s")
    return rows.withColumn(name, (F.col("_s") + rng.uniform(seed, element, slot=2)) / n).drop("_o", "_s")


def cholesky(matrix: Sequence[Sequence[float]]) -> np.ndarray:
    """Lower factor of a correlation matrix that may be singular; one that isn't positive semi-definite is an error."""
    a = np.array(matrix, float)
    out = np.zeros_like(a)
    for i in range(len(a)):
        for j in range(i + 1):
            rest = a[i, j] - out[i, :j] @ out[j, :j]
            if i == j:
                if rest < -1e-10:
                    raise ValueError("the correlation matrix is not positive semi-definite")
                out[i, i] = np.sqrt(max(rest, 0.0))
            elif out[j, j] > 1e-12:
                out[i, j] = rest / out[j, j]
    return out


def copula(scores: Sequence[Column], matrix: Sequence[Sequence[float]]) -> list[Column]:
    """Correlated normal scores of independent ones."""
    low = cholesky(matrix)
    return [sum((scores[j] * float(low[i, j]) for j in range(i + 1)), F.lit(0.0)) for i in range(len(scores))]


def rank_correlated(df: DataFrame, columns: Sequence[str], matrix: Sequence[Sequence[float]], n: int, seed: int = 0) -> DataFrame:
    """Iman and Conover: df (real, columns; n rows) with the columns' values dealt anew, so that their ranks correlate as
    asked for and each keeps its values. Scores are shuffled by hash, made uncorrelated, correlated, and ranked; rank joins rank."""
    rows = df.select("real")
    for i in range(len(columns)):
        rows = placed(rows.withColumn("_o", rng.uniform(seed, f"ic{i}")), "_o", ["real"], "_r").withColumn(f"_m{i}", norm_ppf((F.col("_r") + 1) / F.lit(n + 1))).drop("_o", "_r")
    rows = rows.persist()
    names = [f"_m{i}" for i in range(len(columns))]
    _, _, cov = moments(rows, names)
    sd = np.sqrt(np.diag(cov))
    turn = np.linalg.solve(np.linalg.cholesky(cov / np.outer(sd, sd)).T, cholesky(matrix).T)
    mixed = rows.select("real", *[sum((F.col(names[j]) * float(turn[j, i]) for j in range(len(names))), F.lit(0.0)).alias(f"_t{i}") for i in range(len(names))]).persist()
    out = None
    for i, c in enumerate(columns):
        target = placed(mixed.select("real", f"_t{i}"), f"_t{i}", ["real"], "_p").select("real", "_p")
        own = placed(df.select(c, F.col("real").alias("_real")), c, ["_real"], "_p").select("_p", c)
        column = target.join(own, "_p").select("real", c)
        out = column if out is None else out.join(column, "real")
    return out


def importance(x: Column, target: Mapping[str, float], proposal: Mapping[str, float]) -> Column:
    """Weight of a normal draw from `proposal` for `target` (mean, sd)."""
    m, s, q, t = target["mean"], target["sd"], proposal["mean"], proposal["sd"]
    return (t / s) * F.exp(0.5 * F.pow((x - q) / t, F.lit(2.0)) - 0.5 * F.pow((x - m) / s, F.lit(2.0)))
