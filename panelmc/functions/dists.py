"""Distributions by inverse cumulative functions of a uniform column, and those without one by slots of uniforms.

Each family with an inverse is a Column function and, beside it, the same formula as DuckDB SQL (for the queries' twins).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Acklam's rational approximation of the normal quantile.
A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
LOW = 0.02425
TINY = 1e-12


def _poly(cs: Sequence[float], x: Column) -> Column:
    out = F.lit(cs[0])
    for c in cs[1:]:
        out = out * x + c
    return out


def _poly_sql(cs: Sequence[float], x: str) -> str:
    out = f"({cs[0]!r}::double)"
    for c in cs[1:]:
        out = f"({out} * {x} + ({c!r}::double))"
    return out


def norm_ppf(u: Column) -> Column:
    def tail(p: Column) -> Column:
        q = F.sqrt(-2.0 * F.log(p))
        return _poly(C, q) / (_poly(D, q) * q + 1.0)

    q = u - 0.5
    r = q * q
    return F.when(u < LOW, tail(u)).when(u > 1 - LOW, -tail(1.0 - u)).otherwise(_poly(A, r) * q / (_poly(B, r) * r + 1.0))


def norm_ppf_sql(u: str) -> str:
    def tail(p: str) -> str:
        q = f"sqrt(-2 * ln({p}))"
        return f"{_poly_sql(C, q)} / ({_poly_sql(D, q)} * {q} + 1)"

    q = f"({u} - 0.5)"
    r = f"({q} * {q})"
    return f"(case when {u} < {LOW} then {tail(u)} when {u} > {1 - LOW} then -({tail(f'(1 - {u})')}) else {_poly_sql(A, r)} * {q} / ({_poly_sql(B, r)} * {r} + 1) end)"


def norm_cdf(x: Column) -> Column:
    from panelmc.functions.numerics import erf

    return 0.5 * (1.0 + erf(x / math.sqrt(2)))


def norm_cdf_float(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


@dataclass(frozen=True)
class Family:
    """quantile: of a uniform column; twin: of a uniform SQL expression."""

    quantile: Callable[[Column], Column]
    twin: Callable[[str], str]


def _d(x: float) -> str:
    return f"({float(x)!r}::double)"


def uniform(low: float, high: float) -> Family:
    if not low < high:
        raise ValueError("uniform needs min < max")
    return Family(lambda u: low + (high - low) * u, lambda u: f"({_d(low)} + {_d(high - low)} * {u})")


def normal(mean: float, sd: float) -> Family:
    return Family(lambda u: mean + sd * norm_ppf(u), lambda u: f"({_d(mean)} + {_d(sd)} * {norm_ppf_sql(u)})")


def lognormal(mu: float, sigma: float) -> Family:
    """Of the logarithm's mean and deviation."""
    return Family(lambda u: F.exp(mu + sigma * norm_ppf(u)), lambda u: f"exp({_d(mu)} + {_d(sigma)} * {norm_ppf_sql(u)})")


def lognormal_moments(mean: float, sd: float) -> Family:
    s2 = math.log(1 + (sd / mean) ** 2)
    return lognormal(math.log(mean) - s2 / 2, math.sqrt(s2))


def triangular(low: float, mode: float, high: float) -> Family:
    c = (mode - low) / (high - low)
    up, down = (high - low) * (mode - low), (high - low) * (high - mode)
    return Family(
        lambda u: F.when(u < c, low + F.sqrt(u * up)).otherwise(high - F.sqrt((1 - u) * down)),
        lambda u: f"(case when {u} < {_d(c)} then {_d(low)} + sqrt({u} * {_d(up)}) else {_d(high)} - sqrt((1 - {u}) * {_d(down)}) end)",
    )


def trapezoidal(low: float, lower: float, upper: float, high: float) -> Family:
    h = 2 / (high + upper - lower - low)
    a, b = h * (lower - low) / 2, h * (lower - low) / 2 + h * (upper - lower)
    return Family(
        lambda u: F.when(u < a, low + F.sqrt(2 * (lower - low) / h * u)).when(u < b, lower + (u - a) / h).otherwise(high - F.sqrt(2 * (high - upper) / h * (1 - u))),
        lambda u: f"(case when {u} < {_d(a)} then {_d(low)} + sqrt({_d(2 * (lower - low) / h)} * {u}) when {u} < {_d(b)} then {_d(lower)} + ({u} - {_d(a)}) / {_d(h)} else {_d(high)} - sqrt({_d(2 * (high - upper) / h)} * (1 - {u})) end)",
    )


def exponential(mean: float) -> Family:
    return Family(lambda u: -mean * F.log(1 - u), lambda u: f"(-{_d(mean)} * ln(1 - {u}))")


def weibull(shape: float, scale: float) -> Family:
    return Family(lambda u: scale * F.pow(-F.log(1 - u), F.lit(1 / shape)), lambda u: f"({_d(scale)} * pow(-ln(1 - {u}), {_d(1 / shape)}))")


def discrete_uniform(low: int, high: int) -> Family:
    n = high - low + 1
    return Family(lambda u: F.least(low + F.floor(u * n), F.lit(high)).cast("double"), lambda u: f"least({low} + floor({u} * {n}), {high})::double")


def bernoulli(p: float) -> Family:
    return Family(lambda u: F.when(u < p, F.lit(1.0)).otherwise(F.lit(0.0)), lambda u: f"(case when {u} < {_d(p)} then 1 else 0 end)::double")


def discrete(values: Sequence[float], weights: Sequence[float]) -> Family:
    total = sum(weights)
    ends = [sum(weights[: i + 1]) / total for i in range(len(weights))]

    def quantile(u: Column) -> Column:
        out = F.lit(float(values[-1]))
        for v, e in reversed(list(zip(values[:-1], ends[:-1], strict=True))):
            out = F.when(u <= e, F.lit(float(v))).otherwise(out)
        return out

    return Family(quantile, lambda u: "(case " + " ".join(f"when {u} <= {_d(e)} then {_d(v)}" for v, e in zip(values[:-1], ends[:-1], strict=True)) + f" else {_d(values[-1])} end)")


def pareto(shape: float, scale: float, location: float = 0.0) -> Family:
    return Family(
        lambda u: location + scale / F.pow(1 - F.greatest(F.lit(TINY), F.least(F.lit(1 - TINY), u)), F.lit(1 / shape)),
        lambda u: f"({_d(location)} + {_d(scale)} / pow(1 - greatest({_d(TINY)}, least({_d(1 - TINY)}, {u})), {_d(1 / shape)}))",
    )


def extreme_value(location: float, scale: float) -> Family:
    return Family(lambda u: location - scale * F.log(-F.log(u)), lambda u: f"({_d(location)} - {_d(scale)} * ln(-ln({u})))")


def cumulative(points: Sequence[tuple[float, float]]) -> Family:
    """Piecewise linear through (value, chance), in order of chance; constant beyond the ends."""
    pts = sorted(((p, v) for v, p in points))

    def pieces():
        for (p0, v0), (p1, v1) in zip(pts, pts[1:], strict=False):
            if p1 > p0:
                yield p0, v0, p1, (v1 - v0) / (p1 - p0)

    def quantile(u: Column) -> Column:
        out = F.lit(float(pts[-1][1]))
        for p0, v0, p1, k in reversed(list(pieces())):
            out = F.when(u < p1, v0 + (u - p0) * k).otherwise(out)
        return F.when(u <= pts[0][0], F.lit(float(pts[0][1]))).otherwise(out)

    return Family(quantile, lambda u: f"(case when {u} <= {_d(pts[0][0])} then {_d(pts[0][1])} " + " ".join(f"when {u} < {_d(p1)} then {_d(v0)} + ({u} - {_d(p0)}) * {_d(k)}" for p0, v0, p1, k in pieces()) + f" else {_d(pts[-1][1])} end)")


def sampled(values: Sequence[float]) -> Family:
    n = len(values)
    return Family(
        lambda u: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.least(F.floor(u * n), F.lit(n - 1)).cast("int") + 1),
        lambda u: f"([{', '.join(_d(v) for v in values)}])[least(floor({u} * {n}), {n - 1})::int + 1]",
    )


def exp_of(base: Family) -> Family:
    """The exponential of a family: the logarithmic variants."""
    return Family(lambda u: F.exp(base.quantile(u)), lambda u: f"exp({base.twin(u)})")


def log_uniform(low: float, high: float) -> Family:
    return exp_of(uniform(math.log(low), math.log(high)))


def log_triangular(low: float, mode: float, high: float) -> Family:
    return exp_of(triangular(math.log(low), math.log(mode), math.log(high)))


def log_cumulative(points: Sequence[tuple[float, float]]) -> Family:
    return exp_of(cumulative([(math.log(v), p) for v, p in points]))


def triangular1090(p10: float, mode: float, p90: float) -> Family:
    """Triangular of its 10th and 90th percentiles: both ends by bisection in turn."""

    def quantile(a: float, c: float, u: float) -> float:
        k = (mode - a) / (c - a)
        return a + math.sqrt(u * (c - a) * (mode - a)) if u < k else c - math.sqrt((1 - u) * (c - a) * (c - mode))

    low, high = p10, p90
    span = p90 - p10
    for _ in range(60):
        near, far = p10 - 10 * span, p10
        for _ in range(60):
            mid = (near + far) / 2
            near, far = (mid, far) if quantile(mid, high, 0.1) < p10 else (near, mid)
        low = (near + far) / 2
        near, far = p90, p90 + 10 * span
        for _ in range(60):
            mid = (near + far) / 2
            near, far = (mid, far) if quantile(low, mid, 0.9) < p90 else (near, mid)
        high = (near + far) / 2
    return triangular(low, mode, high)


def extreme_probability(base: Family, n: float, largest: bool = True) -> Family:
    """Of the largest (or smallest) of n draws of base."""
    if largest:
        return Family(lambda u: base.quantile(F.pow(u, F.lit(1 / n))), lambda u: base.twin(f"pow({u}, {_d(1 / n)})"))
    return Family(lambda u: base.quantile(1 - F.pow(1 - u, F.lit(1 / n))), lambda u: base.twin(f"(1 - pow(1 - {u}, {_d(1 / n)}))"))


def truncated_normal(mean: float, sd: float, low: float, high: float) -> Family:
    """By scaling the uniform into the chances of both bounds."""
    a, b = norm_cdf_float((low - mean) / sd), norm_cdf_float((high - mean) / sd)
    base = normal(mean, sd)
    return Family(lambda u: base.quantile(a + u * (b - a)), lambda u: base.twin(f"({_d(a)} + {u} * {_d(b - a)})"))


# families without an inverse: whole batches in numpy, from uniforms that are counted off a hash of the row's key


def _counter(key: np.ndarray, slot: int) -> np.ndarray:
    x = key.astype(np.uint64) + np.uint64((slot + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53 + 2.0**-54


def _normals(key: np.ndarray, slot: int) -> np.ndarray:
    return np.sqrt(-2 * np.log(_counter(key, 2 * slot))) * np.cos(2 * np.pi * _counter(key, 2 * slot + 1))


def _gammas(key: np.ndarray, shape: float, base: int = 0) -> np.ndarray:
    """Marsaglia and Tsang's method; a row that is refused goes on to its next slots."""
    d = (shape if shape >= 1 else shape + 1) - 1 / 3
    c = 1 / math.sqrt(9 * d)
    out, left = np.empty(len(key)), np.arange(len(key))
    slot = base
    while len(left):
        x, u = _normals(key[left], 3 * slot), _counter(key[left], 6 * slot + 4)
        v = (1 + c * x) ** 3
        ok = (v > 0) & (np.log(u) < 0.5 * x * x + d - d * v + d * np.log(np.maximum(v, 1e-300)))
        out[left[ok]] = d * v[ok]
        left = left[~ok]
        slot += 1
    return out if shape >= 1 else out * _counter(key, 6 * base + 5) ** (1 / shape)


#: Largest rate that is inverted at once; exp(-rate) must be far from the smallest float.
POISSON_RATE = 500


def _inverted(u: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Poisson draws of rates up to POISSON_RATE, all rows a step at a time; a row ends at the latest where its sum of chances no longer grows."""
    out, chance = np.zeros(len(u)), np.exp(-rate)
    total, k = chance.copy(), 0
    left = np.flatnonzero(u > total)
    while len(left):
        k += 1
        chance[left] *= rate[left] / k
        more = total[left] + chance[left]
        grows = (more > total[left]) | (k < rate[left])
        total[left], out[left] = more, k
        left = left[(u[left] > more) & grows]
    return out


def _poissons(key: np.ndarray, slot: int, rate: np.ndarray) -> np.ndarray:
    """By inversion; a rate above POISSON_RATE is a sum of draws of equal, bounded rates, each of its own slot from `slot` on. An infinite rate's draw is infinite."""
    out = np.where(np.isfinite(rate), 0.0, rate)
    pieces = np.where(np.isfinite(rate), np.maximum(np.ceil(rate / POISSON_RATE), 1), 0)
    left, i = np.flatnonzero(pieces > 0), 0
    while len(left):
        out[left] += _inverted(_counter(key[left], slot + i), rate[left] / pieces[left])
        i += 1
        left = left[pieces[left] > i]
    return out


def _student(k: np.ndarray, df: float, location: float = 0.0, scale: float = 1.0) -> np.ndarray:
    return location + scale * _normals(k, 5000) / np.sqrt(2 * _gammas(k, df / 2) / df)


def _pearson3(k: np.ndarray, mean: float, sd: float, skew: float) -> np.ndarray:
    if abs(skew) < 1e-12:
        return mean + sd * _normals(k, 5000)
    a, b = (2 / skew) ** 2, sd * skew / 2
    return mean - a * b + b * _gammas(k, a)


def _betas(k: np.ndarray, a: float, b: float, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    x, y = _gammas(k, a), _gammas(k, b, 1000)
    return low + (high - low) * x / (x + y)


#: Families without an inverse: name to draws from a batch of keys and parameters.
SLOTTED: dict[str, Callable[..., np.ndarray]] = {
    "gamma": lambda k, shape, scale: scale * _gammas(k, shape),
    "beta": _betas,
    "beta_success_failure": lambda k, s, f: _betas(k, s + 1, f + 1),
    "pert": lambda k, a, m, b: _betas(k, 1 + 4 * (m - a) / (b - a), 1 + 4 * (b - m) / (b - a), a, b),
    "pearson_v": lambda k, shape, scale: scale / _gammas(k, shape),
    "pearson_iii": _pearson3,
    "student_t": _student,
    "poisson": lambda k, rate: _poissons(k, 0, np.full(len(k), float(rate))),
    "negative_binomial": lambda k, r, p: _poissons(k, 9999, _gammas(k, r) * (1 - p) / p),
    "binomial": lambda k, n, p: sum(((_counter(k, i) < p).astype(float) for i in range(round(n))), np.zeros(len(k))),
}


def slotted(family: str, *params: float, seed: int, element: str, real: str = "real", step: int = 0) -> Column:
    """A draw of a family in SLOTTED for each row, by its key alone."""
    draw = SLOTTED[family]

    @F.pandas_udf("double")
    def run(key: pd.Series) -> pd.Series:
        return pd.Series(draw(key.to_numpy().astype(np.int64).view(np.uint64), *params))

    return run(F.xxhash64(F.lit(seed), F.lit(element), F.col(real).cast("long"), F.lit(step)))
