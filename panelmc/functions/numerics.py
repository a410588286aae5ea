"""IEEE arithmetic on DOUBLE columns: what Spark makes an error or NULL of is inf or NaN here, and truth values are 1.0 and 0.0."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16
NAN, INF = float("nan"), float("inf")


def num(x: Column | float | str) -> Column:
    """A DOUBLE column of a column, a column's name or a number."""
    if isinstance(x, str):
        x = F.col(x)
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("double")


def flag(test: Column) -> Column:
    return F.when(test, F.lit(1.0)).otherwise(F.lit(0.0))


def truth(x: Column) -> Column:
    """Anything but zero is true, NaN too."""
    return x != 0.0


def ieee_div(a: Column, b: Column) -> Column:
    zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(zero)


def fmod(a: Column, b: Column) -> Column:
    """Remainder with the sign of a."""
    return F.when((b != 0) & ~F.isnan(b), a % F.when(b != 0, b)).otherwise(F.lit(NAN))


def _log(f, x: Column) -> Column:
    return F.when(F.isnan(x), x).when(x > 0, f(F.when(x > 0, x))).when(x == 0, F.lit(-INF)).otherwise(F.lit(NAN))


def ln(x: Column) -> Column:
    return _log(F.log, x)


def log10(x: Column) -> Column:
    return _log(F.log10, x)


def log2(x: Column) -> Column:
    return _log(F.log2, x)


def _ordered(test: Column, a: Column, b: Column) -> Column:
    return flag(test & ~F.isnan(a) & ~F.isnan(b))


def lt(a: Column, b: Column) -> Column:
    return _ordered(a < b, a, b)


def gt(a: Column, b: Column) -> Column:
    return _ordered(a > b, a, b)


def lte(a: Column, b: Column) -> Column:
    return _ordered(a <= b, a, b)


def gte(a: Column, b: Column) -> Column:
    return _ordered(a >= b, a, b)


def eq(a: Column, b: Column) -> Column:
    return _ordered(F.abs(a - b) < EPSILON, a, b)


def neq(a: Column, b: Column) -> Column:
    return _ordered(F.abs(a - b) >= EPSILON, a, b)


def nan_max(*xs: Column) -> Column:
    """The largest; NaN only if all are."""
    return F.coalesce(F.greatest(*[F.when(~F.isnan(x), x) for x in xs]), F.lit(NAN)) if len(xs) > 1 else xs[0]


def nan_min(*xs: Column) -> Column:
    return F.coalesce(F.least(*[F.when(~F.isnan(x), x) for x in xs]), F.lit(NAN)) if len(xs) > 1 else xs[0]


def whole(f, x: Column) -> Column:
    """floor or ceil that stays DOUBLE; beyond 2**53 every value is whole already."""
    return F.when(F.abs(x) < 2.0**53, f(x).cast("double")).otherwise(x)


def trunc(x: Column) -> Column:
    return F.when(x >= 0, whole(F.floor, x)).otherwise(whole(F.ceil, x))


def round_away(x: Column, digits: int = 0) -> Column:
    """Half away from zero, after scaling by a power of ten."""
    scale = 10.0**digits
    y = x * scale
    return F.when(y >= 0, whole(F.floor, y + 0.5)).otherwise(whole(F.ceil, y - 0.5)) / scale


def sign(x: Column) -> Column:
    """1 for zero and above, NaN for NaN."""
    return F.when(F.isnan(x), x).when(x >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def step(x: Column) -> Column:
    return flag((x >= 0) & ~F.isnan(x))


#: The coefficients of Abramowitz and Stegun 7.1.26.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
#: Lanczos's approximation, g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def erf(x: Column) -> Column:
    a = F.abs(x)
    t = 1.0 / (1.0 + 0.3275911 * a)
    poly = F.lit(0.0)
    for c in reversed(ERF):
        poly = (poly + c) * t
    return sign(x) * (1.0 - poly * F.exp(-a * a))


def erfc(x: Column) -> Column:
    return 1.0 - erf(x)


def gamma(x: Column) -> Column:
    """Gamma function; below one half by reflection."""

    def upper(z: Column) -> Column:
        z = z - 1.0
        s = F.lit(LANCZOS[0])
        for i, c in enumerate(LANCZOS[1:], 1):
            s = s + c / (z + float(i))
        t = z + 7.5
        return math.sqrt(2 * math.pi) * F.pow(t, z + 0.5) * F.exp(-t) * s

    return F.when(x < 0.5, ieee_div(F.lit(math.pi), F.sin(F.lit(math.pi) * x) * upper(1.0 - x))).otherwise(upper(x))


def pv_factor(r: Column, n: Column) -> Column:
    return F.pow(1.0 + r, n)


def annuity_factor(r: Column, n: Column) -> Column:
    """(1 - (1 + r) ** -n) / r, and n where r is zero."""
    return F.when(r == 0, n).otherwise(ieee_div(1.0 - F.pow(1.0 + r, -n), r))
