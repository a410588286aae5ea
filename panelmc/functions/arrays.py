"""Arrays of doubles: align-by-name broadcast, reductions, masks, orderings, gathers. Places are counted from 1; what is out of range is 0."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Axes = Sequence[tuple[str, int]]
ZERO = "double"


def at(a: Column, i: Column | int) -> Column:
    """The element in place i (rounded), or 0."""
    i = i if isinstance(i, Column) else F.lit(i)
    return F.coalesce(F.get(a, F.round(i).cast("int") - 1), F.lit(0.0))


def _fold(a: Column, start: float, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(a, F.lit(float(start)), f)


def total(a: Column) -> Column:
    return _fold(a, 0.0, lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a)).otherwise(F.lit(0.0))


def low(a: Column) -> Column:
    return F.coalesce(F.array_min(a), F.lit(0.0))


def high(a: Column) -> Column:
    return F.coalesce(F.array_max(a), F.lit(0.0))


def argmin(a: Column) -> Column:
    """Place of the smallest, the first of equals; NaN never wins, 0 where the array is empty."""
    best = F.array_min(F.filter(a, lambda x: ~F.isnan(x)))
    return F.when(F.size(a) == 0, F.lit(0)).otherwise(F.coalesce(F.array_position(a, best), F.lit(1))).cast("double")


def argmax(a: Column) -> Column:
    best = F.array_max(F.filter(a, lambda x: ~F.isnan(x)))
    return F.when(F.size(a) == 0, F.lit(0)).otherwise(F.coalesce(F.array_position(a, best), F.lit(1))).cast("double")


def picked(a: Column, mask: Column) -> Column:
    """Elements whose mask is neither 0 nor NaN."""
    pairs = F.zip_with(F.slice(a, 1, F.least(F.size(a), F.size(mask))), F.slice(mask, 1, F.least(F.size(a), F.size(mask))), lambda x, m: F.struct(x.alias("x"), m.alias("m")))
    return F.transform(F.filter(pairs, lambda p: (p["m"] != 0) & ~F.isnan(p["m"])), lambda p: p["x"])


def _first_of(a: Column, mask: Column, sign: int) -> Column:
    n = F.least(F.size(a), F.size(mask))
    rows = F.transform(F.slice(a, 1, n), lambda x, i: F.struct((x * sign).alias("x"), (i + 1).alias("i"), F.get(mask, i).alias("m")))
    rows = F.filter(rows, lambda p: (p["m"] != 0) & ~F.isnan(p["m"]) & (p["x"] < float("inf")))
    return F.coalesce(F.array_min(rows)["i"], F.lit(0)).cast("double")


def argmin_where(a: Column, mask: Column) -> Column:
    """Place of the smallest element whose mask is neither 0 nor NaN, the first of equals; 0 where there is none."""
    return _first_of(a, mask, 1)


def argmax_where(a: Column, mask: Column) -> Column:
    return _first_of(a, mask, -1)


def dot(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return total(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y))


def interp(a: Column, place: Column) -> Column:
    """Between neighbours at a fractional place, held at the ends."""
    p = F.greatest(F.lit(1.0), F.least(place, F.size(a).cast("double")))
    i = F.floor(p)
    return at(a, i) + (p - i) * (at(a, F.least(i + 1, F.size(a))) - at(a, i))


def _placed(a: Column) -> Column:
    return F.array_sort(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))


def sort(a: Column) -> Column:
    return F.transform(_placed(a), lambda p: p["x"])


def sort_index(a: Column) -> Column:
    """Places in order of value, equal ones as they stand."""
    return F.transform(_placed(a), lambda p: (p["i"] + 1).cast("double"))


def rank(a: Column) -> Column:
    """Of each element its place in sorted order; equal ones in turn."""
    return sort_index(sort_index(a))


def cumulate(a: Column) -> Column:
    return F.transform(a, lambda x, i: total(F.slice(a, 1, i + 1)))


def cumproduct(a: Column) -> Column:
    return F.transform(a, lambda x, i: _fold(F.slice(a, 1, i + 1), 1.0, lambda s, y: s * y))


def gather(a: Column, places: Column) -> Column:
    return F.transform(places, lambda i: at(a, i))


def ordinal(a: Column) -> Column:
    return F.transform(a, lambda x, i: (i + 1).cast("double"))


def broadcast(f: Callable[[Column, Column], Column], a: Column, a_axes: Axes, b: Column, b_axes: Axes) -> tuple[Column, Axes]:
    """f over arrays with named axes (row-major): shared axes are aligned, at the shorter length, others make the outer product; axes are in
    order of their names. Where which element goes is settled when the plan is made."""
    sizes: dict[str, int] = {}
    for name, n in [*a_axes, *b_axes]:
        sizes[name] = min(n, sizes.get(name, n))
    out = sorted(sizes.items())

    def places(axes: Axes) -> Column:
        step, steps = 1, {}
        for name, n in reversed(axes):
            steps[name] = step
            step *= n
        cells: list[int] = [0]
        for name, n in out:
            cells = [c + i * steps.get(name, 0) for c in cells for i in range(n)]
        return F.array(*map(F.lit, cells)) if cells else F.array().cast("array<int>")

    return F.zip_with(places(a_axes), places(b_axes), lambda i, j: f(F.coalesce(F.get(a, i), F.lit(0.0)), F.coalesce(F.get(b, j), F.lit(0.0)))), out


def along(reduce: Callable[[Column], Column], a: Column, axes: Axes, axis: int) -> tuple[Column, Axes]:
    """Reduces one axis (counted from 1) of a row-major array."""
    n = axes[axis - 1][1]
    inner = 1
    for _, k in axes[axis:]:
        inner *= k
    outer = 1
    for _, k in axes[: axis - 1]:
        outer *= k
    cells = [reduce(F.array(*[F.coalesce(F.get(a, F.lit((o * n + k) * inner + i)), F.lit(0.0)) for k in range(n)])) for o in range(outer) for i in range(inner)]
    return F.array(*cells), [x for i, x in enumerate(axes, 1) if i != axis]


def subscript(a: Column, axes: Axes, axis: str, place: int) -> tuple[Column, Axes]:
    """The slice of one axis at a place; 0 throughout where there is none."""
    k = [x for x, _ in axes].index(axis) + 1
    return along(lambda xs: at(xs, place), a, axes, k)
