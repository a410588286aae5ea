"""Lookup tables as column expressions: knots are part of the plan."""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Table:
    """Knots in order of x. mode: linear, step, cubic (monotone) or log (linear in ln y, if all y are positive); beyond: clamp or linear."""

    x: Sequence[float]
    y: Sequence[float]
    mode: str = "linear"
    beyond: str = "clamp"

    def _pieces(self, at: Column, pieces: Sequence[Column], first: Column, last: Column) -> Column:
        """pieces[i] between knots i and i + 1, by halving: a plan as deep as the logarithm of the knots."""

        def half(lo: int, hi: int) -> Column:
            if hi - lo == 1:
                return pieces[lo]
            mid = (lo + hi) // 2
            return F.when(at < float(self.x[mid]), half(lo, mid)).otherwise(half(mid, hi))

        inside = half(0, len(self.x) - 1) if len(self.x) > 1 else first
        return F.when(at < float(self.x[0]), first).when(at >= float(self.x[-1]), last).otherwise(inside)

    def slopes(self) -> list[float]:
        return [(b - a) / (v - u) for a, b, u, v in zip(self.y, self.y[1:], self.x, self.x[1:], strict=False)]

    def __call__(self, at: Column) -> Column:
        x, y = list(map(float, self.x)), list(map(float, self.y))
        if self.mode == "log" and min(y) > 0:
            return F.exp(Table(x, [math.log(v) for v in y], "linear", self.beyond)(at))
        k = self.slopes()
        if self.mode == "step":
            pieces = [F.lit(v) for v in y[:-1]]
        elif self.mode == "cubic":
            pieces = self._cubic(at, k)
        else:
            pieces = [y[i] + (at - x[i]) * k[i] for i in range(len(k))]
        first, last = F.lit(y[0]), F.lit(y[-1])
        if self.beyond == "linear" and k:
            first, last = y[0] + (at - x[0]) * k[0], y[-1] + (at - x[-1]) * k[-1]
        return self._pieces(at, pieces, first, last)

    def tangents(self) -> list[float]:
        """Fritsch and Carlson's, which keep each piece monotone."""
        k = self.slopes()
        m = [k[0], *[(a + b) / 2 if a * b > 0 else 0.0 for a, b in zip(k, k[1:], strict=False)], k[-1]]
        for i, s in enumerate(k):
            if s == 0:
                m[i] = m[i + 1] = 0.0
                continue
            a, b = m[i] / s, m[i + 1] / s
            if a * a + b * b > 9:
                t = 3 / math.sqrt(a * a + b * b)
                m[i], m[i + 1] = t * a * s, t * b * s
        return m

    def _cubic(self, at: Column, k: list[float]) -> list[Column]:
        m, out = self.tangents(), []
        for i in range(len(k)):
            h = float(self.x[i + 1] - self.x[i])
            t = (at - float(self.x[i])) / h
            y0, y1 = float(self.y[i]), float(self.y[i + 1])
            out.append(y0 * (1 + 2 * t) * (1 - t) * (1 - t) + h * m[i] * t * (1 - t) * (1 - t) + y1 * t * t * (3 - 2 * t) + h * m[i + 1] * t * t * (t - 1))
        return out

    def integral(self, at: Column) -> Column:
        """From the first knot to `at` (held within the knots), by trapezoids."""
        x, y, k = self.x, self.y, self.slopes()
        area = [0.0]
        for i in range(len(k)):
            area.append(area[-1] + (y[i] + y[i + 1]) / 2 * (x[i + 1] - x[i]))
        pieces = [area[i] + (at - float(x[i])) * (float(y[i]) + (at - float(x[i])) * (k[i] / 2)) for i in range(len(k))]
        return self._pieces(at, pieces, F.lit(0.0), F.lit(area[-1]))

    def inverse(self, at: Column) -> Column:
        """x of a value, linear; descending tables are turned round."""
        x, y = (self.x, self.y) if self.y[0] <= self.y[-1] else (self.x[::-1], self.y[::-1])
        return Table(y, x)(at)

    def derivative(self, at: Column) -> Column:
        """The slope of the piece, the nearest piece's beyond the ends; 0 for steps."""
        k = [0.0] * (len(self.x) - 1) if self.mode == "step" else self.slopes()
        return self._pieces(at, [F.lit(s) for s in k], F.lit(k[0]), F.lit(k[-1]))

    def inverse_integral(self, area: Column) -> Column:
        """x at which the integral reaches an area, by each piece's quadratic."""
        x, y, k = self.x, self.y, self.slopes()
        ends = [0.0]
        for i in range(len(k)):
            ends.append(ends[-1] + (y[i] + y[i + 1]) / 2 * (x[i + 1] - x[i]))
        pieces = []
        for i in range(len(k)):
            rest = area - ends[i]
            if abs(k[i]) < 1e-12:
                pieces.append(float(x[i]) + (rest / float(y[i]) if y[i] else F.lit(0.0)))
            else:
                pieces.append(float(x[i]) + (F.sqrt(F.greatest(F.lit(0.0), float(y[i]) ** 2 + 2 * k[i] * rest)) - float(y[i])) / k[i])
        return Table(ends, list(x))._pieces(area, pieces, F.lit(float(x[0])), F.lit(float(x[-1])))

    def value(self, at: float) -> float:
        """Of a number, linear and clamped."""
        i = bisect.bisect_right(self.x, at) - 1
        if i < 0 or i >= len(self.x) - 1:
            return self.y[0] if i < 0 else self.y[-1]
        return self.y[i] + (at - self.x[i]) * self.slopes()[i]


def bilinear(xs: Sequence[float], ys: Sequence[float], z: Sequence[Sequence[float]], x: Column, y: Column) -> Column:
    """z[i][j] at knots xs[i], ys[j]; between them linear in either direction, held at the edges."""
    rows = [Table(ys, row)(y) for row in z]
    at = F.greatest(F.lit(float(xs[0])), F.least(F.lit(float(xs[-1])), x))
    pieces = [rows[i] + (at - float(xs[i])) * (rows[i + 1] - rows[i]) / float(xs[i + 1] - xs[i]) for i in range(len(xs) - 1)]
    return Table(xs, xs)._pieces(at, pieces, rows[0], rows[-1])
