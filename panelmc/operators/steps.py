"""Rules over steps as window expressions: one sort a realization, no state in Python."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Steps:
    """A realization's keys and the order of its steps."""

    keys: Sequence[str]
    order: Sequence[str]

    @property
    def window(self):
        return W.partitionBy(*self.keys).orderBy(*self.order)

    def rows(self, before: int | None):
        return self.window.rowsBetween(W.unboundedPreceding if before is None else -before, 0)

    def number(self) -> Column:
        return F.row_number().over(self.window) - 1

    def lag(self, x: Column, initial: float = 0.0) -> Column:
        return F.lag(x, 1, initial).over(self.window)

    def changed(self, x: Column) -> Column:
        """1 where x isn't what it was the step before; 0 at first."""
        was = F.lag(x, 1).over(self.window)
        return F.when(was.isNotNull() & (was != x), 1.0).otherwise(0.0)

    def rolling(self, how: str, x: Column, width: int = 0) -> Column:
        """mean, min, max or sum over the last `width` steps, this one included (all so far for 0)."""
        return {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}[how](x).over(self.rows(width - 1 if width else None))

    def stock(self, initial: float, rate: Column, dt: float = 1.0) -> Column:
        """Level after the step of a stock whose rate doesn't read its own level."""
        return initial + F.sum(rate * dt).over(self.rows(None))

    def compound(self, initial: float, growth: Column, dt: float = 1.0) -> Column:
        """initial grown by (1 + growth * dt) at each step; growth above -1 / dt."""
        return initial * F.exp(F.sum(F.log(1 + growth * dt)).over(self.rows(None)))

    def milestone(self, fires: Column, elapsed: Column) -> Column:
        """When it first fired, NaN before."""
        return F.coalesce(F.min(F.when(fires, elapsed)).over(self.rows(None)), F.lit(float("nan")))

    def status(self, on: Column, off: Column) -> Column:
        """1 from a step that sets until one that resets; setting wins; 0 at first."""
        return F.coalesce(F.last(F.when(on, 1.0).when(off, 0.0), ignorenulls=True).over(self.rows(None)), F.lit(0.0))

    def hysteresis(self, x: Column, low: float, high: float) -> Column:
        """1 from `high` up, 0 from `low` down, between them as it was."""
        return F.coalesce(F.last(F.when(x >= high, 1.0).when(x <= low, 0.0), ignorenulls=True).over(self.rows(None)), F.lit(0.0))

    def held(self, draw: Column, fires: Column) -> Column:
        """The draw of the last step that fired; the first step's until then."""
        return F.last(F.when(fires | (self.number() == 0), draw), ignorenulls=True).over(self.rows(None))

    def convolution(self, x: Column, weights: Sequence[float]) -> Column:
        """Newest first: weights[0] times this step's x, weights[1] times the last one's, and so on."""
        return sum((F.coalesce(F.lag(x, i).over(self.window), F.lit(0.0)) * w if i else x * w for i, w in enumerate(weights)), F.lit(0.0))

    def delayed(self, x: Column, steps: int, decay: float = 0.0) -> Column:
        """What comes out of a transit of so many steps; 0 until then."""
        from math import exp

        return F.coalesce(F.lag(x, steps).over(self.window), F.lit(0.0)) * exp(-decay * steps)

    def periodic(self, every: int) -> Column:
        """Fires at multiples of a period, not at first."""
        return (self.number() > 0) & (self.number() % every == 0)

    def on_schedule(self, at: Sequence[int]) -> Column:
        return self.number().isin(*at)


def at_least(votes: int, *inputs: Column) -> Column:
    """k of n: 1 if as many inputs are above zero."""
    return F.when(sum((F.when(x > 0, 1).otherwise(0) for x in inputs), F.lit(0)) >= votes, 1.0).otherwise(0.0)


def allocation(request: Column, available: Column, keys: Sequence[str], priority: Sequence[str]) -> Column:
    """What each request gets of what is available to its keys, in order of priority."""
    before = F.coalesce(F.sum(request).over(W.partitionBy(*keys).orderBy(*priority).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return F.least(request, F.greatest(available - before, F.lit(0.0)))
