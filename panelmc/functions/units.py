"""Units and calendar fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit to (dimension, factor to the dimension's base unit).
UNITS: dict[str, tuple[str, float]] = {
    "s": ("time", 1.0),
    "min": ("time", 60.0),
    "h": ("time", 3600.0),
    "d": ("time", 86400.0),
    "wk": ("time", 604800.0),
    "mo": ("time", 2629800.0),
    "yr": ("time", 31557600.0),
    "mm": ("length", 0.001),
    "cm": ("length", 0.01),
    "m": ("length", 1.0),
    "km": ("length", 1000.0),
    "g": ("mass", 0.001),
    "kg": ("mass", 1.0),
    "t": ("mass", 1000.0),
    "L": ("volume", 0.001),
    "m3": ("volume", 1.0),
    "1": ("none", 1.0),
    "%": ("none", 0.01),
}
#: Temperatures as (factor, offset) to kelvin.
TEMPERATURES = {"K": (1.0, 0.0), "C": (1.0, 273.15), "F": (5 / 9, 459.67 * 5 / 9)}


def parsed(unit: str) -> tuple[tuple[str, ...], float]:
    """Dimension and factor of a unit, or of one unit per another."""
    over, _, under = unit.partition("/")
    if under:
        (a, f), (b, g) = UNITS[over], UNITS[under]
        return (a, b), f / g
    a, f = UNITS[over]
    return (a,), f


def convert(x: Column, unit: str, to: str) -> Column:
    if unit in TEMPERATURES and to in TEMPERATURES:
        (a, b), (c, d) = TEMPERATURES[unit], TEMPERATURES[to]
        return (x * a + b - d) / c
    (one, f), (two, g) = parsed(unit), parsed(to)
    if one != two:
        raise ValueError(f"{unit} and {to} are of different dimensions")
    return x * (f / g)


def calendar(seconds: Column) -> dict[str, Column]:
    """Fields of a time in epoch seconds (session time zone UTC), as doubles."""
    t = F.timestamp_seconds(F.floor(seconds))
    fields = {"year": F.year(t), "month": F.month(t), "day_of_year": F.dayofyear(t), "day_of_month": F.dayofmonth(t), "days_in_month": F.dayofmonth(F.last_day(t)), "hour": F.hour(t), "minute": F.minute(t), "second": F.second(t)}
    return {k: v.cast("double") for k, v in fields.items()}


def elapsed(start: Column, now: Column) -> dict[str, Column]:
    """Boundaries of months and years crossed between two times in epoch seconds."""
    a, b = calendar(start), calendar(now)
    months = (b["year"] - a["year"]) * 12 + b["month"] - a["month"]
    return {"elapsed_months": months, "elapsed_years": b["year"] - a["year"]}


def plain_calendar(elapsed_days: Column) -> dict[str, Column]:
    """Without an anchor: years of 365 days; the year, and the day in it from 1."""
    return {"year": F.floor(elapsed_days / 365).cast("double"), "day_of_year": (F.floor(elapsed_days) % 365 + 1).cast("double")}
