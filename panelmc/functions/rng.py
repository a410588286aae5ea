"""Randomness as data: a draw is a function of seed, element, realization, step and slot, so that neither
partitions nor other elements change it. sql() is the same draw in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 2.0**48


def uniform(seed: int, element: str, real: Column | str = "real", step: Column | int = 0, slot: int = 0) -> Column:
    """In the open interval from 0 to 1: 48 bits of an MD5 digest, and a half."""
    real = F.col(real) if isinstance(real, str) else real
    step = step if isinstance(step, Column) else F.lit(step)
    key = F.concat_ws(":", F.lit(str(seed)), F.lit(element), real.cast("string"), step.cast("string"), F.lit(str(slot)))
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("bigint") + 0.5) / SCALE


def sql(seed: int, element: str, real: str = "real", step: str = "0", slot: int = 0) -> str:
    return f"((('0x' || substr(md5('{seed}:{element}:' || {real} || ':' || {step} || ':{slot}'), 1, 12))::bigint + 0.5) / 281474976710656.0::double)"
