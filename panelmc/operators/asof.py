"""As-of join: of each left row, the last right row of its keys that isn't later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], ties: str) -> DataFrame:
    """left with the values of right (keys, time, values, ties). Both sides are laid in one order of time, one shuffle and one sort; of right rows at the same
    time the one with the largest `ties` counts. Left rows before any right row get nulls."""
    marked = right.select(*keys, time, F.struct(*values).alias("_r"), F.col(ties).cast("long").alias("_tie"), F.lit(0).alias("_side"))
    both = marked.withColumn("_l", F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType))
    own = left.select(*keys, time, F.lit(None).cast(marked.schema["_r"].dataType).alias("_r"), F.lit(None).cast("long").alias("_tie"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    w = W.partitionBy(*keys).orderBy(time, "_side", "_tie").rowsBetween(W.unboundedPreceding, 0)
    out = both.unionByName(own).withColumn("_last", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return out.select("_l.*", *[F.col(f"_last.{v}").alias(v) for v in values])
