"""Global order without a single task: places over bins whose edges are quantiles, and values at running weights without a sort of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS = 64
#: Rows of a small table up to which it is sent to tasks; a larger one is a checkpoint.
MOST_SENT = 10_000
ACCURACY = 10_000


def binned(df: DataFrame, by: str, bins: int = BINS) -> DataFrame:
    """df with _bin: the number of quantile edges at or below the value (rows of one bin are sorted in one task)."""
    edges = sorted(set(df.approxQuantile(by, [i / bins for i in range(1, bins)], 0.002)))
    at = F.lit(0)
    for e in edges:
        at = at + F.when(F.col(by) >= e, 1).otherwise(0)
    return df.withColumn("_bin", at)


def placed(df: DataFrame, by: str, ties: Sequence[str] = (), name: str = "place") -> DataFrame:
    """df with a row's place from 0 in order of `by` (then `ties`)."""
    rows = binned(df, by)
    order = W.partitionBy("_bin").orderBy(by, *ties)
    return rows.withColumn(name, _before(rows) + F.row_number().over(order) - 1).drop("_bin")


def _before(rows: DataFrame) -> Column:
    """How many rows are in the bins before a row's own; there are BINS of them at most."""
    counts = {r["_bin"]: r["count"] for r in rows.groupBy("_bin").count().collect()}
    out, so_far = F.lit(0), 0
    for b in sorted(counts):
        out = F.when(F.col("_bin") == b, F.lit(so_far)).otherwise(out)
        so_far += counts[b]
    return out


def pinned(rows: DataFrame) -> DataFrame:
    """rows as they are now, whatever reads them later: sent to the tasks up to MOST_SENT, a checkpoint beyond, which Spark joins as it finds best."""
    held = rows.take(MOST_SENT + 1)
    return rows.checkpoint() if len(held) > MOST_SENT else F.broadcast(rows.sparkSession.createDataFrame(held, rows.schema))


def beside(rows: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the columns of the row of `small` that has their keys, null ones too."""
    other = small.select(*[F.col(k).alias(f"_own_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_own_{k}")) for k in keys])
    return rows.join(other, same).drop(*[f"_own_{k}" for k in keys])


def reached(df: DataFrame, value: Column, weight: Column, targets: dict[str, Column], fractions: Sequence[float], keys: Sequence[str] = (), rounds: int = 1) -> DataFrame:
    """Of each key and target the least value whose running weight, in order of value, reaches the target (the greatest value if none does).

    A target is a column of `_all`, the weight of its key. Each round takes approximate quantiles at `fractions` as edges, adds up the weight between and at
    edges, and keeps the rows of the bins that targets fall in: rows equal to an edge are a bin of their own, so any edges give exact results, and good ones few rows.
    Of those the last step sorts the different values. Sums by bin are partial before their shuffle, so a hot key isn't one task. Null values don't count.
    """
    groups = list(keys) or ["_every"]
    rows = df.select(*(keys or [F.lit(0).alias("_every")]), value.alias("_v"), weight.alias("_w")).where("_v is not null")
    wants = None
    for k in range(rounds):
        edges = pinned(rows.groupBy(*groups).agg(F.array_distinct(F.percentile_approx("_v", list(fractions), ACCURACY)).alias("_edges")))
        bin_of = 2 * F.size(F.filter("_edges", lambda e: e < F.col("_v"))) + F.array_contains("_edges", F.col("_v")).cast("int")
        rows = beside(rows, edges, groups).withColumn(f"_bin_{k}", bin_of).drop("_edges")
        sums = rows.groupBy(*groups, f"_bin_{k}").agg(F.sum("_w").alias("_sum"))
        own = W.partitionBy(*groups)
        sums = sums.withColumn("_all", F.sum("_sum").over(own)).withColumn("_to", F.sum("_sum").over(own.orderBy(f"_bin_{k}")))
        if wants is None:
            aims = F.array(*[F.struct(F.lit(i).alias("_t"), c.cast("double").alias("_left")) for i, c in enumerate(targets.values())])
            sums = sums.select("*", F.inline(aims))
        else:
            sums = beside(sums, wants, groups).select("*", F.inline("_aims")).drop("_aims")
        at = F.struct(F.col(f"_bin_{k}").alias("bin"), (F.col("_to") - F.col("_sum")).alias("before"))
        found = sums.groupBy(*groups, "_t", "_left").agg(F.coalesce(F.min(F.when(F.col("_to") >= F.col("_left"), at)), F.max(at)).alias("_at"))
        aim = F.struct("_t", (F.col("_left") - F.col("_at.before")).alias("_left"))
        groups = [*groups, f"_bin_{k}"]
        # as many aims as there are targets at most
        wants = pinned(found.withColumn(f"_bin_{k}", F.col("_at.bin")).groupBy(*groups).agg(F.collect_list(aim).alias("_aims")))
        rows = beside(rows, wants.drop("_aims"), groups)
    values = rows.groupBy(*groups, "_v").agg(F.sum("_w").alias("_sum"))
    values = values.withColumn("_to", F.sum("_sum").over(W.partitionBy(*groups).orderBy("_v")))
    values = beside(values, wants, groups).select("*", F.inline("_aims"))
    ends = values.groupBy(*(keys or ["_every"]), "_t").agg(F.coalesce(F.min(F.when(F.col("_to") >= F.col("_left"), F.col("_v"))), F.max("_v")).alias("_v"))
    return ends.groupBy(*keys).agg(*[F.max(F.when(F.col("_t") == i, F.col("_v"))).alias(t) for i, t in enumerate(targets)])
