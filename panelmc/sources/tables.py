"""Tables as panels: rows as realizations, ordered events as steps, aggregates as lookup knots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def realizations(spark: SparkSession, n: int) -> DataFrame:
    """real from 0 to n - 1."""
    return spark.range(n).withColumnRenamed("id", "real")


def panel(spark: SparkSession, n: int, steps: int) -> DataFrame:
    """real and step: each realization's steps made where the realization is."""
    return realizations(spark, n).select("real", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as realizations: key (a row's number within the order), and its measures."""
    rows = table(spark, folder, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def walks(spark: SparkSession, folder: str) -> DataFrame:
    """events as steps: each user's events in order of (ts, event_id), value as the observed level."""
    return table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type", F.col("value").cast("double").alias("value"))


def knots(df: DataFrame, x: str, y: str, most: int = 10_000) -> tuple[list[float], list[float]]:
    """A lookup table of a DataFrame: the mean of y for each x, in order of x. More than `most` knots are an error."""
    rows = df.groupBy(F.col(x).cast("double").alias("x")).agg(F.avg(y).alias("y")).orderBy("x").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} knots")
    return [r.x for r in rows], [r.y for r in rows]
