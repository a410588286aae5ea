"""Rules on event streams: windows of event time with watermarks, and latches kept as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream; ts as a timestamp in UTC."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, width: str, late: str) -> DataFrame:
    """start, event_type, n, total of windows of event time."""
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """user_id, start, n of sessions that a gap ends."""
    rows = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), "n")


def latch(stream: DataFrame, low: float, high: float) -> DataFrame:
    """user_id, event_id, state: hysteresis of each user's value in order of (ts, event_id) within a batch, kept between batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        on = state.get[0] if state.exists else 0.0
        # rows of one user in one batch, which the trigger bounds
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for v in rows["value"]:
            on = 1.0 if v >= high else 0.0 if v <= low else on
            out.append(on)
        state.update((on,))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "state": out})

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, state double", "on double", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Runs a stream over what is there and gives its result as a table: batches are written to the folder, in complete mode each over the last."""
    spark = stream.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        # a batch that is run again after a failure overwrites its own output
        df.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
