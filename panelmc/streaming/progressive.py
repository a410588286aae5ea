"""Progressive runs: chunks of realizations arrive as files, moments merge, and the run ends when the mean is known well enough."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Moments:
    """Count, mean and sum of squared deviations; merging is in any order."""

    n: int = 0
    mean: float = 0.0
    m2: float = 0.0

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return Moments()
        d = other.mean - self.mean
        return Moments(n, self.mean + d * other.n / n, self.m2 + other.m2 + d * d * self.n * other.n / n)

    @property
    def std(self) -> float:
        return math.sqrt(self.m2 / (self.n - 1)) if self.n > 1 else 0.0

    def half_width(self, z: float = 1.96) -> float:
        return z * self.std / math.sqrt(self.n) if self.n else math.inf


@dataclass
class Progress:
    """What a run has so far, by chunk: a chunk that comes again after a restart counts once."""

    chunks: dict[int, Moments] = field(default_factory=dict)

    @property
    def total(self) -> Moments:
        out = Moments()
        for m in self.chunks.values():
            out = out.merged(m)
        return out

    def settled(self, tolerance: float, least: int) -> bool:
        t = self.total
        return t.n >= least and t.half_width() < tolerance * abs(t.mean)


def run(spark: SparkSession, folder: str, schema: str, value: Callable[[DataFrame], F.Column], checkpoint: str, tolerance: float = 0.02, least: int = 100) -> Progress:
    """Reads chunks from a folder as a stream, one file a batch, until the mean's half width is under tolerance or no chunk is left."""
    progress = Progress()
    state = {"stop": False}

    def batch(df: DataFrame, number: int) -> None:
        if state["stop"]:
            return
        v = value(df).cast("double")
        r = df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var")).first()
        progress.chunks[number] = Moments(r.n, r.mean or 0.0, (r["var"] or 0.0) * r.n)
        state["stop"] = progress.settled(tolerance, least)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return progress
