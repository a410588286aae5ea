"""Studies: every design point is evaluated over the same realizations, in one job."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[Mapping[str, Column]], Column]


def over_designs(df: DataFrame, designs: Sequence[Mapping[str, float]], model: Model) -> DataFrame:
    """design (its number), objective: the mean of the model over df's rows. Each row is met once and summed for all designs there."""
    means = [F.avg(model({k: F.lit(float(v)) for k, v in d.items()})).alias(f"d{i}") for i, d in enumerate(designs)]
    pairs = F.array(*[F.struct(F.lit(i).alias("design"), F.col(f"d{i}").alias("objective")) for i in range(len(designs))])
    return df.agg(*means).select(F.explode(pairs).alias("p")).select("p.design", "p.objective")


def evaluated(df: DataFrame, designs: Sequence[Mapping[str, float]], model: Model) -> list[float]:
    rows = over_designs(df, designs, model).collect()
    return [r.objective for r in sorted(rows, key=lambda r: r.design)]


def grid(low: float, high: float, steps: int) -> list[float]:
    return [low + (high - low) * i / (steps - 1) for i in range(steps)]


def tornado(df: DataFrame, base: Mapping[str, float], ranges: Mapping[str, tuple[float, float]], model: Model) -> DataFrame:
    """element_id, low, high, swing of the objective at either end of each range."""
    names = list(ranges)
    designs = [{**base, k: ranges[k][side]} for k in names for side in (0, 1)]
    rows = over_designs(df, designs, model)
    name = F.element_at(F.array(*map(F.lit, names)), (F.floor(F.col("design") / 2) + 1).cast("int"))
    out = rows.groupBy(name.alias("element_id")).agg(F.max(F.when(F.col("design") % 2 == 0, F.col("objective"))).alias("low"), F.max(F.when(F.col("design") % 2 == 1, F.col("objective"))).alias("high"))
    return out.withColumn("swing", F.abs(F.col("high") - F.col("low"))).orderBy(F.desc("swing"))


def information_value(df: DataFrame, scenario: Column, candidates: Sequence[float], payoff: Callable[[float], Column]) -> DataFrame:
    """Expected value of knowing the scenario before choosing: the mean of each scenario's best candidate less the best mean."""
    means = df.groupBy(scenario.alias("scenario")).agg(F.count("*").alias("n"), *[F.avg(payoff(c)).alias(f"c{i}") for i, c in enumerate(candidates)])
    cs = [F.col(f"c{i}") for i in range(len(candidates))]
    best = F.greatest(*cs) if len(cs) > 1 else cs[0]
    total = F.sum("n")
    overall = [F.sum(F.col("n") * c) / total for c in cs]
    without = F.greatest(*overall) if len(cs) > 1 else overall[0]
    return means.agg((F.sum(F.col("n") * best) / total).alias("with_information"), without.alias("without_information")).withColumn("evppi", F.col("with_information") - F.col("without_information"))


def box_complex(df: DataFrame, bounds: Mapping[str, tuple[float, float]], model: Model, maximize: bool = False, feasible: Callable[[Mapping[str, float]], bool] = lambda _: True, rounds: int = 200, seed: int = 0) -> dict:
    """Box's complex method: points, of which the worst is reflected through the others' centre (1.3 times as far), halfway back while it
    stays worst. One job evaluates the first points, one each reflection with all its retreats. Infeasible points cost infinity."""
    names = list(bounds)
    n = len(names)
    k = max(2 * n, n + 2)
    low, high = np.array([bounds[c][0] for c in names], float), np.array([bounds[c][1] for c in names], float)
    rng_ = np.random.default_rng(seed)
    points = low + (high - low) * np.stack([(rng_.permutation(k) + rng_.random(k)) / k for _ in names], 1)

    def costs(xs: np.ndarray) -> np.ndarray:
        designs = [dict(zip(names, x.tolist(), strict=True)) for x in xs]
        ok = [feasible(d) for d in designs]
        values = iter(evaluated(df, [d for d, good in zip(designs, ok, strict=True) if good], model) if any(ok) else [])
        return np.array([(-1 if maximize else 1) * next(values) if good else np.inf for good in ok])

    cost = costs(points)
    evaluations, done = k, False
    for _ in range(rounds):
        best, worst = cost.min(), int(np.argmax(cost))
        if np.isfinite(cost).all() and cost.max() - best <= 1e-6 * (1 + abs(best)) and np.abs((points.max(0) - points.min(0)) / (high - low)).max() <= 1e-3:
            done = True
            break
        centre = (points.sum(0) - points[worst]) / (k - 1)
        edge = 1e-3 * (high - low)
        tries = np.stack([np.clip(centre + (1.3 * 0.5**i) * (1 if i < 8 else 0) * (centre - points[worst]), low + edge, high - edge) for i in range(10)])
        values = costs(tries)
        evaluations += len(tries)
        better = np.flatnonzero(values < cost[worst])
        pick = int(better[0]) if len(better) else int(np.argmin(values))
        points[worst], cost[worst] = tries[pick], values[pick]
    i = int(np.argmin(cost))
    return {"values": dict(zip(names, points[i].tolist(), strict=True)), "objective": float(-cost[i] if maximize else cost[i]), "evaluations": evaluations, "converged": done}


def early_exercise(paths: DataFrame, dates: int, strike: float, rate: float, dt: float) -> DataFrame:
    """Least-squares Monte Carlo for a put: paths have s1 to s<dates>. Backwards, cash flows are regressed on the price and its square over
    paths in the money (two moments' rows a date), and exercised where the payoff is above what that foresees. price, std_error."""
    from panelmc.operators.reducers import moments

    discount = float(np.exp(-rate * dt))
    # each date's cash flows are kept for the next one; a lost part is made again from the paths
    now_kept = paths.withColumn("_flow", F.greatest(F.lit(strike) - F.col(f"s{dates}"), F.lit(0.0))).persist()
    held = F.col("_flow") * discount
    for t in range(dates - 1, 0, -1):
        s = F.col(f"s{t}")
        x = s / strike
        inside = now_kept.where(s < strike).select(x.alias("x"), (x * x).alias("xx"), held.alias("y"))
        count, mean, cov = moments(inside, ["x", "xx", "y"])
        flow = held
        if count > 3 and abs(np.linalg.det(cov[:2, :2])) > 1e-14:
            b = np.linalg.solve(cov[:2, :2], cov[:2, 2])
            a = mean[2] - b @ mean[:2]
            foreseen = float(a) + float(b[0]) * x + float(b[1]) * x * x
            now = F.greatest(F.lit(strike) - s, F.lit(0.0))
            flow = F.when((s < strike) & (now > foreseen), now).otherwise(held)
        now_kept = now_kept.withColumn("_flow", flow).persist()
    return now_kept.agg(F.avg(held).alias("price"), (F.stddev_samp(held) / F.sqrt(F.count("*"))).alias("std_error"))
