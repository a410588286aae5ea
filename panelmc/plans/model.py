"""Model documents as panels: elements become columns of (real, step), level by level in order of what they read.

Supported: fixed, sample (families with an inverse), expression, lookup, series, lag, filter, status, milestone, hysteresis, and stocks whose rate doesn't read
their own level. Elements that read themselves through others need operators.folds and are refused.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmc.functions import dists, rng
from panelmc.functions.lookup import Table
from panelmc.functions.units import parsed
from panelmc.operators.reducers import BANDS, percentiles, summary
from panelmc.operators.steps import Steps
from panelmc.plans.expr import Scope, column, references
from panelmc.sources.tables import panel

#: Parameters of families by the documents' names, in the order of the functions'.
FAMILIES: dict[str, tuple[str, tuple[str, ...]]] = {
    "uniform": ("uniform", ("min", "max")),
    "normal": ("normal", ("mean", "stddev")),
    "lognormal": ("lognormal", ("mean", "stddev")),
    "lognormal_moments": ("lognormal_moments", ("mean", "stddev")),
    "triangular": ("triangular", ("min", "mode", "max")),
    "exponential": ("exponential", ("mean",)),
    "weibull": ("weibull", ("shape", "scale")),
    "bernoulli": ("bernoulli", ("p",)),
    "pareto": ("pareto", ("shape", "scale")),
    "extreme_value": ("extreme_value", ("location", "scale")),
    "log_uniform": ("log_uniform", ("min", "max")),
    "log_triangular": ("log_triangular", ("min", "mode", "max")),
}


def load(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def number(q: object) -> float:
    return float(q["value"]) if isinstance(q, Mapping) else float(q)


def steps_of(settings: Mapping) -> tuple[int, float]:
    """Number of steps, and a step's length in its unit; the duration is brought to that unit."""
    dt, duration = settings["timestep"], settings["duration"]
    length = number(duration) * parsed(duration["unit"])[1] / parsed(dt["unit"])[1]
    return max(1, int(length / number(dt) + 0.5)), number(dt)


def reads(element: Mapping) -> set[str]:
    """What an element reads in the same step."""
    return references([v for k, v in element.items() if k != "inputs"]) | ({element["input"]} if isinstance(element.get("input"), str) else set()) if element.get("value_rule") != "lag" else set()


def ordered(elements: list[Mapping]) -> list[list[Mapping]]:
    """Elements in levels, each of which reads only those before. A circle is an error."""
    left, done, levels = {e["id"]: e for e in elements}, set(), []
    lags = {e["id"]: e["input"] for e in elements if e.get("value_rule") == "lag" and e.get("input") in left}
    needs = {i: ({lags[i]} if i in lags else reads(e)) & set(left) - {i} for i, e in left.items()}
    while left:
        level = [e for i, e in left.items() if needs[i] <= done]
        if not level:
            raise ValueError(f"elements read each other in a circle: {sorted(left)}")
        levels.append(level)
        done |= {e["id"] for e in level}
        left = {i: e for i, e in left.items() if i not in done}
    return levels


def validate(document: Mapping) -> dict:
    """ok, errors, and the order of evaluation."""
    errors, order = [], []
    ids = [e.get("id") for e in document.get("elements", [])]
    errors += [f"repeated id {i}" for i in sorted({i for i in ids if ids.count(i) > 1})]
    try:
        order = [e["id"] for level in ordered(document.get("elements", [])) for e in level]
    except ValueError as e:
        errors.append(str(e))
    return {"ok": not errors, "errors": errors, "order": order}


def run(spark: SparkSession, document: Mapping, n: int | None = None, seed: int | None = None) -> DataFrame:
    """The panel: real, step, elapsed, and a column for each element."""
    settings = document["simulation_settings"]
    n = n or settings.get("n_realizations", 1)
    seed = settings.get("seed", 0) if seed is None else seed
    count, dt = steps_of(settings)
    dims = {d["id"]: d["size"] for d in document.get("dimensions", [])}
    df = panel(spark, n, count).withColumn("elapsed", F.col("step") * dt)
    axis = Steps(["real"], ["step"])
    lookups = {e["id"]: table_of(e) for e in document["elements"] if e.get("value_rule") == "lookup"}
    names: dict[str, Column] = {}
    for level in ordered(document["elements"]):
        scope = Scope(dict(names), lookups, {"elapsed": F.col("elapsed"), "timestep": F.lit(dt)}, dims)
        new = {e["id"]: value_of(e, scope, axis, seed, dt) for e in level if e.get("value_rule") != "lookup"}
        df = df.select("*", *[c.alias(i) for i, c in new.items()])
        names |= {i: F.col(f"`{i}`") for i in new}
    return df


def table_of(e: Mapping) -> Table:
    t = e["table"]
    return Table(tuple(t["x"]), tuple(t["y"]), {"log_linear": "log", "step": "step", "cubic": "cubic"}.get(e.get("interpolation", "linear"), "linear"))


def value_of(e: Mapping, scope: Scope, axis: Steps, seed: int, dt: float) -> Column:
    if e.get("primitive") == "stock":
        if e["id"] in references(e.get("rate", {})) or any(k in e for k in ("floor", "capacity", "return_rate", "withdrawals")):
            raise NotImplementedError(f"stock {e['id']} needs its own level: use operators.folds")
        return axis.stock(number(e["initial_value"]), column(e["rate"]["ast"] if "ast" in e["rate"] else e["rate"], scope), dt)
    rule = e.get("value_rule")
    if rule == "fixed":
        return F.array(*[F.lit(number(v)) for v in e["values"]]) if "values" in e else F.lit(number(e["value"]))
    if rule == "expression":
        return column(e["expression"]["ast"], scope)
    if rule == "sample":
        d = e["distribution"]
        if d["family"] not in FAMILIES:
            raise NotImplementedError(f"family {d['family']}")
        name, params = FAMILIES[d["family"]]
        family = getattr(dists, name)(*[number(d["parameters"][p]) for p in params])
        return family.quantile(rng.uniform(seed, e["id"]))
    if rule == "series":
        return Table(tuple(map(float, e["timestamps"])), tuple(map(float, e["values"])), "step" if e.get("interpolation") == "step" else "linear")(F.col("elapsed"))
    x = scope.columns.get(e.get("input"), F.lit(0.0))
    if rule == "lag":
        return axis.lag(x, number(e.get("initial", 0.0)))
    if rule == "filter" and e["statistic"] != "ema":
        return axis.rolling(e["statistic"], x, int(e.get("window", 0)))
    if rule == "hysteresis":
        on = axis.hysteresis(x, number(e["low_threshold"]), number(e["high_threshold"]))
        return F.when(on == 1, number(e.get("output_above", 1.0))).otherwise(number(e.get("output_below", 0.0)))
    if rule == "status":
        return axis.status(column(e["set"]["ast"], scope) != 0, column(e["reset"]["ast"], scope) != 0)
    if rule == "milestone":
        return axis.milestone(column(e["trigger"]["ast"], scope) != 0, F.col("elapsed"))
    raise NotImplementedError(f"{e.get('primitive')} {rule}")


def finals(df: DataFrame, ids: list[str]) -> DataFrame:
    """real, id, value of the last step."""
    last = df.groupBy("real").agg(*[F.max_by(i, "step").alias(i) for i in ids])
    return last.select("real", F.explode(F.array(*[F.struct(F.lit(i).alias("id"), F.col(f"`{i}`").alias("value")) for i in ids])).alias("v")).select("real", "v.id", "v.value")


def history(df: DataFrame, element: str) -> DataFrame:
    """step, mean and bands of an element over realizations."""
    bands = percentiles(df, element, BANDS, ["step"])
    return summary(df, element, ["step"]).select("step", "mean").join(bands, "step")
