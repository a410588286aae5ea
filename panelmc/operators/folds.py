"""Rules whose next value needs their last: a fold over each realization's steps, streamed.

Rows come sorted by realization and step; a task holds one batch and the state of one realization, however many steps it has.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

#: A rule: (initial state, step). step(state, *inputs) gives (state, outputs).
Rule = tuple[Callable[[], object], Callable[..., tuple[object, tuple[float, ...]]]]


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], outputs: Sequence[str], rule: Rule) -> DataFrame:
    """df with the outputs of a rule, whose state starts anew in each realization."""
    start, step = rule
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            made = []
            for k, xs in zip(batch[list(keys)].itertuples(index=False, name=None), batch[list(inputs)].itertuples(index=False, name=None), strict=True):
                if k != key:
                    key, state = k, start()
                state, out = step(state, *xs)
                made.append(out)
            yield batch.assign(**{o: [m[i] for m in made] for i, o in enumerate(outputs)})[[*names, *outputs]]

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{o}` double" for o in outputs])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def ema(window: int) -> Rule:
    a = 2 / (window + 1)

    def step(s, x):
        s = x if s is None else s + a * (x - s)
        return s, (s,)

    return (lambda: None), step


def stock(initial: float, floor: float = -math.inf, capacity: float = math.inf, dt: float = 1.0) -> Rule:
    """Level after the step, and what flowed over its capacity; a NaN rate leaves it as it is."""

    def step(s, rate):
        s = s if math.isnan(rate) else s + rate * dt
        s = max(s, floor)
        over = max(0.0, s - capacity)
        return s - over, (s - over, over)

    return (lambda: initial), step


def pid(kp: float, ki: float, kd: float, setpoint: float, low: float, high: float, deadband: float = 0.0, dt: float = 1.0) -> Rule:
    def step(s, x):
        integral, last = s
        e = setpoint - x
        e = 0.0 if abs(e) < deadband else e
        integral += e * dt
        slope = 0.0 if last is None else (e - last) / dt
        return (integral, e), (min(high, max(low, kp * e + ki * integral + kd * slope)),)

    return (lambda: (0.0, None)), step


def on_off(setpoint: float, band: float, cap: float) -> Rule:
    def step(s, x):
        s = 1.0 if x > setpoint + band / 2 else 0.0 if x < setpoint - band / 2 else s
        return s, (s * cap,)

    return (lambda: 0.0), step


def markov(matrix: Sequence[Sequence[float]], values: Sequence[float], initial: int = 0) -> Rule:
    """The current state's value; then the next state by a uniform."""

    def step(s, u):
        at, run, to = s, 0.0, len(values) - 1
        for i, p in enumerate(matrix[at]):
            run += p
            if u <= run:
                to = i
                break
        return to, (values[at],)

    return (lambda: initial), step


def queue(delay: int, capacity: float = math.inf, leak: float = 0.0) -> Rule:
    """Throughput, and what is in the queue: arrivals leave `delay` steps later; beyond capacity they are turned away."""

    def step(s, x):
        line, held = s
        out = line.pop(0)
        held -= out
        take = min(max(0.0, x), capacity - held)
        line.append(take)
        held += take
        return (line, held), (out * math.exp(-leak * delay), held)

    return (lambda: ([0.0] * delay, 0.0)), step


def ornstein_uhlenbeck(kappa: float, level: float, sigma: float, initial: float, dt: float = 1.0) -> Rule:
    def step(s, z):
        s = s + kappa * (level - s) * dt + sigma * math.sqrt(dt) * z
        return s, (s,)

    return (lambda: initial), step


def autocorrelated(rho: float) -> Rule:
    """Normal scores with first-order autocorrelation, of independent ones."""

    def step(s, z):
        s = z if s is None else rho * s + math.sqrt(1 - rho * rho) * z
        return s, (s,)

    return (lambda: None), step


def decay_chain(half_lives: Sequence[float], dt: float = 1.0) -> Rule:
    """Masses of a chain, parents first: each step's release goes to the first, what decays goes to the next."""
    kept = [0.5 ** (dt / h) if h else 1.0 for h in half_lives]

    def step(s, x):
        s = [s[0] + x, *s[1:]]
        for i, k in enumerate(kept):
            gone = s[i] * (1 - k)
            s[i] -= gone
            if i + 1 < len(s):
                s[i + 1] += gone
        return s, tuple(s)

    return (lambda: [0.0] * len(half_lives)), step


def repairable(failure_chance: float, repair_steps: int) -> Rule:
    """1 while it works: fails by a uniform, is back after so many steps."""

    def step(s, u):
        if s > 0:
            return s - 1, (0.0,)
        if u < failure_chance:
            return repair_steps - 1, (0.0,)
        return 0, (1.0,)

    return (lambda: 0), step


def links(source: float, floor: float = 0.0, dt: float = 1.0) -> Rule:
    """A source that two outflows draw on in order of priority; each gets what is left above the floor."""

    def step(s, first, second):
        a = min(max(0.0, first) * dt, max(0.0, s - floor))
        b = min(max(0.0, second) * dt, max(0.0, s - a - floor))
        return s - a - b, (s - a - b, a, b)

    return (lambda: source), step
