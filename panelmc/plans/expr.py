"""Expression trees of model documents as columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelmc.functions import arrays as A
from panelmc.functions import numerics as N
from panelmc.functions.lookup import Table
from panelmc.functions.units import calendar


@dataclass
class Scope:
    """What a tree may refer to. extern: functions by name, for extern_call; an unknown one is 0."""

    columns: Mapping[str, Column]
    lookups: Mapping[str, Table] = field(default_factory=dict)
    time: Mapping[str, Column] = field(default_factory=dict)
    dimensions: Mapping[str, int] = field(default_factory=dict)
    extern: Mapping[str, Callable[..., Column]] = field(default_factory=dict)
    loops: tuple[Column, ...] = ()


BINARY = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": N.ieee_div,
    "power": lambda a, b: F.pow(a, b),
    "lt": N.lt,
    "gt": N.gt,
    "lte": N.lte,
    "gte": N.gte,
    "eq": N.eq,
    "neq": N.neq,
    "and": lambda a, b: N.flag(N.truth(a) & N.truth(b)),
    "or": lambda a, b: N.flag(N.truth(a) | N.truth(b)),
}
UNARY = {"neg": lambda a: -a, "not": lambda a: N.flag(~N.truth(a))}
CALLS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "ln": N.ln, "log": N.log10, "log2": N.log2, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "atan2": F.atan2, "floor": lambda x: N.whole(F.floor, x), "ceil": lambda x: N.whole(F.ceil, x), "sign": N.sign, "int": N.trunc, "step": N.step, "mod": N.fmod, "min": N.nan_min, "max": N.nan_max, "round": N.round_away,
    "gamma": N.gamma, "erf": N.erf, "erfc": N.erfc, "pv_factor": N.pv_factor, "annuity_factor": N.annuity_factor, "null": lambda: F.lit(N.NAN),
    "sum_array": A.total, "mean_array": A.mean, "min_array": A.low, "max_array": A.high, "argmin_array": A.argmin, "argmax_array": A.argmax, "size_array": lambda a: F.size(a).cast("double"), "get_element": A.at, "dot_product": A.dot,
    "interp_array": A.interp, "sort_array": A.sort, "sort_index": A.sort_index, "rank_array": A.rank, "cumulate": A.cumulate, "cumproduct": A.cumproduct, "gather": A.gather, "ordinal": A.ordinal,
    "masked_sum": lambda a, m: A.total(A.picked(a, m)), "masked_mean": lambda a, m: A.mean(A.picked(a, m)), "masked_min": lambda a, m: A.low(A.picked(a, m)), "masked_max": lambda a, m: A.high(A.picked(a, m)), "masked_count": lambda a, m: F.size(A.picked(a, m)).cast("double"),
    "argmin_where": A.argmin_where, "argmax_where": A.argmax_where, "column_count": lambda a: F.size(a).cast("double"),
    "table_min": lambda a: F.coalesce(F.array_min(a), F.lit(float("inf"))), "table_max": lambda a: F.coalesce(F.array_max(a), F.lit(float("-inf"))),
} | {f"get_{k}": lambda t, f=f: calendar(t)[f] for k, f in {"year": "year", "month": "month", "day": "day_of_month", "hour": "hour", "minute": "minute", "second": "second"}.items()}


def references(tree: object) -> set[str]:
    """Elements that a tree reads."""
    if isinstance(tree, dict):
        own = {tree["element_id"]} if tree.get("op") in ("ref", "lookup_call", "run_stat") else set()
        return own.union(*[references(v) for v in tree.values()])
    return set().union(*map(references, tree)) if isinstance(tree, list) else set()


def column(tree: Mapping, scope: Scope) -> Column:
    """The column of a tree. What it refers to in vain is 0; an unknown operation is an error."""
    op = tree["op"]

    def of(key: str) -> Column:
        return column(tree[key], scope)

    if op == "literal":
        return F.lit(float(tree["value"]))
    if op == "ref":
        return scope.columns.get(tree["element_id"], F.lit(0.0))
    if op == "time_ref":
        return scope.time[tree["property"]]
    if op in BINARY:
        return BINARY[op](of("left"), of("right"))
    if op in UNARY:
        return UNARY[op](of("operand"))
    if op == "if":
        return F.when(N.truth(of("cond")), of("then")).otherwise(of("else"))
    if op == "call":
        if tree["fn"] not in CALLS:
            raise NotImplementedError(f"function {tree['fn']}")
        args = [column(a, scope) for a in tree["args"]]
        if tree["fn"] == "round" and len(args) == 2:
            return N.round_away(args[0], int(tree["args"][1]["value"]))
        return CALLS[tree["fn"]](*args)
    if op == "lookup_call":
        return scope.lookups[tree["element_id"]](of("input"))
    if op == "array":
        return F.array(*[column(e, scope) for e in tree["elements"]])
    if op == "vector_map":
        n = scope.dimensions.get(tree["over"], 0)
        if not n:
            return F.array().cast("array<double>")
        return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: column(tree["body"], Scope(scope.columns, scope.lookups, scope.time, scope.dimensions, scope.extern, (i.cast("double"), *scope.loops))))
    if op == "index_ref":
        return scope.loops[tree.get("depth") or 0]
    if op == "index" and len(tree["indices"]) == 1:
        return A.at(of("array"), column(tree["indices"][0], scope))
    if op == "extern_call":
        f = scope.extern.get(tree["fn"])
        return f(*[column(a, scope) for a in tree["args"]]) if f else F.lit(0.0)
    raise NotImplementedError(f"operation {op}")
