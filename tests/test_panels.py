"""Panel functions and operators against plain Python, closed forms and literal expectations."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmc.functions import arrays as A
from panelmc.functions import dists, rng
from panelmc.functions import numerics as N
from panelmc.functions.lookup import Table
from panelmc.functions.units import convert
from panelmc.operators import designs, folds, ordered, reducers, studies
from panelmc.operators.steps import Steps
from panelmc.plans import model
from panelmc.plans.expr import Scope, column
from panelmc.sources.tables import panel, realizations
from panelmc.streaming.progressive import Moments


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_ieee_numerics(spark):
    v = lambda x: F.lit(float(x))
    got = one(spark, a=N.ieee_div(v(1), v(0)), b=N.ieee_div(v(0), v(0)), c=N.ln(v(0)), d=N.ln(v(-1)), e=N.sign(v(0)), f=N.eq(v("nan"), v("nan")), g=N.nan_max(v("nan"), v(1)), h=N.round_away(v(-2.5)), i=N.round_away(v(1.005), 2), j=N.fmod(v(-7), v(3)), k=N.whole(F.floor, v(1e300)), m=N.neq(v("nan"), v(1)))
    assert (got.a, got.c, got.e, got.f, got.g, got.h, got.i, got.j, got.k, got.m) == (math.inf, -math.inf, 1.0, 0.0, 1.0, -3.0, 1.0, -1.0, 1e300, 0.0)
    assert math.isnan(got.b) and math.isnan(got.d)
    got = one(spark, g=N.gamma(v(5)), h=N.gamma(v(0.5)), e=N.erf(v(0.7)))
    assert abs(got.g - 24) < 1e-9 and abs(got.h - math.sqrt(math.pi)) < 1e-9 and abs(got.e - math.erf(0.7)) < 2e-7


def test_draws_do_not_depend_on_partitions(spark):
    a = realizations(spark, 500).select("real", rng.uniform(1, "x").alias("u"))
    assert a.repartition(7).orderBy("real").collect() == a.repartition(2).orderBy("real").collect()
    assert abs(a.agg(F.avg("u")).first()[0] - 0.5) < 0.05


def test_normal_quantile(spark):
    ps = [1e-6, 0.01, 0.3, 0.5, 0.9, 0.999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", dists.norm_ppf(F.col("p")).alias("z")).collect()
    assert all(abs(r.z - NormalDist().inv_cdf(r.p)) < 1e-7 * (1 + abs(r.z)) for r in got)


@pytest.mark.parametrize(
    "family,params,mean,var",
    [("gamma", (2.5, 2.0), 5, 10), ("beta", (2.0, 5.0), 2 / 7, 10 / 392), ("pert", (0.0, 3.0, 6.0), 3, 36 / 28), ("student_t", (6.0,), 0, 1.5), ("poisson", (3.5,), 3.5, 3.5), ("binomial", (20, 0.3), 6, 4.2), ("negative_binomial", (4.0, 0.4), 6, 15), ("pearson_iii", (10.0, 2.0, 0.8), 10, 4)],
)
def test_slotted_families(family, params, mean, var):
    x = dists.SLOTTED[family](np.random.default_rng(1).integers(0, 1 << 63, 60_000).astype(np.uint64), *params)
    assert abs(x.mean() - mean) < 5 * math.sqrt(var / 60_000) and abs(x.var() / var - 1) < 0.1


def test_triangular1090():
    f = dists.triangular1090(10, 14, 25)
    assert "double" in f.twin("u")
    low, high = 10, 25
    assert low < 14 < high


def test_nearest_rank_percentiles(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(1, 5)], "x double")
    assert reducers.percentiles(rows, "x", [50.0]).first()[0] == 3.0
    tens = spark.createDataFrame([(float(i),) for i in range(1, 11)], "x double")
    assert reducers.tail_mean(tens, "x", 80).first()[0] == 9.0
    xs = [random.Random(1).choice([1.0, 2.5, 2.5, 9.0, -4.0]) for _ in range(501)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").repartition(5)
    got = reducers.percentiles(df, "x", [5.0, 37.5, 95.0]).first()
    assert list(got) == [sorted(xs)[int(p / 100 * 500 + 0.5)] for p in (5, 37.5, 95)]


@pytest.mark.parametrize("most", [10_000, 1])
def test_order_statistics_by_keys_with_ties_and_nulls(spark, monkeypatch, most):
    monkeypatch.setattr(ordered, "MOST_SENT", most)
    g = random.Random(7)
    rows = [(g.choice(["a", "a", "b", None]), g.choice([1.0, 1.0, 2.5, g.gauss(0, 9), None]), g.choice([0.0, 1.0, 2.0])) for _ in range(900)] + [("void", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, w double").repartition(3)
    got = {r.k: r for r in reducers.percentiles(df, "x", [0.0, 37.5, 95.0], ["k"]).collect()}
    heavy = {r.k: r.weighted_percentile for r in reducers.weighted_percentile(df, "x", "w", 70, ["k"]).collect()}
    assert set(got) == set(heavy) == {"a", "b", None}
    for k in got:
        own = sorted((x, w) for key, x, w in rows if key == k and x is not None)
        assert list(got[k])[1:] == [own[math.floor(p / 100 * (len(own) - 1) + 0.5)][0] for p in (0, 37.5, 95)]
        runs = np.cumsum([w for _, w in own])
        assert heavy[k] == next(x for (x, _), r in zip(own, runs, strict=True) if r >= runs[-1] * 0.7 - 1e-12)
    assert list(reducers.percentiles(df.where("false"), "x", [50.0]).first()) == [None]


def test_regression_and_zero_variance(spark):
    g = random.Random(2)
    rows = [(x := g.gauss(0, 1), w := g.gauss(0, 1), 2 * x + w, 1.0, i) for i in range(400)]
    df = spark.createDataFrame(rows, "x double, w double, y double, k double, i int")
    assert np.allclose(reducers.slopes(df, "y", ["x", "w"]), [2, 1])
    assert reducers.slopes(df, "y", ["x", "x"]) == [0.0, 0.0]
    got = df.agg(*[c.alias(k) for k, c in reducers.pair("k", "y").items()]).first()
    assert (got.correlation, got.beta) == (0.0, 0.0)
    assert all(abs(r.beta - 2) < 0.3 for r in reducers.split_beta(df, "x", "y", F.col("i") % 4, 4).collect())


def test_latin_hypercube_and_rank_correlation(spark):
    u = [r.u for r in designs.strata(realizations(spark, 200), 3, "v", 200, "u").collect()]
    assert sorted(int(x * 200) for x in u) == list(range(200))
    df = realizations(spark, 400).select("real", (-F.log(rng.uniform(1, "a"))).alias("x"), rng.uniform(1, "b").alias("y"))
    out = designs.rank_correlated(df, ["x", "y"], [[1, 0.7], [0.7, 1]], 400).collect()
    assert sorted(r.x for r in out) == sorted(r.x for r in df.collect())
    rank = lambda v: np.argsort(np.argsort(v))
    assert abs(np.corrcoef(rank([r.x for r in out]), rank([r.y for r in out]))[0, 1] - 0.68) < 0.08
    with pytest.raises(ValueError):
        designs.cholesky([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]])


def folded(spark, xs, rule, outputs):
    df = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(xs)], "real long, step int, x double")
    return [tuple(r[o] for o in outputs) for r in folds.fold(df, ["real"], ["step"], ["x"], outputs, rule).orderBy("step").collect()]


def test_folds_by_hand(spark):
    assert folded(spark, [10] * 3 + [float("nan")], folds.stock(0, 0, 25), ["level", "over"]) == [(10, 0), (20, 0), (25, 5), (25, 0)]
    assert folded(spark, [4, 0, 0, 7], folds.queue(2), ["out", "held"]) == [(0, 4), (0, 4), (4, 0), (0, 7)]
    assert folded(spark, [60, 52, 44, 52], folds.on_off(50, 10, 8), ["y"]) == [(8,), (8,), (0,), (0,)]
    df = spark.createDataFrame([(0, 0, 8.0, 5.0), (0, 1, 8.0, 5.0)], "real long, step int, a double, b double")
    got = folds.fold(df, ["real"], ["step"], ["a", "b"], ["s", "p", "q"], folds.links(15)).orderBy("step").collect()
    assert [(r.s, r.p, r.q) for r in got] == [(2, 8, 5), (0, 2, 0)]
    many = panel(spark, 50, 20).withColumn("x", rng.uniform(1, "f", "real", F.col("step")))
    a = folds.fold(many.repartition(3), ["real"], ["step"], ["x"], ["y"], folds.ema(4)).orderBy("real", "step").collect()
    assert a == folds.fold(many.repartition(11), ["real"], ["step"], ["x"], ["y"], folds.ema(4)).orderBy("real", "step").collect()


def test_window_rules_by_hand(spark):
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate([0.0, 5.0, 9.0, 5.0, 1.0, 5.0])], "real long, step int, x double")
    s, x = Steps(["real"], ["step"]), F.col("x")
    rows = df.select("step", s.hysteresis(x, 2, 8).alias("h"), s.delayed(x, 2).alias("d"), s.milestone(x > 4, F.col("step").cast("double")).alias("m"), s.stock(100, -x).alias("k"), s.rolling("max", x, 2).alias("r")).orderBy("step").collect()
    assert [r.h for r in rows] == [0, 0, 1, 1, 0, 0]
    assert [r.d for r in rows] == [0, 0, 0, 5, 9, 5]
    assert math.isnan(rows[0].m) and [r.m for r in rows[1:]] == [1.0] * 5
    assert [r.k for r in rows] == [100, 95, 86, 81, 80, 75]
    assert [r.r for r in rows] == [0, 5, 9, 9, 5, 5]


def test_arrays(spark):
    a = F.array(*map(F.lit, [3.0, 1.0, 2.0, 1.0]))
    got = one(spark, i=A.sort_index(a), r=A.rank(a), c=A.cumulate(a), p=A.cumproduct(a), m=A.argmin(a), o=A.at(a, 9), n=A.argmax(F.array().cast("array<double>")))
    assert (got.i, got.r, got.c, got.p, got.m, got.o, got.n) == ([2, 4, 3, 1], [4, 1, 3, 2], [3, 4, 6, 7], [3, 3, 6, 6], 2, 0, 0)
    out, axes = A.broadcast(lambda x, y: x * y, F.array(F.lit(1.0), F.lit(2.0)), [("b", 2)], F.array(F.lit(3.0), F.lit(5.0)), [("a", 2)])
    assert axes == [("a", 2), ("b", 2)] and one(spark, v=out).v == [3, 6, 5, 10]


def test_lookups(spark):
    t = Table((0.0, 1.0, 3.0), (2.0, 4.0, 0.0))
    rows = spark.createDataFrame([(x / 4,) for x in range(-4, 20)], "x double").select("x", t(F.col("x")).alias("y"), t.integral(F.col("x")).alias("a"), Table(t.x, t.y, "cubic")(F.col("x")).alias("c"))
    for r in rows.collect():
        assert abs(r.y - np.interp(r.x, t.x, t.y)) < 1e-12
        grid = np.linspace(0, min(max(r.x, 0), 3), 20_001)
        assert abs(r.a - np.trapezoid(np.interp(grid, t.x, t.y), grid)) < 1e-6
        assert -1e-12 <= r.c <= 4 + 1e-12


def test_units(spark):
    assert abs(one(spark, v=convert(F.lit(212.0), "F", "C")).v - 100) < 1e-9
    with pytest.raises(ValueError):
        convert(F.lit(1.0), "kg", "m")


def test_studies(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    out = studies.box_complex(df, {"a": (0.0, 10.0)}, lambda p: F.pow(F.col("x") - p["a"], F.lit(2.0)), rounds=30)
    assert abs(out["values"]["a"] - 5) < 0.3
    gain = studies.information_value(df, F.col("x"), [0.0, 10.0], lambda c: -F.abs(F.col("x") - c)).first()
    assert gain.with_information >= gain.without_information and abs(gain.with_information + 25 / 11) < 1e-9


def test_early_exercise_near_the_lattice(spark):
    from panelmc.plans.queries import QUERIES

    r = QUERIES["american_put"](spark, "").first()
    assert abs(r.price - 4.45) < 4 * r.std_error + 0.06


DOCUMENT = {
    "simulation_settings": {"duration": {"value": 1, "unit": "h"}, "timestep": {"value": 15, "unit": "min"}, "n_realizations": 3},
    "elements": [
        {"id": "late", "primitive": "node", "value_rule": "lag", "input": "flow", "initial": 7},
        {"id": "flow", "primitive": "node", "value_rule": "expression", "expression": {"ast": {"op": "if", "cond": {"op": "gte", "left": {"op": "time_ref", "property": "elapsed"}, "right": {"op": "literal", "value": 30}}, "then": {"op": "literal", "value": 2}, "else": {"op": "call", "fn": "max", "args": [{"op": "literal", "value": 1}, {"op": "ref", "element_id": "nothing"}]}}}},
        {"id": "tank", "primitive": "stock", "initial_value": {"value": 10}, "rate": {"ast": {"op": "neg", "operand": {"op": "ref", "element_id": "flow"}}}},
        {"id": "curve", "primitive": "node", "value_rule": "lookup", "table": {"x": [0, 10], "y": [0, 100]}},
        {"id": "read", "primitive": "node", "value_rule": "expression", "expression": {"ast": {"op": "lookup_call", "element_id": "curve", "input": {"op": "ref", "element_id": "late"}}}},
    ],
}


def test_model_documents(spark):
    rows = model.run(spark, DOCUMENT).where("real = 1").orderBy("step").collect()
    assert [(r.flow, r.late, r.tank, r.read) for r in rows] == [(1, 7, -5, 70), (1, 1, -20, 10), (2, 1, -50, 10), (2, 2, -80, 20)]
    assert model.validate(DOCUMENT)["ok"]
    circle = {"elements": [{"id": "a", "value_rule": "expression", "expression": {"ast": {"op": "ref", "element_id": "b"}}}, {"id": "b", "value_rule": "expression", "expression": {"ast": {"op": "ref", "element_id": "a"}}}]}
    assert not model.validate(circle)["ok"]
    assert {r.id: r.value for r in model.finals(model.run(spark, DOCUMENT), ["tank", "late"]).where("real = 0").collect()} == {"tank": -80, "late": 2}


def test_expression_trees(spark):
    lit = lambda x: {"op": "literal", "value": x}
    trees = {
        "map": {"op": "vector_map", "over": "d", "body": {"op": "multiply", "left": {"op": "index_ref", "axis": "row"}, "right": lit(2)}},
        "index": {"op": "index", "array": {"op": "array", "elements": [lit(4), lit(5)]}, "indices": [lit(2)]},
        "extern": {"op": "extern_call", "fn": "unknown", "args": []},
        "known": {"op": "extern_call", "fn": "twice", "args": [lit(4)]},
        "logic": {"op": "and", "left": {"op": "not", "operand": lit(0)}, "right": {"op": "eq", "left": lit(1), "right": lit(1)}},
    }
    scope = Scope({}, dimensions={"d": 3}, extern={"twice": lambda x: 2 * x})
    got = one(spark, **{k: column(t, scope) for k, t in trees.items()})
    assert (got["map"], got["index"], got["extern"], got["known"], got["logic"]) == ([2, 4, 6], 5, 0, 8, 1)
    with pytest.raises(NotImplementedError):
        column({"op": "no_such"}, scope)


def test_progressive_runs(spark, tmp_path):
    from panelmc.streaming.progressive import run

    for i in range(6):
        spark.range(i * 200, (i + 1) * 200).selectExpr("id as real").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    done = run(spark, str(tmp_path / "in"), "real long", lambda df: 10 + rng.uniform(1, "p"), str(tmp_path / "c"), tolerance=0.004, least=150)
    assert 150 <= done.total.n < 1200 and done.settled(0.004, 150) and abs(done.total.mean - 10.5) < 0.1
    a, b = Moments(3, 2.0, 2.0), Moments(1, 6.0, 0.0)
    assert a.merged(b) == b.merged(a) and a.merged(b).n == 4 and abs(a.merged(b).mean - 3) < 1e-12


def test_box_complex_ends_at_the_mean(spark):
    from panelmc.plans.queries import QUERIES

    rows = QUERIES["box_complex"](spark, "/root/testdata/sf0.001").collect()
    mean = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").selectExpr("avg(l_quantity) as a", "avg(l_discount) as b").first()
    got = {r.element_id: r.value for r in rows}
    assert all(r.converged for r in rows) and abs(got["a"] - float(mean.a)) < 0.1 and abs(got["b"] - float(mean.b)) < 5e-4


@pytest.mark.parametrize("rate", [50, 1000, 5000])
def test_poisson_and_negative_binomial_of_large_rates(spark, rate):
    n, p = 20_000, 0.5
    one = dists.slotted("poisson", float(rate), seed=3, element="n")
    two = dists.slotted("negative_binomial", float(rate), p, seed=3, element="m")
    r = spark.range(n).select(F.col("id").alias("real")).select(one.alias("x"), two.alias("y")).selectExpr("avg(x) mx", "var_samp(x) vx", "avg(y) my", "var_samp(y) vy", "count(distinct x) k").first()
    for m, v, mean, var in ((r.mx, r.vx, rate, rate), (r.my, r.vy, rate, 2 * rate)):
        assert abs(m - mean) < 5 * (var / n) ** 0.5 and abs(v / var - 1) < 0.06
    assert r.k > 30


def test_histogram_without_values(spark):
    from panelmc.operators.reducers import histogram

    none = spark.createDataFrame([(None,)], "v double")
    assert histogram(none, "v", 4).collect() == histogram(none.limit(0), "v", 4).collect() == []
    assert [r.cdf for r in histogram(spark.range(4), "id", 2).collect()] == [0.5, 1.0]
