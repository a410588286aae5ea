"""The registered queries over the test tables, each with its DuckDB twin where SQL can state it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmc.functions import arrays as A
from panelmc.functions import dists, rng
from panelmc.functions import numerics as N
from panelmc.functions.lookup import Table, bilinear
from panelmc.functions.units import calendar, convert, elapsed, plain_calendar
from panelmc.operators import designs, folds, reducers, studies
from panelmc.operators.asof import asof
from panelmc.operators.steps import Steps, allocation, at_least
from panelmc.plans import model
from panelmc.plans.expr import Scope, column
from panelmc.sources.tables import lines, panel, realizations, table, walks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SEED = 42


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)


# draws ---------------------------------------------------------------------------------------------------------------

DRAWS = 2000
FAMILIES: dict[str, dists.Family] = {
    "uniform": dists.uniform(-2, 5),
    "normal": dists.normal(10, 3),
    "lognormal": dists.lognormal(0.5, 0.4),
    "lognormal_moments": dists.lognormal_moments(8500, 1800),
    "triangular": dists.triangular(2.5, 3, 4),
    "trapezoidal": dists.trapezoidal(0, 2, 5, 9),
    "exponential": dists.exponential(4),
    "weibull": dists.weibull(1.7, 3),
    "discrete_uniform": dists.discrete_uniform(1, 6),
    "bernoulli": dists.bernoulli(0.3),
    "discrete": dists.discrete([1, 5, 10], [2, 1, 1]),
    "pareto": dists.pareto(3, 2, 1),
    "extreme_value": dists.extreme_value(5, 2),
    "cumulative": dists.cumulative([(0, 0), (2, 0.3), (3, 0.8), (10, 1)]),
    "sampled": dists.sampled([3, 1, 4, 1, 5, 9, 2, 6]),
    "log_uniform": dists.log_uniform(1, 100),
    "log_triangular": dists.log_triangular(1, 4, 50),
    "log_cumulative": dists.log_cumulative([(1, 0), (5, 0.5), (20, 1)]),
    "triangular1090": dists.triangular1090(10, 14, 25),
    "extreme_probability": dists.extreme_probability(dists.normal(0, 1), 12),
    "truncated_normal": dists.truncated_normal(0, 1, -0.5, 2),
}


def _draws(name: str, family: dists.Family) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return realizations(spark, DRAWS).select("real", r(family.quantile(rng.uniform(SEED, name))).alias("value"))

    return run


for _name, _family in FAMILIES.items():
    QUERIES[f"mc_{_name}"] = _draws(_name, _family)
    ORACLE_SQL[f"mc_{_name}"] = f"select real, round({_family.twin('u')}, 6) as value from (select i as real, {rng.sql(SEED, _name, 'i')} as u from range({DRAWS}) t(i))"

SLOTTED = {"gamma": (2.5, 2.0), "beta": (2.0, 5.0), "beta_success_failure": (7, 3), "pert": (1.0, 4.0, 12.0), "pearson_v": (4.0, 3.0), "pearson_iii": (10.0, 2.0, 0.8), "student_t": (6.0,), "poisson": (3.5,), "negative_binomial": (4.0, 0.4), "binomial": (20, 0.3)}


def _moments(name: str, params: tuple) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return reducers.summary(realizations(spark, 20_000).withColumn("value", dists.slotted(name, *params, seed=SEED, element=name)), "value")

    return run


for _name, _params in SLOTTED.items():
    QUERIES[f"mc_{_name}"] = _moments(_name, _params)


@query(f"select real, round((row_number() over (order by o, real) - 1 + u) / 1000.0::double, 9) as u from (select i as real, {rng.sql(SEED, 'lhs', 'i', slot=1)} as o, {rng.sql(SEED, 'lhs', 'i', slot=2)} as u from range(1000) t(i))")
def lhs_strata(spark, folder):
    return designs.strata(realizations(spark, 1000), SEED, "lhs", 1000, "u").select("real", r(F.col("u"), 9).alias("u"))


def _z(name: str, step: str = "0") -> str:
    return dists.norm_ppf_sql(rng.sql(SEED, name, "real", step))


@query(
    f"""with z as (select real, {dists.norm_ppf_sql("u1")} as a, {dists.norm_ppf_sql("u2")} as b from (select i as real, {rng.sql(SEED, "c1", "i")} as u1, {rng.sql(SEED, "c2", "i")} as u2 from range(1000) t(i)))
select real, round(a, 6) as x, round(a * 0.6::double + b * sqrt(1 - 0.6::double * 0.6::double), 6) as y from z"""
)
def gaussian_copula(spark, folder):
    x, y = designs.copula([dists.norm_ppf(rng.uniform(SEED, "c1")), dists.norm_ppf(rng.uniform(SEED, "c2"))], [[1, 0.6], [0.6, 1]])
    return realizations(spark, 1000).select("real", r(x).alias("x"), r(y).alias("y"))


@query()
def iman_conover(spark, folder):
    df = realizations(spark, 2000).select("real", dists.exponential(4).quantile(rng.uniform(SEED, "e")).alias("x"), dists.uniform(0, 1).quantile(rng.uniform(SEED, "f")).alias("y"))
    return designs.rank_correlated(df, ["x", "y"], [[1, 0.7], [0.7, 1]], 2000)


@query(
    f"""with z as (select i as real, s as step, {dists.norm_ppf_sql("u")} as z from (select i, s, {rng.sql(SEED, "gbm", "i", "s")} as u from range(300) t(i), range(12) k(s)))
select real, step, round(100 * exp(sum((0.05::double - 0.02::double) / 12 + 0.2::double * sqrt(1 / 12.0::double) * z) over (partition by real order by step)), 6) as level from z"""
)
def gbm_path(spark, folder):
    z = dists.norm_ppf(rng.uniform(SEED, "gbm", "real", F.col("step")))
    grown = F.sum((0.05 - 0.02) / 12 + 0.2 * math.sqrt(1 / 12) * z).over(Steps(["real"], ["step"]).rows(None))
    return panel(spark, 300, 12).select("real", "step", r(100 * F.exp(grown)).alias("level"))


def _recursive(source: str, init: str, step: str, out: str, keys: str = "real, step") -> str:
    """DuckDB: a recurrence over rows (k, n from 1, x) of `source`; init and step read e (the row) and r (the row before)."""
    return f"with recursive e as ({source}), r as (select e.k, e.id, e.n, {init} from e where n = 1 union all select e.k, e.id, e.n, {step} from r join e on e.k = r.k and e.n = r.n + 1) select {out} from r"


_NOISE = "select i as k, s as id, s + 1 as n, {z} as x from (select i, s, {u} as u from range(200) t(i), range(15) w(s))"


@query(_recursive(_NOISE.format(z=dists.norm_ppf_sql("u"), u=rng.sql(SEED, "ou", "i", "s")), "5 + 0.3::double * (4 - 5) + 0.5::double * e.x as s", "r.s + 0.3::double * (4 - r.s) + 0.5::double * e.x", "k as real, id::int as step, round(s, 6) as level"))
def ou_process(spark, folder):
    df = panel(spark, 200, 15).withColumn("z", dists.norm_ppf(rng.uniform(SEED, "ou", "real", F.col("step"))))
    return folds.fold(df, ["real"], ["step"], ["z"], ["level"], folds.ornstein_uhlenbeck(0.3, 4, 0.5, 5)).select("real", "step", r(F.col("level")).alias("level"))


@query(_recursive(_NOISE.format(z=dists.norm_ppf_sql("u"), u=rng.sql(SEED, "ar", "i", "s")), "e.x as s", "0.8::double * r.s + 0.6::double * e.x", "k as real, id::int as step, round(s, 6) as score"))
def ar1_scores(spark, folder):
    df = panel(spark, 200, 15).withColumn("z", dists.norm_ppf(rng.uniform(SEED, "ar", "real", F.col("step"))))
    return folds.fold(df, ["real"], ["step"], ["z"], ["score"], folds.autocorrelated(0.8)).select("real", "step", r(F.col("score")).alias("score"))


@query(
    f"""with d as (select i as real, s as step, {rng.sql(SEED, "re", "i", "s")} as u from range(200) t(i), range(15) w(s))
select real, step::int as step, round(last_value(case when step % 4 = 0 then u end ignore nulls) over (partition by real order by step), 9) as held from d"""
)
def resampling_hold(spark, folder):
    axis = Steps(["real"], ["step"])
    return panel(spark, 200, 15).select("real", "step", r(axis.held(rng.uniform(SEED, "re", "real", F.col("step")), F.col("step") % 4 == 0), 9).alias("held"))


@query(
    f"""with x as (select 3 + {dists.norm_ppf_sql("u")} as x from (select {rng.sql(SEED, "is", "i")} as u from range(5000) t(i)))
select round(avg(case when x > 3 then exp(0.5 * (x - 3) * (x - 3) - 0.5 * x * x) else 0 end), 9) as tail, count(*) as n from x"""
)
def importance_tail(spark, folder):
    x = 3 + dists.norm_ppf(rng.uniform(SEED, "is"))
    df = realizations(spark, 5000).select(x.alias("x"))
    w = designs.importance(F.col("x"), {"mean": 0, "sd": 1}, {"mean": 3, "sd": 1})
    return df.agg(r(F.avg(F.when(F.col("x") > 3, w).otherwise(0.0)), 9).alias("tail"), F.count("*").alias("n"))


_CALL = "greatest(0, 100 * exp(0.03::double + 0.2::double * {z}) - 100) * exp(-0.05::double)"


@query(
    f"""with z as (select {dists.norm_ppf_sql("u")} as z from (select {rng.sql(SEED, "bs", "i")} as u from range(5000) t(i))), p as (select {_CALL.format(z="z")} as a, {_CALL.format(z="(-z)")} as b from z)
select round(avg(a), 6) as plain, round(stddev_samp(a), 6) as plain_std, round(avg((a + b) / 2), 6) as antithetic, round(stddev_samp((a + b) / 2), 6) as antithetic_std from p"""
)
def antithetic_bs(spark, folder):
    def pay(z: Column) -> Column:
        return F.greatest(F.lit(0.0), 100 * F.exp(0.03 + 0.2 * z) - 100) * math.exp(-0.05)

    df = realizations(spark, 5000).select(dists.norm_ppf(rng.uniform(SEED, "bs")).alias("z")).select(pay(F.col("z")).alias("a"), pay(-F.col("z")).alias("b"))
    both = (F.col("a") + F.col("b")) / 2
    return df.agg(r(F.avg("a")).alias("plain"), r(F.stddev_samp("a")).alias("plain_std"), r(F.avg(both)).alias("antithetic"), r(F.stddev_samp(both)).alias("antithetic_std"))


# reducers ------------------------------------------------------------------------------------------------------------


def _at(p: float, x: str = "xs") -> str:
    return f"{x}[floor({p / 100!r}::double * (len({x}) - 1) + 0.5)::int + 1]"


@query("select l_returnflag, count(*) as n, round(avg(l_quantity), 6) as mean, round(stddev_samp(l_quantity), 6) as std, min(l_quantity) as low, max(l_quantity) as high, round(sum(l_quantity), 3) as total from lineitem group by all")
def realization_summary(spark, folder):
    out = reducers.summary(lines(spark, folder), "l_quantity", ["l_returnflag"])
    return out.withColumns({"mean": r(F.col("mean")), "std": r(F.col("std")), "total": r(F.col("total"), 3)})


@query("with s as (select l_returnflag, list_sort(list(l_extendedprice)) as xs from lineitem group by all) select l_returnflag, " + ", ".join(f"{_at(p)} as p{p:g}" for p in reducers.BANDS) + " from s")
def percentile_bands(spark, folder):
    return reducers.percentiles(lines(spark, folder), "l_extendedprice", keys=["l_returnflag"])


@query("with s as (select list_sort(list(l_extendedprice)) as xs from lineitem) select " + ", ".join(f"{_at(p)} as p{f'{p:g}'.replace('.', '_')}" for p in (0.0, 12.5, 50.0, 99.0, 100.0)) + " from s")
def percentile_global(spark, folder):
    return reducers.percentiles(lines(spark, folder), "l_extendedprice", (0.0, 12.5, 50.0, 99.0, 100.0))


@query(f"with s as (select l_returnflag, list_sort(list(l_extendedprice)) as xs from lineitem group by all) select l_returnflag, round(avg(l_extendedprice), 4) as cte from lineitem join s using (l_returnflag) where l_extendedprice >= {_at(95)} group by all")
def cte_price(spark, folder):
    return reducers.tail_mean(lines(spark, folder), "l_extendedprice", 95, ["l_returnflag"]).withColumn("cte", r(F.col("cte"), 4))


@query("select t as threshold, round(avg(case when l_quantity > t then 1.0::double else 0 end), 9) as exceeds, round(avg(case when l_quantity <= t then 1.0::double else 0 end), 9) as below from lineitem, (values (5), (25), (45)) v(t) group by all")
def exceedance_curve(spark, folder):
    q = F.col("l_quantity")
    at = (5, 25, 45)
    sums = lines(spark, folder).agg(*[c.alias(f"{k}{t}") for t in at for k, c in (("e", reducers.exceedance(q, t)), ("b", reducers.cumulative_prob(q, t)))])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), r(F.col(f"e{t}"), 9).alias("exceeds"), r(F.col(f"b{t}"), 9).alias("below")) for t in at]))
    return sums.select(rows.alias("v")).select("v.*")


@query(
    f"""with s as (select l_linestatus, list_sort(list(l_quantity)) as xs, avg(l_quantity) as m, stddev_samp(l_quantity) as s, count(*) as n from lineitem group by all),
k as (select l_linestatus, avg(pow(l_quantity - m, 2)) as m2, avg(pow(l_quantity - m, 3)) as m3, avg(pow(l_quantity - m, 4)) as m4, avg(case when l_quantity >= {_at(95)} then l_quantity end) as cte from lineitem join s using (l_linestatus) group by all)
select l_linestatus, n, round(m, 6) as mean, round(s, 6) as std, round(1.959963984540054::double * s / sqrt(n), 6) as ci_half_width, round(m3 / pow(m2, 1.5), 6) as skewness, round(m4 / (m2 * m2) - 3, 6) as excess_kurtosis, round(cte, 6) as cte from s join k using (l_linestatus)"""
)
def final_stats(spark, folder):
    out = reducers.final_stats(lines(spark, folder), "l_quantity", ["l_linestatus"])
    return out.select("l_linestatus", "n", *[r(F.col(c)).alias(c) for c in ("mean", "std", "ci_half_width", "skewness", "excess_kurtosis", "cte")])


@query("select l_returnflag, round(sum(l_discount * l_quantity) / sum(l_discount), 6) as weighted_mean, round(sqrt(sum(l_discount * l_quantity * l_quantity) / sum(l_discount) - pow(sum(l_discount * l_quantity) / sum(l_discount), 2)), 6) as weighted_std from lineitem group by all")
def weighted_stats(spark, folder):
    out = reducers.weighted(lines(spark, folder), "l_quantity", "l_discount", ["l_returnflag"])
    return out.select("l_returnflag", r(F.col("weighted_mean")).alias("weighted_mean"), r(F.col("weighted_std")).alias("weighted_std"))


@query(
    """with c as (select l_returnflag, l_quantity, sum(sum(l_tax)) over (partition by l_returnflag order by l_quantity) as run, sum(sum(l_tax)) over (partition by l_returnflag) as total from lineitem group by l_returnflag, l_quantity)
select l_returnflag, min(l_quantity) as weighted_percentile from c where run >= total * 0.703::double - 1e-12 group by all"""
)
def weighted_percentile(spark, folder):
    return reducers.weighted_percentile(lines(spark, folder), "l_quantity", "l_tax", 70.3, ["l_returnflag"])


@query(
    """with b as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi, count(*) as n from lineitem), h as (select least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19)::int as bin, count(*) as c from lineitem, b group by all), a as (select i::int as bin, coalesce(c, 0) as c from range(20) t(i) left join h on h.bin = i)
select bin, round(lo + bin * ((hi - lo) / 20), 4) as "left", round(c / (n * ((hi - lo) / 20)), 12) as pdf, round(sum(c) over (order by bin) / n::double, 9) as cdf, round(1 - sum(c) over (order by bin) / n::double, 9) as ccdf from a, b"""
)
def pdf_cdf(spark, folder):
    out = reducers.histogram(lines(spark, folder), "l_extendedprice", 20)
    return out.select("bin", r(F.col("left"), 4).alias("left"), r(F.col("pdf"), 12).alias("pdf"), r(F.col("cdf"), 9).alias("cdf"), r(F.col("ccdf"), 9).alias("ccdf"))


@query("select l_returnflag, round(covar_samp(l_quantity, l_extendedprice), 2) as covariance, round(corr(l_quantity, l_extendedprice), 6) as correlation, round(covar_samp(l_quantity, l_extendedprice) / var_samp(l_quantity), 4) as beta from lineitem group by all")
def run_stat2_pairs(spark, folder):
    cs = reducers.pair("l_quantity", "l_extendedprice")
    digits = {"covariance": 2, "correlation": 6, "beta": 4}
    return lines(spark, folder).groupBy("l_returnflag").agg(*[r(c, digits[k]).alias(k) for k, c in cs.items()])


@query(
    """with m as (select var_samp(l_quantity) as aa, covar_samp(l_quantity, l_discount) as ab, var_samp(l_discount) as bb, covar_samp(l_quantity, l_extendedprice) as ay, covar_samp(l_discount, l_extendedprice) as by_ from lineitem)
select 'l_quantity' as control, round((ay * bb - by_ * ab) / (aa * bb - ab * ab), 4) as slope from m union all select 'l_discount', round((by_ * aa - ay * ab) / (aa * bb - ab * ab), 4) from m"""
)
def run_regress2(spark, folder):
    names = ["l_quantity", "l_discount"]
    return spark.createDataFrame([(n, round(s, 4)) for n, s in zip(names, reducers.slopes(lines(spark, folder), "l_extendedprice", names), strict=True)], "control string, slope double")


@query(
    """select k::bigint as fold, round(covar_samp(l_quantity, l_extendedprice) / var_samp(l_quantity), 4) as beta from lineitem, range(5) t(k) where l_orderkey % 5 <> k group by all"""
)
def split_beta_folds(spark, folder):
    return reducers.split_beta(lines(spark, folder), "l_quantity", "l_extendedprice", F.col("l_orderkey") % 5, 5).withColumn("beta", r(F.col("beta"), 4))


@query("select l_returnflag, round(sum(abs(l_quantity - m)), 3) as spread, count(*) filter (l_quantity > m) as above from lineitem, (select avg(l_quantity) as m from lineitem) group by all")
def run_stat_center(spark, folder):
    rows = lines(spark, folder)
    mean = rows.agg(F.avg("l_quantity").alias("m"))
    d = F.col("l_quantity") - mean.scalar()
    return rows.select("l_returnflag", d.alias("d")).groupBy("l_returnflag").agg(r(F.sum(F.abs("d")), 3).alias("spread"), F.count(F.when(F.col("d") > 0, 1)).alias("above"))


@query(
    """with m as (select covar_samp(l_quantity, l_extendedprice) / var_samp(l_quantity) as b, avg(l_quantity) as e from lineitem where l_linestatus = 'O'), y as (select l_extendedprice as y, l_extendedprice - b * (l_quantity - e) as c from lineitem, m where l_linestatus = 'O')
select round(avg(y), 4) as plain, round(avg(c), 4) as controlled, round(stddev_samp(c) / stddev_samp(y), 6) as std_ratio from y"""
)
def control_variate(spark, folder):
    rows = lines(spark, folder).where("l_linestatus = 'O'")
    m = rows.agg(reducers.pair("l_quantity", "l_extendedprice")["beta"].alias("b"), F.avg("l_quantity").alias("e")).first()
    c = F.col("l_extendedprice") - m.b * (F.col("l_quantity") - m.e)
    return rows.select(F.col("l_extendedprice").alias("y"), c.alias("c")).agg(r(F.avg("y"), 4).alias("plain"), r(F.avg("c"), 4).alias("controlled"), r(F.stddev_samp("c") / F.stddev_samp("y")).alias("std_ratio"))


@query()
def jackknife_bands(spark, folder):
    """Bands of a compounding panel by step."""
    df = panel(spark, 500, 10).withColumn("x", rng.uniform(SEED, "hist", "real", F.col("step")))
    return model.history(df.withColumn("level", Steps(["real"], ["step"]).stock(0.0, F.col("x"))), "level")


# steps ---------------------------------------------------------------------------------------------------------------

USER = Steps(["user_id"], ["ts", "event_id"])


def V() -> Column:
    return F.col("value")


_W = "over (partition by user_id order by ts, event_id)"
_WR = "over (partition by user_id order by ts, event_id rows between {} preceding and current row)"


def _walk(spark: SparkSession, folder: str, **columns: Column) -> DataFrame:
    return walks(spark, folder).select("user_id", "event_id", *[c.alias(k) for k, c in columns.items()])


@query(f"select user_id, event_id, round(value - coalesce(lag(value) {_W}, 0), 6) as delta from events")
def lag_delta(spark, folder):
    return _walk(spark, folder, delta=r(V() - USER.lag(V())))


@query(f"select user_id, event_id, case when lag(event_type) {_W} <> event_type then 1.0::double else 0 end as changed from events")
def changed_flag(spark, folder):
    return _walk(spark, folder, changed=USER.changed(F.col("event_type")))


@query("select user_id, event_id, " + ", ".join(f"round({f}(value) {_WR.format(4)}, 9) as {k}" for k, f in (("mean", "avg"), ("low", "min"), ("high", "max"), ("total", "sum"))) + " from events")
def filter_rolling(spark, folder):
    return _walk(spark, folder, **{k: r(USER.rolling(h, V(), 5), 9) for k, h in (("mean", "mean"), ("low", "min"), ("high", "max"), ("total", "sum"))})


@query(f"select user_id, event_id, round(avg(value) {_WR.format('unbounded')}, 9) as mean, max(value) {_WR.format('unbounded')} as high from events")
def filter_expanding(spark, folder):
    return _walk(spark, folder, mean=r(USER.rolling("mean", V()), 9), high=USER.rolling("max", V()))


@query(f"select user_id, event_id, round(100 + sum((value - 50) * 0.5) {_WR.format('unbounded')}, 4) as level from events")
def stock_cumulative(spark, folder):
    return _walk(spark, folder, level=r(USER.stock(100, V() - 50, 0.5), 4))


@query(f"select user_id, event_id, round(1000 * exp(sum(ln(1 + least(value, 100) / 10000)) {_WR.format('unbounded')}), 4) as balance from events where value >= 0")
def compound_growth(spark, folder):
    return walks(spark, folder).where("value >= 0").select("user_id", "event_id", r(USER.compound(1000, F.least(V(), F.lit(100.0)) / 10000), 4).alias("balance"))


@query(
    f"""with n as (select user_id, event_id, ts, value, (row_number() {_W} - 1)::double as step from events)
select user_id, event_id, coalesce(min(case when value > 80 then step end) {_WR.format("unbounded")}, -1) as reached from n"""
)
def milestone_first(spark, folder):
    rows = walks(spark, folder).withColumn("step", USER.number().cast("double"))
    return rows.select("user_id", "event_id", F.nanvl(USER.milestone(V() > 80, F.col("step")), F.lit(-1.0)).alias("reached"))


@query(f"select user_id, event_id, coalesce(last_value(case when event_type = 'purchase' then 1.0::double when event_type = 'click' then 0 end ignore nulls) {_W}, 0) as on_ from events")
def status_latch(spark, folder):
    t = F.col("event_type")
    return _walk(spark, folder, on_=USER.status(t == "purchase", t == "click"))


@query(f"select user_id, event_id, coalesce(last_value(case when value >= 70 then 1.0::double when value <= 30 then 0 end ignore nulls) {_W}, 0) as state from events")
def hysteresis_state(spark, folder):
    return _walk(spark, folder, state=USER.hysteresis(V(), 30, 70))


@query(f"select user_id, event_id from (select user_id, event_id, row_number() {_W} - 1 as n from events) where n > 0 and n % 7 = 0")
def periodic_trigger(spark, folder):
    return walks(spark, folder).select("user_id", "event_id", USER.periodic(7).alias("fires")).where("fires").drop("fires")


@query(f"select user_id, event_id, round(value * 0.5 + coalesce(lag(value) {_W}, 0) * 0.3 + coalesce(lag(value, 2) {_W}, 0) * 0.2, 6) as response from events")
def convolution_kernel(spark, folder):
    return _walk(spark, folder, response=r(USER.convolution(V(), [0.5, 0.3, 0.2])))


@query(f"select user_id, event_id, round(coalesce(lag(value, 3) {_W}, 0) * exp(-0.1::double * 3), 6) as arrived from events")
def plug_flow(spark, folder):
    return _walk(spark, folder, arrived=r(USER.delayed(V(), 3, 0.1)))


@query(
    """with n as (select user_id, value, floor((row_number() over (partition by user_id order by ts, event_id) - 1) / 5)::bigint as period, row_number() over (partition by user_id order by ts, event_id) as n from events)
select user_id, period, round(sum(value) * 0.5, 4) as accumulated, round(avg(value), 6) as average, round(arg_max(value, n) - arg_min(value, n), 6) as change, round((arg_max(value, n) - arg_min(value, n)) / (count(*) * 0.5), 6) as rate_of_change from n group by all"""
)
def reporting_periods(spark, folder):
    per = reducers.effective_steps(2.5, 0.5)
    rows = walks(spark, folder).withColumn("n", USER.number()).withColumn("period", F.floor(F.col("n") / per))
    change = F.max_by("value", "n") - F.min_by("value", "n")
    return rows.groupBy("user_id", "period").agg(r(F.sum("value") * 0.5, 4).alias("accumulated"), r(F.avg("value")).alias("average"), r(change).alias("change"), r(change / (F.count("*") * 0.5)).alias("rate_of_change"))


@query("select user_id, n::int as step, value from (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as n from events) where n in (0, 5, 10)")
def capture_steps(spark, folder):
    return walks(spark, folder).withColumn("step", USER.number()).where(F.col("step").isin(0, 5, 10)).select("user_id", "step", "value")


@query("select user_id, round(avg(value), 6) as mean, max(value) as peak, min(value) as valley, round(sum(value), 4) as total, arg_min(value, (ts, event_id)) as first from events group by all")
def objective_reduce(spark, folder):
    order = F.struct("ts", "event_id")
    rows = {"mean": r(reducers.objective(V(), order, "mean")), "peak": reducers.objective(V(), order, "peak"), "valley": reducers.objective(V(), order, "valley"), "total": r(reducers.objective(V(), order, "sum"), 4), "first": reducers.objective(V(), order, "first")}
    return walks(spark, folder).groupBy("user_id").agg(*[c.alias(k) for k, c in rows.items()])


@query(
    """with b as (select *, coalesce(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows between unbounded preceding and 1 preceding), 0) as before from lineitem)
select l_orderkey, l_linenumber, l_partkey, round(least(l_quantity, greatest(60 - before, 0)), 6) as granted from b"""
)
def priority_allocation(spark, folder):
    rows = table(spark, folder, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", r(allocation(F.col("l_quantity"), F.lit(60.0), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])).alias("granted"))


@query("select o_orderkey, case when (case when o_totalprice > 150000 then 1 else 0 end) + (case when o_orderstatus = 'O' then 1 else 0 end) + (case when o_orderpriority like '1%' then 1 else 0 end) >= 2 then 1.0::double else 0 end as passes from orders")
def gate_kofn(spark, folder):
    votes = [N.flag(F.col("o_totalprice") > 150000), N.flag(F.col("o_orderstatus") == "O"), N.flag(F.col("o_orderpriority").startswith("1"))]
    return table(spark, folder, "orders").select("o_orderkey", at_least(2, *votes).alias("passes"))


@query(
    """with l as (select e.event_id, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as price from events e join orders o on o.o_custkey = e.user_id and o.o_orderdate <= e.ts group by all)
select e.event_id, e.user_id, l.price as o_totalprice from events e left join l using (event_id)"""
)
def series_asof(spark, folder):
    left = table(spark, folder, "events").select("event_id", "user_id", "ts")
    right = table(spark, folder, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"), "o_totalprice", "o_orderkey")
    return asof(left, right, ["user_id"], "ts", ["o_totalprice"], "o_orderkey").select("event_id", "user_id", "o_totalprice")


# folds ---------------------------------------------------------------------------------------------------------------

_EVENTS = "select user_id as k, event_id as id, row_number() over (partition by user_id order by ts, event_id) as n, {x} as x from events"


def _folded(spark: SparkSession, folder: str, inputs: dict[str, Column], outputs: list[str], rule: folds.Rule, digits: int = 6) -> DataFrame:
    rows = walks(spark, folder).select("user_id", "ts", "event_id", *[c.alias(k) for k, c in inputs.items()])
    out = folds.fold(rows, ["user_id"], ["ts", "event_id"], list(inputs), outputs, rule)
    return out.select("user_id", "event_id", *[r(F.col(o), digits).alias(o) for o in outputs])


@query(_recursive(_EVENTS.format(x="value"), "e.x as s", "r.s + (2 / 6.0::double) * (e.x - r.s)", "k as user_id, id as event_id, round(s, 6) as smooth"))
def ema_fold(spark, folder):
    return _folded(spark, folder, {"x": V()}, ["smooth"], folds.ema(5))


@query(_recursive(_EVENTS.format(x="value - 50"), "least(greatest(20 + e.x, 0), 100)::double as s, greatest(0, greatest(20 + e.x, 0) - 100)::double as o", "least(greatest(r.s + e.x, 0), 100), greatest(0, greatest(r.s + e.x, 0) - 100)", "k as user_id, id as event_id, round(s, 6) as level, round(o, 6) as overflow"))
def stock_floor_capacity(spark, folder):
    return _folded(spark, folder, {"rate": V() - 50}, ["level", "overflow"], folds.stock(20, 0, 100))


@query(
    _recursive(
        _EVENTS.format(x="case when abs(60 - value) < 5 then 0 else 60 - value end"),
        "e.x as i, e.x as last, least(40, greatest(-40, 0.5 * e.x + 0.1 * e.x)) as out",
        "r.i + e.x, e.x, least(40, greatest(-40, 0.5 * e.x + 0.1 * (r.i + e.x) + 0.2 * (e.x - r.last)))",
        "k as user_id, id as event_id, round(out, 6) as control",
    )
)
def pid_loop(spark, folder):
    return _folded(spark, folder, {"x": V()}, ["control"], folds.pid(0.5, 0.1, 0.2, 60, -40, 40, 5))


@query(_recursive(_EVENTS.format(x="value"), "case when e.x > 55 then 1 else 0 end as s", "case when e.x > 55 then 1 when e.x < 45 then 0 else r.s end", "k as user_id, id as event_id, s * 8.0::double as output"))
def on_off_control(spark, folder):
    return _folded(spark, folder, {"x": V()}, ["output"], folds.on_off(50, 10, 8))


@query(
    _recursive(
        _EVENTS.format(x=rng.sql(SEED, "markov", "event_id")),
        "0 as s, e.x as u",
        "case r.s when 0 then (case when r.u <= 0.7::double then 0 when r.u <= 0.7::double + 0.2::double then 1 else 2 end) when 1 then (case when r.u <= 0.3::double then 0 when r.u <= 0.3::double + 0.4::double then 1 else 2 end) else (case when r.u <= 0.5::double then 0 else 2 end) end, e.x",
        "k as user_id, id as event_id, case s when 0 then 10.0::double when 1 then 20 else 30 end as state",
    )
)
def markov_chain(spark, folder):
    return _folded(spark, folder, {"u": rng.uniform(SEED, "markov", "event_id")}, ["state"], folds.markov([[0.7, 0.2, 0.1], [0.3, 0.4, 0.3], [0.5, 0.0, 0.5]], [10, 20, 30]))


@query(f"select user_id, event_id, round(coalesce(lag(greatest(value, 0), 3) {_W}, 0) * exp(-0.15::double), 6) as throughput, round(sum(greatest(value, 0)) {_WR.format(2)}, 4) as held from events")
def queue_throughput(spark, folder):
    return _folded(spark, folder, {"x": V()}, ["throughput", "held"], folds.queue(3, leak=0.05)).withColumn("held", r(F.col("held"), 4))


@query(
    _recursive(
        _EVENTS.format(x="value"),
        "e.x * pow(0.5, 1 / 2.0::double) as a, e.x * (1 - pow(0.5, 1 / 2.0::double)) * pow(0.5, 1 / 5.0::double) as b",
        "(r.a + e.x) * pow(0.5, 1 / 2.0::double), (r.b + (r.a + e.x) * (1 - pow(0.5, 1 / 2.0::double))) * pow(0.5, 1 / 5.0::double)",
        "k as user_id, id as event_id, round(a, 4) as parent, round(b, 4) as child",
    )
)
def decay_chain(spark, folder):
    return _folded(spark, folder, {"x": V()}, ["parent", "child"], folds.decay_chain([2, 5]), 4)


@query(
    _recursive(
        _EVENTS.format(x=rng.sql(SEED, "fail", "event_id")),
        "case when e.x < 0.1::double then 2 else 0 end as s, case when e.x < 0.1::double then 0.0::double else 1 end as w",
        "case when r.s > 0 then r.s - 1 when e.x < 0.1::double then 2 else 0 end, case when r.s > 0 or e.x < 0.1::double then 0.0::double else 1 end",
        "k as user_id, id as event_id, w as works",
    )
)
def repairable_machine(spark, folder):
    return _folded(spark, folder, {"u": rng.uniform(SEED, "fail", "event_id")}, ["works"], folds.repairable(0.1, 3))


@query(
    _recursive(
        _EVENTS.format(x="value"),
        "300 - least(greatest(e.x, 0), 300) - least(10, 300 - least(greatest(e.x, 0), 300)) as s, least(greatest(e.x, 0), 300) as a, least(10, 300 - least(greatest(e.x, 0), 300))::double as b",
        "r.s - least(greatest(e.x, 0), r.s) - least(10, r.s - least(greatest(e.x, 0), r.s)), least(greatest(e.x, 0), r.s), least(10, r.s - least(greatest(e.x, 0), r.s))",
        "k as user_id, id as event_id, round(s, 6) as source, round(a, 6) as first, round(b, 6) as second",
    )
)
def link_priority(spark, folder):
    return _folded(spark, folder, {"first": V(), "second": F.lit(10.0)}, ["source", "a", "b"], folds.links(300)).withColumnsRenamed({"a": "first", "b": "second"})


# arrays --------------------------------------------------------------------------------------------------------------


def X() -> Column:
    return F.col("x")


def _vectors(spark: SparkSession, folder: str, **columns: Column) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return rows.select("vec_id", *[c.alias(k) for k, c in columns.items()])


_XS = "(select vec_id, embedding::double[] as x from embeddings)"


@query(f"select vec_id, round(list_sum(x), 6) as total, round(list_avg(x), 6) as mean, round(list_min(x), 6) as low, round(list_max(x), 6) as high, len(x)::bigint as n from {_XS}")
def array_reduce(spark, folder):
    return _vectors(spark, folder, total=r(A.total(X())), mean=r(A.mean(X())), low=r(A.low(X())), high=r(A.high(X())), n=F.size(X()).cast("long"))


@query(f"select vec_id, list_position(x, list_min(x))::double as lowest, list_position(x, list_max(x))::double as highest from {_XS}")
def argmin_dispatch(spark, folder):
    return _vectors(spark, folder, lowest=A.argmin(X()), highest=A.argmax(X()))


@query(f"select vec_id, round(coalesce(list_sum(list_filter(x, lambda v: v > 0)), 0), 6) as total, round(coalesce(list_avg(list_filter(x, lambda v: v > 0)), 0), 6) as mean, round(coalesce(list_min(list_filter(x, lambda v: v > 0)), 0), 6) as low, len(list_filter(x, lambda v: v > 0))::bigint as n from {_XS}")
def masked_reduce(spark, folder):
    chosen = A.picked(X(), F.transform(X(), lambda v: N.flag(v > 0)))
    return _vectors(spark, folder, total=r(A.total(chosen)), mean=r(A.mean(chosen)), low=r(A.low(chosen)), n=F.size(chosen).cast("long"))


@query(f"select vec_id, round(list_sort(x)[2], 6) as second, list_position(x, list_sort(x)[3])::double as third_at, len(list_filter(x, lambda v: v <= x[1]))::double as rank_of_first from {_XS}")
def sort_rank_index(spark, folder):
    return _vectors(spark, folder, second=r(A.at(A.sort(X()), 2)), third_at=A.at(A.sort_index(X()), 3), rank_of_first=A.at(A.rank(X()), 1))


@query(f"select vec_id, round(list_sum(x[1:5]), 6) as fifth, round(list_sum(x), 6) as last, round(list_product(x[1:3]), 9) as product from {_XS}")
def cumulate_product(spark, folder):
    return _vectors(spark, folder, fifth=r(A.at(A.cumulate(X()), 5)), last=r(F.element_at(A.cumulate(X()), -1)), product=r(A.at(A.cumproduct(X()), 3), 9))


@query(f"select vec_id, round(x[3] + x[1], 6) as gathered, round(list_sum(list_transform(x, lambda v: v * v)), 6) as dot, round(x[2] + 0.5 * (x[3] - x[2]), 6) as between_ from {_XS}")
def gather_dot_interp(spark, folder):
    places = F.array(F.lit(3.0), F.lit(1.0), F.lit(9999.0))
    return _vectors(spark, folder, gathered=r(A.total(A.gather(X(), places))), dot=r(A.dot(X(), X())), between_=r(A.interp(X(), F.lit(2.5))))


@query(f"select vec_id, " + ", ".join(f"round(x[{i}] * x[{3 + j}], 9) as c{i}{j}" for i in (1, 2, 3) for j in (1, 2)) + f", round((x[1] + x[2] + x[3]) * x[5], 9) as column2, round(x[2] * (x[4] + x[5]), 9) as row2 from {_XS}")
def align_outer_product(spark, folder):
    out, axes = A.broadcast(lambda a, b: a * b, F.slice(X(), 1, 3), [("a", 3)], F.slice(X(), 4, 2), [("b", 2)])
    cells = {f"c{i}{j}": r(F.get(out, F.lit((i - 1) * 2 + j - 1)), 9) for i in (1, 2, 3) for j in (1, 2)}
    down, _ = A.along(A.total, out, axes, 1)
    across, _ = A.along(A.total, out, axes, 2)
    return _vectors(spark, folder, **cells, column2=r(F.get(down, F.lit(1)), 9), row2=r(F.get(across, F.lit(1)), 9))


@query(f"select vec_id, round(x[1] + x[4] + x[5] * 0, 6) as shared, round(x[2], 6) as picked from {_XS}")
def align_shared_axis(spark, folder):
    """A shared axis aligns at the shorter length; a subscript takes a slice."""
    out, _ = A.broadcast(lambda a, b: a + b, F.slice(X(), 1, 3), [("k", 3)], F.slice(X(), 4, 2), [("k", 2)])
    part, _ = A.subscript(F.slice(X(), 1, 4), [("p", 2), ("q", 2)], "q", 2)
    return _vectors(spark, folder, shared=r(F.get(out, F.lit(0))), picked=r(F.get(part, F.lit(0))))


# lookups, numerics, calendar, units ----------------------------------------------------------------------------------

CURVE = Table((0.0, 10.0, 20.0, 35.0, 50.0), (1.0, 4.0, 9.0, 12.0, 30.0))
_AT = "(p_size * 1.3::double - 5)"


def _curve_sql(pieces: list[str], first: str, last: str) -> str:
    return f"case when pos < {CURVE.x[0]} then {first} " + " ".join(f"when pos < {b} then {p}" for b, p in zip(CURVE.x[1:], pieces, strict=True)) + f" else {last} end"


def _parts(spark: SparkSession, folder: str, **columns: Column) -> DataFrame:
    rows = table(spark, folder, "part").select("p_partkey", (F.col("p_size") * 1.3 - 5).alias("at"))
    return rows.select("p_partkey", *[c.alias(k) for k, c in columns.items()])




def AT() -> Column:
    return F.col("at")


_K, _AREA = CURVE.slopes(), [0.0, 25.0, 90.0, 247.5, 562.5]
_LIN = [f"{y}::double + (pos - {x}) * {k!r}::double" for x, y, k in zip(CURVE.x, CURVE.y, _K, strict=False)]


@query(
    "select p_partkey, round("
    + _curve_sql(_LIN, "1.0::double", "30.0::double")
    + ", 6) as linear, "
    + _curve_sql([f"{y}::double" for y in CURVE.y[:-1]], "1.0::double", "30.0::double")
    + " as step, round("
    + _curve_sql(_LIN, _LIN[0], f"30.0::double + (pos - 50) * {_K[-1]!r}::double")
    + f", 6) as beyond from (select p_partkey, {_AT} as pos from part)"
)
def lookup_linear_step(spark, folder):
    return _parts(spark, folder, linear=r(CURVE(AT())), step=Table(CURVE.x, CURVE.y, "step")(AT()), beyond=r(Table(CURVE.x, CURVE.y, "linear", "linear")(AT())))


@query(
    "select p_partkey, round("
    + _curve_sql([f"{a}::double + (pos - {x}) * ({y}::double + (pos - {x}) * {k / 2!r}::double)" for a, x, y, k in zip(_AREA, CURVE.x, CURVE.y, _K, strict=False)], "0.0::double", "562.5::double")
    + ", 6) as integral, round("
    + _curve_sql([f"{k!r}::double" for k in _K], f"{_K[0]!r}::double", f"{_K[-1]!r}::double")
    + f", 6) as derivative from (select p_partkey, {_AT} as pos from part)"
)
def lookup_integral_derivative(spark, folder):
    return _parts(spark, folder, integral=r(CURVE.integral(AT())), derivative=r(CURVE.derivative(AT())))


@query(f"with v as (select p_partkey, {_AT} as pos from part), l as (select p_partkey, pos, exp(" + _curve_sql([f"ln({a}::double) + (pos - {x}) * (ln({b}::double) - ln({a}::double)) / {w - x}" for a, b, x, w in zip(CURVE.y, CURVE.y[1:], CURVE.x, CURVE.x[1:], strict=False)], "ln(1.0::double)", "ln(30.0::double)") + ") as y from v) select p_partkey, round(y, 6) as log_linear, round(least(greatest(pos, 0), 50), 6) as round_trip from l")
def lookup_log_inverse(spark, folder):
    return _parts(spark, folder, log_linear=r(Table(CURVE.x, CURVE.y, "log")(AT())), round_trip=r(CURVE.inverse(CURVE(AT()))))


@query(f"select p_partkey, round(least(greatest({_AT}, 0), 50), 5) as by_area from part")
def lookup_inverse_integral(spark, folder):
    return _parts(spark, folder, by_area=r(CURVE.inverse_integral(CURVE.integral(AT())), 5))


@query()
def lookup_cubic(spark, folder):
    return _parts(spark, folder, cubic=r(Table(CURVE.x, CURVE.y, "cubic")(AT())))


@query(
    """with v as (select p_partkey, least(greatest(p_size / 10.0::double, 0), 2) as x, least(greatest(p_retailprice / 1000, 0), 2) as y from part), c as (select *, least(floor(x), 1)::int as i, least(floor(y), 1)::int as j from v),
z as (select *, [[1, 2, 4], [3, 5, 8], [2, 9, 7]] as z from c)
select p_partkey, round((1 - (x - i)) * ((1 - (y - j)) * z[i + 1][j + 1] + (y - j) * z[i + 1][j + 2]) + (x - i) * ((1 - (y - j)) * z[i + 2][j + 1] + (y - j) * z[i + 2][j + 2]), 6) as surface from z"""
)
def lookup_bilinear(spark, folder):
    rows = table(spark, folder, "part")
    return rows.select("p_partkey", r(bilinear((0, 1, 2), (0, 1, 2), ((1, 2, 4), (3, 5, 8), (2, 9, 7)), F.col("p_size") / 10, F.col("p_retailprice") / 1000)).alias("surface"))


@query(
    """select c_custkey, case when c_acctbal = 0 then 9e9 else round(1000 / c_acctbal, 6) end as ratio, round(c_acctbal - trunc(c_acctbal / 7) * 7, 4) as remainder, case when c_acctbal >= 0 then 1.0::double else -1 end as sign,
  (case when c_acctbal * 2 >= 0 then floor(c_acctbal * 2 + 0.5) else ceil(c_acctbal * 2 - 0.5) end) / 2 as rounded, case when c_acctbal > 0 then round(ln(c_acctbal), 6) else -9 end as log_ from customer"""
)
def numerics_ieee(spark, folder):
    x = F.col("c_acctbal")
    big = N.ieee_div(F.lit(1000.0), x)
    half = F.when(x * 2 >= 0, N.round_away(x * 2)).otherwise(N.round_away(x * 2)) / 2
    return table(spark, folder, "customer").select(
        "c_custkey", F.when(F.abs(big) == N.INF, F.lit(9e9)).otherwise(r(big)).alias("ratio"), r(N.fmod(x, F.lit(7.0)), 4).alias("remainder"), N.sign(x).alias("sign"), half.alias("rounded"), F.when(x > 0, r(N.ln(x))).otherwise(F.lit(-9.0)).alias("log_")
    )


def _erf_sql(x: str) -> str:
    t = f"(1 / (1 + 0.3275911::double * abs({x})))"
    poly = "0.0::double"
    for c in reversed(N.ERF):
        poly = f"(({poly}) + ({c!r}::double)) * {t}"
    return f"((case when {x} >= 0 then 1 else -1 end) * (1 - {poly} * exp(-{x} * {x})))"


@query(f"select p_partkey, round({_erf_sql('x')}, 6) as erf, round(1 - {_erf_sql('x')}, 6) as erfc, round(gamma(p_size / 10.0::double + 0.25), 4) as gamma from (select p_partkey, p_size, p_size / 10.0::double - 2 as x from part)")
def special_functions(spark, folder):
    x = F.col("p_size") / 10 - 2
    return table(spark, folder, "part").select("p_partkey", r(N.erf(x)).alias("erf"), r(N.erfc(x)).alias("erfc"), r(N.gamma(F.col("p_size") / 10 + 0.25), 4).alias("gamma"))


@query("select o_orderkey, round(pow(1 + 0.05::double, l), 6) as growth, round((1 - pow(1 + 0.05::double, -l)) / 0.05::double, 6) as annuity from (select o_orderkey, (o_orderkey % 30)::double as l from orders)")
def finance_factors(spark, folder):
    n = (F.col("o_orderkey") % 30).cast("double")
    return table(spark, folder, "orders").select("o_orderkey", r(N.pv_factor(F.lit(0.05), n)).alias("growth"), r(N.annuity_factor(F.lit(0.05), n)).alias("annuity"))


@query(
    """select o_orderkey, year(o_orderdate)::double as year, month(o_orderdate)::double as month, dayofyear(o_orderdate)::double as day_of_year, day(o_orderdate)::double as day_of_month, day(last_day(o_orderdate))::double as days_in_month, hour(o_orderdate)::double as hour,
  ((year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1)::double as elapsed_months, (year(o_orderdate) - 1992)::double as elapsed_years from orders"""
)
def calendar_fields(spark, folder):
    t = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double")
    start = F.lit(694224000.0)  # 1992-01-01
    fields = {k: v for k, v in calendar(t).items() if k not in ("minute", "second")} | elapsed(start, t)
    return table(spark, folder, "orders").select("o_orderkey", *[c.alias(k) for k, c in fields.items()])


def _call(fn: str, *args: dict) -> dict:
    return {"op": "call", "fn": fn, "args": list(args)}


def _ref(name: str) -> dict:
    return {"op": "ref", "element_id": name}


@query(
    "select o_orderkey, "
    + ", ".join(f"extract({k} from o_orderdate + to_seconds((o_orderkey % 86400)::bigint))::int::double as get_{k}" for k in ("year", "month", "day", "hour", "minute", "second"))
    + " from orders"
)
def calendar_calls(spark, folder):
    """Fields of a time of the day that the key gives, by trees."""
    t = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400
    scope = Scope({"t": t.cast("double")})
    return table(spark, folder, "orders").select("o_orderkey", *[column(_call(f"get_{k}", _ref("t")), scope).alias(f"get_{k}") for k in ("year", "month", "day", "hour", "minute", "second")])


@query(
    """with v as (select l_orderkey, l_linenumber, [l_quantity, l_tax * 500, l_discount * 400] as a, [l_tax > 0.02, l_discount > 0.03, l_quantity > 20] as m from lineitem),
w as (select *, list_min([a[i] for i in [1, 2, 3] if m[i]]) as lo, list_max([a[i] for i in [1, 2, 3] if m[i]]) as hi from v)
select l_orderkey, l_linenumber, case when m[1] and a[1] = lo then 1 when m[2] and a[2] = lo then 2 when m[3] and a[3] = lo then 3 else 0 end::double as argmin_where,
case when m[1] and a[1] = hi then 1 when m[2] and a[2] = hi then 2 when m[3] and a[3] = hi then 3 else 0 end::double as argmax_where, round(list_min(a), 6) as table_min, round(list_max(a), 6) as table_max, 3::double as column_count from w"""
)
def array_places_where(spark, folder):
    c = F.col
    a = F.array(c("l_quantity").cast("double"), c("l_tax") * 500, c("l_discount") * 400)
    m = F.array(*[N.flag(x) for x in (c("l_tax") > 0.02, c("l_discount") > 0.03, c("l_quantity") > 20)])
    scope = Scope({"a": a, "m": m})
    two = [column(_call(k, _ref("a"), _ref("m")), scope).alias(k) for k in ("argmin_where", "argmax_where")]
    one = [r(column(_call(k, _ref("a")), scope)).alias(k) for k in ("table_min", "table_max", "column_count")]
    return lines(spark, folder).select("l_orderkey", "l_linenumber", *two, *one)


@query("select p_partkey, round(p_size * 604800 / 86400.0::double, 6) as days, round(p_size * (1000 / 3600.0::double), 6) as metres_a_second, round((p_size * (5 / 9.0::double) + 459.67::double * 5 / 9 - 273.15::double), 6) as celsius, floor(p_size * 30 / 365.0::double) as year, (p_size * 30) % 365 + 1.0::double as day_of_year from part")
def unit_convert(spark, folder):
    x = F.col("p_size").cast("double")
    plain = plain_calendar(x * 30)
    return table(spark, folder, "part").select("p_partkey", r(convert(x, "wk", "d")).alias("days"), r(convert(x, "km/h", "m/s")).alias("metres_a_second"), r(convert(x, "F", "C")).alias("celsius"), plain["year"].alias("year"), plain["day_of_year"].alias("day_of_year"))


# nested runs and studies ---------------------------------------------------------------------------------------------


@query(
    f"""with o as (select i as outer_, {rng.sql(SEED, "outer", "i")} * 10 as level from range(100) t(i)), n as (select outer_, level, j, {rng.sql(SEED, "inner", "outer_ * 50 + j")} as u from o, range(50) k(j))
select outer_, round(avg(level * -ln(1 - u)), 6) as expected, round(max(level * -ln(1 - u)), 6) as worst from n group by all"""
)
def nested_stat(spark, folder):
    outer = realizations(spark, 100).select(F.col("real").alias("outer_"), (rng.uniform(SEED, "outer") * 10).alias("level"))
    inner = outer.select("*", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("j"))
    value = F.col("level") * -F.log(1 - rng.uniform(SEED, "inner", F.col("outer_") * 50 + F.col("j")))
    return inner.groupBy("outer_").agg(r(F.avg(value)).alias("expected"), r(F.max(value)).alias("worst"))


@query(f"select l_returnflag, round(avg(l_quantity * m), 6) as scaled from lineitem, (select avg({rng.sql(SEED, 'sub', 'i')}) as m from range(500) t(i)) group by all")
def submodel_stat(spark, folder):
    inner = realizations(spark, 500).agg(F.avg(rng.uniform(SEED, "sub")).alias("m"))
    return lines(spark, folder).select("l_returnflag", (F.col("l_quantity") * inner.scalar()).alias("x")).groupBy("l_returnflag").agg(r(F.avg("x")).alias("scaled"))


def _margin(p) -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount") * p["discount_scale"]) - p["unit_cost"] * F.col("l_quantity")


_M = "avg(l_extendedprice * (1 - l_discount * {d}) - {u} * l_quantity)"


@query(
    f"""with t as (select 'discount_scale' as element_id, {_M.format(d="0.5", u="900")} as low, {_M.format(d="1.5", u="900")} as high from lineitem union all select 'unit_cost', {_M.format(d="1.0", u="800")}, {_M.format(d="1.0", u="1100")} from lineitem)
select element_id, round(low, 3) as low, round(high, 3) as high, round(abs(high - low), 3) as swing from t"""
)
def tornado(spark, folder):
    out = studies.tornado(lines(spark, folder), {"discount_scale": 1.0, "unit_cost": 900.0}, {"discount_scale": (0.5, 1.5), "unit_cost": (800.0, 1100.0)}, _margin)
    return out.select("element_id", *[r(F.col(c), 3).alias(c) for c in ("low", "high", "swing")])


@query(f"select i::int as design, round({_M.format(d='1.0', u='(800 + i * 50.0::double)')}, 3) as objective from lineitem, range(7) t(i) group by all")
def one_at_a_time(spark, folder):
    points = [{"discount_scale": 1.0, "unit_cost": u} for u in studies.grid(800, 1100, 7)]
    return studies.over_designs(lines(spark, folder), points, _margin).withColumn("objective", r(F.col("objective"), 3))


@query(
    """with c as (select l_linestatus || l_returnflag as s, k, count(*) as n, avg(least(l_quantity, k) * 10 - k * 4) as v from lineitem, (values (10.0::double), (25.0::double), (40.0::double)) t(k) group by all), b as (select s, any_value(n) as n, max(v) as best from c group by s), w as (select k, sum(n * v) / sum(n) as v from c group by k)
select round((select sum(n * best) / sum(n) from b), 6) as with_information, round((select max(v) from w), 6) as without_information, round((select sum(n * best) / sum(n) from b) - (select max(v) from w), 6) as evppi"""
)
def evppi(spark, folder):
    out = studies.information_value(lines(spark, folder), F.concat("l_linestatus", "l_returnflag"), [10.0, 25.0, 40.0], lambda k: F.least(F.col("l_quantity").cast("double"), F.lit(k)) * 10 - k * 4)
    return out.select(*[r(F.col(c)).alias(c) for c in ("with_information", "without_information", "evppi")])


@query()
def box_complex(spark, folder):
    """The point that the squared distance to the rows is smallest from, which is their mean."""
    out = studies.box_complex(lines(spark, folder), {"a": (0.0, 50.0), "b": (0.0, 0.2)}, lambda p: F.pow(F.col("l_quantity") - p["a"], F.lit(2.0)) / 100 + F.pow((F.col("l_discount") - p["b"]) * 50, F.lit(2.0)))
    return spark.createDataFrame([(k, v, out["objective"], out["evaluations"], out["converged"]) for k, v in out["values"].items()], "element_id string, value double, objective double, evaluations int, converged boolean")


@query()
def american_put(spark, folder):
    """Strike 40, spot 36, rate 0.06, volatility 0.2, one year, 10 dates."""
    dt = 0.1
    level, columns = F.lit(math.log(36.0)), []
    for t in range(1, 11):
        level = level + (0.06 - 0.02) * dt + 0.2 * math.sqrt(dt) * F.col(f"z{t}")
        columns.append(F.exp(level).alias(f"s{t}"))
    z = realizations(spark, 8000).select("real", *[dists.norm_ppf(rng.uniform(SEED, "put", "real", t)).alias(f"z{t}") for t in range(1, 11)])
    paths = z.select("real", *columns)
    return studies.early_exercise(paths, 10, 40.0, 0.06, dt)


# models and streams --------------------------------------------------------------------------------------------------

MODEL = {
    "simulation_settings": {"duration": {"value": 1, "unit": "yr"}, "timestep": {"value": 1, "unit": "yr"}, "n_realizations": 2000, "seed": SEED},
    "elements": [
        {"id": "price", "primitive": "node", "value_rule": "sample", "distribution": {"family": "normal", "parameters": {"mean": {"value": 100, "unit": "1"}, "stddev": {"value": 15, "unit": "1"}}}},
        {"id": "volume", "primitive": "node", "value_rule": "sample", "distribution": {"family": "uniform", "parameters": {"min": {"value": 5, "unit": "1"}, "max": {"value": 9, "unit": "1"}}}},
        {"id": "cost", "primitive": "node", "value_rule": "fixed", "value": {"value": 420, "unit": "1"}},
        {"id": "margin", "primitive": "node", "value_rule": "expression", "expression": {"ast": {"op": "subtract", "left": {"op": "multiply", "left": {"op": "ref", "element_id": "price"}, "right": {"op": "ref", "element_id": "volume"}}, "right": {"op": "ref", "element_id": "cost"}}}},
    ],
}


@query(
    f"""with s as (select list_sort(list((100 + 15 * {dists.norm_ppf_sql("a")}) * (5 + 4 * b) - 420)) as xs from (select {rng.sql(SEED, "price", "i")} as a, {rng.sql(SEED, "volume", "i")} as b from range(2000) t(i)))
select 0 as step, round(list_avg(xs), 6) as mean, """
    + ", ".join(f"round({_at(p)}, 6) as p{p:g}" for p in reducers.BANDS)
    + " from s"
)
def model_margin(spark, folder):
    out = model.history(model.run(spark, MODEL), "margin")
    return out.select("step", *[r(F.col(c)).alias(c) for c in out.columns if c != "step"])


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def stream_tumbling(spark, folder):
    from panelmc.streaming.stateful import drained, events, tumbling

    out = drained(tumbling(events(spark, folder), "1 hour", "1 day"), "complete", _scratch(spark))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r(F.col("total"), 4).alias("total"))


@query(
    """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as start, count(*) as n from s group by user_id, k"""
)
def stream_sessions(spark, folder):
    from panelmc.streaming.stateful import drained, events, sessions

    out = drained(sessions(events(spark, folder), "30 minutes", "1 day"), "complete", _scratch(spark))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(ORACLE_SQL["hysteresis_state"])
def stream_latch(spark, folder):
    from panelmc.streaming.stateful import drained, events, latch

    return drained(latch(events(spark, folder), 30, 70), "append", _scratch(spark)).select("user_id", "event_id", "state")


def _scratch(spark: SparkSession) -> str:
    """A new folder that executors share; a temporary one where the session names none."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="panelmc-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
