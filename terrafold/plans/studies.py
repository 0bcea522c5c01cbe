"""Queries of threshold studies, sampling laws, stratified tables and text lookups."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions import laws, radar
from terrafold.operators import order
from terrafold.plans.raster import r6, ratios
from terrafold.plans.registry import DISC, PX, RATIOS, query
from terrafold.plans.statistics import _STRATA, strata
from terrafold.shared import staged
from terrafold.sources import views


def dbl(sql: str) -> str:
    """SQL whose decimal literals are doubles, as they are in DuckDB's arithmetic here."""
    return re.sub(r"(?<![\w.])(\d+\.\d+(?:[eE]-?\d+)?)(?![\w.])", r"\1D", sql)


def ex(sql: str):
    return F.expr(dbl(sql))


_PCT = {f"p{q}": q / 100 for q in (0, 1, 5, 25, 50, 75, 95, 99, 100)}


def _quantile_sql(value: str, names: dict[str, float]) -> str:
    return ", ".join(f"round(quantile_cont({value}, {q}), 6) + 0.0 AS {n}" for n, q in names.items())


@query(f"SELECT kind, count(*) AS n, round(avg(z), 6) AS mean, round(stddev_pop(z), 6) AS sd, {_quantile_sql('z', _PCT)} FROM {PX} WHERE measured GROUP BY 1")
def stat_block(spark, sf_dir):
    """Count, mean, deviation and nine percentiles of the measured pixels of each kind."""
    px = staged(views.pixels(spark, sf_dir).where("measured").select("kind", "z"), "measured")
    q = order.wide(order.quantiles(px, "z", list(_PCT.values()), ["kind"]), _PCT, ["kind"])
    return px.groupBy("kind").agg(F.count("*").alias("n"), r6(F.avg("z")).alias("mean"), r6(F.stddev_pop("z")).alias("sd")).join(F.broadcast(q), "kind")


@query(f"SELECT count(*) AS n, round(median(x), 6) AS median, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.75), 6) AS q3, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr, round(quantile_cont(x, 0.95), 6) AS p95, round(max(x), 6) AS highest FROM (SELECT cpr AS x FROM {RATIOS} WHERE measured)")
def distribution(spark, sf_dir):
    """Median, quartiles, spread, 95th percentile and maximum of a ratio."""
    x = staged(ratios(views.pixels(spark, sf_dir)).where("measured").select(F.col("cpr").alias("x")), "ratio")
    names = {"median": 0.5, "q1": 0.25, "q3": 0.75, "p95": 0.95, "highest": 1.0}
    q = order.quantiles(x, "x", list(names.values()))
    iqr = q.agg(r6(F.max(F.when(F.col("q") == 0.75, F.col("value"))) - F.max(F.when(F.col("q") == 0.25, F.col("value")))).alias("iqr"))
    return x.agg(F.count("*").alias("n")).join(F.broadcast(order.wide(q, names))).join(F.broadcast(iqr))


_AXIS_Q, _RAMP, _SET = [0.5, 0.9, 0.99, 0.999, 1.0], [k / 8 for k in range(9)], 0.35


@query(f"""WITH q AS (SELECT {', '.join(f'quantile_cont(cpr, {q}) AS q{i}' for i, q in enumerate(_AXIS_Q))} FROM {RATIOS} WHERE measured), u AS (SELECT unnest([{', '.join(f'q{i}' for i in range(len(_AXIS_Q)))}, {', '.join(map(str, [*_RAMP, _SET]))}]) AS v FROM q)
SELECT DISTINCT round(v, 6)::DOUBLE AS threshold FROM u WHERE round(v, 6) >= 0""")
def threshold_axis(spark, sf_dir):
    """An axis of thresholds: percentiles and maximum of the data, a ramp and the set value; rounded, each once."""
    return axis(spark, ratios(views.pixels(spark, sf_dir)).where("measured"), "cpr")


def axis(spark, px: DataFrame, value: str) -> DataFrame:
    fixed = spark.createDataFrame([(x,) for x in [*_RAMP, _SET]], "v double")
    return order.quantiles(px, value, _AXIS_Q).select(F.col("value").alias("v")).unionByName(fixed).select(F.round("v", 6).alias("threshold")).where("threshold >= 0").distinct()


@query(f"""WITH p AS (SELECT cpr, dop FROM {RATIOS} WHERE measured), t AS (SELECT unnest([0.0, 0.125, 0.25, 0.3, 0.375, 0.5, 0.6, 0.625, 0.75, 0.875, 1.0])::DOUBLE AS threshold), a AS (SELECT unnest(['cpr', 'dop']) AS axis)
SELECT axis, threshold, abs(threshold - CASE WHEN axis = 'cpr' THEN 0.3 ELSE 0.6 END) < 1e-12 AS configured, count(*) FILTER (CASE WHEN axis = 'cpr' THEN cpr > threshold AND dop < 0.6 ELSE cpr > 0.3 AND dop < threshold END) AS n,
round(count(*) FILTER (CASE WHEN axis = 'cpr' THEN cpr > threshold AND dop < 0.6 ELSE cpr > 0.3 AND dop < threshold END) * 0.0006, 6) AS area_km2, round(count(*) FILTER (CASE WHEN axis = 'cpr' THEN cpr > threshold AND dop < 0.6 ELSE cpr > 0.3 AND dop < threshold END) * 0.0006 * 1e6 * 5.0 * 0.1, 3) AS volume_m3 FROM p, t, a GROUP BY 1, 2""")
def threshold_sweep(spark, sf_dir):
    """Area and volume as one threshold moves and the other is held. Pixels are counted by how many thresholds they pass, once; running sums over those counts do the rest."""
    ts = [0.0, 0.125, 0.25, 0.3, 0.375, 0.5, 0.6, 0.625, 0.75, 0.875, 1.0]
    px = ratios(views.pixels(spark, sf_dir)).where("measured")
    one = px.agg(*[F.count_if(F.expr(f"cpr > {t}D and dop < 0.6D")).alias(f"c{i}") for i, t in enumerate(ts)], *[F.count_if(F.expr(f"cpr > 0.3D and dop < {t}D")).alias(f"d{i}") for i, t in enumerate(ts)])
    rows = [F.struct(F.lit(a).alias("axis"), F.lit(t).alias("threshold"), F.lit(abs(t - s) < 1e-12).alias("configured"), F.col(f"{a[0]}{i}").alias("n")) for a, s in (("cpr", 0.3), ("dop", 0.6)) for i, t in enumerate(ts)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*", F.round(F.col("x.n") * 0.0006, 6).alias("area_km2"), F.round(F.col("x.n") * 0.0006 * 1e6 * 5.0 * 0.1, 3).alias("volume_m3"))


_TIERS = [("conservative", 1.0, 0.02), ("expected", 5.0, 0.05), ("upper", 10.0, 0.1)]


@query(f"""WITH a AS (SELECT count(*) FILTER (measured AND cpr > 0.3 AND dop < 0.6) * 0.0006 AS km2 FROM {RATIOS}) SELECT tier, round(km2, 6) AS area_km2, round(km2 * 1e6 * depth * fraction, 3) AS volume_m3, round(km2 * 1e6 * depth * fraction * 917.0 / 1000.0, 3) AS mass_t, round(1e6 * depth * fraction, 3) AS m3_per_km2
FROM a, (VALUES {', '.join(f"('{n}', {d}, {f})" for n, d, f in _TIERS)}) t(tier, depth, fraction)""")
def volume_tiers(spark, sf_dir):
    """Volume and mass of the candidate area under three depths and fractions, and the rate by area."""
    a = ratios(views.pixels(spark, sf_dir)).agg((F.count_if(F.expr("measured and cpr > 0.3D and dop < 0.6D")) * 0.0006).alias("km2"))
    t = F.explode(F.array(*[F.struct(F.lit(n).alias("tier"), F.lit(d).alias("depth"), F.lit(f).alias("fraction")) for n, d, f in _TIERS]))
    v = F.expr("km2 * 1e6D * depth * fraction")
    return a.select("km2", t.alias("t")).select("km2", "t.*").select("tier", r6("km2").alias("area_km2"), F.round(v, 3).alias("volume_m3"), F.round(v * 917.0 / 1000.0, 3).alias("mass_t"), F.round(F.expr("1e6D * depth * fraction"), 3).alias("m3_per_km2"))


@query(f"""WITH g AS (SELECT line // 5 AS a, sample // 5 AS b, round(stddev_samp(z) / avg(z), 6) AS cv, avg(z) * avg(z) / var_samp(z) AS looks, count(*) AS n FROM {PX} GROUP BY 1, 2), f AS (SELECT * FROM g WHERE n = 25), c AS (SELECT quantile_cont(cv, 0.2) AS t FROM f)
SELECT count(*) AS tiles, round(min(looks), 6) AS lowest, round(max(looks), 6) AS highest, round(median(looks), 6) AS median FROM f, c WHERE cv <= t""")
def homogeneous_tiles(spark, sf_dir):
    """The tiles with the lowest fifth of coefficients of variation, and how their looks spread."""
    g = views.pixels(spark, sf_dir).groupBy(F.expr("line div 5").alias("a"), F.expr("sample div 5").alias("b")).agg(F.round(F.stddev_samp("z") / F.avg("z"), 6).alias("cv"), (F.avg("z") * F.avg("z") / F.var_samp("z")).alias("looks"), F.count("*").alias("n"))
    f = staged(g.where("n = 25").select("cv", "looks"), "tiles")
    low = staged(f.join(F.broadcast(order.quantiles(f, "cv", [0.2]).select(F.col("value").alias("t")))).where("cv <= t").select("looks"), "low")
    q = order.wide(order.quantiles(low, "looks", [0.5]), {"median": 0.5})
    return low.agg(F.count("*").alias("tiles"), r6(F.min("looks")).alias("lowest"), r6(F.max("looks")).alias("highest")).join(F.broadcast(q))


_DISCS = f"(SELECT line // 10 AS dl, sample // 10 AS ds, avg((z < 20)::INT) AS dark, count(*) AS cells, count(*) FILTER (measured AND cpr > 0.3 AND dop < 0.6) AS rule, median(cpr) AS cpr, avg((lv < 5)::INT) AS weak FROM {RATIOS} GROUP BY 1, 2)"
_CLASS = "CASE WHEN dark = 0 THEN 'outside' WHEN dark = 1 THEN 'inside' ELSE 'mixed' END"


def disc_rows(spark, sf_dir) -> DataFrame:
    """A row for each square of 10 x 10 pixels: at most 100 values a group."""
    p = ratios(views.pixels(spark, sf_dir))
    return p.groupBy(F.expr("line div 10").alias("dl"), F.expr("sample div 10").alias("ds")).agg(F.avg((F.col("z") < 20).cast("int")).alias("dark"), F.count("*").alias("cells"), F.count_if(F.expr("measured and cpr > 0.3D and dop < 0.6D")).alias("rule"), F.median("cpr").alias("cpr"), F.avg((F.col("lv") < 5).cast("int")).alias("weak"))


@query(f"SELECT dl, ds, {_CLASS} AS class, cells, rule, round(dark, 6) AS dark, round(cpr, 6) AS median_cpr, round(weak, 6) AS weak FROM {_DISCS}")
def disc_profiles(spark, sf_dir):
    """Each disc's class, counts, medians and shares."""
    return disc_rows(spark, sf_dir).select("dl", "ds", F.expr(_CLASS).alias("class"), "cells", "rule", r6("dark").alias("dark"), r6("cpr").alias("median_cpr"), r6("weak").alias("weak"))


@query(f"SELECT coalesce(class, 'all') AS class, count(*) AS discs, sum(cells)::BIGINT AS cells, sum(rule)::BIGINT AS rule, round(sum(rule) / sum(cells), 6) AS rate, round(avg(cpr), 6) AS mean_cpr FROM (SELECT *, {_CLASS} AS class FROM {_DISCS}) GROUP BY ROLLUP (class)")
def disc_classes(spark, sf_dir):
    """Discs outside, inside and across a mask, and all."""
    d = disc_rows(spark, sf_dir).withColumn("class", F.expr(_CLASS))
    g = d.rollup("class").agg(F.count("*").alias("discs"), F.sum("cells").alias("cells"), F.sum("rule").alias("rule"), r6(F.sum("rule") / F.sum("cells")).alias("rate"), r6(F.avg("cpr")).alias("mean_cpr"))
    return g.withColumn("class", F.coalesce("class", F.lit("all")))


# ---- sampling laws

_N = [3, 4, 6, 9, 14, 21, 38, 100]
#: Numbers of looks that stand in a table: whole quantities.
_NS = "(SELECT DISTINCT l_quantity::INT AS n FROM lineitem WHERE l_quantity >= 3)"


def looks_table(spark, sf_dir) -> DataFrame:
    return views.table(spark, sf_dir, "lineitem").where("l_quantity >= 3").select(F.col("l_quantity").cast("int").alias("n")).distinct()


_SKEW = "CASE WHEN n > 3 THEN (6.0 * n - 2) * sqrt(8 * (2.0 * n - 4)) / ((2.0 * n - 6) * sqrt(2.0 * n * (4.0 * n - 2))) END"
_KURT = "CASE WHEN n > 4 THEN 12 * (2.0 * n * (10.0 * n - 22) * (4.0 * n - 2) + (2.0 * n - 4) * pow(2.0 * n - 2, 2)) / (2.0 * n * (2.0 * n - 6) * (2.0 * n - 8) * (4.0 * n - 2)) END"


@query(f"""WITH t AS (SELECT n, exp(lgamma(n + 0.5) - lgamma(n)) / sqrt(n) AS c, exp(lgamma(n + 0.5) - lgamma(n)) AS m1, exp(lgamma(n + 1) - lgamma(n)) AS m2, exp(lgamma(n + 1.5) - lgamma(n)) AS m3 FROM {_NS})
SELECT n, round({_SKEW}, 6) AS skewness, round({_KURT}, 6) AS kurtosis, round(c * c / (1 - c * c), 5) AS amplitude_ratio, round(2 / sqrt(n), 6) AS intensity_skew, round((m3 - 3 * m1 * m2 + 2 * pow(m1, 3)) / pow(m2 - m1 * m1, 1.5), 5) AS amplitude_skew FROM t""")
def ratio_moments(spark, sf_dir):
    """Skewness and excess kurtosis of the ratio of two means of n looks, and moments of the looks' amplitude, in closed form."""
    g = lambda k: f"exp({laws.log_gamma(f'(n + {k}D)')} - {laws.log_gamma('n')})"
    t = looks_table(spark, sf_dir).withColumns({"m1": F.expr(g(0.5)), "m2": F.expr(g(1.0)), "m3": F.expr(g(1.5))})
    return t.select("n", F.round(ex(_SKEW), 6).alias("skewness"), F.round(ex(_KURT), 6).alias("kurtosis"), F.round(F.expr(laws.amplitude_ratio("double(n)")), 5).alias("amplitude_ratio"), F.round(F.expr("2D / sqrt(n)"), 6).alias("intensity_skew"), F.round(F.expr("(m3 - 3 * m1 * m2 + 2 * pow(m1, 3)) / pow(m2 - m1 * m1, 1.5D)"), 5).alias("amplitude_skew"))


@query("""WITH RECURSIVE t AS (SELECT DISTINCT 0.25::DOUBLE + 0.05::DOUBLE * round(l_discount * 100) AS target FROM lineitem), b AS (SELECT target, 0 AS i, 0.001::DOUBLE AS lo, 1e6::DOUBLE AS hi FROM t UNION ALL
SELECT target, i + 1, CASE WHEN pow(exp(lgamma(sqrt(lo * hi) + 0.5) - lgamma(sqrt(lo * hi))) / sqrt(sqrt(lo * hi)), 2) / (1 - pow(exp(lgamma(sqrt(lo * hi) + 0.5) - lgamma(sqrt(lo * hi))) / sqrt(sqrt(lo * hi)), 2)) < target * 40 THEN sqrt(lo * hi) ELSE lo END,
CASE WHEN pow(exp(lgamma(sqrt(lo * hi) + 0.5) - lgamma(sqrt(lo * hi))) / sqrt(sqrt(lo * hi)), 2) / (1 - pow(exp(lgamma(sqrt(lo * hi) + 0.5) - lgamma(sqrt(lo * hi))) / sqrt(sqrt(lo * hi)), 2)) < target * 40 THEN hi ELSE sqrt(lo * hi) END FROM b WHERE i < 80)
SELECT target, round((2 * target * target + 2 + sqrt(pow(2 * target * target + 2, 2) - 4 * target * target)) / (2 * target * target), 5) AS looks_of_sd, round(sqrt(lo * hi), 4) AS looks_of_amplitude FROM b WHERE i = 80""")
def looks_inversion(spark, sf_dir):
    """Looks that a relative deviation of the ratio, or a ratio of amplitude moments, implies: bisection. The first has a closed form, which its SQL uses."""
    t = views.table(spark, sf_dir, "lineitem").select(F.expr("0.25D + 0.05D * round(l_discount * 100)").alias("target")).distinct()
    sd = laws.bisected("sqrt((2D * {x} - 1D) / ({x} * ({x} - 2D))) > target", "2.000000001", "1e6")
    amp = laws.bisected(laws.amplitude_ratio("{x}") + " < target * 40D", "0.001", "1e6")
    return t.select("target", F.round(sd, 5).alias("looks_of_sd"), F.round(amp, 4).alias("looks_of_amplitude"))


_DTAIL = "list_sum([exp(lgamma(2 * n) - lgamma(j + 1) - lgamma(2 * n - j)) * pow(1 / (1 + {x}), j) * pow({x} / (1 + {x}), 2 * n - 1 - j) for j in range(n, 2 * n)])"
_CRIT = f"""b AS (SELECT n, 0 AS i, 1e-6::DOUBLE AS lo, 1e6::DOUBLE AS hi FROM {{ns}} UNION ALL SELECT n, i + 1, CASE WHEN {_DTAIL.format(x='sqrt(lo * hi)')} > 0.05 THEN sqrt(lo * hi) ELSE lo END, CASE WHEN {_DTAIL.format(x='sqrt(lo * hi)')} > 0.05 THEN hi ELSE sqrt(lo * hi) END FROM b WHERE i < 80), k AS (SELECT n, sqrt(lo * hi) AS crit FROM b WHERE i = 80)"""


@query(f"WITH RECURSIVE {_CRIT.format(ns=_NS)} SELECT n, round(crit, 6) AS critical, round((crit - 1) / (crit + 1), 6) AS edge FROM k")
def critical_values(spark, sf_dir):
    """What the ratio of two means of n looks exceeds in one case of twenty (the floor for a true ratio of 1), and the polarisation that it needs."""
    t = looks_table(spark, sf_dir).withColumn("crit", laws.critical_value("n", 0.05))
    return t.select("n", r6("crit").alias("critical"), r6(F.expr("(crit - 1) / (crit + 1)")).alias("edge"))


#: A feature's ratio: one and a part of its mean.
_PUBLISHED = "(SELECT event_type AS feature, round(1 + avg(value) / 40, 6) AS cpr FROM events GROUP BY 1)"


@query(f"""WITH RECURSIVE {_CRIT.format(ns=_NS)} SELECT feature, cpr, {', '.join(f"max(CASE WHEN n = {n} THEN CASE WHEN cpr > crit THEN 'yes' ELSE 'no' END END) AS n{n}" for n in _N)} FROM {_PUBLISHED} p, k GROUP BY 1, 2""")
def published_floors(spark, sf_dir):
    """Whether each feature's ratio clears the floor of n looks: a pivot by n."""
    p = views.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("feature")).agg(F.round(1 + F.avg("value") / 40, 6).alias("cpr"))
    k = looks_table(spark, sf_dir).withColumn("crit", laws.critical_value("n", 0.05))
    j = p.crossJoin(F.broadcast(k)).withColumn("clears", F.when(F.expr("cpr > crit"), "yes").otherwise("no"))
    g = j.groupBy("feature", "cpr").pivot("n", _N).agg(F.first("clears"))
    return g.select("feature", "cpr", *[F.col(str(n)).alias(f"n{n}") for n in _N])


@query(f"""WITH RECURSIVE {_CRIT.format(ns=_NS)}, t AS (SELECT unnest([1.0, 1.3, 2.0, 3.0])::DOUBLE AS true_cpr) SELECT n, true_cpr, round(100 * {_DTAIL.format(x='(crit / true_cpr)')}, 4) AS power FROM k, t WHERE n <= 38""")
def power_table(spark, sf_dir):
    """Chance, in percent, that n looks of a true ratio exceed the critical value."""
    k = looks_table(spark, sf_dir).where("n <= 38").withColumn("crit", laws.critical_value("n", 0.05))
    j = k.withColumn("true_cpr", F.explode(F.array(*[F.lit(x) for x in (1.0, 1.3, 2.0, 3.0)]))).withColumn("x", F.expr("crit / true_cpr"))
    return j.select("n", "true_cpr", F.round(radar.ratio_tail("n", "x") * 100, 4).alias("power"))


#: A fixed step table of the fifth percentile of sample polarisation by looks.
_Q05 = [(3, 0.21), (6, 0.18), (14, 0.15), (38, 0.135), (100, 0.13)]
_Q05_SQL = "(VALUES " + ", ".join(f"({n}, {q}::DOUBLE)" for n, q in _Q05) + ") q(n, q05)"
_STEPS = list(zip(_Q05[:-1], _Q05[1:], strict=True))
_Q05_AT = "CASE WHEN nh <= 3 THEN 0.21 " + " ".join(f"WHEN nh <= {b} THEN {p} + (ln(nh) - ln({a}.0)) / (ln({b}.0) - ln({a}.0)) * ({q} - {p})" for (a, p), (b, q) in _STEPS) + " ELSE 0.13 END"
_JOINT = "CASE WHEN r > 1 AND dop < q05 + 0.5 THEN 'both' WHEN r > 1 THEN 'ratio' WHEN dop < q05 + 0.5 THEN 'dop' ELSE 'none' END"


@query(f"""WITH p AS (SELECT line, sample, 1 + 4 * cpr AS ratio, dop, least(30, greatest(2, floor(lv)))::INT AS nh FROM {RATIOS} WHERE measured), t AS (SELECT *, {_Q05_AT} AS q05 FROM p), u AS (SELECT *, list_sum([exp(lgamma(2 * nh) - lgamma(j + 1) - lgamma(2 * nh - j)) * pow(1 / (1 + ratio), j) * pow(ratio / (1 + ratio), 2 * nh - 1 - j) for j in range(nh, 2 * nh)]) AS tail FROM t)
SELECT nh AS looks, count(*) AS n, count(*) FILTER (tail < 0.05) AS ratio_fires, count(*) FILTER (dop < q05 + 0.5) AS dop_fires, count(*) FILTER (tail < 0.05 AND dop < q05 + 0.5) AS rule_fires, round(any_value(q05), 6) AS q05 FROM u GROUP BY 1""")
def joint_rule(spark, sf_dir):
    """Joint rule by local looks: the ratio is over its critical value (its tail is under one in twenty) and the polarisation under a step table, interpolated in log looks."""
    p = ratios(views.pixels(spark, sf_dir)).where("measured").select(F.expr("1D + 4 * cpr").alias("ratio"), "dop", F.expr("int(least(30, greatest(2, floor(lv))))").alias("nh"))
    t = p.withColumn("q05", ex(_Q05_AT)).withColumn("tail", radar.ratio_tail("nh", "ratio"))
    n = lambda e: F.count_if(F.expr(e))
    return t.groupBy(F.col("nh").alias("looks")).agg(F.count("*").alias("n"), n("tail < 0.05D").alias("ratio_fires"), n("dop < q05 + 0.5D").alias("dop_fires"), n("tail < 0.05D and dop < q05 + 0.5D").alias("rule_fires"), r6(F.first("q05")).alias("q05"))


@query(f"""WITH RECURSIVE {_CRIT.format(ns='(SELECT n FROM ' + _Q05_SQL + ')')}, c AS (SELECT l_quantity::INT AS n, count(*) AS c FROM lineitem GROUP BY 1), e AS (SELECT q.n, (crit - 1) / (crit + 1) AS edge, q05, coalesce(c, 0) AS c FROM k JOIN {_Q05_SQL} ON q.n = k.n LEFT JOIN c ON c.n = k.n)
SELECT min(n) FILTER (edge < q05) AS first_with_region, max(n) FILTER (edge >= q05) AS last_without_region, coalesce(sum(c) FILTER (edge < q05), 0)::BIGINT AS rows_with_region FROM e""")
def rule_onset(spark, sf_dir):
    """The first number of looks in the step table at which the joint rule can fire at all, whether it occurs or not, and the rows that have such looks."""
    occurs = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("n")).agg(F.count("*").alias("c"))
    q = spark.createDataFrame(_Q05, "n int, q05 double").withColumn("crit", laws.critical_value("n", 0.05)).withColumn("edge", F.expr("(crit - 1) / (crit + 1)")).join(occurs, "n", "left")
    fires = F.expr("edge < q05")
    return q.agg(F.min(F.when(fires, F.col("n"))).alias("first_with_region"), F.max(F.when(F.expr("edge >= q05"), F.col("n"))).alias("last_without_region"), F.coalesce(F.sum(F.when(fires, F.col("c"))), F.lit(0)).cast("long").alias("rows_with_region"))


_LEVELS = [0.2, 0.4, 0.6, 0.8]


@query(f"SELECT t.v::DOUBLE AS dop_th, count(*) FILTER (dop < t.v) AS n, round(max(cpr) FILTER (dop < t.v), 6) AS highest, round(pow(tanh(atanh(t.v) / 2), 2), 6) AS ceiling, coalesce(max(cpr) FILTER (dop < t.v) <= pow(tanh(atanh(t.v) / 2), 2) + 1e-6, true) AS held FROM {RATIOS} p, (VALUES {', '.join(f'({x})' for x in _LEVELS)}) t(v) WHERE measured GROUP BY t.v")
def algebraic_ceiling(spark, sf_dir):
    """The highest ratio under each polarisation against what amplitudes alone can reach."""
    px = ratios(views.pixels(spark, sf_dir)).where("measured")
    one = px.agg(*[x for i, t in enumerate(_LEVELS) for x in (F.count_if(F.col("dop") < t).alias(f"n{i}"), F.max(F.when(F.col("dop") < t, F.col("cpr"))).alias(f"m{i}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("dop_th"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"), F.lit(radar.tanh_ceiling(t)).alias("c")) for i, t in enumerate(_LEVELS)]))
    return one.select(rows.alias("x")).select("x.dop_th", "x.n", r6("x.m").alias("highest"), r6("x.c").alias("ceiling"), F.coalesce(F.expr("x.m <= x.c + 1e-6D"), F.lit(True)).alias("held"))


_COUPLE = "CASE WHEN dop < abs((cpr - 1) / (cpr + 1)) - 1e-12 THEN NULL ELSE sqrt(greatest(dop * dop - pow((cpr - 1) / (cpr + 1), 2), 0) / (1 - pow((cpr - 1) / (cpr + 1), 2))) END"


@query(f"SELECT line, sample, round({_COUPLE}, 6) AS coherence FROM (SELECT line, sample, 0.2 + 2 * cpr AS cpr, dop FROM {RATIOS} WHERE measured)")
def coupling(spark, sf_dir):
    """The circular coherence that each pixel's polarisation and ratio need; null where nothing realises them."""
    p = ratios(views.pixels(spark, sf_dir)).where("measured").select("line", "sample", F.expr("0.2D + 2 * cpr").alias("cpr"), "dop")
    return p.select("line", "sample", F.round(laws.coupling("dop", "cpr"), 6).alias("coherence"))


_MEAN_DOP = "exp(lgamma(2.0) + lgamma({n} - 1.0) - lgamma({n} + 1.0) - lgamma(1.5) - lgamma({n} - 1.0) + lgamma({n} + 0.5))"


@query(f"""WITH RECURSIVE b AS (SELECT n, 0 AS i, 1.5::DOUBLE AS lo, 1e6::DOUBLE AS hi FROM {_NS} UNION ALL SELECT n, i + 1, CASE WHEN {_MEAN_DOP.format(n='sqrt(lo * hi)')} > 1.0 / n THEN sqrt(lo * hi) ELSE lo END, CASE WHEN {_MEAN_DOP.format(n='sqrt(lo * hi)')} > 1.0 / n THEN hi ELSE sqrt(lo * hi) END FROM b WHERE i < 80)
SELECT n, round({_MEAN_DOP.format(n='n')}, 6) AS mean_dop, round(sqrt(lo * hi), 1) AS looks_for_inverse FROM b WHERE i = 80""")
def mean_sample_dop(spark, sf_dir):
    """Mean sample polarisation of unpolarised light over n looks, and the looks at which it is 1 / n."""
    lg = laws.log_gamma
    mean = lambda n: f"exp({lg('2D')} - {lg(f'({n} + 1D)')} - {lg('1.5D')} + {lg(f'({n} + 0.5D)')})"
    return looks_table(spark, sf_dir).select("n", F.round(F.expr(mean("n")), 6).alias("mean_dop"), F.round(laws.bisected(mean("{x}") + " > 1D / n", "1.5", "1e6"), 1).alias("looks_for_inverse"))


@query(f"""WITH t AS (SELECT n, 100 * {_DTAIL.format(x='1.4285714')} AS p FROM {_NS} WHERE n < 40), s AS (SELECT *, sqrt(p * (100 - p) / 1000) AS se FROM t), v AS (SELECT 'value' AS curve, n, p AS v FROM s UNION ALL SELECT 'high', n, p + 2 * se FROM s UNION ALL SELECT 'low', n, p - 2 * se FROM s),
w AS (SELECT *, lag(v) OVER (PARTITION BY curve ORDER BY n) AS before FROM v) SELECT curve, round(min(n - 1 + (20 - before) / (v - before)) FILTER (v < 20 AND before >= 20), 6) AS crossing FROM w GROUP BY 1""")
def level_crossings(spark, sf_dir):
    """Where the chance of an excess first falls under 20 %, between two numbers of looks, with two errors on either side."""
    t = looks_table(spark, sf_dir).where("n < 40").withColumn("p", radar.ratio_tail("n", "1.4285714D") * 100).withColumn("se", F.expr("sqrt(p * (100 - p) / 1000)"))
    v = t.select("n", F.explode(F.expr("array(struct('value' as curve, p as v), struct('high' as curve, p + 2 * se as v), struct('low' as curve, p - 2 * se as v))")).alias("x")).select("n", "x.*")
    w = v.withColumn("before", F.lag("v").over(Window.partitionBy("curve").orderBy("n")))  # 37 rows a curve
    return w.groupBy("curve").agg(r6(F.min(F.when(F.expr("v < 20 and before >= 20"), F.expr("n - 1 + (20 - before) / (v - before)")))).alias("crossing"))


@query("""WITH t AS (SELECT user_id % 9 + 3 AS n, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM events GROUP BY 1), m AS (SELECT n, max(lo) OVER (ORDER BY n) AS lo, max(hi) OVER (ORDER BY n) AS hi FROM t) SELECT n, round(lo, 6) AS lo, round(hi, 6) AS hi FROM m""")
def monotone_envelope(spark, sf_dir):
    """Quantile curves by looks, made monotone by running maxima: what an interval is read from."""
    e = views.table(spark, sf_dir, "events").select((F.col("user_id") % 9 + 3).alias("n"), "value")
    q = order.quantiles(e, "value", [0.025, 0.975], ["n"]).groupBy("n").agg(F.max(F.when(F.col("q") < 0.5, F.col("value"))).alias("lo"), F.max(F.when(F.col("q") > 0.5, F.col("value"))).alias("hi"))
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # nine rows
    return q.select("n", r6(F.max("lo").over(w)).alias("lo"), r6(F.max("hi").over(w)).alias("hi"))


# ---- stratified tables

_WOOLF = "sqrt(1 / a + 1 / b + 1 / c + 1 / d)"


@query(f"""WITH s AS ({_STRATA.format(DISC)}), h AS (SELECT stratum, least(a, b, c, d) = 0 AS corrected, a + CASE WHEN least(a, b, c, d) = 0 THEN 0.5 ELSE 0.0 END AS a, b + CASE WHEN least(a, b, c, d) = 0 THEN 0.5 ELSE 0.0 END AS b, c + CASE WHEN least(a, b, c, d) = 0 THEN 0.5 ELSE 0.0 END AS c, d + CASE WHEN least(a, b, c, d) = 0 THEN 0.5 ELSE 0.0 END AS d FROM s)
SELECT stratum, corrected, round(a * d / (b * c), 6) AS odds_ratio, round(exp(ln(a * d / (b * c)) - 1.96 * {_WOOLF}), 6) AS low, round(exp(ln(a * d / (b * c)) + 1.96 * {_WOOLF}), 6) AS high FROM h""")
def crude_odds(spark, sf_dir):
    """Odds ratio of each stratum with Woolf's interval; a half is added to every cell where one is empty."""
    s = strata(views.discs(spark, sf_dir)).withColumn("corrected", F.expr("least(a, b, c, d) = 0"))
    h = s.select("stratum", "corrected", *[F.expr(f"{k} + if(corrected, 0.5D, 0D)").alias(k) for k in "abcd"])
    o = "a * d / (b * c)"
    return h.select("stratum", "corrected", r6(F.expr(o)).alias("odds_ratio"), r6(ex(f"exp(ln({o}) - 1.96 * {_WOOLF})")).alias("low"), r6(ex(f"exp(ln({o}) + 1.96 * {_WOOLF})")).alias("high"))


_EXPECT = "((psi * (n1 + m1) + n0 - m1) - sqrt(pow(psi * (n1 + m1) + n0 - m1, 2) - 4 * (psi - 1) * psi * n1 * m1)) / (2 * (psi - 1))"
_PSI = "SELECT sum(a * d / n) / sum(b * c / n) AS psi FROM s"


@query(f"""WITH s AS ({_STRATA.format(DISC)}), o AS ({_PSI}), t AS (SELECT a, (a + b)::DOUBLE AS n1, (c + d)::DOUBLE AS n0, (a + c)::DOUBLE AS m1, psi FROM s, o WHERE a + b > 0 AND c + d > 0 AND a + c > 0 AND b + d > 0), e AS (SELECT *, CASE WHEN abs(psi - 1) < 1e-12 THEN n1 * m1 / (n1 + n0) ELSE {_EXPECT} END AS ah FROM t),
v AS (SELECT a - ah AS dev, 1 / (1 / ah + 1 / (n1 - ah) + 1 / (m1 - ah) + 1 / (n0 - m1 + ah)) AS var FROM e), g AS (SELECT count(*) AS k, sum(dev * dev / var) AS stat, sum(dev * dev / var) - pow(sum(dev), 2) / sum(var) AS tarone FROM v)
SELECT k AS strata_used, round(stat, 6) AS breslow_day, round(tarone, 6) AS tarone, round(1 - list_sum([exp(((k - 1) / 2.0 + i) * ln(tarone / 2) - tarone / 2 - lgamma((k - 1) / 2.0 + i + 1)) for i in range(0, 200)]), 6) AS p FROM g""")
def breslow_day(spark, sf_dir):
    """Whether odds ratios differ between strata, with Tarone's correction. The expected count is the root of a quadratic."""
    s = strata(views.discs(spark, sf_dir))
    psi = s.agg(F.expr("sum(a * d / n) / sum(b * c / n)").alias("psi"))
    t = s.where("a + b > 0 and c + d > 0 and a + c > 0 and b + d > 0").join(F.broadcast(psi)).selectExpr("a", "double(a + b) as n1", "double(c + d) as n0", "double(a + c) as m1", "psi")
    t = t.withColumn("ah", F.expr(f"if(abs(psi - 1) < 1e-12D, n1 * m1 / (n1 + n0), {_EXPECT})")).selectExpr("a - ah as dev", "1 / (1 / ah + 1 / (n1 - ah) + 1 / (m1 - ah) + 1 / (n0 - m1 + ah)) as var")
    g = t.agg(F.count("*").alias("k"), F.expr("sum(dev * dev / var)").alias("stat"), F.expr("sum(dev * dev / var) - pow(sum(dev), 2) / sum(var)").alias("tarone"))
    return g.select(F.col("k").alias("strata_used"), r6("stat").alias("breslow_day"), r6("tarone").alias("tarone"), r6(F.expr(laws.chi_square_tail("tarone", "double(k - 1)"))).alias("p"))





@query(f"""WITH s AS ({_STRATA.format(DISC)}), t AS (SELECT sum(a * d / n) AS r, sum(b * c / n) AS q FROM s) SELECT stratum AS left_out, round((r - a * d / n) / (q - b * c / n), 6) AS odds_ratio, round(r / q, 6) AS whole, ((r - a * d / n) / (q - b * c / n) > 1) <> (r / q > 1) AS reverses FROM s, t""")
def leave_one_out(spark, sf_dir):
    """The pooled odds ratio without each stratum, from totals less that stratum, and whether it turns over."""
    s = strata(views.discs(spark, sf_dir))
    t = s.agg(F.expr("sum(a * d / n)").alias("r"), F.expr("sum(b * c / n)").alias("q"))
    one = s.join(F.broadcast(t)).withColumn("o", F.expr("try_divide(r - a * d / n, q - b * c / n)"))
    return one.select(F.col("stratum").alias("left_out"), r6("o").alias("odds_ratio"), r6(F.expr("r / q")).alias("whole"), F.expr("(o > 1) <> (r / q > 1)").alias("reverses"))


@query(f"""WITH d AS (SELECT *, (SELECT count(*) FROM (SELECT unnest([-1.0, 0.5, 2.5, 5.0, 7.5]) AS e) WHERE e <= x) AS w FROM {DISC}), s AS (SELECT 'width' AS definition, w AS stratum, exposed, outcome FROM d UNION ALL SELECT 'nation', stratum, exposed, outcome FROM d UNION ALL SELECT 'none', 0, exposed, outcome FROM d),
t AS (SELECT definition, stratum, count(*) FILTER (exposed AND outcome) AS a, count(*) FILTER (exposed AND NOT outcome) AS b, count(*) FILTER (NOT exposed AND outcome) AS c, count(*) FILTER (NOT exposed AND NOT outcome) AS d, count(*) AS n FROM s GROUP BY 1, 2)
SELECT definition, count(*) AS strata, round(sum(a * d / n) / nullif(sum(b * c / n), 0), 6) AS odds_ratio FROM t GROUP BY 1""")
def stratum_definitions(spark, sf_dir):
    """The pooled odds ratio under several definitions of strata: bins of equal width, nations, none."""
    d = views.discs(spark, sf_dir)
    w = "size(filter(array(-1D, 0.5D, 2.5D, 5D, 7.5D), e -> e <= x))"
    s = d.select("exposed", "outcome", F.explode(F.expr(f"array(struct('width' as definition, bigint({w}) as stratum), struct('nation' as definition, bigint(stratum) as stratum), struct('none' as definition, 0L as stratum))")).alias("x")).select("exposed", "outcome", "x.*")
    c = lambda x: F.count_if(F.expr(x))
    t = s.groupBy("definition", "stratum").agg(c("exposed and outcome").alias("a"), c("exposed and not outcome").alias("b"), c("not exposed and outcome").alias("c"), c("not exposed and not outcome").alias("d"), F.count("*").alias("n"))
    return t.groupBy("definition").agg(F.count("*").alias("strata"), r6(F.expr("try_divide(sum(a * d / n), sum(b * c / n))")).alias("odds_ratio"))


@query(f"""WITH v AS (SELECT exposed, 'x' AS covariate, x AS v FROM {DISC} UNION ALL SELECT exposed, 'stratum', stratum FROM {DISC}), g AS (SELECT covariate, avg(v) FILTER (exposed) AS m1, avg(v) FILTER (NOT exposed) AS m0, var_pop(v) FILTER (exposed) AS v1, var_pop(v) FILTER (NOT exposed) AS v0 FROM v GROUP BY 1)
SELECT covariate, round(m1, 6) AS mean_exposed, round(m0, 6) AS mean_other, round(CASE WHEN v1 + v0 > 0 THEN (m1 - m0) / sqrt(0.5 * (v1 + v0)) END, 6) AS difference FROM g""")
def mean_differences(spark, sf_dir):
    """Standardised differences of covariates between exposed and other rows."""
    d = views.discs(spark, sf_dir).select("exposed", F.explode(F.expr("array(struct('x' as covariate, x as v), struct('stratum' as covariate, double(stratum) as v))")).alias("c")).select("exposed", "c.*")
    one = lambda f, e: f(F.when(F.expr(e), F.col("v")))
    g = d.groupBy("covariate").agg(one(F.avg, "exposed").alias("m1"), one(F.avg, "not exposed").alias("m0"), one(F.var_pop, "exposed").alias("v1"), one(F.var_pop, "not exposed").alias("v0"))
    return g.select("covariate", r6("m1").alias("mean_exposed"), r6("m0").alias("mean_other"), r6(F.expr("if(v1 + v0 > 0, (m1 - m0) / sqrt(0.5D * (v1 + v0)), null)")).alias("difference"))


_PHI = "(0.5 * (1 + sign({z}) * CASE WHEN {z} = 0 THEN 0 ELSE list_sum([exp((0.5 + i) * ln({z} * {z} / 2) - {z} * {z} / 2 - lgamma(1.5 + i)) for i in range(0, 200)]) END))"


@query(f"""WITH s AS (SELECT sum(a) + 0.5 AS a, sum(b) + 0.5 AS b, sum(c) + 0.5 AS c, sum(d) + 0.5 AS d, stratum % 3 AS part FROM ({_STRATA.format(DISC)}) GROUP BY stratum % 3), e AS (SELECT part, ln(a * d / (b * c)) AS coef, {_WOOLF} AS se FROM s), z AS (SELECT *, abs(coef) / se - 1.959964 AS z1, abs(coef) / se + 1.959964 AS z2 FROM e)
SELECT part, round(se, 6) AS se, round(exp((1.959964 + 0.841621) * se), 6) AS detectable_above, round(exp(-(1.959964 + 0.841621) * se), 6) AS detectable_below, round({_PHI.format(z='z1')} + 1 - {_PHI.format(z='z2')}, 6) AS power FROM z""")
def detectable_effects(spark, sf_dir):
    """The smallest odds ratios found in four cases of five, and the power at the observed one."""
    s = strata(views.discs(spark, sf_dir)).groupBy((F.col("stratum") % 3).alias("part")).agg(*[(F.sum(k) + 0.5).alias(k) for k in "abcd"])
    e = s.withColumn("coef", F.expr("ln(a * d / (b * c))")).withColumn("se", F.expr(_WOOLF)).withColumn("z1", ex("abs(coef) / se - 1.959964")).withColumn("z2", ex("abs(coef) / se + 1.959964"))
    return e.select("part", r6("se").alias("se"), r6(ex("exp((1.959964 + 0.841621) * se)")).alias("detectable_above"), r6(ex("exp(-(1.959964 + 0.841621) * se)")).alias("detectable_below"), r6(F.expr(f"{laws.normal_cdf('z1')} + 1 - {laws.normal_cdf('z2')}")).alias("power"))


@query(f"""WITH p AS (SELECT list(p ORDER BY stratum) AS ps FROM (SELECT stratum, (count(*) FILTER (outcome)) / count(*) AS p FROM {DISC} GROUP BY 1)), f AS (SELECT list_reduce(list_prepend([1.0::DOUBLE], list_transform(ps, lambda x: [x::DOUBLE])), lambda d, q: list_transform(range(0, len(d) + 1), lambda k: coalesce(d[k + 1], 0) * (1 - q[1]) + CASE WHEN k = 0 THEN 0 ELSE d[k] * q[1] END)) AS d FROM p)
SELECT k, round(d[k + 1], 9) + 0.0 AS chance FROM f, (SELECT unnest(range(0, 26)) AS k) WHERE k < len(d)""")
def poisson_binomial(spark, sf_dir):
    """The exact distribution of how many strata have an event, where each has its own chance: a fold over the strata's rates (25 of them)."""
    p = views.discs(spark, sf_dir).groupBy("stratum").agg((F.count_if("outcome") / F.count("*")).alias("p"))
    d = p.agg(F.expr("transform(array_sort(collect_list(struct(stratum, p))), s -> s.p)").alias("ps"))
    fold = "aggregate(ps, array(1D), (d, q) -> transform(sequence(0, size(d)), k -> coalesce(get(d, k), 0D) * (1 - q) + if(k = 0, 0D, get(d, k - 1) * q)))"
    return d.select(F.posexplode(F.expr(fold)).alias("k", "c")).select(F.col("k").cast("long").alias("k"), (F.round("c", 9) + F.lit(0.0)).alias("chance"))


# ---- display, assembly, texts

_KNOTS = [0, 2, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 98, 100]


@query(f"""WITH q AS (SELECT quantile_cont(z, [{', '.join(str(k / 100) for k in _KNOTS)}]) AS k, quantile_cont(z, 0.995) AS hi FROM {PX} WHERE measured)
SELECT line, sample, round(greatest(0, least(1, (z - k[2]) / (k[14] - k[2]))), 6) AS linear, round(greatest(0, least(1, ln(1 + z / k[8]) / ln(1 + greatest(hi, k[8]) / k[8]))), 6) AS log,
round(CASE WHEN z <= k[1] THEN 0 WHEN z >= k[15] THEN 1 ELSE list_sum([CASE WHEN z >= k[i] AND z < k[i + 1] THEN [{', '.join(str(k / 100) for k in _KNOTS)}][i] + (z - k[i]) / (k[i + 1] - k[i]) * ([{', '.join(str(k / 100) for k in _KNOTS)}][i + 1] - [{', '.join(str(k / 100) for k in _KNOTS)}][i]) ELSE 0 END for i in range(1, 15)]) END, 6) AS tint FROM {PX}, q""")
def display_stretch(spark, sf_dir):
    """Each pixel from 0 to 1 by three stretches: linear, logarithmic, and piecewise linear through 15 percentiles of the measured pixels."""
    px = views.pixels(spark, sf_dir)
    q = order.quantiles(px.where("measured"), "z", [*[k / 100 for k in _KNOTS], 0.995])
    pick = lambda x: F.max(F.when(F.abs(F.col("q") - x) < 1e-9, F.col("value")))
    one = q.agg(F.array(*[pick(k / 100) for k in _KNOTS]).alias("k"), pick(0.995).alias("hi"))
    y = "array(" + ", ".join(f"{k / 100}D" for k in _KNOTS) + ")"
    tint = f"case when z <= k[0] then 0D when z >= k[14] then 1D else aggregate(sequence(0, 13), 0D, (a, i) -> a + if(z >= k[i] and z < k[i + 1], {y}[i] + (z - k[i]) / (k[i + 1] - k[i]) * ({y}[i + 1] - {y}[i]), 0D)) end"
    log = "ln(1 + z / k[7]) / ln(1 + greatest(hi, k[7]) / k[7])"
    clip = lambda e: r6(F.expr(f"greatest(0D, least(1D, {e}))"))
    return px.join(F.broadcast(one)).select("line", "sample", clip("(z - k[1]) / (k[13] - k[1])").alias("linear"), clip(log).alias("log"), r6(F.expr(tint)).alias("tint"))


@query(f"""WITH p AS (SELECT DISTINCT line, radians(-90 + line / 20.0) AS phi FROM {PX}), e AS (SELECT line, phi, a.v * 30 AS hour, degrees(asin(sin(phi) * sin(radians(1.54)) + cos(phi) * cos(radians(1.54)) * cos(radians(a.v * 30)))) AS el FROM p, range(12) a(v))
SELECT line, round(max(el), 6) AS highest, round(min(el), 6) AS lowest, round(avg((el > 0)::INT), 6) AS lit FROM e GROUP BY 1""")
def solar_elevation(spark, sf_dir):
    """Highest and lowest elevation of the sun over a turn at each line's latitude, and the share of the turn with the sun up."""
    p = views.pixels(spark, sf_dir).select("line").distinct().select("line", F.expr("radians(-90 + line / 20D)").alias("phi"), F.explode(F.sequence(F.lit(0), F.lit(330), F.lit(30))).alias("hour"))
    e = p.withColumn("el", ex("degrees(asin(sin(phi) * sin(radians(1.54)) + cos(phi) * cos(radians(1.54)) * cos(radians(hour))))"))
    return e.groupBy("line").agg(r6(F.max("el")).alias("highest"), r6(F.min("el")).alias("lowest"), r6(F.avg((F.col("el") > 0).cast("int"))).alias("lit"))


@query("""WITH p AS (SELECT o_custkey % 5 AS band, extract(year FROM o_orderdate) AS pass, o_orderpriority = '1-URGENT' AS registered, avg(o_totalprice) AS predicted FROM orders GROUP BY 1, 2, 3), m AS (SELECT o_custkey % 5 AS band, extract(year FROM o_orderdate) AS pass, avg(o_totalprice) AS measured FROM orders WHERE o_custkey % 5 < 4 GROUP BY 1, 2)
SELECT registered, count(*) AS predictions, count(measured) AS scored, round(avg(measured / predicted), 6) AS mean_ratio, count(*) FILTER (abs(measured / predicted - 1) < 0.05) AS within FROM p LEFT JOIN m USING (band, pass) GROUP BY 1""")
def prediction_scores(spark, sf_dir):
    """Measurements against predictions of the same band and pass; those without a measurement stay, unscored."""
    o = views.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("band"), F.year("o_orderdate").alias("pass"), (F.col("o_orderpriority") == "1-URGENT").alias("registered"), F.col("o_totalprice").cast("double").alias("v"))
    p = o.groupBy("band", "pass", "registered").agg(F.avg("v").alias("predicted"))
    m = o.where("band < 4").groupBy("band", "pass").agg(F.avg("v").alias("measured"))
    j = p.join(m, ["band", "pass"], "left").withColumn("r", F.col("measured") / F.col("predicted"))
    return j.groupBy("registered").agg(F.count("*").alias("predictions"), F.count("measured").alias("scored"), r6(F.avg("r")).alias("mean_ratio"), F.count_if(F.abs(F.col("r") - 1) < 0.05).alias("within"))


@query("""SELECT sha256(text) AS digest, lang, count(*) AS copies, min(doc_id) AS first, count(DISTINCT source) AS sources FROM documents WHERE text IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def content_hashes(spark, sf_dir):
    """Contents that stand more than once under one role, by digest: counted in each task first, so that no group is gathered."""
    d = views.table(spark, sf_dir, "documents").where("text is not null").select(F.sha2("text", 256).alias("digest"), "lang", "doc_id", "source")
    return d.groupBy("digest", "lang").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.count_distinct("source").alias("sources")).where("copies > 1")


_NUMBER = r"[0-9]+(?:\.[0-9]+)?"


@query(rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_NUMBER}')) AS token FROM documents) SELECT doc_id, count(*) AS numbers, max(length(ltrim(replace(token, '.', ''), '0'))) AS digits, count(*) FILTER (contains(token, '.')) AS fractions FROM t GROUP BY 1""")
def number_tokens(spark, sf_dir):
    """Numbers in each text: how many, most significant digits, and how many have a fraction."""
    t = views.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_NUMBER), F.lit(0))).alias("token"))
    return t.groupBy("doc_id").agg(F.count("*").alias("numbers"), F.max(F.expr("length(ltrim('0', replace(token, '.', '')))")).alias("digits"), F.count_if(F.expr("contains(token, '.')")).alias("fractions"))


@query(rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_NUMBER}')) AS token FROM documents), a AS (SELECT DISTINCT token FROM t WHERE doc_id % 2 = 0) SELECT token, count(*) AS n, min(doc_id) AS first FROM t WHERE doc_id % 2 = 1 AND token NOT IN (SELECT token FROM a) GROUP BY 1""")
def unknown_numbers(spark, sf_dir):
    """Numbers of one half of the texts that stand nowhere in the other: an anti-join."""
    t = views.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_NUMBER), F.lit(0))).alias("token"))
    a = t.where("doc_id % 2 = 0").select("token").distinct()
    return t.where("doc_id % 2 = 1").join(a, "token", "left_anti").groupBy("token").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


_PREFIXES = [("", "other"), ("http", "web"), ("https://", "secure"), ("http://www.", "site"), ("https://blog.", "blog")]


@query(f"""WITH p(prefix, label) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _PREFIXES)}), m AS (SELECT page_id, arg_max(label, length(prefix)) AS label FROM pages JOIN p ON starts_with(coalesce(url, ''), prefix) GROUP BY 1) SELECT label, count(*) AS n, min(page_id) AS first FROM m GROUP BY 1""")
def longest_prefix(spark, sf_dir):
    """Each key's label by the longest prefix that a table holds; one row a key, without a join of ranges."""
    pick = F.lit(None).cast("string")
    for prefix, label in sorted(_PREFIXES, key=lambda x: len(x[0])):
        pick = F.when(F.coalesce("url", F.lit("")).startswith(prefix), label).otherwise(pick)
    return views.table(spark, sf_dir, "pages").groupBy(pick.alias("label")).agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
