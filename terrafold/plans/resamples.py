"""Queries of block bootstraps and of the specification curve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.operators import bootstrap
from terrafold.plans.raster import r6
from terrafold.plans.registry import DISC, PX, query
from terrafold.shared import staged
from terrafold.sources import views

#: Replicates; discs stand on a lattice of 100 columns, in blocks of 5 x 5.
REPLICATES, TIMES = 200, 100
BLOCK = "(id {div} 100 {div} 5 * 20 + id % 100 {div} 5)"
_DUCK_BLOCK, _SPARK_BLOCK = BLOCK.format(div="//"), BLOCK.format(div="div")

_ODDS = f"""c AS (SELECT stratum, {_DUCK_BLOCK} AS block, count(*) FILTER (exposed AND outcome) AS a, count(*) FILTER (exposed AND NOT outcome) AS b, count(*) FILTER (NOT exposed AND outcome) AS c, count(*) FILTER (NOT exposed AND NOT outcome) AS d FROM {DISC} GROUP BY 1, 2),
w AS (SELECT block, replicate, {bootstrap.weights_sql('block', 'replicate')} FROM (SELECT DISTINCT block FROM c), (SELECT unnest(range(0, {REPLICATES})) AS replicate)),
s AS (SELECT stratum, replicate, sum(w * a) AS a, sum(w * b) AS b, sum(w * c) AS c, sum(w * d) AS d FROM c JOIN w USING (block) GROUP BY 1, 2),
o AS (SELECT replicate, sum(a * d / nullif(a + b + c + d, 0)) AS r, sum(b * c / nullif(a + b + c + d, 0)) AS q, sum(a) * sum(d) AS ad, sum(b) * sum(c) AS bc FROM s GROUP BY 1),
l AS (SELECT replicate, CASE WHEN ad > 0 AND bc > 0 THEN ln(ad / bc) END AS crude, CASE WHEN r > 0 AND q > 0 THEN ln(r / q) END AS pooled FROM o)"""


def odds_replicates(spark, sf_dir) -> DataFrame:
    d = views.discs(spark, sf_dir).withColumn("block", F.expr(_SPARK_BLOCK))
    n = lambda x: F.count_if(F.expr(x))
    cells = d.groupBy("stratum", "block").agg(n("exposed and outcome").alias("a"), n("exposed and not outcome").alias("b"), n("not exposed and outcome").alias("c"), n("not exposed and not outcome").alias("d"))
    s = bootstrap.replicate_sums(cells, ["stratum"], "block", list("abcd"), REPLICATES)
    total = "nullif(a + b + c + d, 0)"
    o = s.groupBy("replicate").agg(F.sum(F.expr(f"a * d / {total}")).alias("r"), F.sum(F.expr(f"b * c / {total}")).alias("q"), (F.sum("a") * F.sum("d")).alias("ad"), (F.sum("b") * F.sum("c")).alias("bc"))
    return o.select("replicate", F.expr("if(ad > 0 and bc > 0, ln(ad / bc), null)").alias("crude"), F.expr("if(r > 0 and q > 0, ln(r / q), null)").alias("pooled"))


@query(f"WITH {_ODDS} SELECT replicate::INT AS replicate, round(crude, 6) + 0.0 AS crude, round(pooled, 6) + 0.0 AS pooled FROM l")
def odds_bootstrap(spark, sf_dir):
    """Crude and pooled log odds ratios of 200 resamples of 2-D blocks: weights are a matrix, cells are counted once."""
    return odds_replicates(spark, sf_dir).select("replicate", r6("crude").alias("crude"), r6("pooled").alias("pooled"))


@query(f"""WITH {_ODDS}, v AS (SELECT 'crude' AS statistic, crude AS x FROM l WHERE crude IS NOT NULL UNION ALL SELECT 'pooled', pooled FROM l WHERE pooled IS NOT NULL),
g AS (SELECT statistic, q, count(*) AS n, quantile_cont(x, q) AS value, stddev_samp(x) * pow(count(*), -0.2) AS h FROM v, (VALUES (0.025), (0.5), (0.975)) AS t(q) GROUP BY 1, 2)
SELECT statistic, g.q::DOUBLE AS q, round(any_value(value), 6) + 0.0 AS value, round(sqrt(any_value(g.q) * (1 - any_value(g.q)) / any_value(n)) / (sum(exp(-0.5 * pow((x - value) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi()))), 6) AS se, any_value(n) AS used FROM v JOIN g USING (statistic) GROUP BY statistic, g.q""".replace("quantile_cont(x, q)", "CASE q WHEN 0.025 THEN quantile_cont(x, 0.025) WHEN 0.5 THEN quantile_cont(x, 0.5) ELSE quantile_cont(x, 0.975) END"))
def odds_intervals(spark, sf_dir):
    """Percentiles of the resampled odds ratios, with their Monte-Carlo errors from a kernel's density."""
    o = staged(odds_replicates(spark, sf_dir), "odds")
    both = [bootstrap.percentiles(o, c, [0.025, 0.5, 0.975]).select(F.lit(c).alias("statistic"), "q", r6("value").alias("value"), r6("se").alias("se"), "used") for c in ("crude", "pooled")]
    return both[0].unionByName(both[1])


#: How patches are drawn: each for itself, by rows of patches, by blocks of 4 x 4 patches; schemes have numbers of their own.
SCHEMES = {"simple": "a {div} 1 * 20 + b", "rows": "a", "blocks": "a {div} 4 * 5 + b {div} 4"}
_CASES = " UNION ALL ".join(f"SELECT '{k}' AS scheme, {i} * 1099511627776 + {e.format(div='//')} AS block, x FROM r" for i, (k, e) in enumerate(SCHEMES.items()))


@query(f"""WITH g AS (SELECT line // 5 AS a, sample // 5 AS b, avg(z) AS m, var_samp(z) AS v, count(*) AS n FROM {PX} GROUP BY 1, 2), r AS (SELECT a, b, ln(m * m / v) AS x FROM g WHERE n = 25 AND v > 0), m AS (SELECT min(x) AS lo, max(x) AS hi FROM r),
s AS ({_CASES}), c AS (SELECT scheme, block, least(119, floor((x - lo) / (hi - lo) * 120))::INT AS bin, count(*) AS n FROM s, m GROUP BY ALL),
w AS (SELECT block, replicate, {bootstrap.weights_sql('block', 'replicate')} FROM (SELECT DISTINCT block FROM c), (SELECT unnest(range(0, {TIMES})) AS replicate)),
h AS (SELECT scheme, replicate, bin, sum(w * n) AS n FROM c JOIN w USING (block) GROUP BY 1, 2, 3 HAVING sum(w * n) > 0),
f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY scheme, replicate ORDER BY n DESC, bin) = 1)
SELECT scheme, replicate::INT AS replicate, bin, round(exp(lo + (bin + 0.5) * (hi - lo) / 120), 6) AS mode FROM f, m""")
def mode_bootstrap(spark, sf_dir):
    """The log-space mode of patch looks in 100 resamples under three schemes: histograms are counted by block once, and weighted."""
    g = views.pixels(spark, sf_dir).groupBy(F.expr("line div 5").alias("a"), F.expr("sample div 5").alias("b")).agg(F.avg("z").alias("m"), F.var_samp("z").alias("v"), F.count("*").alias("n"))
    r = staged(g.where("n = 25 and v > 0").select("a", "b", F.expr("ln(m * m / v)").alias("x")), "patches")
    m = r.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    cases = F.explode(F.expr("array(" + ", ".join(f"struct('{k}' as scheme, {i} * 1099511627776L + {e.format(div='div')} as block)" for i, (k, e) in enumerate(SCHEMES.items())) + ")")).alias("s")
    c = r.select("a", "b", "x", cases).crossJoin(F.broadcast(m)).select("s.scheme", "s.block", F.expr("int(least(119, floor((x - lo) / (hi - lo) * 120)))").alias("bin"))
    h = bootstrap.replicate_sums(c.groupBy("scheme", "bin", "block").agg(F.count("*").alias("n")), ["scheme", "bin"], "block", ["n"], TIMES).where("n > 0")
    f = h.groupBy("scheme", "replicate").agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin"))
    return f.crossJoin(F.broadcast(m)).select("scheme", "replicate", "bin", r6(F.expr("exp(lo + (bin + 0.5D) * (hi - lo) / 120)")).alias("mode"))


@query()
def fit_bootstrap(spark, sf_dir):
    """Coefficients of the logistic model over 100 block resamples, all fitted side by side: percentiles with errors, and how many had a fit (iterative: no SQL; tested against fits with the same weights)."""
    d = views.discs(spark, sf_dir).withColumn("e", F.col("exposed").cast("int"))
    found = bootstrap.replicate_fits(d, "outcome", ["e", "stratum"], _SPARK_BLOCK, TIMES)
    names = ["intercept", "exposed", "stratum"]
    rows = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in found.tolist()], ", ".join(f"{n} double" for n in names))
    parts = [bootstrap.percentiles(rows, n, [0.025, 0.5, 0.975]).select(F.lit(n).alias("term"), "q", "value", "se", "used") for n in names]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: Ten covariates of a disc.
COVARIATES = ["stratum % 2", "stratum % 3", "int(stratum > 12)", "int(stratum % 5 = 0)", "int(id % 11 < 4)", "int(id % 13 < 6)", "id % 2", "int(id % 3 = 0)", "int(id % 7 < 3)", "int(id % 100 < 50)"]


@query()
def specification_curve(spark, sf_dir):
    """The exposure's coefficient under each of the 1,024 subsets of ten covariates, with errors of the model and of clusters; one scan for all (iterative: no SQL; tested against single fits)."""
    d = views.discs(spark, sf_dir).withColumn("e", F.col("exposed").cast("int"))
    return bootstrap.specification_curve(d, "outcome", "e", COVARIATES, "stratum").withColumn("odds_ratio", F.exp("coefficient"))


@query()
def specification_summary(spark, sf_dir):
    """Of the specification curve, whole and by whether a covariate is in: fits, those without one, range and median of odds ratios, how many exclude 1 by clusters."""
    s = staged(specification_curve(spark, sf_dir), "curve")
    split = F.explode(F.expr("concat(array(struct('all' as covariate, true as inside)), array(" + ", ".join(f"struct('{c}' as covariate, shiftright(mask, {k}) & 1L = 1L as inside)" for k, c in enumerate(COVARIATES)) + "))")).alias("c")
    return s.select("*", split).groupBy("c.covariate", "c.inside").agg(
        F.count("*").alias("specifications"), F.count_if(F.col("coefficient").isNull()).alias("unfitted"), F.min("odds_ratio").alias("lowest"), F.median("odds_ratio").alias("median"), F.max("odds_ratio").alias("highest"),
        F.count_if(F.abs("coefficient") > 1.959963984540054 * F.col("se_cluster")).alias("exclude_one"),
    )
