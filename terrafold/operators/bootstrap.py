"""Block bootstraps in one pass: Poisson weights as arrays of replicates, fits of all replicates at once, shared patterns.

A block's weight in a replicate is a function of both numbers, so that runs, retries and tasks agree without a table of
draws. What a statistic needs is first summed by block (one scan); the replicates are a matrix product of weights and sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.shared import staged

#: Multipliers of the weights' hash; where a uniform number passes from one count of a Poisson law of mean 1 to the next.
BLOCK_ODD, REPLICATE_ODD, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
STEPS = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]
#: Cells of a weights' matrix that a task holds at once.
CELLS = 1 << 21


def weights(block: np.ndarray, replicates: int) -> np.ndarray:
    """Blocks (64-bit numbers) x replicates: how often a block is drawn, from a Poisson law of mean 1."""
    u64 = np.uint64
    x = block.astype(np.int64).view(u64)[:, None] * u64(BLOCK_ODD) + np.arange(1, replicates + 1, dtype=u64)[None, :] * u64(REPLICATE_ODD)
    x ^= x >> u64(33)
    x *= u64(MIX_A)
    x ^= x >> u64(29)
    x *= u64(MIX_B)
    x ^= x >> u64(32)
    return np.searchsorted(np.array(STEPS), (x >> u64(11)).astype(float) / (1 << 53), "left").astype(float)


def weights_sql(block: str, replicate: str) -> str:
    """The same in DuckDB, step by step: columns x1 to x5, and w."""
    wide = lambda x, m: f"(({x}::UHUGEINT * {m}) % 18446744073709551616)"
    return (
        f"(({wide(block, BLOCK_ODD)} + {wide(f'({replicate} + 1)', REPLICATE_ODD)}) % 18446744073709551616)::UBIGINT AS x1, xor(x1, x1 >> 33) AS x2, {wide('x2', MIX_A)}::UBIGINT AS x3, "
        f"xor(x3, x3 >> 29) AS x4, {wide('x4', MIX_B)}::UBIGINT AS x5, len(list_filter({STEPS}::DOUBLE[], lambda t: (xor(x5, x5 >> 32) >> 11)::DOUBLE / 9007199254740992 > t)) AS w"
    )


def replicate_sums(cells: DataFrame, by: list[str], block: str, values: list[str], replicates: int) -> DataFrame:
    """by, replicate and each value's weighted sum over blocks; cells has a row for each by and block (a long, not negative)."""
    kinds = dict(cells.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            step = max(1, CELLS // replicates)
            for a in range(0, len(whole), step):
                b = whole.iloc[a : a + step]
                w, v = weights(b[block].to_numpy(), replicates), b[values].to_numpy(float)
                groups = b.groupby(by, sort=False, dropna=False).indices if by else {(): np.arange(len(b))}
                for key, rows in groups.items():
                    out = pd.DataFrame(w[rows].T @ v[rows], columns=values)
                    for c, k in zip(by, key if isinstance(key, tuple) else (key,), strict=True):
                        out[c] = k
                    out["replicate"] = np.arange(replicates)
                    yield out[[*by, "replicate", *values]]

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], "replicate int", *[f"{v} double" for v in values]])
    return cells.select(*by, block, *values).mapInPandas(run, schema).groupBy(*by, "replicate").agg(*[F.sum(v).alias(v) for v in values])


def percentiles(rows: DataFrame, value: str, qs: list[float]) -> DataFrame:
    """q, value, se, used: percentiles of replicates (a bounded number of rows; nulls are left out) and their Monte-Carlo errors, by a Gaussian kernel's density there."""
    x = rows.where(F.col(value).isNotNull()).agg(F.array_sort(F.collect_list(value)).alias("x"))
    x = x.withColumn("n", F.expr("size(x)")).where("n > 1").withColumn("mean", F.expr("aggregate(x, 0D, (s, v) -> s + v) / n"))
    x = x.withColumn("h", F.expr("sqrt(aggregate(x, 0D, (s, v) -> s + (v - mean) * (v - mean)) / (n - 1)) * pow(n, -0.2D)"))
    x = x.select("x", "n", "h", F.explode(F.array(*map(F.lit, qs))).alias("q")).withColumn("r", F.expr("(n - 1) * q"))
    x = x.withColumn("value", F.expr("x[int(floor(r))] + (x[int(ceil(r))] - x[int(floor(r))]) * (r - floor(r))"))
    dense = "aggregate(x, 0D, (s, v) -> s + exp(-0.5D * pow((v - value) / h, 2))) / (n * h * sqrt(2 * pi()))"
    return x.select("q", "value", F.expr(f"if(h > 0, sqrt(q * (1 - q) / n) / ({dense}), 0D)").alias("se"), F.col("n").cast("long").alias("used"))


def _scored(x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """replicates x (1 + p + p * p): likelihood, scores and information of rows with weights (rows x replicates), each at its own coefficients."""
    eta = np.clip(x @ beta.T, -40, 40)
    mu = 1 / (1 + np.exp(-eta))
    like = (w * (y[:, None] * eta - np.log1p(np.exp(eta)))).sum(axis=0)
    score = (w * (y[:, None] - mu)).T @ x
    spread = w * mu * (1 - mu)
    info = np.stack([(spread * x[:, i : i + 1]).T @ x for i in range(x.shape[1])], axis=1)
    return np.concatenate([like[:, None], score, info.reshape(len(beta), -1)], axis=1)


class Newton:
    """Newton steps of many fits side by side; each halves its own step where its likelihood falls. settled tells when no fit moves."""

    def __init__(self, n: int, p: int):
        self.p, self.beta = p, np.zeros((n, p))
        self.like, self.step = np.full(n, -np.inf), np.zeros((n, p))
        self.done, self.bad, self.halved = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, int)
        self.asked, self.info = self.beta.copy(), np.zeros((n, p, p))

    def take(self, sums: np.ndarray) -> None:
        """What the rows say at `asked`: likelihood, scores, information."""
        like, score, info = sums[:, 0], sums[:, 1 : self.p + 1], sums[:, self.p + 1 :].reshape(-1, self.p, self.p)
        better = ~self.done & (like >= self.like - 1e-12 * np.abs(self.like).clip(0, 1e300)) | (self.halved >= 30) & ~self.done
        worse = ~self.done & ~better
        self.step[worse] /= 2
        self.halved[worse] += 1
        for k in np.flatnonzero(better):
            self.beta[k], self.like[k], self.info[k], self.halved[k] = self.asked[k], like[k], info[k], 0
            try:
                self.step[k] = np.linalg.solve(info[k], score[k])
            except np.linalg.LinAlgError:
                self.bad[k] = True
            if np.abs(self.beta[k]).max() > 30 or not np.isfinite(self.step[k]).all():  # the columns part the outcomes
                self.bad[k] = True
            self.done[k] = self.bad[k] or np.abs(self.step[k]).max() < 1e-9
        self.asked = np.where(self.done[:, None], self.beta, self.beta + self.step)

    @property
    def settled(self) -> bool:
        return bool(self.done.all())

    def result(self) -> np.ndarray:
        """Coefficients; NaN where a fit has none."""
        return np.where((self.bad | ~self.done)[:, None], np.nan, self.beta)


def replicate_fits(df: DataFrame, y: str, columns: list[str], block: str, replicates: int, rounds: int = 60) -> np.ndarray:
    """replicates x (1 + columns): a logistic fit of each block resample, NaN without one. A scan is a Newton step of all of them.

    df: y, columns (numbers, as SQL) and block (a long). Rows of one block that are equal in all are counted first. Only
    sums come to the driver: a row for each replicate and sum.
    """
    p, x = 1 + len(columns), [f"x{k}" for k in range(1 + len(columns))]
    cells = df.select(F.expr(block).cast("long").alias("block"), F.expr(f"double(int({y}))").alias("y"), F.lit(1.0).alias("x0"), *[F.expr(f"double({c})").alias(f"x{k + 1}") for k, c in enumerate(columns)])
    cells = staged(cells.groupBy("block", "y", *x).agg(F.count("*").cast("double").alias("n")), "cells")
    fit = Newton(replicates, p)

    def sums(beta: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((replicates, 1 + p + p * p))
            for whole in batches:
                step = max(1, CELLS // replicates)
                for a in range(0, len(whole), step):
                    b = whole.iloc[a : a + step]
                    w = weights(b["block"].to_numpy(), replicates) * b["n"].to_numpy()[:, None]
                    total += _scored(b[x].to_numpy(float), b["y"].to_numpy(float), w, beta)
            yield pd.DataFrame({"at": np.arange(total.size), "v": total.reshape(-1)})

        got = cells.mapInPandas(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas().sort_values("at")
        return got["v"].to_numpy().reshape(replicates, -1) if len(got) else np.zeros((replicates, 1 + p + p * p))

    for _ in range(rounds):
        fit.take(sums(fit.asked))
        if fit.settled:
            break
    return fit.result()


#: Patterns (different rows of outcome, covariates and cluster) that fits may share.
PATTERNS = 50_000


def specification_curve(df: DataFrame, y: str, exposure: str, covariates: list[str], cluster: str, rounds: int = 60) -> DataFrame:
    """mask, covariates, n_covariates, coefficient, se, se_cluster of the exposure for every subset of covariates (bit k of mask: the k-th).

    df's columns are read in one scan, which counts different patterns of outcome, exposure, covariates and cluster;
    each fit then works on the patterns, which every task has. Nulls: a fit that has no finite best. More patterns than
    PATTERNS raise an error: then a fit is a scan of its own (terrafold.plans.statistics.logistic), or covariates want coarser values.
    """
    spark, x = df.sparkSession, [f"x{k}" for k in range(len(covariates))]
    p = df.select(F.expr(f"double(int({y}))").alias("y"), F.expr(f"double({exposure})").alias("e"), *[F.expr(f"double({c})").alias(n) for n, c in zip(x, covariates, strict=True)], F.expr(cluster).cast("long").alias("cluster"))
    p = staged(p.groupBy("y", "e", *x, "cluster").agg(F.count("*").cast("double").alias("n")), "patterns")
    many = p.limit(PATTERNS + 1).count()
    if many > PATTERNS:
        raise ValueError(f"over {PATTERNS} different patterns of {', '.join(covariates)}")
    table = p.toPandas().to_numpy(float)  # bounded by PATTERNS
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        for b in batches:
            yield pd.DataFrame([(int(m), *one_fit(t, [k for k in range(len(covariates)) if m >> k & 1], rounds)) for m in b["mask"]], columns=["mask", "coefficient", "se", "se_cluster"])

    masks = spark.range(1 << len(covariates)).select(F.col("id").alias("mask")).repartition(spark.sparkContext.defaultParallelism)
    names = F.expr("concat_ws(', ', filter(array(" + ", ".join(f"if(shiftright(mask, {k}) & 1L = 1L, '{c.replace(chr(39), chr(39) * 2)}', '')" for k, c in enumerate(covariates)) + "), c -> c <> ''))")
    fits = masks.mapInPandas(run, "mask long, coefficient double, se double, se_cluster double")
    null = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return fits.select("mask", names.alias("covariates"), F.bit_count("mask").alias("n_covariates"), null("coefficient"), null("se"), null("se_cluster"))


def one_fit(t: np.ndarray, chosen: list[int], rounds: int) -> tuple[float, float, float]:
    """Coefficient of the exposure, its error and its error by clusters, from patterns (y, e, covariates..., cluster, n)."""
    y, n, cluster = t[:, 0], t[:, -1], t[:, -2]
    cols = [t[:, 2 + k] for k in chosen]
    cols = [c for c in cols if len(c) and c.max() > c.min()]  # a constant covariate is the intercept
    x = np.column_stack([np.ones(len(t)), t[:, 1], *cols])
    fit = Newton(1, x.shape[1])
    for _ in range(rounds):
        fit.take(_scored(x, y, n[:, None], fit.asked))
        if fit.settled:
            break
    beta = fit.result()[0]
    if np.isnan(beta).any():
        return (math.nan,) * 3
    cov = np.linalg.inv(fit.info[0])
    score = x * ((y - 1 / (1 + np.exp(-x @ beta))) * n)[:, None]
    _, at = np.unique(cluster, return_inverse=True)
    by = np.zeros((at.max() + 1, x.shape[1]))
    np.add.at(by, at, score)
    g = len(by)
    robust = cov @ (by.T @ by) @ cov * (g / (g - 1) if g > 1 else math.nan)
    return float(beta[1]), float(np.sqrt(cov[1, 1])), float(np.sqrt(robust[1, 1]))
