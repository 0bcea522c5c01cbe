"""Horizons along profiles at any azimuth, in pieces that merge.

A profile is cut into segments. Of what lies beyond a segment only crests can be a horizon, that is the upper hull of each
segment beyond; hulls of segments merge into hulls of blocks of segments, so that a segment receives a few crests for
each block of its own level and of the levels above. A group is a strip of segments, a tile of bounded size, however
long profiles are. An azimuth beside lines and columns has profiles of its own: a pixel's place in the rotated grid.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.shared import staged

#: Places in a segment, profiles in a group, segments (or blocks) in a block; crests that a group takes at once.
SEGMENT, STRIP, FAN, MOST = 256, 16, 16, 1 << 15
_POINT = "rot int, prof long, at long, z double, line long, sample long"


def turned(angle: float) -> tuple[float, float]:
    """Cosine and sine of degrees, exact on the axes."""
    return round(math.cos(math.radians(angle)), 15) + 0.0, round(math.sin(math.radians(angle)), 15) + 0.0


def grid(angle: float, dx: float, dy: float) -> tuple[str, str, float]:
    """SQL of a pixel's profile and of its place on it, and the ground between places, for a direction from samples (0) to lines (90 degrees).

    Places and profiles are as far apart as a pixel is long and wide in that direction.
    """
    c, s = turned(angle)
    step, width = abs(dx * c) + abs(dy * s), abs(dx * s) + abs(dy * c)
    along, across = f"(sample * {dx!r} * {c!r} + line * {dy!r} * {s!r})", f"(line * {dy!r} * {c!r} - sample * {dx!r} * {s!r})"
    return f"CAST(floor({across} / {width!r} + 0.5) AS BIGINT)", f"CAST(floor({along} / {step!r} + 0.5) AS BIGINT)", step


def upper(at: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Indices of the upper hull of points, from left to right; points on an edge stay."""
    order = np.lexsort((-z, at))
    order = order[np.r_[True, np.diff(at[order]) > 0]] if len(order) else order
    hull: list[tuple[int, float, int]] = []
    for x, y, k in zip(at[order].tolist(), z[order].tolist(), order.tolist(), strict=True):
        while len(hull) > 1 and (hull[-1][1] - hull[-2][1]) * (x - hull[-2][0]) < (y - hull[-2][1]) * (hull[-1][0] - hull[-2][0]):
            hull.pop()
        hull.append((x, y, k))
    return np.array([k for _, _, k in hull], int)


def _profiles(prof: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The places of each profile's rows, in order."""
    order = np.lexsort((at, prof))
    return np.split(order, np.flatnonzero(np.diff(prof[order])) + 1) if len(order) else []


def _hulls(rows: pd.DataFrame) -> pd.DataFrame:
    """The crests of each profile in a strip of blocks."""
    rows = rows[np.isfinite(rows["z"].to_numpy(float))]
    at, z = rows["at"].to_numpy(), rows["z"].to_numpy(float)
    kept = [own[upper(at[own], z[own])] for own in _profiles(rows["prof"].to_numpy(), at)]
    return rows.iloc[np.concatenate(kept)] if kept else rows


def _seen(steps: list[float], ways: tuple[bool, bool]):
    def best(at, z, c_at, c_z, step):
        """For each place the steepest of the candidates further on, which ascend; NaN and 0 without one. Of equal ones the nearest."""
        d = c_at[None, :] - at[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = np.where(d > 0, (c_z[None, :] - z[:, None]) / (d * step), -np.inf)
        k = slope.argmax(axis=1)
        top = slope[np.arange(len(at)), k]
        return np.where(np.isfinite(top), top, np.nan), k

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at, z, line, sample, asks = (rows[n].to_numpy() for n in ("at", "z", "line", "sample", "ask"))
        z, asks, step = z.astype(float), asks.astype(bool), steps[int(rows["rot"].iloc[0])]
        known, size = np.isfinite(z), len(rows)
        found = {n: rows[n].to_numpy() for n in ("rot", "line", "sample")}
        for name in ("ahead", "behind"):
            found |= {name: np.full(size, np.nan), f"{name}_line": np.zeros(size, np.int64), f"{name}_sample": np.zeros(size, np.int64)}
        for own in _profiles(rows["prof"].to_numpy(), at):
            q, cand = own[asks[own]], own[known[own]]
            for name, wanted, sign in (("ahead", ways[0], 1), ("behind", ways[1], -1)):
                here = cand[::sign]
                if not (wanted and len(here)):
                    continue
                for a in range(0, len(q), 256):
                    b = q[a : a + 256]
                    slope, k = best(sign * at[b], z[b], sign * at[here], z[here], step)
                    seen = ~np.isnan(slope)
                    found[name][b] = slope
                    found[f"{name}_line"][b], found[f"{name}_sample"][b] = np.where(seen, line[here[k]], 0), np.where(seen, sample[here[k]], 0)
        return pd.DataFrame({n: x[asks] for n, x in found.items()})

    return run


def horizons(px: DataFrame, shape: tuple[int, int], angles: list[float], spacing: tuple[float, float], value: str = "z", ways: tuple[bool, bool] = (True, True), segment: int | None = None) -> DataFrame:
    """rot (the angle's number), line, sample and for both ways ahead, ahead_line, ahead_sample, behind, ...: the steepest slope along a direction and against it, and the pixel that makes it.

    px: line, sample and a height for each pixel of a raster of that shape (lines, samples). angles: degrees from 0, along
    samples, to below 180. spacing: ground between samples and between lines. Null, NaN and infinite heights hide
    nothing and see nothing; a pixel without anything ahead has null. Of equal slopes the nearest pixel is told.
    """
    if not all(0 <= a < 180 for a in angles):
        raise ValueError("angles from 0 to below 180")
    segment = segment or SEGMENT
    grids = [grid(a, *spacing) for a in angles]
    corners = [(0, 0), (shape[0] - 1, 0), (0, shape[1] - 1), (shape[0] - 1, shape[1] - 1)]
    ends = []
    for a, (_, _, step) in zip(angles, grids, strict=True):
        c, s = turned(a)
        ends.append([math.floor((x * spacing[0] * c + y * spacing[1] * s) / step + 0.5) for y, x in corners])
    low = min(map(min, ends))
    most = (max(map(max, ends)) - low) // segment
    # Each angle's first and last segments: crests go to no others, and a profile of one segment has none to send.
    first_of, last_of = (F.expr(f"array({', '.join(f'{(f(e) - low) // segment}L' for e in ends)})[rot]") for f in (min, max))
    points = px.select("line", "sample", F.col(value).cast("double").alias("z"))
    points = points.select("*", F.explode(F.expr(f"array({', '.join(f'struct({k} AS rot, {prof} AS prof, {at} AS at)' for k, (prof, at, _) in enumerate(grids))})")).alias("g"))
    points = points.select(F.col("g.rot").alias("rot"), F.col("g.prof").alias("prof"), F.col("g.at").alias("at"), "z", "line", "sample")
    strip = F.expr(f"bigint(floor(prof / {STRIP}))")
    own = points.withColumn("seg", F.expr(f"(at - {low}L) div {segment}"))
    rows = own.withColumn("ask", F.lit(True))
    copies = None
    if most:
        points = own = staged(own, "points")
        met, size, hulls = [], 1, own.where(first_of < last_of).select(*[c.split()[0] for c in _POINT.split(", ")], F.col("seg").alias("block"))
        while size <= most:
            # The crests of each block go to all segments of the other blocks under the same parent.
            hulls = staged(hulls.withColumn("strip", strip).groupBy("rot", "strip", "block").applyInPandas(_hulls, f"{_POINT}, block long, strip long").drop("strip"), "hulls")
            first = F.expr(f"block div {FAN} * {FAN * size}")
            to = F.explode(F.sequence(F.greatest(first, first_of), F.least(first + FAN * size - 1, last_of)))
            met.append(hulls.select("*", to.alias("seg")).where(f"seg div {size} <> block").drop("block"))
            hulls, size = hulls.withColumn("block", F.expr(f"block div {FAN}")), size * FAN
        # A turned profile has pixels in some of its angle's segments only; crests that meet none are left out.
        asked = own.select("rot", strip.alias("strip"), "seg").distinct()
        far = staged(reduce(DataFrame.unionByName, met).withColumn("strip", strip).join(asked, ["rot", "strip", "seg"], "left_semi").drop("strip"), "far")
        full = far.groupBy("rot", strip.alias("strip"), "seg").agg((F.count("*") / MOST).cast("int").alias("over")).where("over > 0")
        rows = own.withColumn("ask", F.lit(True))
        far = far.withColumn("ask", F.lit(False))
        if full.limit(1).count():  # smooth ground has many crests: a group's are dealt to several, which all get its places
            full = staged(full, "full").withColumnRenamed("strip", "_s")
            copies = lambda df: df.withColumn("_s", strip).join(full, ["rot", "_s", "seg"], "left").withColumn("over", F.coalesce("over", F.lit(0)))
            rows = copies(rows).withColumn("salt", F.explode(F.expr("sequence(0, over)"))).drop("_s", "over")
            far = copies(far).withColumn("salt", F.expr("pmod(xxhash64(line, sample), over + 1)")).drop("_s", "over")
        rows = rows.unionByName(far)
    keys = ["rot", "strip", "seg", *(["salt"] if copies else [])]
    kinds = "rot int, line long, sample long, " + ", ".join(f"{n} double, {n}_line long, {n}_sample long" for n in ("ahead", "behind"))
    got = rows.withColumn("strip", strip).groupBy(*keys).applyInPandas(_seen([g[2] for g in grids], ways), kinds)
    for n in ("ahead", "behind"):
        seen = F.col(n).isNotNull() & ~F.isnan(n)
        got = got.select(*[F.when(seen, F.col(c)).alias(c) if c in (n, f"{n}_line", f"{n}_sample") else F.col(c) for c in got.columns])
    if copies:
        gap = lambda n: F.abs(F.col(f"{n}_line") - F.col("line")) + F.abs(F.col(f"{n}_sample") - F.col("sample"))
        top = [F.max(F.when(F.col(n).isNotNull(), F.struct(F.col(n).alias("s"), (-gap(n)).alias("g"), F.col(f"{n}_line").alias("l"), F.col(f"{n}_sample").alias("p")))).alias(n) for n in ("ahead", "behind")]
        got = got.groupBy("rot", "line", "sample").agg(*top)
        got = got.select("rot", "line", "sample", *[F.col(f"{n}.{k}").alias(f"{n}{t}") for n in ("ahead", "behind") for k, t in (("s", ""), ("l", "_line"), ("p", "_sample"))])
    return got


def skylines(px: DataFrame, shape: tuple[int, int], along: str, spacing: tuple[float, float], value: str = "z", ways: tuple[bool, bool] = (True, True)) -> DataFrame:
    """line, sample, ahead, ahead_crest, behind, behind_crest: slopes and crests both ways along samples or lines; see horizons."""
    got = horizons(px, shape, [0.0 if along == "sample" else 90.0], spacing, value, ways)
    return got.select("line", "sample", "ahead", F.col(f"ahead_{along}").alias("ahead_crest"), "behind", F.col(f"behind_{along}").alias("behind_crest"))
