"""Neighbourhood operators on rasters: tiles with halos, box sums, gradients, relief, hazard, distance.

Pixels go to tiles of a bounded size, with copies of what lies around a tile within reach of the window. All windows of
an operator are inside the tile, so there is one shuffle, by tile, and no group grows with the raster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A tile's edge; pixels in a group of whole lines, about (one line at least); pixels of a task, about, in large rasters.
EDGE, LINES_OF, PER_TASK = 256, 1 << 16, 1 << 17


def spread(df: DataFrame, shape: tuple[int, int], *by: str) -> DataFrame:
    """df dealt by columns: to the session's number of tasks, or to more where those would get more than PER_TASK pixels of a raster of this shape."""
    n = -(-shape[0] * shape[1] // PER_TASK)
    return df.repartition(n, *by) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*by)


def _images(x: str, n: int, h: int, boundary: str) -> str:
    """SQL for the places at which a pixel stands: its own, and those beyond the border that repeat it."""
    if boundary == "reflect":  # d c b a | a b c d
        return f"array_compact(array({x}, if({x} < {h}, -1 - {x}, null), if({x} >= {n - h}, {2 * n - 1} - {x}, null)))"
    if boundary == "mirror":  # d c b | a b c d
        return f"array_compact(array({x}, if({x} between 1 and {h}, -{x}, null), if({x} between {n - 1 - h} and {n - 2}, {2 * n - 2} - {x}, null)))"
    if boundary == "nearest":  # a a a | a b c d
        return f"concat(array({x}), if({x} = 0, sequence(-{h}L, -1L), array()), if({x} = {n - 1}, sequence({n}L, {n + h - 1}L), array()))"
    return f"array({x})"


def tiled(px: DataFrame, shape: tuple[int, int], h: int, boundary: str = "valid", edge: int | None = None) -> DataFrame:
    """px with _tl, _ts (tile) and _l, _s (place), with copies for halos of h pixels and for the border's rule."""
    t, edge = px, edge or EDGE
    for name, x, n in (("l", "line", shape[0]), ("s", "sample", shape[1])):
        t = t.withColumn(f"_{name}", F.explode(F.expr(_images(x, n, h, boundary)).cast("array<long>")))
        lo, hi = f"greatest(0, bigint(floor((_{name} - {h}) / {edge})))", f"least({(n - 1) // edge}, bigint(floor((_{name} + {h}) / {edge})))"
        t = t.withColumn(f"_t{name}", F.explode(F.expr(f"sequence({lo}, {hi})")))
    return spread(t, shape, "_tl", "_ts")


def own(t: DataFrame, edge: int | None = None) -> DataFrame:
    """The tiles' own pixels, without halos; edge as for tiled()."""
    return t.where("_l = line and _s = sample and _tl = line div {0} and _ts = sample div {0}".format(edge or EDGE)).drop("_l", "_s", "_tl", "_ts")


def _axis(axis: str) -> Window:
    return Window.partitionBy("_tl", "_ts", "_s" if axis == "line" else "_l").orderBy("_l" if axis == "line" else "_s")


def box(px: DataFrame, shape: tuple[int, int], size: int, values: dict[str, Column], boundary: str = "valid") -> DataFrame:
    """px with the sum of each value over the size x size box around each pixel, and n, the box's non-null pixels.

    Two passes, along lines and along samples. boundary is reflect, mirror, nearest, or valid (nothing beyond the
    border; divide by size squared instead of n for zeros there).
    """
    h = size // 2
    t = tiled(px, shape, h, boundary)
    first = next(iter(values.values()))
    cols = {**values, "n": first.isNotNull().cast("long")}
    t = t.select("*", *[c.alias(f"_v_{k}") for k, c in cols.items()])
    for axis in ("line", "sample"):
        w = _axis(axis).rangeBetween(-h, h)
        t = t.select(*[c for c in t.columns if not c.startswith("_v_")], *[F.sum(f"_v_{k}").over(w).alias(f"_v_{k}") for k in cols])
    t = own(t)
    return t.select(*px.columns, *[F.col(f"_v_{k}").alias(k) for k in cols])


def extremes(px: DataFrame, shape: tuple[int, int], size: int, value: str, how: str = "max") -> DataFrame:
    """px with the largest (or smallest) value over the box around each pixel."""
    h, f = size // 2, {"max": F.max, "min": F.min}[how]
    t = tiled(px, shape, h).withColumn(how, F.col(value))
    for axis in ("line", "sample"):
        t = t.withColumn(how, f(how).over(_axis(axis).rangeBetween(-h, h)))
    return own(t)


def neighbours(px: DataFrame, shape: tuple[int, int], value: str, steps: dict[str, tuple[str, int]]) -> DataFrame:
    """px with a column for each step (axis, distance): the value there, null where there is no pixel."""
    t = tiled(px, shape, max(abs(d) for _, d in steps.values()))
    for name, (axis, d) in steps.items():
        t = t.withColumn(name, F.first(value).over(_axis(axis).rangeBetween(d, d)))
    return own(t)


def gradient(px: DataFrame, shape: tuple[int, int], spacing: tuple[float, float], value: str = "z") -> DataFrame:
    """px with gy and gx: central differences, one-sided at borders, with the spacing of lines and of samples."""
    t = neighbours(px, shape, value, {"_up": ("line", -1), "_down": ("line", 1), "_left": ("sample", -1), "_right": ("sample", 1)})

    def slope(before: str, after: str, step: float) -> Column:
        wide = F.when(F.col(before).isNotNull() & F.col(after).isNotNull(), 2 * step).otherwise(step)
        return (F.coalesce(after, value) - F.coalesce(before, value)) / wide

    return t.withColumn("gy", slope("_up", "_down", spacing[0])).withColumn("gx", slope("_left", "_right", spacing[1])).drop("_up", "_down", "_left", "_right")


def slope_aspect(px: DataFrame, shape: tuple[int, int], spacing: tuple[float, float]) -> DataFrame:
    """gradient with slope and aspect, in degrees; aspect from 0 to 360."""
    g = gradient(px, shape, spacing)
    aspect = F.degrees(F.atan2(-F.col("gx"), F.col("gy")))
    return g.withColumn("slope", F.degrees(F.atan(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2)))).withColumn("aspect", F.when(aspect < 0, aspect + 360).otherwise(aspect))


def relief(azimuth: float, altitude: float) -> Column:
    """Cosine of the light's angle on the surface with slope gx, gy; not clipped."""
    return F.expr(f"(sin(radians({altitude})) - cos(radians({altitude})) * (gx * sin(radians({azimuth})) - gy * cos(radians({azimuth})))) / sqrt(1 + gx * gx + gy * gy)")


def hazard(terms: dict[str, tuple[str, float, float]]) -> Column:
    """Weighted mean of terms (SQL, scale, weight), each clipped to [0, 1]; absent terms leave their weight to the others."""
    if not sum(w for _, _, w in terms.values()):
        raise ValueError("all weights are 0")
    part = [f"coalesce({w} * greatest(0, least(1, ({x}) / {s})), 0)" for x, s, w in terms.values()]
    weight = [f"if(({x}) is null, 0, {w})" for x, _, w in terms.values()]
    return F.expr(f"greatest(0D, least(1D, ({' + '.join(part)}) / nullif({' + '.join(weight)}, 0)))")


def distance(px: DataFrame, shape: tuple[int, int], target: str) -> DataFrame:
    """line, sample, distance: exact Euclidean distance, in pixels, to the nearest pixel where target holds, of a raster without gaps.

    Along each sample's column, the nearest target's line offset by running minima; then, along each line, the lower
    envelope of the columns' parabolas, which a linear scan gives.
    """
    # Both ways a frame that only grows: one that ends with its partition is summed anew for each row.
    ways = {n: F.last(F.when(F.col(target), F.col("line")), True).over(Window.partitionBy("sample").orderBy(o)) for n, o in (("_a", "line"), ("_b", F.desc("line")))}
    c = px.withColumns(ways).select("line", "sample", F.least(F.col("line") - F.col("_a"), F.col("_b") - F.col("line")).cast("double").alias("_g"))

    def run(lines: pd.DataFrame) -> pd.DataFrame:
        line, sample, g = (lines[n].to_numpy() for n in ("line", "sample", "_g"))
        order = np.lexsort((sample, line))
        line, sample, height = line[order], sample[order], g[order].astype(float) ** 2
        ends = np.flatnonzero(np.diff(line)) + 1
        found = [envelope(a, h) for a, h in zip(np.split(sample.astype(float), ends), np.split(height, ends), strict=True)]
        return pd.DataFrame({"line": line, "sample": sample, "distance": np.sqrt(np.concatenate(found))})

    each = max(1, LINES_OF // shape[1])
    d = c.groupBy(F.expr(f"line div {each}")).applyInPandas(run, "line long, sample long, distance double")
    return d.select("line", "sample", F.when(~F.isnan("distance"), F.col("distance")).alias("distance"))


def envelope(at: np.ndarray, height: np.ndarray) -> np.ndarray:
    """At each place, the lowest of the parabolas (x - at)**2 + height, in one scan; NaN heights have none, and NaN is told without any."""
    own = np.flatnonzero(~np.isnan(height))
    if not len(own):
        return np.full(len(at), np.nan)
    hull, start = [own[0]], [-np.inf]  # parabolas in order, and from where on each is the lowest
    for k in own[1:]:
        while True:
            j = hull[-1]
            meet = ((height[k] + at[k] ** 2) - (height[j] + at[j] ** 2)) / (2 * (at[k] - at[j]))
            if meet > start[-1] or len(hull) == 1:
                break
            hull.pop()
            start.pop()
        hull.append(k)
        start.append(meet)
    best = np.array(hull)[np.searchsorted(np.array(start), at, "right") - 1]
    return (at - at[best]) ** 2 + height[best]


def weighted(px: DataFrame, shape: tuple[int, int], kernel: dict[int, float], values: dict[str, Column], boundary: str = "valid") -> DataFrame:
    """line, sample and each value's sum under a separable kernel (weight by distance): one pass along each axis, in tiles."""
    h = max(map(abs, kernel))
    t = tiled(px, shape, h, boundary).select("line", "sample", "_l", "_s", "_tl", "_ts", *[v.alias(k) for k, v in values.items()])
    for axis in ("line", "sample"):
        w = _axis(axis)
        near = lambda k: sum((F.coalesce(F.first(k).over(w.rangeBetween(d, d)), F.lit(0.0)) * x for d, x in kernel.items()), F.lit(0.0))  # noqa: B023, E731
        t = t.select("line", "sample", "_l", "_s", "_tl", "_ts", *[near(k).alias(k) for k in values])
    return own(t)


def shifted_sums(px: DataFrame, shape: tuple[int, int], a: str, b: str, reach: int, edge: int | None = None) -> DataFrame:
    """dl, ds, n, a, b, aa, bb, ab: for each shift of up to reach lines and samples, sums over pixels with both values of a here and b there.

    All shifts are summed in a tile with its halo, so that what is shuffled grows with the pixels, and then with the shifts' sums.
    """
    t = tiled(px.select("line", "sample", F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")), shape, reach, edge=edge)
    size = edge or EDGE

    def run(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
        top, left, n = int(key[0]) * size, int(key[1]) * size, size + 2 * reach
        x, y = np.full((n, n), np.nan), np.full((n, n), np.nan)
        at = (tile["line"].to_numpy() - top + reach, tile["sample"].to_numpy() - left + reach)
        x[at], y[at] = tile["a"].to_numpy(), tile["b"].to_numpy()
        own, rows = x[reach : reach + size, reach : reach + size], []
        for dl in range(-reach, reach + 1):
            for ds in range(-reach, reach + 1):
                other = y[reach + dl : reach + dl + size, reach + ds : reach + ds + size]
                both = ~(np.isnan(own) | np.isnan(other))
                p, q = own[both], other[both]
                rows.append((dl, ds, len(p), p.sum(), q.sum(), p @ p, q @ q, p @ q))
        return pd.DataFrame(rows, columns=["dl", "ds", "n", "a", "b", "aa", "bb", "ab"])

    sums = t.groupBy("_tl", "_ts").applyInPandas(run, "dl long, ds long, n long, a double, b double, aa double, bb double, ab double")
    return sums.groupBy("dl", "ds").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab")]).where("n > 0")
