"""Grid graphs: edges, connected components, shortest paths.

Parts of a bounded size are solved whole in their task, so that rounds grow with the parts that a path crosses, not with
its steps. Only what crosses parts is exchanged. Iterations are cut by tables in the shared folder. Joins that grow with
the raster are merge joins: Spark broadcasts by the size of files, which for places is a small part of what they become.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.shared import staged as kept

#: A tile's edge, in components; vertices of a part, about, and samples of it at most, in paths.
EDGE, PART, ACROSS = 256, 1 << 17, 512
#: Roots are broadcast while there are so many, counted, at most.
BROADCAST_ROWS = 200_000


def grid_edges(px: DataFrame, passable: str, diagonal: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """src, dst (struct of line and sample) and step (1 or the square root of 2) for neighbouring pixels that pass, both ways; each column c of carry as src_c and dst_c."""
    near = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if diagonal else [])]
    p = px.where(passable).select("line", "sample", F.struct("line", "sample", *carry).alias("at"))
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in near])).alias("m")
    one = p.select("line", "sample", "at", moves).select(F.col("at").alias("src"), (F.col("line") + F.col("m.a")).alias("line"), (F.col("sample") + F.col("m.b")).alias("sample"), F.sqrt((F.col("m.a") != 0).cast("int") + (F.col("m.b") != 0).cast("int")).alias("step"))
    e = one.join(p.withColumnRenamed("at", "dst").hint("merge"), ["line", "sample"]).select("src", "dst", "step")
    e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "step"))
    return e.select(*[F.struct(f"{s}.line", f"{s}.sample").alias(s) for s in ("src", "dst")], "step", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for c in carry for s in ("src", "dst")])


def connected(edges: DataFrame) -> DataFrame:
    """v, c for each end of edges (a, b; other columns are ignored): c is the smallest end that v reaches.

    Each end points to its smallest neighbour, pointers jump to their roots, and edges become edges of roots, of which
    there are at most half as many, until none is left.
    """
    edges = kept(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = None
    while True:
        to = lambda v, c: F.struct(F.col(v).alias("v"), F.col(c).alias("c"))
        ends = edges.select(F.explode(F.array(to("a", "b"), to("b", "a"))).alias("x"))
        roots = kept(ends.groupBy("x.v").agg(F.min("x.c").alias("c")).select("v", F.least("v", "c").alias("c")), "roots")
        sized = F.broadcast if roots.count() <= BROADCAST_ROWS else lambda df: df.hint("merge")
        while True:
            far = roots.select(F.col("v").alias("c"), F.col("c").alias("far"))
            jumped = kept(roots.join(sized(far), "c").select("v", "c", "far"), "roots")
            roots = jumped.select("v", F.col("far").alias("c"))
            if not jumped.where("far <> c").limit(1).count():
                break
        of = lambda v, c: sized(roots.select(F.col("v").alias(v), F.col("c").alias(c)))  # noqa: B023, E731
        found = roots if found is None else kept(found.join(of("c", "root"), "c", "left").select("v", F.coalesce("root", "c").alias("c")), "labels")
        left = edges.join(of("a", "p"), "a").join(of("b", "q"), "b").where("p <> q")
        edges = kept(left.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "edges")
        if not edges.limit(1).count():
            return found


def first_of_component(line: np.ndarray, sample: np.ndarray, diagonal: bool) -> np.ndarray:
    """For each of a tile's pixels, in order, the index of the first one that it is connected with."""
    width = int(sample.max() - sample.min()) + 3
    at = (line - line.min()) * width + sample - sample.min() + 1
    same = np.flatnonzero(at[1:] == at[:-1])  # a place given twice
    label, pairs = np.arange(len(at)), [np.stack([same, same + 1])]
    for move in (1, width, *((width - 1, width + 1) if diagonal else ())):
        there = np.minimum(np.searchsorted(at, at + move), len(at) - 1)
        here = np.flatnonzero(at[there] == at + move)
        pairs.append(np.stack([here, there[here]]))
    a, b = np.concatenate(pairs, 1)
    while len(a):
        np.minimum.at(label, b, a)  # a pixel points to a smaller root
        while (label[label] != label).any():
            label = label[label]
        a, b = label[a], label[b]
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    return label


def _tile_components(diagonal: bool):
    def run(tile: pa.Table) -> pa.Table:
        line, sample = tile.column("line").to_numpy(), tile.column("sample").to_numpy()
        order = np.lexsort((sample, line))
        line, sample = line[order], sample[order]
        first = first_of_component(line, sample, diagonal)
        return pa.table({"line": line, "sample": sample, "root_line": line[first], "root_sample": sample[first]})

    return run


def components(px: DataFrame, member: str, diagonal: bool = True, sized: bool = False) -> DataFrame:
    """line, sample, label (and size) for pixels where member holds; label is its component's first pixel (by line, then sample), size its pixels.

    Tiles are labelled whole; then the components that touch across tiles are joined.
    """
    at = [F.floor(F.col(c) / EDGE).alias(f"_t{c}") for c in ("line", "sample")]
    p = px.where(member).select(F.col("line").cast("long").alias("line"), F.col("sample").cast("long").alias("sample"))
    p = p.groupBy(*at).applyInArrow(_tile_components(diagonal), "line long, sample long, root_line long, root_sample long")
    p = kept(p.select("line", "sample", F.struct(F.col("root_line").alias("line"), F.col("root_sample").alias("sample")).alias("root")), "tiles")
    rim = p.where(" or ".join(f"pmod({c}, {EDGE}) in (0, {EDGE - 1})" for c in ("line", "sample")))
    across = grid_edges(rim, "true", diagonal, ["root"]).where("src_root < dst_root").select(F.col("src_root").alias("a"), F.col("dst_root").alias("b"))
    names = connected(across).select(F.col("v").alias("root"), F.col("c").alias("label"))
    if not sized:
        return p.join(names.hint("merge"), "root", "left").select("line", "sample", F.coalesce("label", "root").alias("label"))
    part = p.groupBy("root").agg(F.count("*").alias("n")).join(names.hint("merge"), "root", "left").select("root", F.coalesce("label", "root").alias("label"), "n")
    part = kept(part, "parts")
    whole = part.groupBy("label").agg(F.sum("n").alias("size"))
    return p.join(part.join(whole.hint("merge"), "label").hint("merge"), "root").select("line", "sample", "label", "size")


def numbered(shape: tuple[int, int]) -> tuple[Callable[..., Column], Callable[[str], Column], Callable[[str], Column]]:
    """For a grid of this shape: the number of a vertex (its line and sample, and layer if there are several), a number's place (a struct with them), and its part."""
    lines, samples = shape
    wide = min(samples, ACROSS)
    long = max(1, PART // wide)
    number = lambda at, layer="0": F.expr(f"bigint(({layer}) * {lines}L + {at}.line) * {samples}L + {at}.sample")
    place = lambda v: F.expr(f"struct({v} div {samples} % {lines} as line, {v} % {samples} as sample, {v} div {samples} div {lines} as layer)")
    part = lambda v: F.expr(f"({v} div {samples} div {lines} * {-(-lines // long)}L + {v} div {samples} % {lines} div {long}) * {-(-samples // wide)}L + {v} % {samples} div {wide}")
    return number, place, part


def _paths(edges: pa.Table, begin: pa.Table) -> pa.Table:
    """The best labels (cost, hops, before) that a part's edges give, inside and just beyond it, from those that vertices begin with."""
    src, dst, cost = (edges.column(c).to_numpy() for c in ("src", "dst", "cost"))
    order = np.argsort(src, kind="stable")
    names, code = np.unique(np.concatenate([src[order], dst[order], begin.column("v").to_numpy(), begin.column("before").to_numpy()]), return_inverse=True)
    n, m = len(src), begin.num_rows
    starts = np.searchsorted(code[:n], np.arange(len(names) + 1)).tolist()
    to, cost = code[n : 2 * n].tolist(), cost[order].tolist()
    best = [None] * len(names)
    for v, label in zip(code[2 * n : 2 * n + m].tolist(), zip(begin.column("cost").to_pylist(), begin.column("hops").to_pylist(), code[2 * n + m :].tolist(), strict=True), strict=True):
        best[v] = label
    heap = [(label, v) for v, label in enumerate(best) if label is not None]
    heapq.heapify(heap)
    while heap:
        label, v = heapq.heappop(heap)
        if label is best[v]:  # else a better one came
            for k in range(starts[v], starts[v + 1]):
                new, o = (label[0] + cost[k], label[1] + 1, v), to[k]
                if best[o] is None or new < best[o]:
                    best[o] = new
                    heapq.heappush(heap, (new, o))
    told = [v for v, label in enumerate(best) if label is not None]
    part = pa.array(np.full(len(told), begin.column("part")[0].as_py() if m else 0))
    cost, hops, before = zip(*[best[v] for v in told], strict=True) if told else ((), (), ())
    return pa.table({"part": part, "v": names[told], "cost": pa.array(cost, pa.float64()), "hops": pa.array(hops, pa.int64()), "before": names[list(before)]})


def cheapest(edges: DataFrame, source: DataFrame, part: Callable[[str], Column] | None = None) -> DataFrame:
    """v, cost, hops, before (the vertex before it) of every vertex that edges (src, dst, cost) reach from source (v); vertices are numbers.

    part tells a vertex's part from its name; parts are solved whole, and a round solves those that a better way has
    entered since. Without it, vertices are dealt by hash to as many parts as hold them.
    """
    if part is None:
        edges = kept(edges.select("src", "dst", "cost"), "edges")
        parts = edges.select("src").distinct().count() // PART + 1
        part = lambda v: F.pmod(F.xxhash64(v), F.lit(parts))
    edges = kept(edges.select("src", "dst", "cost", part("src").alias("part")), "edges")
    enter = kept(source.select(part("v").alias("part"), F.col("v").cast("long").alias("v"), F.lit(0.0).alias("cost"), F.lit(0).cast("long").alias("hops"), F.col("v").cast("long").alias("before"), F.lit(True).alias("fresh")).where("v is not null"), "enter")
    schema = "part long, v long, cost double, hops long, before long"

    def solved(parts: DataFrame | None) -> DataFrame:
        e, b = edges, enter.drop("fresh")
        if parts is not None:
            e, b = (t.join(F.broadcast(parts), "part", "left_semi") for t in (e, b))  # a row for each part of PART vertices
        return e.groupBy("part").cogroup(b.groupBy("part")).applyInArrow(_paths, schema)

    while enter.where("fresh").limit(1).count():
        out = solved(enter.where("fresh").select("part").distinct()).where(part("v") != F.col("part")).select(part("v").alias("part"), "v", "cost", "hops", "before", F.lit(True).alias("fresh"))
        label = F.struct("cost", "hops", "before", "fresh")  # of equal labels the old one, which is not fresh, is the smaller
        both = enter.withColumn("fresh", F.lit(False)).unionByName(out)
        enter = kept(both.groupBy("part", "v").agg(F.min(label).alias("x")).select("part", "v", "x.*"), "enter")
    inside = solved(None).where(part("v") == F.col("part"))
    return kept(inside.select("v", "cost", F.col("hops").cast("int").alias("hops"), "before"), "best")


def walk_back(best: DataFrame, end: DataFrame) -> DataFrame:
    """v, cost, place (from 0 at the source) of the path to end (v), from the vertices before; pointers jump, so that rounds grow with the logarithm of its length."""
    best = kept(best.select("v", "cost", "hops", "before"), "tree")
    on = kept(end.select("v"), "path")
    jump = best.select("v", "before")
    while True:
        more = kept(on.join(jump, "v").select(F.col("before").alias("v")).unionByName(on).distinct(), "path")
        if more.count() == on.count():  # the source is before itself
            return more.join(best, "v").select("v", "cost", F.col("hops").alias("place"))
        on = more
        jump = kept(jump.join(jump.select(F.col("v").alias("before"), F.col("before").alias("further")), "before").select("v", F.col("further").alias("before")), "jump")
