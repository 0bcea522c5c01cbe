"""Operator 12, centroid clustering in integers with Hamerly's bounds.

Each vector keeps its cluster, an upper bound of its distance to that centroid and a lower bound of its distance to any
other. A round loosens the bounds by how far centroids moved; only vectors whose bounds then meet are compared with
every centroid, exactly. Vectors lie in buckets, written once; a round reads them beside the state of the round before,
which lies in the same buckets, and writes the new state and each task's exact sums in one pass, without a shuffle.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.common import shared_dir, staged

#: Components, clusters, rounds, what a component is scaled by, seed of the first centroids.
DIM, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3"
#: Rows in a bucket of vectors, about.
BUCKET_ROWS = 250_000
#: Integers up to here have squared distances below 2**63 (for 64 components); beyond, Python's integers are used.
PLAIN = 1 << 27
#: What bounds allow for the rounding of roots and sums; parts of a sum that is sent on.
SLACK, LIMB = 1e-9, 32
#: A row of a round's table: a vector's state (limb null), or one limb of a task's sums of a cluster, the last its count.
STATE = "n long, cluster int, upper double, lower double, limb int, sums array<long>"


def exact(row: np.ndarray, scale: int) -> list[int]:
    """The integers of one vector of any size; a double times a power of two may pass the doubles, its fraction doesn't."""
    out = []
    for x in row.tolist():
        num, den = x.as_integer_ratio()
        out.append(num * scale // den)
    return out


def squared(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def root(square: int) -> float:
    """The square root of an integer of any size, to within SLACK; infinite beyond the doubles."""
    return math.sqrt(square) if square < 1 << 1000 else float(math.isqrt(square)) if square < 1 << 2000 else math.inf


class Scan:
    """What a task knows of a round: centroids, exact, and how far each has moved since the bounds were written."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]]):
        self.centroids, k = centroids, len(centroids)
        self.large = [j for j, c in enumerate(centroids) if any(abs(x) > PLAIN for x in c)]
        self.plain = np.array([j for j in range(k) if j not in self.large], int)
        self.whole = [np.array(c, np.int64) if j in set(self.plain) else None for j, c in enumerate(centroids)]
        self.far = {j: np.array([float(x) if abs(x) < 1 << 1000 else math.inf * (1 if x > 0 else -1) for x in centroids[j]]) for j in self.large}
        moved = [root(squared(a, b)) * (1 + SLACK) for a, b in zip(centroids, before, strict=True)]
        self.moved = np.array(moved)
        self.others = np.array([max([0.0, *moved[:j], *moved[j + 1 :]]) for j in range(k)])
        self.half = np.array([min([math.inf, *(root(squared(a, b)) / 2 for i, b in enumerate(centroids) if i != j)]) for j, a in enumerate(centroids)])

    def one(self, v: list[int]) -> tuple[int, float, float]:
        """Nearest centroid (ties: smaller number), its distance and the second one's, in Python's integers."""
        d = sorted((squared(v, c), j) for j, c in enumerate(self.centroids))
        return d[0][1], root(d[0][0]), root(d[1][0]) if len(d) > 1 else math.inf

    def all(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for rows of plain integers."""
        n = len(x)
        cluster, near, second, rows = np.zeros(n, np.int32), np.full(n, np.inf), np.full(n, np.inf), np.arange(n)
        if len(self.plain):
            d = np.stack([((x - self.whole[j]) ** 2).sum(axis=1) for j in self.plain], axis=1)
            at = d.argmin(axis=1)  # the first of equal ones, and plain centroids are in order
            cluster, near = self.plain[at].astype(np.int32), np.sqrt(d[rows, at])
            d[rows, at] = np.iinfo(np.int64).max
            second = np.sqrt(d.min(axis=1)) if len(self.plain) > 1 else second
        if self.large:
            # Doubles rule out what is clearly further than the nearest plain centroid; for other rows Python decides.
            with np.errstate(over="ignore"):
                away = np.sqrt(np.min([((x - c) ** 2).sum(axis=1) for c in self.far.values()], axis=0)) * (1 - SLACK)
            second = np.minimum(second, away)
            for i in np.flatnonzero(~(near * (1 + SLACK) < away)):
                cluster[i], near[i], second[i] = self.one(x[i].tolist())
        return cluster, near, second


def limbs(total: int) -> list[int]:
    """A sum in parts of LIMB bits, each with its sign: parts of many sums add up without passing 64 bits."""
    sign, total, out = (1 if total >= 0 else -1), abs(total), []
    while total or not out:
        out.append(sign * (total & ((1 << LIMB) - 1)))
        total >>= LIMB
    return out


def whole_vectors(batch: pa.RecordBatch, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's integers (of rows within PLAIN), which rows pass it, and their components as they came."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(over="ignore"):
        x = np.floor(flat * scale)
    beyond = (np.abs(x) > PLAIN).any(axis=1)
    return np.where(beyond[:, None], 0, x).astype(np.int64), beyond, flat


def nearest(scan: Scan, batch: pa.RecordBatch, x: np.ndarray, beyond: np.ndarray, large: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, upper and lower bound of each row: by its bounds, loosened, where they stay apart, else by a full exact scan."""
    n, k = len(x), len(scan.centroids)
    if "upper" in batch.schema.names:
        cluster = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int32)
        upper = batch.column("upper").to_numpy(zero_copy_only=False) + scan.moved[cluster]
        lower = batch.column("lower").to_numpy(zero_copy_only=False) - scan.others[cluster]
        apart = lambda: upper * (1 + SLACK) < np.maximum(lower, scan.half[cluster]) * (1 - SLACK)
        asked = np.flatnonzero(~apart() & ~beyond)
        for j in set(scan.plain) & set(cluster[asked]):  # the own centroid first: a tight upper bound may do
            own = asked[cluster[asked] == j]
            upper[own] = np.sqrt(((x[own] - scan.whole[j]) ** 2).sum(axis=1))
        asked = np.flatnonzero(~apart() & ~beyond)
    else:
        cluster, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf), np.zeros(n)
        asked = np.flatnonzero(~beyond)
    if k and len(asked):
        cluster[asked], upper[asked], lower[asked] = scan.all(x[asked])
    for i, v in large.items():
        cluster[i], upper[i], lower[i] = scan.one(v)
    return cluster, upper, lower


def _round(scan: Scan, dim: int, scale: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The new state of a task's vectors, then its sums by cluster."""
        kinds = pa.schema([("n", pa.int64()), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("limb", pa.int32()), ("sums", pa.list_(pa.int64()))])
        sums, first = {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, beyond, flat = whole_vectors(batch, dim, scale)
            large = {int(i): exact(flat[i], scale) for i in np.flatnonzero(beyond)}
            cluster, upper, lower = nearest(scan, batch, x, beyond, large)
            for j in np.unique(cluster):
                own = cluster == j
                total = [*x[own].sum(axis=0).tolist(), int(own.sum())]
                sums[j] = [a + b for a, b in zip(sums.get(j, [0] * (dim + 1)), total, strict=True)]
            for i, v in large.items():
                sums[cluster[i]] = [a + b for a, b in zip(sums[cluster[i]], [*v, 0], strict=True)]
            first = batch.column("n")[0].as_py() if first is None else first
            none = pa.nulls(batch.num_rows)
            yield pa.record_batch([batch.column("n"), pa.array(cluster), pa.array(upper), pa.array(lower), none.cast(pa.int32()), none.cast(pa.list_(pa.int64()))], schema=kinds)
        for j, total in sums.items():
            parts = [limbs(t) for t in total]
            for limb in range(max(map(len, parts))):
                row = [p[limb] if limb < len(p) else 0 for p in parts]
                # Under the number of one of the task's vectors, so that the row lies in the same bucket.
                yield pa.record_batch([pa.array([first]), pa.array([j], pa.int32()), pa.array([None], pa.float64()), pa.array([None], pa.float64()), pa.array([limb], pa.int32()), pa.array([row], pa.list_(pa.int64()))], schema=kinds)

    return step


def _last(scan: Scan, dim: int, scale: int, kinds: pa.Schema):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """vec_id, cluster, squared distance (null beyond 63 bits)."""
        for batch in batches:
            if not batch.num_rows:
                continue
            x, beyond, flat = whole_vectors(batch, dim, scale)
            large = {int(i): exact(flat[i], scale) for i in np.flatnonzero(beyond)}
            cluster, _, _ = nearest(scan, batch, x, beyond, large)
            distance: list[int | None] = [None] * len(x)
            for j in np.unique(cluster):
                own = np.flatnonzero(cluster == j)
                by = ((x[own] - scan.whole[j]) ** 2).sum(axis=1).tolist() if scan.whole[j] is not None else [squared(x[i].tolist(), scan.centroids[j]) for i in own]
                for i, d in zip(own, by, strict=True):
                    d = squared(large[i], scan.centroids[j]) if i in large else d
                    distance[i] = d if d < 1 << 63 else None
            yield pa.record_batch([batch.column("vec_id"), pa.array(cluster), pa.array(distance, pa.int64())], schema=kinds)

    return step


class Buckets:
    """Tables that lie in the same buckets by n, in the shared folder; the catalog names them for as long as the work takes."""

    def __init__(self, spark: SparkSession, count: int):
        self.spark, self.count, self.paths = spark, count, {}

    def write(self, df: DataFrame) -> str:
        name = f"clusters_{uuid.uuid4().hex}"
        self.paths[name] = f"{shared_dir(self.spark)}/{name}"
        df.write.bucketBy(self.count, "n").option("path", self.paths[name]).saveAsTable(name, format="parquet")
        return name

    def drop(self, name: str) -> None:
        """Forget the table and free its files, which are this work's own."""
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED, column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each row of vectors that has exactly dim finite components.

    Rows with a null vector, another length, or a null, NaN or infinite component are left out. Null ids are kept; they,
    and then rows of one id, start centroids last, in order of their components. Repeated rows are vectors each, and may
    start two equal centroids, of which the second stays empty. With fewer vectors than clusters, each starts one. An
    empty table gives no row. Components may be of any size; a distance that passes 63 bits is null, and so are sums with
    it or beyond 63 bits. Further columns are left alone.
    """
    spark = vectors.sparkSession
    fit = f"size(v) = {dim} and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    kept = vectors.select(vectors["vec_id"], vectors[column].alias("v")).where(fit)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centroids = [exact(np.array(r.v, float), scale) for r in kept.orderBy(digest.asc_nulls_last(), "v").limit(clusters).select("v").collect()]
    kind = dict(vectors.dtypes)["vec_id"]
    sealed = spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    if not centroids:
        return sealed
    buckets = Buckets(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), vectors.count() // BUCKET_ROWS + 1))
    numbered = staged(kept.withColumn("n", F.monotonically_increasing_id()), "vectors")  # numbers that a lost task can't change
    home = buckets.write(numbered.repartition(buckets.count, "n"))
    state, before = None, centroids
    try:
        for done in range(rounds + 1):
            rows, scan = spark.table(home), Scan(centroids, before)
            if state:
                bounds = spark.table(state).where("limb is null").select("n", "cluster", "upper", "lower")
                rows = rows.join(bounds.hint("shuffle_hash"), "n")
            if done == rounds:
                out = rows.mapInArrow(_last(scan, dim, scale, pa.schema([("vec_id", _arrow(kind)), ("cluster", pa.int32()), ("distance", pa.int64())])), f"vec_id {kind}, cluster int, distance long")
                found = staged(out, "assigned")
                break
            new = buckets.write(rows.drop("vec_id").mapInArrow(_round(scan, dim, scale), STATE))
            if state:
                buckets.drop(state)
            sums = spark.table(new).where("limb is not null").groupBy("cluster", "limb").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim + 1)])
            total: dict[int, list[int]] = {}
            for r in sums.collect():  # clusters times a few limbs
                total[r.cluster] = [a + (b << (LIMB * r.limb)) for a, b in zip(total.get(r.cluster, [0] * (dim + 1)), r[2:], strict=True)]
            state, before = new, centroids
            centroids = [[s // total[j][-1] for s in total[j][:-1]] if j in total else c for j, c in enumerate(centroids)]
    finally:
        for name in [*buckets.paths]:
            buckets.drop(name)
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("none")).collect()  # one row a cluster
    short = lambda s: int(s) if s is not None and s < 1 << 63 else None
    by = {r.cluster: None if r.none else short(r.s) for r in per}
    inertia = None if None in by.values() else short(sum(by.values()))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    known = spark.createDataFrame([(j, s, inertia, digests[j]) for j, s in by.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select(*sealed.columns)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}[kind]
