"""Readers of a product's files: XML labels, geolocation grids, raw rasters, content hashes. Files are read where Spark puts them, never by the driver."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.sources import rasters


def leaves(content: bytes) -> list[tuple[str, str]]:
    """The path, by local names, and the text of each element that holds no other; of equal paths in page order."""
    found, todo = [], [(ET.fromstring(content), "")]
    while todo:
        e, above = todo.pop()
        path = f"{above}/{e.tag.rpartition('}')[2]}"
        if len(e):
            todo += [(c, path) for c in reversed(e)]
        else:
            found.append((path, (e.text or "").strip()))
    return found


def parsed(files: DataFrame) -> DataFrame:
    """file, place, name, value for each leaf of the XML labels in files (path, content). A label is a small file; one that isn't XML raises an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(f, k, n, v) for f, c in zip(b["path"], b["content"], strict=True) for k, (n, v) in enumerate(leaves(c))], columns=["file", "place", "name", "value"])

    return files.select("path", "content").mapInPandas(run, "file string, place int, name string, value string")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """parsed() of the XML labels in path (a folder or a pattern)."""
    return parsed(spark.read.format("binaryFile").load(path))


def numbered(df: DataFrame) -> DataFrame:
    """df with _at, each row's place in file order: places within a task, after the counts of the tasks before it."""
    d = df.withColumn("_task", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id() % (1 << 33))
    n = d.groupBy("_task").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(F.lit(0)).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    return d.join(F.broadcast(n.select("_task", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))), "_task").withColumn("_at", F.col("_before") + F.col("_in")).drop("_task", "_in", "_n", "_before")


def geolocation_grid(spark: SparkSession, path: str, records: int, samples: int, columns: tuple[str, ...] = ("lat", "lon", "range", "incidence")) -> DataFrame:
    """record, sample and the columns of a CSV of numbers, one row for each tie point in record order. Another number of rows, or a value that isn't a number, raises an error."""
    schema = ", ".join(f"{c} double" for c in columns)
    g = numbered(spark.read.schema(schema).option("mode", "FAILFAST").csv(path))
    n = g.count()
    if n != records * samples:
        raise ValueError(f"{n} rows instead of {records} x {samples}")
    return g.select(F.expr(f"_at div {samples}").alias("record"), (F.col("_at") % samples).alias("sample"), *columns)


def raw_raster(spark: SparkSession, path: str, samples: int, width: int = 2, signed: bool = True) -> DataFrame:
    """line, sample, dn of a headerless raster of big-endian integers of so many bytes; a ragged end raises an error. See rasters.RasterSource."""
    fs, local = rasters.opened(path)
    size = fs.get_file_info(local).size
    if size % (samples * width):
        raise ValueError("a file of whole lines is needed")
    dtype = f">{'i' if signed else 'u'}{width}"
    return rasters.read_raster(spark, path, layout="raw", dtype=dtype, lines=size // (samples * width), samples=samples).select("line", "sample", F.col("value").cast("long").alias("dn"))


def duplicates(spark: SparkSession, path: str, role: str) -> DataFrame:
    """digest, role, copies, first: contents that several files of one role share. role is SQL over the column path."""
    f = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("digest"), F.expr(role).alias("role"), "path")
    return f.groupBy("digest", "role").agg(F.count("*").alias("copies"), F.min("path").alias("first")).where("copies > 1")


#: A value of a label: quoted, in brackets (either may pass over lines), or the rest of the line.
_STATEMENT = re.compile(r'^[ \t]*(\^?[A-Za-z][\w:]*)[ \t]*=[ \t]*("[^"]*"|\([^)]*\)|\{[^}]*\}|[^\n]*)|^[ \t]*(END_OBJECT|END_GROUP)[ \t]*$', re.M)
_NUMBER = re.compile(r'\s*"?\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*(?:<([^>]*)>)?\s*"?\s*$')


def statements(text: str) -> list[tuple[str, str, str, float | None, str | None]]:
    """object, key, value, number, unit of each statement of a label in object description language; comments and END are left out.

    object is the path of the objects and groups that hold a statement. A value that is a number, with a unit in angle
    brackets or without one, is told as such; other numbers are null.
    """
    found, within = [], []
    for m in _STATEMENT.finditer(re.sub(r"/\*.*?\*/", " ", text, flags=re.S)):
        key, value = (m[1] or m[3]).upper(), " ".join((m[2] or "").split())
        if key in ("OBJECT", "GROUP"):
            within.append(value.upper())
        elif key in ("END_OBJECT", "END_GROUP"):
            del within[-1:]
        else:
            n = _NUMBER.match(value)
            found.append(("/".join(within), key, value.strip('"'), float(n[1]) if n else None, n[2] if n else None))
    return found


def odl(texts: DataFrame, name: str = "file", text: str = "text") -> DataFrame:
    """name, place, object, key, value, number, unit for each statement of each label; see statements. A label is a small text; null has none."""
    kind = dict(texts.dtypes)[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, k, *x) for f, t in zip(b[name], b[text], strict=True) for k, x in enumerate(statements(t or ""))]
            yield pd.DataFrame(rows, columns=[name, "place", "object", "key", "value", "number", "unit"])

    return texts.select(name, text).mapInPandas(run, f"{name} {kind}, place int, object string, key string, value string, number double, unit string")


def odl_labels(spark: SparkSession, path: str) -> DataFrame:
    """odl of the label files in path."""
    return odl(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("content").cast("string").alias("text")))


def needed(fields: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """name and a column for each key, the last number of that key (or of OBJECT.KEY); a label without one of them, or with a word there, raises an error."""
    last = lambda k: F.max_by("number", F.when(_named(k), F.col("place")))
    got = fields.groupBy(name).agg(*[last(k).alias(k.rpartition(".")[2].lower()) for k in keys])
    for k in keys:
        c = k.rpartition(".")[2].lower()
        got = got.withColumn(c, F.coalesce(c, F.raise_error(F.concat(F.lit(f"no number {k} in label "), F.col(name).cast("string"))).cast("double")))
    return got


def _named(key: str):
    within, _, last = key.rpartition(".")
    return (F.col("key") == last) & (F.element_at(F.split("object", "/"), -1) == within if within else F.lit(True))


def calibration(leaves: DataFrame) -> DataFrame:
    """file, channel, constant_db, gain_imbalance, phase_orthogonality, bias_real, bias_imag from the rows of labels().

    Leaves stand in order, and a polarization opens its channel's block, so that a value belongs to the last channel named
    before it; the first value of a kind counts. A label without a constant or without a channel raises an error.
    """
    kinds = ["gain_imbalance", "phase_orthogonality", "bias_real", "bias_imag"]
    own = Window.partitionBy("file").orderBy("place")  # a label's leaves
    x = leaves.withColumn("leaf", F.lower(F.regexp_extract("name", r"([^/]+)$", 1)))
    x = x.withColumn("channel", F.last(F.when(F.col("leaf") == "polarization", F.upper("value")), True).over(own))
    x = x.withColumn("constant_db", F.last(F.when(F.col("leaf") == "calibration_constant", F.col("value").cast("double")), True).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    got = x.where("channel is not null").groupBy("file", "channel").agg(F.max("constant_db").alias("constant_db"), *[F.min_by(F.when(F.col("leaf") == k, F.col("value")).cast("double"), F.when(F.col("leaf") == k, F.col("place"))).alias(k) for k in kinds])
    every = leaves.select("file").distinct().join(got, "file", "left")
    bad = F.raise_error(F.concat(F.lit("no calibration constant or channel in "), F.col("file"))).cast("double")
    return every.withColumn("constant_db", F.when(F.col("channel").isNotNull(), F.coalesce("constant_db", bad)).otherwise(bad))
