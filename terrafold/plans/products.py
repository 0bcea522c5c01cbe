"""Queries of product files: rasters written to the shared folder and read back by windows, frames, labels, constants."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terrafold.plans.raster import r6
from terrafold.plans.registry import PX, query
from terrafold.shared import shared_dir
from terrafold.sources import files, rasters, views

#: Lines in a file; the frame's corner, spacing of samples and of lines, and radius, in metres.
LINES, FRAME = 64, (-1500.0, 1200.0, 25.0, 20.0, 1737400.0)
_COMPLEX = "(SELECT vec_id AS line, unnest(range(0, 16)) AS sample, embedding FROM embeddings)"


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"SELECT line, sample, z AS value FROM {PX} WHERE sample BETWEEN 20 AND 59")
def raster_window(spark, sf_dir):
    """A raster of doubles in deflated TIFFs, and a window of its samples read back: every strip of a file, and of a strip what the window holds."""
    path = folder(spark, "raster")
    rasters.write_tiffs(views.pixels(spark, sf_dir).withColumnRenamed("z", "value"), path, views.WIDTH, LINES)
    return rasters.mosaic(spark, path, (0, 1 << 40, 20, 60))


@query(f"SELECT line, sample, embedding[4 * sample + 1]::DOUBLE AS re, embedding[4 * sample + 2]::DOUBLE AS im FROM {_COMPLEX} WHERE line BETWEEN 100 AND 299 AND sample BETWEEN 3 AND 7")
def complex_raster(spark, sf_dir):
    """A channel of complex looks in plain TIFFs of 64-bit pixels: byte ranges of lines 100 to 299 and samples 3 to 7, files outside unopened."""
    path = folder(spark, "complex")
    looks = views.looks(spark, sf_dir).select("line", "sample", F.col("re_h").alias("re"), F.col("im_h").alias("im"))
    rasters.write_tiffs(looks, path, 16, LINES, ("re", "im"), "<c8", deflate=False)
    return rasters.mosaic(spark, path, (100, 300, 3, 8))


@query(f"""WITH p AS {PX}, f AS (SELECT line // {LINES} AS part, max(line) % {LINES} + 1 AS lines FROM p GROUP BY 1)
SELECT lines, 100 AS samples, {FRAME[0]}::DOUBLE AS x0, ({FRAME[1]} - part * {LINES * FRAME[3]})::DOUBLE AS y0, {FRAME[2]}::DOUBLE AS dx, {FRAME[3]}::DOUBLE AS dy, {FRAME[4]}::DOUBLE AS radius, -90::DOUBLE AS lat0, 0::DOUBLE AS lon0, 1::DOUBLE AS scale, 0::DOUBLE AS easting, 0::DOUBLE AS northing, false AS point, 'south polar stereographic' AS name,
round(degrees(atan2({FRAME[0] + FRAME[2] / 2}, {FRAME[1] - FRAME[3] / 2} - part * {LINES * FRAME[3]})), 6) AS first_lon FROM f""")
def geotiff_frames(spark, sf_dir):
    """Frames of the files of a georeferenced raster, from their own tags and keys, and the longitude of each one's first pixel."""
    path = folder(spark, "frames")
    rasters.write_tiffs(views.pixels(spark, sf_dir).withColumnRenamed("z", "value"), path, views.WIDTH, LINES, frame=FRAME)
    f = rasters.geotiff_frames(spark, path)
    half = F.when(F.col("point"), 0.0).otherwise(0.5)
    lon = F.degrees(F.atan2(F.col("x0") + half * F.col("dx"), F.col("y0") - half * F.col("dy")))
    return f.drop("file").withColumn("first_lon", r6(lon))


_ODL = """concat('/* part */ OBJECT = PART\\n  NAME = "', p_name, '"\\n  PRICE = ', cast(cast(p_retailprice as decimal(12, 2)) as string), ' <USD>\\n  OBJECT = BOX\\n    SIZES = (', p_size, ',\\n ', p_size + 1, ')\\n    SIZE = "', p_size, '"\\n  END_OBJECT = BOX\\nEND_OBJECT = PART\\nPRICE = 1 <X>\\nEND\\n')"""


@query("""WITH p AS (SELECT p_partkey AS part, p_name, p_size, p_retailprice::DECIMAL(12, 2) AS price FROM part)
SELECT part, 0 AS place, 'PART' AS object, 'NAME' AS key, p_name AS value, NULL::DOUBLE AS number, NULL AS unit FROM p
UNION ALL SELECT part, 1, 'PART', 'PRICE', price || ' <USD>', price::DOUBLE, 'USD' FROM p
UNION ALL SELECT part, 2, 'PART/BOX', 'SIZES', '(' || p_size || ', ' || (p_size + 1) || ')', NULL, NULL FROM p
UNION ALL SELECT part, 3, 'PART/BOX', 'SIZE', p_size::VARCHAR, p_size::DOUBLE, NULL FROM p UNION ALL SELECT part, 4, '', 'PRICE', '1 <X>', 1.0, 'X' FROM p""")
def label_statements(spark, sf_dir):
    """Statements of a label in object description language, one label for each part: nested objects, quotes, values over lines, units."""
    t = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.expr(_ODL).alias("text"))
    return files.odl(t, "part")


@query("SELECT p_partkey AS part, p_retailprice::DECIMAL(12, 2)::DOUBLE AS price, p_size::DOUBLE AS size FROM part")
def label_numbers(spark, sf_dir):
    """Numbers that a product needs from its label, by object and key, as numbers; the same key elsewhere isn't taken."""
    return files.needed(label_statements(spark, sf_dir), "part", ["PART.PRICE", "BOX.SIZE"])


@query("""WITH o AS (SELECT s_suppkey AS k, s_name AS name FROM supplier) SELECT name AS file, c.channel, (k + 0.5)::DOUBLE AS constant_db, (k + c.i)::DOUBLE AS gain_imbalance, -c.i::DOUBLE AS phase_orthogonality, NULL::DOUBLE AS bias_real, 2 * k::DOUBLE AS bias_imag FROM o, (VALUES (1, 'LH'), (2, 'LV')) AS c(i, channel)""")
def calibration_constants(spark, sf_dir):
    """Constants by channel from XML labels, one for each supplier: what follows a polarization is that channel's."""
    block = lambda i, c: f"'<x:polarization>{c}</x:polarization><x:gain_imbalance>', s_suppkey + {i}, '</x:gain_imbalance><x:phase_orthogonality>-{i}</x:phase_orthogonality><x:bias_imag>', 2 * s_suppkey, '</x:bias_imag>'"
    text = f"concat('<x:Product xmlns:x=\"urn:y\"><x:calibration_constant>', s_suppkey + 0.5, '</x:calibration_constant>', {block(1, 'lh')}, {block(2, 'LV')}, '</x:Product>')"
    t = views.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("path"), F.expr(text).cast("binary").alias("content"))
    return files.calibration(files.parsed(t))
