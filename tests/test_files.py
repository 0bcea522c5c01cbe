"""Readers of product files on small ones."""

import struct

import pytest

from terrafold.sources import files


def test_labels(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<p:Product xmlns:p="urn:x"><p:Area><p:line> 12 </p:line><p:line>13</p:line></p:Area><p:empty/></p:Product>')
    got = sorted((r.place, r.name, r.value) for r in files.labels(spark, str(tmp_path)).collect())
    assert got == [(0, "/Product/Area/line", "12"), (1, "/Product/Area/line", "13"), (2, "/Product/empty", "")]


def test_geolocation_grid(spark, tmp_path):
    (tmp_path / "g.csv").write_text("\n".join(f"{-80 - k},{k * 2},{k * 3},{k}" for k in range(12)))
    rows = files.geolocation_grid(spark, str(tmp_path / "g.csv"), 3, 4).collect()
    assert sorted((r.record, r.sample, r.incidence) for r in rows) == [(k // 4, k % 4, float(k)) for k in range(12)]
    with pytest.raises(ValueError):
        files.geolocation_grid(spark, str(tmp_path / "g.csv"), 4, 4)


def test_places_over_many_tasks(spark, tmp_path):
    (tmp_path / "n.csv").write_text("\n".join(map(str, range(5000))))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = files.numbered(spark.read.schema("v long").csv(str(tmp_path / "n.csv"))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r["_at"] for r in rows) == list(range(5000))


def test_raw_raster(spark, tmp_path):
    values = [3, -1, 32767, -32768, 0, 256]
    (tmp_path / "r.img").write_bytes(struct.pack(">6h", *values))
    got = {(r.line, r["sample"]): r.dn for r in files.raw_raster(spark, str(tmp_path / "r.img"), 3).collect()}
    assert got == {(k // 3, k % 3): v for k, v in enumerate(values)}
    with pytest.raises(ValueError):
        files.raw_raster(spark, str(tmp_path / "r.img"), 4)


def test_duplicates(spark, tmp_path):
    for name, text in (("a_x.img", "1"), ("b_x.img", "1"), ("c_y.img", "1"), ("d_x.img", "2")):
        (tmp_path / name).write_text(text)
    rows = files.duplicates(spark, str(tmp_path), "regexp_extract(path, '_([a-z]+)[.]', 1)").collect()
    assert [(r.role, r.copies, r["first"][-7:]) for r in rows] == [("x", 2, "a_x.img")]


def test_statements():
    text = 'A = 1 /* no = 2 */\nOBJECT = X\n B = "two\n  lines"\n C = 2.5e3 <M/PIXEL>\n GROUP = Y\n  ^D = (1,\n 2)\n END_GROUP = Y\n E = N/A\nEND_OBJECT\nF = "7"\nEND\n'
    assert files.statements(text) == [
        ("", "A", "1", 1.0, None), ("X", "B", "two lines", None, None), ("X", "C", "2.5e3 <M/PIXEL>", 2500.0, "M/PIXEL"),
        ("X/Y", "^D", "(1, 2)", None, None), ("X", "E", "N/A", None, None), ("", "F", "7", 7.0, None),
    ]
    assert files.statements("") == []


def test_needed_numbers(spark):
    t = spark.createDataFrame([(1, "OBJECT = I\nM = 3 <KM>\nEND_OBJECT\nM = 9\nN = 2"), (2, "M = 4\nN = word")], "id long, text string")
    f = files.odl(t, "id")
    assert files.needed(f.where("id = 1"), "id", ["I.M", "N"]).first()[1:] == (3.0, 2.0)
    for key in ("I.M", "N"):
        with pytest.raises(Exception, match="no number"):
            files.needed(f, "id", [key]).collect()


def test_calibration(spark):
    xml = "<p><polarization>lh</polarization><gain_imbalance>1</gain_imbalance><gain_imbalance>5</gain_imbalance><calibration_constant>70</calibration_constant><polarization>lv</polarization><bias_real>2</bias_real></p>"
    t = spark.createDataFrame([("a", bytearray(xml.encode()))], "path string, content binary")
    rows = sorted(map(tuple, files.calibration(files.parsed(t)).collect()))
    assert rows == [("a", "LH", 70.0, 1.0, None, None, None), ("a", "LV", 70.0, None, None, 2.0, None)]
    for bad in ("<p><polarization>lh</polarization></p>", "<p><calibration_constant>7</calibration_constant></p>"):
        with pytest.raises(Exception, match="no calibration"):
            files.calibration(files.parsed(spark.createDataFrame([("b", bytearray(bad.encode()))], "path string, content binary"))).collect()
