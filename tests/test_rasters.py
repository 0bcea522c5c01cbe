"""The raster source against NumPy, on files written by hand."""

import struct
import zlib

import numpy as np
import pytest

from terrafold.sources import rasters
from terrafold.sources.rasters import geotiff_frames, layout_of, mosaic, opened, pieces, pixels_of, read_raster, tiff_bytes, write_tiffs

RNG = np.random.default_rng(5)


def array(rows, dtype=float):
    """The rows of a read as an array, NaN where there is none."""
    rows = rows.collect()
    if not rows:
        return np.zeros((0, 0))
    l0, s0 = min(r.line for r in rows), min(r["sample"] for r in rows)
    a = np.full((max(r.line for r in rows) - l0 + 1, max(r["sample"] for r in rows) - s0 + 1), np.nan, dtype)
    for r in rows:
        a[r.line - l0, r["sample"] - s0] = r.value if "value" in r else complex(r.re, r.im)
    return a


def whole(path, window=None, **options):
    """The pixels that a scan reads, by its pieces, without Spark; and how many bytes they are."""
    lay = layout_of(str(path), {k: str(v) for k, v in options.items()})
    l0, l1, s0, s1 = window or (0, lay.lines, 0, lay.samples)
    a, n = np.zeros((l1 - l0, s1 - s0), np.dtype(lay.dtype).newbyteorder("=")), 0
    fs, local = opened(str(path))
    with fs.open_input_file(local) as f:
        for p in pieces(lay, window):
            a[p.line - l0 : p.line - l0 + p.lines, p.sample - s0 : p.sample - s0 + p.samples] = pixels_of(p, f)[:, :, 0]
            n += p.bytes
    return a, n


@pytest.mark.parametrize("dtype", [">i2", "<f4", ">c8", "<u1"])
def test_raw(spark, tmp_path, dtype):
    want = (RNG.integers(0, 200, (37, 29)) + (1j * RNG.integers(0, 9, (37, 29)) if dtype == ">c8" else 0)).astype(dtype)
    path = tmp_path / "r.img"
    path.write_bytes(b"head" + want.tobytes())
    geometry = {"dtype": dtype, "lines": 37, "samples": 29, "offset": 4}
    got = array(read_raster(spark, str(path), partBytes=400, **geometry), complex if dtype == ">c8" else float)
    assert (got == want).all()
    cut = array(read_raster(spark, str(path), (5, 9, 20, 99), **geometry), complex if dtype == ">c8" else float)
    assert (cut == want[5:9, 20:]).all()
    for wrong in ({"lines": 38}, {"samples": 28}, {"offset": 0}):
        with pytest.raises(Exception, match="geometry says"):
            layout_of(str(path), {k: str(v) for k, v in (geometry | wrong).items()})


def test_a_window_reads_its_bytes(tmp_path):
    want = RNG.integers(-9, 9, (300, 400)).astype("<f4")
    (tmp_path / "r.img").write_bytes(want.tobytes())
    a, n = whole(tmp_path / "r.img", (100, 130, 40, 80), dtype="<f4", lines=300, samples=400)
    assert (a == want[100:130, 40:80]).all() and n == 30 * 40 * 4
    (tmp_path / "t.tif").write_bytes(tiff_bytes(want, strip=10))
    a, n = whole(tmp_path / "t.tif", (100, 103, 0, 400))
    assert (a == want[100:103]).all() and n < want.nbytes / 20  # one strip of thirty


def test_npy(spark, tmp_path):
    want = RNG.normal(size=(20, 31))
    np.save(tmp_path / "a.npy", want)
    assert (array(read_raster(spark, str(tmp_path / "a.npy"))) == want).all()
    (tmp_path / "b.npy").write_bytes((tmp_path / "a.npy").read_bytes()[:-8])
    with pytest.raises(ValueError, match="geometry says"):
        layout_of(str(tmp_path / "b.npy"), {})


@pytest.mark.parametrize("deflate", [False, True])
@pytest.mark.parametrize("dtype", ["<i2", "<f4", "<c8", "<u1"])
def test_striped_tiff(tmp_path, dtype, deflate):
    want = (RNG.normal(size=(45, 33)) * 50 + (1j if dtype == "<c8" else 0)).astype(dtype)
    path = tmp_path / "a.tif"
    path.write_bytes(tiff_bytes(want, 7, deflate))
    assert (whole(path)[0] == want).all()
    assert (whole(path, (6, 15, 3, 8))[0] == want[6:15, 3:8]).all()
    cut = path.read_bytes()
    (tmp_path / "b.tif").write_bytes(cut[:8] + b"\0" * 400)
    with pytest.raises(Exception):  # noqa: B017
        whole(tmp_path / "b.tif")


def big_endian_tiles(a, edge, big):
    """A tiled TIFF by hand: most significant byte first, differences along lines, deflated; BigTIFF if asked for."""
    lines, samples = a.shape
    tiles = []
    for top in range(0, lines, edge):
        for left in range(0, samples, edge):
            t = np.zeros((edge, edge), ">i4")
            part = a[top : top + edge, left : left + edge]
            t[: part.shape[0], : part.shape[1]] = part
            t[:, 1:] = np.diff(t.astype(np.int64), axis=1)
            tiles.append(zlib.compress(t.tobytes()))
    head = 16 if big else 8
    at = [head + sum(map(len, tiles[:k])) for k in range(len(tiles))]
    end = head + sum(map(len, tiles))
    tags = [(256, 4, [samples]), (257, 4, [lines]), (258, 3, [32]), (259, 3, [8]), (317, 3, [2]), (322, 4, [edge]), (323, 4, [edge]), (324, 4, at), (325, 4, [len(t) for t in tiles]), (339, 3, [2])]
    word, room = ("Q", 8) if big else ("I", 4)
    block, extra = b"", b""
    after = end + (8 if big else 2) + len(tags) * (20 if big else 12) + room
    for code, kind, values in tags:
        v = struct.pack(f">{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(v) > room:
            v, extra = struct.pack(">" + word, after + len(extra)), extra + v
        block += struct.pack(">HH" + word, code, kind, len(values)) + v.ljust(room, b"\0")
    start = b"MM\0+\0\x08\0\0" + struct.pack(">Q", end) if big else b"MM\0*" + struct.pack(">I", end)
    return start + b"".join(tiles) + struct.pack(">Q" if big else ">H", len(tags)) + block + b"\0" * room + extra


@pytest.mark.parametrize("big", [False, True])
def test_tiled_tiff(spark, tmp_path, big):
    want = RNG.integers(-(1 << 30), 1 << 30, (40, 50)).astype(np.int32)
    path = tmp_path / "a.tif"
    path.write_bytes(big_endian_tiles(want, 16, big))
    assert (whole(path)[0] == want).all()
    assert (array(read_raster(spark, str(path), (15, 33, 14, 49))) == want[15:33, 14:49]).all()
    lay = layout_of(str(path), {})
    assert len(list(pieces(lay, (17, 20, 17, 20)))) == 1 and len(list(pieces(lay, (90, 99, 0, 5)))) == 0


def test_png(spark, tmp_path):
    """Every filter of a line, in 8 and 16 bits."""
    for bits in (8, 16):
        want = RNG.integers(0, 1 << bits, (10, 13)).astype(f">u{bits // 8}")
        step = bits // 8
        rows = [np.frombuffer(r.tobytes(), np.uint8).astype(int) for r in want]
        body = b""
        for k, row in enumerate(rows):
            above = rows[k - 1] if k else np.zeros_like(row)
            left, corner = np.r_[np.zeros(step, int), row[:-step]], np.r_[np.zeros(step, int), above[:-step]]
            guess = left + above - corner
            away = [abs(guess - v) for v in (left, above, corner)]
            paeth = np.where((away[0] <= away[1]) & (away[0] <= away[2]), left, np.where(away[1] <= away[2], above, corner))
            kind = k % 5
            sub = [0 * row, left, above, (left + above) // 2, paeth][kind]
            body += bytes([kind]) + ((row - sub) & 255).astype(np.uint8).tobytes()
        z = zlib.compress(body)
        chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + b"\0\0\0\0"
        data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 13, 10, bits, 0, 0, 0, 0)) + chunk(b"IDAT", z[:20]) + chunk(b"IDAT", z[20:]) + chunk(b"IEND", b"")
        path = tmp_path / f"p{bits}.png"
        path.write_bytes(data)
        assert (array(read_raster(spark, str(path))) == want).all()


def test_mosaic_and_frames(spark, tmp_path, monkeypatch):
    px = spark.range(50 * 21).selectExpr("id div 21 AS line", "id % 21 AS sample", "double(hash(id) % 97) AS value")
    folder = str(tmp_path / "m")
    assert write_tiffs(px, folder, 21, lines=8, frame=(-1000.0, 500.0, 10.0, 20.0, 1737400.0)) == 50 * 21
    want = sorted(map(tuple, px.collect()))
    assert sorted(map(tuple, mosaic(spark, folder).collect())) == want
    monkeypatch.setattr(rasters, "PLANNED", 2)
    cut = sorted(map(tuple, mosaic(spark, folder, (7, 26, 3, 6)).collect()))
    assert cut == [r for r in want if 7 <= r[0] < 26 and 3 <= r[1] < 6]
    reader = rasters.RasterReader({"path": folder, "window": "7,26,3,6", "mosaic": "true"})
    assert [a for _, a, _ in reader.files()] == [0, 8, 16, 24]
    frames = {r.file[-13:-4]: r for r in geotiff_frames(spark, folder).collect()}
    assert len(frames) == 7
    r = frames["000000016"]
    assert (r.lines, r.samples, r.x0, r.y0, r.dx, r.dy, r.radius, r.lat0, r.point, r.name) == (8, 21, -1000.0, 500.0 - 16 * 20, 10.0, 20.0, 1737400.0, -90.0, False, "south polar stereographic")
    (tmp_path / "plain.tif").write_bytes(tiff_bytes(np.zeros((2, 2), "<f4")))
    with pytest.raises(ValueError, match="no pixel scale"):
        rasters.frame_of(layout_of(str(tmp_path / "plain.tif"), {}))


def test_geokeys():
    found = rasters.geokeys((1, 1, 0, 4, 3075, 0, 1, 15, 2057, 34736, 1, 1, 1026, 34737, 4, 2, 9, 34736, 2, 0), (7.0, 8.0), "x|Moon|")
    assert found == {3075: 15, 2057: 8.0, 1026: "Moon", 9: [7.0, 8.0]}
    assert rasters.geokeys((1, 1, 0, 2, 3075, 0, 1)) == {} and rasters.geokeys(()) == {}
