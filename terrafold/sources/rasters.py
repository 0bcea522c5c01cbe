"""Raster files as a Spark data source: raw and NPY arrays, TIFF (strips or tiles, plain or deflated), grey PNG.

    spark.dataSource.register(RasterSource)
    spark.read.format("raster").option("path", folder).option("window", "0,100,50,80").load()

gives file, band, line, sample and value (re and im for complex rasters), a row for each pixel. A file's header is read
when the scan is planned; its pixels are read in parts of a bounded number of bytes, each part's byte ranges by one task.
Only strips, tiles and lines that meet the window are read. Files are opened by pyarrow.fs, which must know the path's scheme.
"""

from __future__ import annotations

import ast
import itertools
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A part's bytes, about; a block (strip, tile, line) is never parted.
PART_BYTES = 16 << 20
#: Headers of so many files are read when a scan is planned; of more, each by the file's own task.
PLANNED = 64
#: Lines of a headerless raster make blocks of so many bytes, about.
RAW_BLOCK = 1 << 20
#: TIFF, fixed values: field types' struct letters; sample formats' NumPy kinds; codecs that are read.
FIELD_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
SAMPLE_KINDS = {1: "u", 2: "i", 3: "f", 6: "c"}
PLAIN_CODEC, DEFLATE_CODECS = 1, (8, 32946)
#: Tags by number, fixed values.
WIDTH, LENGTH, BITS, CODEC, STRIPS, BANDS, STRIP_LINES, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILES, TILE_BYTES, FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, GEO_DOUBLES, GEO_TEXT = 33550, 33922, 34735, 34736, 34737
SUFFIXES = {".npy": "npy", ".tif": "tiff", ".tiff": "tiff", ".geotiff": "tiff", ".png": "png"}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """The file itself, or a folder's files with a raster's suffix, in order of names."""
    fs, local = opened(path)
    info = fs.get_file_info(local)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [path]
    names = sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(local)) if i.type == pafs.FileType.File and suffix(i.base_name) in SUFFIXES)
    return [f"{path.rstrip('/')}/{n}" for n in names]


def suffix(name: str) -> str:
    return "." + name.rpartition(".")[2].lower()


@dataclass(frozen=True)
class Layout:
    """How a file's pixels lie: blocks of block_lines x block_samples in rows of blocks, each at an offset, of so many bytes."""

    path: str
    dtype: str
    lines: int
    samples: int
    bands: int
    block_lines: int
    block_samples: int
    offsets: tuple[int, ...]
    counts: tuple[int, ...]
    codec: str = "plain"
    predictor: int = 1
    tags: dict[int, Any] = field(default_factory=dict, compare=False)

    @property
    def pixel(self) -> int:
        return np.dtype(self.dtype).itemsize * self.bands


@dataclass
class Piece:
    """Pixels that come from one block: the block's place, what of it is wanted, and the byte ranges that hold that."""

    layout: Layout
    block: int
    line: int
    sample: int
    lines: int
    samples: int
    skip: tuple[int, int]
    ranges: list[tuple[int, int]]

    @property
    def bytes(self) -> int:
        return sum(n for _, n in self.ranges)


def raw_layout(path: str, dtype: str, lines: int, samples: int, offset: int = 0, size: int | None = None) -> Layout:
    """A headerless raster after so many bytes; size: the file's, which must be what the geometry says."""
    item = np.dtype(dtype).itemsize
    need = offset + lines * samples * item
    if size is not None and size != need:
        raise ValueError(f"{path}: {size} bytes, the geometry says {need}")
    line = samples * item
    block = max(1, min(lines, RAW_BLOCK // max(1, line)))
    offsets = tuple(range(offset, need, block * line)) if line else ()
    return Layout(path, dtype, lines, samples, 1, block, samples, offsets, tuple(min(block * line, need - at) for at in offsets))


def npy_layout(path: str, f: pa.NativeFile, size: int) -> Layout:
    head = f.read_at(12, 0)
    if head[:6] != b"\x93NUMPY":
        raise ValueError(f"{path}: no NPY file")
    wide = head[6] > 1
    n, start = (struct.unpack("<I", head[8:12])[0], 12) if wide else (struct.unpack("<H", head[8:10])[0], 10)
    said = ast.literal_eval(f.read_at(n, start).decode("latin-1").strip())
    if said["fortran_order"] or len(said["shape"]) != 2:
        raise ValueError(f"{path}: only arrays of lines by samples are read")
    return raw_layout(path, said["descr"], *said["shape"], offset=start + n, size=size)


def tiff_tags(f: pa.NativeFile) -> tuple[str, dict[int, Any]]:
    """Byte order and the fields of the first directory (classic or BigTIFF): tuples of numbers, or text."""
    head = f.read_at(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("no TIFF file")
    big = magic == 43
    at = struct.unpack(order + "Q", head[8:16])[0] if big else struct.unpack(order + "I", head[4:8])[0]
    n = struct.unpack(order + "Q", f.read_at(8, at))[0] if big else struct.unpack(order + "H", f.read_at(2, at))[0]
    size, at = (20, at + 8) if big else (12, at + 2)
    block, found = f.read_at(n * size, at), {}
    for k in range(n):
        entry = block[k * size : (k + 1) * size]
        code, kind = struct.unpack(order + "HH", entry[:4])
        count = struct.unpack(order + ("Q" if big else "I"), entry[4 : 12 if big else 8])[0]
        letters = FIELD_TYPES.get(kind)
        if letters is None:
            continue
        inline, width = entry[12:20] if big else entry[8:12], struct.calcsize("=" + letters) * count
        value = inline[:width] if width <= len(inline) else f.read_at(width, struct.unpack(order + ("Q" if big else "I"), inline)[0])
        found[code] = value.split(b"\0")[0].decode("latin-1") if letters == "s" else struct.unpack(order + letters * count, value)
    return order, found


def tiff_layout(path: str, f: pa.NativeFile) -> Layout:
    order, t = tiff_tags(f)
    one = lambda code, other=None: t[code][0] if code in t else other
    lines, samples, bands, bits = one(LENGTH), one(WIDTH), one(BANDS, 1), t.get(BITS, (1,))
    kind, codec, predictor = SAMPLE_KINDS.get(one(FORMAT, 1)), one(CODEC, 1), one(PREDICTOR, 1)
    if kind is None or len(set(bits)) != 1 or bits[0] % 8 or codec not in (PLAIN_CODEC, *DEFLATE_CODECS) or predictor not in (1, 2) or (bands > 1 and one(PLANAR, 1) != 1):
        raise ValueError(f"{path}: bits {bits}, sample format {one(FORMAT, 1)}, codec {codec}, predictor {predictor}, planar {one(PLANAR, 1)} aren't read")
    tiled = TILES in t
    shape = (one(TILE_LENGTH), one(TILE_WIDTH)) if tiled else (min(one(STRIP_LINES, lines), lines), samples)
    offsets, counts = t[TILES if tiled else STRIPS], t.get(TILE_BYTES if tiled else STRIP_BYTES)
    need = -(-lines // shape[0]) * -(-samples // shape[1])
    if len(offsets) != need:
        raise ValueError(f"{path}: {len(offsets)} blocks, the geometry says {need}")
    dtype = f"{order}{kind}{bits[0] // 8}"
    if codec == PLAIN_CODEC:
        full = [shape[0] if tiled else min(shape[0], lines - k * shape[0]) for k in range(need)]
        whole = tuple(n * shape[1] * bands * (bits[0] // 8) for n in full)
        if counts is not None and tuple(counts) != whole:
            raise ValueError(f"{path}: blocks of {set(counts)} bytes, the geometry says {set(whole)}")
        counts = whole
    elif counts is None:
        raise ValueError(f"{path}: no byte counts")
    return Layout(path, dtype, lines, samples, bands, *shape, tuple(offsets), tuple(counts), "plain" if codec == PLAIN_CODEC else "deflate", predictor, {k: v for k, v in t.items() if k in (PIXEL_SCALE, TIE_POINT, GEO_KEYS, GEO_DOUBLES, GEO_TEXT)})


def png_layout(path: str, f: pa.NativeFile, size: int) -> Layout:
    """Grey images of 8 or 16 bits; one block, as a line's filter needs the line before."""
    head = f.read_at(33, 0)
    if head[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError(f"{path}: no PNG file")
    samples, lines, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head[16:29])
    if colour or bits not in (8, 16) or interlaced:
        raise ValueError(f"{path}: only grey images of 8 or 16 bits without interlacing are read")
    return Layout(path, f">u{bits // 8}", lines, samples, 1, lines, samples, (0,), (size,), "png")


def layout_of(path: str, options: dict[str, str]) -> Layout:
    fs, local = opened(path)
    size = fs.get_file_info(local).size
    kind = options.get("layout") or SUFFIXES.get(suffix(path), "raw")
    if kind == "raw":
        return raw_layout(path, options["dtype"], int(options["lines"]), int(options["samples"]), int(options.get("offset", 0)), size)
    with fs.open_input_file(local) as f:
        return tiff_layout(path, f) if kind == "tiff" else npy_layout(path, f, size) if kind == "npy" else png_layout(path, f, size)


def pieces(layout: Layout, window: tuple[int, int, int, int] | None = None) -> Iterator[Piece]:
    """What a scan reads: a piece for each block that meets the window (first and last line, first and last sample, ends left out)."""
    l0, l1, s0, s1 = window or (0, layout.lines, 0, layout.samples)
    l0, l1, s0, s1 = max(0, l0), min(layout.lines, l1), max(0, s0), min(layout.samples, s1)
    if l0 >= l1 or s0 >= s1:
        return
    bl, bs = layout.block_lines, layout.block_samples
    across, slim = -(-layout.samples // bs), replace(layout, offsets=(), counts=())  # a piece has its own ranges
    for row in range(l0 // bl, (l1 - 1) // bl + 1):
        for col in range(s0 // bs, (s1 - 1) // bs + 1):
            k, top, left = row * across + col, row * bl, col * bs
            a, b, c, d = max(l0, top), min(l1, top + bl), max(s0, left), min(s1, left + bs)
            if layout.codec != "plain":
                ranges = [(layout.offsets[k], layout.counts[k])]
            elif d - c == bs:
                ranges = [(layout.offsets[k] + (a - top) * bs * layout.pixel, (b - a) * bs * layout.pixel)]
            else:
                ranges = [(layout.offsets[k] + ((x - top) * bs + c - left) * layout.pixel, (d - c) * layout.pixel) for x in range(a, b)]
            yield Piece(slim, k, a, c, b - a, d - c, (a - top, c - left), ranges)


def unfiltered(data: bytes, lines: int, width: int, step: int) -> np.ndarray:
    """A PNG's lines without their filters; step: bytes of a pixel."""
    rows = np.frombuffer(data, np.uint8).reshape(lines, width + 1)
    out, above = np.zeros((lines, width), np.uint8), np.zeros(width, np.uint8)
    for k in range(lines):
        kind, row = rows[k, 0], rows[k, 1:].copy()
        if kind == 1:  # sums along the line, byte place by byte place
            row = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            for i in range(width):
                left, up, corner = (int(row[i - step]) if i >= step else 0), int(above[i]), (int(above[i - step]) if i >= step else 0)
                if kind == 4:
                    guess = left + up - corner
                    near = min((left, up, corner), key=lambda v: abs(guess - v))  # noqa: B023  the first of equals
                else:
                    near = (left + up) // 2
                row[i] = (int(row[i]) + near) & 255
        out[k] = above = row
    return out


def pixels_of(piece: Piece, f: pa.NativeFile) -> np.ndarray:
    """The piece as lines x samples x bands."""
    lay = piece.layout
    dtype = np.dtype(lay.dtype)
    parts = [f.read_at(n, at) for at, n in piece.ranges]
    if any(len(p) != n for p, (_, n) in zip(parts, piece.ranges, strict=True)):
        raise ValueError(f"{lay.path}: the file ends within block {piece.block}")
    data = b"".join(parts)
    if lay.codec == "plain":
        return np.frombuffer(data, dtype).reshape(piece.lines, piece.samples, lay.bands)
    if lay.codec == "png":
        body, at = b"", 8
        while at < len(data):
            n, name = struct.unpack(">I4s", data[at : at + 8])
            body += data[at + 8 : at + 8 + n] if name == b"IDAT" else b""
            at += n + 12
        whole = unfiltered(zlib.decompress(body), lay.lines, lay.samples * lay.pixel, lay.pixel).view(dtype).reshape(lay.lines, lay.samples, 1)
    else:
        whole = np.frombuffer(zlib.decompress(data), dtype)
        whole = whole.reshape(-1, lay.block_samples, lay.bands)
        if lay.predictor == 2:  # differences along the line
            whole = np.cumsum(whole, axis=1, dtype=dtype.newbyteorder("="))
    top, left = piece.skip
    return whole[top : top + piece.lines, left : left + piece.samples]


@dataclass
class Part(InputPartition):
    """Pieces of files whose headers were read, or whole files that a task looks into itself."""

    pieces: list[Piece]
    files: list[tuple[str, int, int | None]] = field(default_factory=list)


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        window = options.get("window")
        self.window = tuple(int(x) for x in window.split(",")) if window else None
        if self.window and len(self.window) != 4:
            raise ValueError("window is: first line, line after the last, first sample, sample after the last")

    def files(self) -> list[tuple[str, int, int | None]]:
        """Each file that the window may meet, its first line in the mosaic (0 without one), and where the next one's lines start."""
        names = files_of(self.options["path"])
        if self.options.get("mosaic", "false").lower() != "true":
            return [(n, 0, None) for n in names]
        first = sorted((int(re.findall(r"\d+", n.rpartition("/")[2])[-1]), n) for n in names)
        ends = [*[a for a, _ in first[1:]], None]
        return [(n, a, end) for (a, n), end in zip(first, ends, strict=True) if not self.window or (a < self.window[1] and (end is None or end > self.window[0]))]

    def within(self, path: str, first: int) -> Iterator[Piece]:
        window = self.window and (self.window[0] - first, self.window[1] - first, *self.window[2:])
        for piece in pieces(layout_of(path, self.options), window):
            piece.line += first
            yield piece

    def partitions(self) -> list[Part]:
        most, found = int(self.options.get("partbytes", PART_BYTES)), self.files()
        if len(found) > PLANNED:
            return [Part([], [f]) for f in found]
        parts, held = [Part([])], 0
        for path, first, _ in found:
            for piece in self.within(path, first):
                if held and held + piece.bytes > most:
                    parts.append(Part([]))
                    held = 0
                parts[-1].pieces.append(piece)
                held += piece.bytes
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for piece in itertools.chain(partition.pieces, *(self.within(path, first) for path, first, _ in partition.files)):
            if piece.layout.path != name:
                name = piece.layout.path
                fs, local = opened(name)
                f = fs.open_input_file(local)
            yield from batches(piece, pixels_of(piece, f))


def batches(piece: Piece, found: np.ndarray, rows: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Rows of a piece, some lines at a time."""
    step = max(1, rows // max(1, piece.samples))
    for band in range(piece.layout.bands):
        for a in range(0, piece.lines, step):
            part = found[a : a + step, :, band]
            n = part.size
            line = np.repeat(np.arange(piece.line + a, piece.line + a + len(part)), piece.samples)
            sample = np.tile(np.arange(piece.sample, piece.sample + piece.samples), len(part))
            columns = {"file": pa.repeat(pa.scalar(piece.layout.path), n), "band": pa.repeat(pa.scalar(band, pa.int32()), n), "line": pa.array(line, pa.int64()), "sample": pa.array(sample, pa.int64())}
            flat = part.reshape(-1)
            values = {"re": flat.real, "im": flat.imag} if flat.dtype.kind == "c" else {"value": flat}
            yield pa.record_batch(columns | {k: pa.array(v.astype(np.float64)) for k, v in values.items()})


class RasterSource(DataSource):
    """Options: path, window, partBytes; mosaic (true: a file's lines start at the last number in its name); layout (raw, npy, tiff, png; else by the name's suffix); for raw dtype (NumPy's, with byte order), lines, samples, offset."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        options = dict(self.options)
        found = files_of(options["path"])
        if not found:
            raise FileNotFoundError(f"{options['path']}: no raster")
        value = "re double, im double" if np.dtype(layout_of(found[0], options).dtype).kind == "c" else "value double"
        return f"file string, band int, line long, sample long, {value}"

    def reader(self, schema) -> RasterReader:
        return RasterReader({k.lower(): v for k, v in dict(self.options).items()})


def read_raster(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, **options: object) -> DataFrame:
    """file, band, line, sample, value (or re, im) of a raster file, or of a folder's; see RasterSource."""
    spark.dataSource.register(RasterSource)
    r = spark.read.format("raster").option("path", path)
    for k, v in {**options, **({"window": ",".join(map(str, window))} if window else {})}.items():
        r = r.option(k, str(v))
    return r.load()


def geokeys(directory: tuple[int, ...], doubles: tuple[float, ...] = (), text: str = "") -> dict[int, Any]:
    """Keys of a GeoTIFF's directory: values in place, or from the tags of doubles and of text that an entry points to. An entry that is cut off ends the list."""
    found: dict[int, Any] = {}
    entries = [directory[k : k + 4] for k in range(4, 4 + 4 * (directory[3] if len(directory) > 3 else 0), 4)]
    for key, where, count, at in (e for e in entries if len(e) == 4):
        if where == 0:
            found[key] = at
        elif where == GEO_DOUBLES:
            found[key] = doubles[at] if count == 1 else list(doubles[at : at + count])
        elif where == GEO_TEXT:
            found[key] = text[at : at + count].rstrip("|\0 ")
    return found


#: Keys of a frame, fixed values: raster type, text, projection, units, axes, origin, straight pole, offsets, scale. A polar stereographic projection; metres.
RASTER_TYPE, CITATION, PROJECTION, UNITS, MAJOR, MINOR = 1025, 1026, 3075, 3076, 2057, 2058
ORIGIN_LON, ORIGIN_LAT, EASTING, NORTHING, SCALE, POLE_LON = 3080, 3081, 3082, 3083, 3092, 3095
POLAR, METRE = 15, 9001
FRAME = "file string, lines long, samples long, x0 double, y0 double, dx double, dy double, radius double, lat0 double, lon0 double, scale double, easting double, northing double, point boolean, name string"


def frame_of(layout: Layout) -> tuple:
    """A GeoTIFF's frame. One without scale or tie point, of another projection or in other units raises an error: nothing is guessed."""
    t = layout.tags
    if PIXEL_SCALE not in t or TIE_POINT not in t:
        raise ValueError(f"{layout.path}: no pixel scale or tie point")
    keys = geokeys(t.get(GEO_KEYS, ()), t.get(GEO_DOUBLES, ()), t.get(GEO_TEXT, ""))
    if keys.get(PROJECTION) != POLAR:
        raise ValueError(f"{layout.path}: projection {keys.get(PROJECTION)}, not polar stereographic ({POLAR})")
    if keys.get(UNITS, METRE) != METRE:
        raise ValueError(f"{layout.path}: units {keys[UNITS]}, not metres")
    number = lambda *of, other: float(next((keys[k] for k in of if k in keys), other))
    tie, step = t[TIE_POINT], t[PIXEL_SCALE]
    return (
        layout.path, layout.lines, layout.samples, float(tie[3]), float(tie[4]), float(step[0]), float(step[1]), number(MAJOR, MINOR, other=1737400.0),
        number(ORIGIN_LAT, other=-90), number(POLE_LON, ORIGIN_LON, other=0), number(SCALE, other=1) or 1.0, number(EASTING, other=0), number(NORTHING, other=0),
        keys.get(RASTER_TYPE, 1) == 2, str(keys.get(CITATION, "")).split("|")[0],
    )


def geotiff_frames(spark: SparkSession, path: str) -> DataFrame:
    """FRAME's columns for each TIFF in a folder (or the one file): only headers are read, file by file, in tasks."""
    names = spark.createDataFrame([(p,) for p in files_of(path)], "file string")
    names = names.repartition(max(1, min(names.count(), spark.sparkContext.defaultParallelism)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([frame_of(layout_of(p, {"layout": "tiff"})) for p in b["file"]], columns=[c.split()[0] for c in FRAME.split(", ")])

    return names.mapInPandas(run, FRAME)


def tiff_bytes(a: np.ndarray, strip: int = 16, deflate: bool = True, geo: dict[int, tuple[str, tuple]] | None = None) -> bytes:
    """A little-endian TIFF of lines x samples in strips of so many lines; geo: further tags (type letter, values)."""
    a = np.ascontiguousarray(a, a.dtype.newbyteorder("<"))
    lines, samples = a.shape
    parts = [a[k : k + strip].tobytes() for k in range(0, lines, strip)]
    parts = [zlib.compress(p) for p in parts] if deflate else parts
    offsets = tuple(8 + sum(map(len, parts[:k])) for k in range(len(parts)))
    kind = {v: k for k, v in SAMPLE_KINDS.items()}[a.dtype.kind]
    tags = {WIDTH: ("I", (samples,)), LENGTH: ("I", (lines,)), BITS: ("H", (8 * a.dtype.itemsize,)), CODEC: ("H", (8 if deflate else 1,)), 262: ("H", (1,)), STRIPS: ("I", offsets), BANDS: ("H", (1,)), STRIP_LINES: ("I", (strip,)), STRIP_BYTES: ("I", tuple(map(len, parts))), FORMAT: ("H", (kind,))} | (geo or {})
    numbers = {v: k for k, v in FIELD_TYPES.items() if v in "HIds" and k != 7}
    at = 8 + sum(map(len, parts))
    at += at % 2
    after, extra, block = at + 2 + 12 * len(tags) + 4, b"", b""
    for code in sorted(tags):
        letter, values = tags[code]
        value = values[0].encode() + b"\0" if letter == "s" else struct.pack(f"<{len(values)}{letter}", *values)
        count = len(value) if letter == "s" else len(values)
        if len(value) > 4:
            place = struct.pack("<I", after + len(extra))
            extra += value + b"\0" * (len(value) % 2)
        else:
            place = value.ljust(4, b"\0")
        block += struct.pack("<HHI", code, numbers[letter], count) + place
    body = b"II*\0" + struct.pack("<I", at) + b"".join(parts)
    return body.ljust(at, b"\0") + struct.pack("<H", len(tags)) + block + b"\0\0\0\0" + extra


def polar_tags(x0: float, y0: float, dx: float, dy: float, radius: float, name: str = "south polar stereographic") -> dict[int, tuple[str, tuple]]:
    """Tags of a frame about the south pole whose first pixel's corner is at x0, y0."""
    keys = (1, 1, 0, 6, RASTER_TYPE, 0, 1, 1, CITATION, GEO_TEXT, len(name) + 1, 0, MAJOR, GEO_DOUBLES, 1, 0, PROJECTION, 0, 1, POLAR, UNITS, 0, 1, METRE, ORIGIN_LAT, GEO_DOUBLES, 1, 1)
    return {PIXEL_SCALE: ("d", (dx, dy, 0.0)), TIE_POINT: ("d", (0.0, 0.0, 0.0, x0, y0, 0.0)), GEO_KEYS: ("H", keys), GEO_DOUBLES: ("d", (radius, -90.0)), GEO_TEXT: ("s", (name + "|",))}


def write_tiffs(px: DataFrame, path: str, samples: int, lines: int = 64, columns: tuple[str, ...] = ("value",), dtype: str = "<f8", strip: int = 16, deflate: bool = True, frame: tuple[float, float, float, float, float] | None = None) -> int:
    """Write line, sample and a value (or re, im) as TIFFs of so many lines each, named by their first line; how many pixels were written.

    A file holds the lines that a task has got; pixels without a row are NaN (0 for integers). frame: x0, y0, dx, dy and
    radius of a georeferenced raster; each file's tie point is its own first line's. A task that runs again writes the
    same bytes under the same name, and a name appears once its file is whole.
    """
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kind = np.dtype(dtype)
        first = int(key[0]) * lines
        a = np.full((int(rows["line"].max()) - first + 1, samples), np.nan if kind.kind in "fc" else 0, kind)
        value = rows[columns[0]].to_numpy() if len(columns) == 1 else rows[columns[0]].to_numpy() + 1j * rows[columns[1]].to_numpy()
        a[rows["line"].to_numpy() - first, rows["sample"].to_numpy()] = value
        geo = polar_tags(frame[0], frame[1] - first * frame[3], *frame[2:]) if frame else None
        fs, local = opened(path)
        fs.create_dir(local, recursive=True)
        name, part = f"{local}/lines-{first:09d}.tif", f"{local}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as f:
            f.write(tiff_bytes(a, strip, deflate, geo))
        fs.move(part, name)
        return pd.DataFrame({"n": [len(rows)]})

    done = px.select("line", "sample", *columns).groupBy((px["line"] / lines).cast("long").alias("part")).applyInPandas(run, "n long")
    return done.agg({"n": "sum"}).first()[0] or 0


def mosaic(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """write_tiffs' files as one raster: line, sample, value (or re, im)."""
    return read_raster(spark, path, window, mosaic="true").drop("file", "band")
