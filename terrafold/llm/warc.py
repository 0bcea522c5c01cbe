"""Operator 6, WARC archives under a dictionary.

Each task cuts its pages into archives of a bounded size. Of an archive's own records a Zstandard dictionary is built,
which stands in a leading skippable frame; every record is a frame of its own, so that any of them can be read alone.
Pages with equal payloads are archived once; the others become revisit records. Archives are files in the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.common import shared_dir, small, staged

# The magic number of the skippable frame that holds a WARC file's dictionary; the version line.
DICTIONARY_MAGIC, VERSION = 0x184D2A5D, "WARC/1.1"
#: An archive ends after so many bytes of records; the dictionary's size, and the bytes of records that it is built from,
#: which are pieces of PIECE bytes at equal distances over the whole archive.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES, PIECE = 16 << 20, 64 << 10, 4 << 20, 8 << 10
LEVEL, SUFFIX, DATE = 3, ".warc.zst", "1970-01-01T00:00:00Z"
FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields, by lower-case name, and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:size]


def record_id(page_id, copy: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{copy}')}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, copy: int) -> bytes:
    """A response with its payload, or a revisit without; both tell the full payload's length and digest."""
    uri = "".join(c if c > " " and c not in "<>" else f"%{ord(c):02X}" for c in url or "urn:none")
    fields = [("WARC-Record-ID", record_id(page_id, str(copy) if revisit else "")), ("WARC-Target-URI", uri), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to))]
        if refers_to is not None:
            fields.append(("X-Refers-To-Page-Id", str(refers_to)))
    fields.append(("Content-Type", "application/http;msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record("revisit" if revisit else "response", fields, http if revisit else http + payload)


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Built from about SAMPLE_BYTES of an archive's records, spread over all of it; None where they are too few to build one."""
    pieces = [r[at : at + PIECE] for r in records for at in range(0, len(r), PIECE)]
    samples = pieces[:: max(1, -(-sum(map(len, pieces)) // SAMPLE_BYTES))]
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, total // 8)), samples, k=512, d=8)
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes]) -> bytes:
    """The dictionary's frame, a warcinfo record, then a frame for each record."""
    made = dictionary(records)
    out = io.BytesIO()
    if made is not None:
        raw = made.as_bytes()
        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        made.precompute_compress(level=LEVEL)
    z = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=True)
    out.write(z.compress(record("warcinfo", [("WARC-Record-ID", record_id("info")), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
    for r in records:
        out.write(z.compress(r))
    return out.getvalue()


def frames(data: bytes) -> Iterator[bytes]:
    """Each frame's content, under the dictionary that stands in front, if there is one."""
    view, at, made = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        made = zstandard.ZstdCompressionDict(bytes(view[8:at]))
    z = zstandard.ZstdDecompressor(dict_data=made)
    while at < len(data):
        one, got = z.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("an archive ends within a frame")
            part = view[at : at + 32_768]
            got.append(one.decompress(part))
            at += len(part)
        at -= len(one.unused_data)
        yield b"".join(got)


def marked(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest (SHA-1), row, refers_to, revisit: of rows with equal payloads of at least min_bytes, that with the largest page_id is no revisit."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"), F.monotonically_increasing_id().alias("row"))
    # Written once: the rows are numbered for both uses alike, whatever pages is made of.
    p = staged(p.withColumn("digest", F.unhex(F.sha1("payload"))), "pages")
    # Only digests and ids are grouped, and combined in each task first, so that no payload's copies meet in one task.
    groups = p.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "row")).alias("best")).where("n > 1")
    groups = small(staged(groups.select(F.col("digest").alias("d"), F.col("best.page_id").alias("refers_to"), F.col("best.row").alias("best")), "copies"))
    j = p.join(groups, (p["digest"] == groups["d"]) & (F.octet_length("payload") >= min_bytes), "left")
    revisit = F.coalesce(F.col("best") != F.col("row"), F.lit(False))
    return j.select("page_id", "url", "payload", "digest", "row", F.when(revisit, F.col("refers_to")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> int:
    """Write a record for each row of pages (page_id, url, html) to archives in the folder path; how many records there are.

    path must be one that executors reach and pyarrow.fs knows (file, hdfs, s3, gs). A task's files have names of its
    partition and come to their place when whole, so that a task that is run again replaces what it left.
    """

    def run(batches):
        fs, folder = pafs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        partition, attempt, k, records, size = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, [], 0

        def close() -> int:
            name, n = f"{folder}/part-{partition:06d}-{k:06d}{SUFFIX}", len(records)
            with fs.open_output_stream(hidden := f"{folder}/_{partition:06d}-{k:06d}-{attempt}") as f:
                f.write(archive(records))
            fs.move(hidden, name)
            records.clear()
            return n

        written = 0
        for b in batches:
            columns = [b.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to", "revisit", "row")]
            for page_id, url, payload, digest, refers_to, revisit, row in zip(*columns, strict=True):
                records.append(page_record(page_id.as_py(), url.as_py(), payload.as_py(), base64.b32encode(digest.as_py()).decode(), refers_to.as_py(), revisit.as_py(), row.as_py()))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    written += close()
                    k, size = k + 1, 0
        if records:
            written += close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([written], pa.int64())})

    return marked(pages, min_bytes).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload, null for revisits, if asked for) of each archived page.

    Every payload is held against its record's length and digest; a mismatch raises an error.
    """
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if payload else [])])

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def pages(data: bytes):
        for raw in frames(data):
            fields, block = parsed(raw)
            kind = fields["warc-type"]
            if kind not in ("response", "revisit"):
                continue
            head, _, body = block.partition(b"\r\n\r\n")
            size = int(head.lower().rpartition(b"content-length:")[2])
            digest = fields["warc-payload-digest"].partition(":")[2]
            if kind == "response" and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                raise ValueError(f"the payload of page {fields.get('x-page-id')} isn't what its record says")
            row = (number(fields.get("x-page-id")), size, digest, kind, number(fields.get("x-refers-to-page-id")))
            yield (*row, body if kind == "response" else None) if payload else row

    def run(batches):
        for b in batches:
            for data in b.column(0):
                rows, size = [], 0
                for r in pages(data.as_py()):
                    rows.append(r)
                    size += r[1] if payload else 0
                    if len(rows) >= 10_000 or size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(path).select("content")
    return files.mapInArrow(run, FOUND + (", payload binary" if payload else ""))


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) to archives in the shared folder, and what these hold when read back.

    Null html is an empty payload; null urls get a placeholder. Of repeated rows with one page_id and payload, one is
    the response. Null ids count as smaller than all others; their revisits refer to null. An empty table gives no row.
    Columns other than the three are ignored.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    if not write_archives(pages, path, min_bytes):
        return spark.createDataFrame([], FOUND)
    return read_archives(spark, path)
