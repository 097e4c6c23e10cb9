"""WARC archives: a writer on Spark's text sink and a Python data source that reads them.

Every record is a gzip member of its own (several where it is over 15 MB), as archives are
commonly compressed. A member's header has the extra field ``sl`` (skip lengths): the
bytes of the member and of what it inflates to, so a reader can go to the next record
without reading or inflating this one. Members are written through Spark's own committer
and file systems: a row is a member without its last byte, which is zero in any
member of less than 16 MB, and the sink's line separator is that byte. Records whose
payload an earlier record has (equal payloads of at least 100 bytes, smallest page_id
first) are written as ``revisit`` without it.

Reading: the driver lists files, packs small ones into partitions and cuts large ones
into ranges; a range begins at the first record in it. Each task goes from record to
record: the first bytes are inflated until the header is there, pushed-down predicates on
the record type and the other header columns are checked on it, and the rest is
skipped in the file unless the record passes and the schema asks for the payload.
Plain files and archives of other writers, without skip lengths, are read from end to end.
Where only Hadoop knows the file system, Spark reads the files and the same parser
takes them from memory.

Defined results: a null html is an empty payload; a page whose page_id is null,
or equal to the smallest one of its payload (a tie, a repeated row), is a response; a
null url gives a record without a target; a page of any length is written and read
whole; columns other than page_id, url and html are not looked at; no pages give no records.
"""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tesserae.sources.shipping import ship

from . import common

CRLF = "\r\n"
#: Column, header, type. Each can be pushed down.
HEADERS = (
    ("warc_type", "WARC-Type", "string"),
    ("record_id", "WARC-Record-ID", "string"),
    ("target_uri", "WARC-Target-URI", "string"),
    ("payload_digest", "WARC-Payload-Digest", "string"),
    ("refers_to", "WARC-Refers-To", "string"),
    ("page_id", "X-Page-ID", "long"),
    ("payload_length", "X-Payload-Length", "long"),
    ("refers_to_page", "X-Refers-To-Page-ID", "long"),
)
SCHEMA = ", ".join(f"{c} {t}" for c, _, t in HEADERS) + ", payload binary"
SHARED_BYTES = 100  #: shorter payloads are always written out
MEMBER_BYTES = 15 << 20  #: of a record that one member holds; below 16 MB, so that its length ends in a zero byte
#: How a member begins: a gzip header with an extra field of skip lengths; the time stamp tells a record's first member from the others.
FIRST, MORE = (b"\x1f\x8b\x08\x04" + bytes([n, 0, 0, 0, 0, 0xFF, 12, 0]) + b"sl\x08\x00" for n in (0, 1))
HEAD = len(FIRST) + 8


def records(pages: DataFrame, shared_bytes: int = SHARED_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One WARC record (column ``value``) for each page."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.col("url").cast("string"), r"[\x00-\x20\x7f]", "%20").alias("url"),
        html.alias("html"),
        F.sha2(html, 256).alias("sha"),
        F.octet_length(html).cast("long").alias("bytes"),
    )
    first = rows.filter(F.col("bytes") >= shared_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select(F.col("sha").alias("f_sha"), "first")
    known = rows.join(first, rows["sha"] == first["f_sha"], "left")
    again = F.col("first").isNotNull() & (F.col("page_id") != F.col("first"))
    known = known.withColumn("again", F.coalesce(again, F.lit(False)))
    name = lambda page, sha: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("none")), sha)), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    line = lambda key, value: F.when(value.isNotNull(), F.concat(F.lit(f"{key}: "), value.cast("string"), F.lit(CRLF))).otherwise("")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(F.col("again"), http).otherwise(F.concat(http, F.col("html")))
    to = F.when(F.col("again"), F.col("first"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("page_id"), F.col("sha"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("sha"))),
        line("WARC-Refers-To", F.when(F.col("again"), name(F.col("first"), F.col("sha")))),
        line("WARC-Profile", F.when(F.col("again"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("X-Page-ID", F.col("page_id")),
        line("X-Payload-Length", F.col("bytes")),
        line("X-Refers-To-Page-ID", to),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block)),
        F.lit(CRLF),
    )
    return known.select(F.concat(head, block).alias("value"))


def member(data: bytes, begins: bytes = FIRST) -> bytes:
    """A gzip member that says how long it is."""
    press = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = press.compress(data) + press.flush()
    return b"".join([begins, struct.pack("<II", HEAD + len(body) + 8, len(data)), body, struct.pack("<II", zlib.crc32(data), len(data))])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, held = [], 0
        for x in batch.column(0):
            data = x.as_buffer()
            for i in range(0, data.size, MEMBER_BYTES):
                out.append(member(data[i : i + MEMBER_BYTES], MORE if i else FIRST)[:-1])
                held += len(out[-1])
            if held > 16 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write(pages: DataFrame, path: str, **options) -> None:
    """Write pages as WARC files, a gzip member for each record, into a folder."""
    closed = records(pages, **options).select(F.concat("value", F.lit(CRLF * 2)).cast("binary").alias("value"))
    # the sink writes bytes as they are; its separator is each member's last byte
    common.map_arrow(closed, _members, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\x00").text(path)


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


class WarcReader(DataSourceReader):
    """Plans partitions of files and ranges and reads records, header first."""

    def __init__(self, schema: T.StructType, options: dict):
        self.columns = [f.name for f in schema.fields]
        self.types = [f.dataType for f in schema.fields]
        self.path = options.get("path", "")
        self.target = int(options.get("partitionbytes", 32 << 20))
        self.buffer = int(options.get("bufferbytes", 64 << 10))
        self.wanted: list[tuple[str, frozenset]] = []
        self.skipped = self.bytes_read = 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        known = {c for c, _, _ in HEADERS}
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute[0] in known:
                self.wanted.append((f.attribute[0], frozenset([f.value])))
            elif isinstance(f, In) and f.attribute[0] in known:
                self.wanted.append((f.attribute[0], frozenset(f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, path = fs.FileSystem.from_uri(self.path)
        found = sorted((i.path, i.size) for i in store.get_file_info(fs.FileSelector(path, recursive=True)) if i.is_file and i.base_name[0] not in "._")
        pieces = []
        for p, n in found:
            if n > self.target:
                with store.open_input_file(p) as raw:
                    can_be_cut = raw.read(len(FIRST)) == FIRST
                pieces += [(p, a, min(n, a + self.target)) for a in range(0, n, self.target)] if can_be_cut else [(p, 0, n)]
            else:
                pieces.append((p, 0, n))
        out, at, held = [], [], 0
        for p, a, b in pieces:
            if at and held + b - a > self.target:
                out.append(_Files(at))
                at, held = [], 0
            at.append((p, a, b))
            held += b - a
        return [*out, _Files(at)] if at else out or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path) if partition.files else (None, None)

        def every() -> Iterator[tuple[dict, int]]:
            for path, start, end in partition.files:
                with store.open_input_file(path) as raw:
                    plain = _Raw(raw)
                    yield from self.rows(io.BufferedReader(plain, self.buffer), start, end)
                    self.bytes_read += plain.bytes_read

        yield from self.batches(every())

    def batches(self, rows: Iterator[tuple[dict, int]]) -> Iterator[pa.RecordBatch]:
        """Arrow batches of some 8 MB; a longer record has its own."""
        from pyspark.sql.pandas.types import to_arrow_type

        schema = pa.schema([(c, to_arrow_type(t)) for c, t in zip(self.columns, self.types)])
        some, held = [], 0
        for row, size in rows:
            some.append(row)
            held += size + 200
            if held > 8 << 20:
                yield pa.RecordBatch.from_pylist(some, schema)
                some, held = [], 0
        yield pa.RecordBatch.from_pylist(some, schema)

    def rows(self, file, start: int, end: int) -> Iterator[tuple[dict, int]]:
        """The records that begin in a range of a file and pass, and the size of their payload."""
        head = file.read(len(FIRST))
        file.seek(0)
        if head == FIRST:
            yield from self.hop(file, start, end)
        else:  # such files are never cut
            yield from self.walk(gzip.GzipFile(fileobj=file) if head[:2] == b"\x1f\x8b" else file)

    def _parsed(self, lines: list[bytes]) -> tuple[dict, dict, bool]:
        """The header, the row so far, and whether the record passes."""
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        head, row = {}, {}
        for line in lines[1:]:
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        for column, key, kind in HEADERS:
            v = head.get(key.lower())
            row[column] = int(v) if v is not None and kind == "long" else v
        return head, row, all(row[c] in values for c, values in self.wanted)

    def _row(self, head: dict, row: dict, block: bytes | None) -> dict:
        if block is not None:
            if len(block) != int(head["content-length"]):
                raise ValueError("a WARC record is cut short")
            row["payload"] = block.partition(b"\r\n\r\n")[2] if "application/http" in head.get("content-type", "") else block
        return {c: row.get(c) for c in self.columns}

    def hop(self, file, start: int, end: int) -> Iterator[tuple[dict, int]]:
        """Records in members with skip lengths: no more is inflated than is asked for."""
        at, want_payload = _first_member(file, start, end), "payload" in self.columns
        while 0 <= at < end:
            file.seek(at)
            begin = file.read(HEAD)
            if not begin.startswith(FIRST):
                raise ValueError("a WARC record is cut short")
            size, plain = struct.unpack("<II", begin[-8:])
            left, tool, data = size - HEAD - 8, zlib.decompressobj(-15), b""
            while b"\r\n\r\n" not in data and left:
                part = file.read(min(left, 1024))
                left -= len(part)
                data += tool.decompress(part)
                if not part:
                    raise ValueError("a WARC record is cut short")
            lines, _, rest = data.partition(b"\r\n\r\n")
            head, row, passes = self._parsed(lines.split(b"\r\n"))
            length = int(head["content-length"])
            at, missing = at + size, length + 4 - (plain - len(lines) - 4)  # what the record's other members hold
            block = None
            if passes and want_payload:
                parts = [rest, tool.decompress(file.read(left))]
                while missing > 0:
                    file.seek(at)
                    size, plain = struct.unpack("<II", file.read(HEAD)[-8:])
                    parts.append(zlib.decompress(file.read(size - HEAD - 8), -15))
                    at, missing = at + size, missing - plain
                block = b"".join(parts)[:length]
            else:
                self.skipped += 1
                while missing > 0:
                    file.seek(at)
                    size, plain = struct.unpack("<II", file.read(HEAD)[-8:])
                    at, missing = at + size, missing - plain
            if passes:
                yield self._row(head, row, block), length if block is not None else 0

    def walk(self, file) -> Iterator[tuple[dict, int]]:
        """Records of a plain file, or of a gzipped one without skip lengths."""
        while True:
            first = file.readline()
            if not first:
                return
            if not first.strip():
                continue
            lines = [first]
            while (line := file.readline()).strip():
                lines.append(line)
            head, row, passes = self._parsed(lines)
            length, block = int(head["content-length"]), None
            if passes and "payload" in self.columns:
                block = file.read(length)
            else:
                file.seek(length, 1)
                self.skipped += 1
            if passes:
                yield self._row(head, row, block), length if block is not None else 0


def _first_member(file, start: int, end: int) -> int:
    """Where the first record at or after a place begins, -1 if none does before the end."""
    at, kept = start, b""
    while at - len(kept) < end:
        file.seek(at)
        part = file.read(1 << 16)
        if not part:
            return -1
        i = (kept + part).find(FIRST)
        if i >= 0:
            return at - len(kept) + i
        kept, at = (kept + part)[-len(FIRST) + 1 :], at + len(part)
    return -1


class _Raw(io.RawIOBase):
    """A pyarrow file as one that can be buffered; skipping within the buffer costs nothing."""

    def __init__(self, file):
        self.file, self.bytes_read = file, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.file.seek(offset, whence)
        return self.file.tell()

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, b) -> int:
        got = self.file.read(len(b))
        b[: len(got)] = got
        self.bytes_read += len(got)
        return len(got)


class WarcDataSource(DataSource):
    """``spark.read.format("warc")``. A schema without payload reads headers only."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WarcReader(schema, {k.lower(): v for k, v in self.options.items()})


def _known(path: str) -> bool:
    """Whether the data source's own file systems can open a path."""
    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, OSError):
        return False
    return True


def _from_memory(schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WarcReader(schema, {})
        for batch in batches:
            for x in batch.column(0):
                yield from reader.batches(reader.rows(io.BytesIO(x.as_py()), 0, len(x.as_buffer())))

    return run


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The records of a folder of WARC files."""
    if not _known(path):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
        kind = T.StructType.fromDDL(schema or SCHEMA)
        return common.map_arrow(files, _from_memory(kind), kind)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    ship(spark)
    spark.dataSource.register(WarcDataSource)
    reader = spark.read.format("warc")
    return (reader.schema(schema) if schema else reader).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder, read these back, one row for each page."""
    spark = pages.sparkSession
    path = common.fresh_path(spark, "warc")
    write(pages, path)
    back = read(spark, path)
    revisit = F.col("warc_type") == "revisit"
    return back.select(
        "page_id",
        F.when(revisit, F.col("payload_length")).otherwise(F.octet_length("payload")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("payload_digest", "^sha256:", "")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.col("refers_to_page").alias("refers_to"),
    )
