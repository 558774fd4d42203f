"""WARC archives as a Python data source, read and written, and the archiving of pages.

Reading. An archive's folder has index files that name its committed files and places in them
where a record starts; a partition is a run of such places, small files share one. Files without
an index are partitions as they are. Predicates on the record type and other headers are pushed
down to the source, by ``read`` or as Spark's own filters. Of each record the headers are read
first. If they fail a predicate, or no payload is asked for, the body is passed over: in a
gzip member by the length that the writer left in its extra field, in a plain file by
Content-Length, else by inflating without keeping it.

Writing. Each task writes files of its own name. Only the driver's commit makes an index of
those of the tasks that count, so repeated or lost tasks leave nothing that is read.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as S
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evimap.llm.common import kept_table, shared_folder

FORMAT = "warc_archive"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: bytes of an archive that one partition reads, bytes after which a task begins a new file, bytes of payload in an Arrow batch
SPLIT_BYTES, FILE_BYTES, BATCH_BYTES = 32 << 20, 1 << 30, 4 << 20
HEAD = 4096
# fixed values: the format's version, line end, header names and the id of the extra field with a member's lengths
VERSION, EOL, BLANK = b"WARC/1.1", b"\r\n", b"\r\n\r\n"
FIELDS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to",
          "payload_digest": "warc-payload-digest", "content_type": "content-type"}
SKIP_LENGTHS = b"sl"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = T.MapType(T.StringType(), T.StringType())
SCHEMA = T.StructType([*(T.StructField(c, T.StringType()) for c in FIELDS), T.StructField("length", T.LongType()), T.StructField("headers", NAMES),
                       T.StructField("http_headers", NAMES), T.StructField("payload", T.BinaryType())])
ARROW = pa.schema([*(pa.field(c, pa.string()) for c in FIELDS), pa.field("length", pa.int64()), pa.field("headers", pa.map_(pa.string(), pa.string())),
                   pa.field("http_headers", pa.map_(pa.string(), pa.string())), pa.field("payload", pa.binary())])
WRITTEN = ("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload", "payload_bytes")


def _headers(block: bytes) -> dict[str, str]:
    """Names (lower-cased) and values of header lines after the first; a line that starts with white space goes on with the last."""
    out, name = {}, None
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


@dataclass
class Part(S.InputPartition):
    """Runs of records: (path, first byte, byte after the last one); the end is None for a whole file."""

    runs: list[tuple[str, int, int | None]]


# predicates of a header's value; of a missing value only the tests for null are true
TESTS = {
    "=": lambda v, x: v == x, "in": lambda v, x: v in x, "not in": lambda v, x: v not in x, "starts with": lambda v, x: v.startswith(x),
    "ends with": lambda v, x: v.endswith(x), "contains": lambda v, x: x in v,
}


def _passes(name: str, test: str, asked, headers: dict[str, str]) -> bool:
    value = headers.get(FIELDS.get(name, name.lower()))
    if test in ("null", "not null"):
        return (value is None) == (test == "null")
    return value is not None and TESTS[test](value, asked)


def predicate(f: S.Filter) -> tuple | None:
    """A filter of Spark's as (header column, test, value), or None where the source can't apply it."""
    of = f.child if isinstance(f, S.Not) else f
    if len(of.attribute) != 1 or of.attribute[0] not in FIELDS:
        return None
    if isinstance(f, S.Not):
        named = {S.EqualTo: ("not in", [getattr(of, "value", None)]), S.In: ("not in", getattr(of, "value", None)), S.IsNull: ("not null", None), S.IsNotNull: ("null", None)}
    else:
        value = getattr(of, "value", None)
        named = {S.EqualTo: ("=", value), S.In: ("in", value), S.StringStartsWith: ("starts with", value), S.StringEndsWith: ("ends with", value),
                 S.StringContains: ("contains", value), S.IsNull: ("null", None), S.IsNotNull: ("not null", None)}
    found = named.get(type(of))
    return found and (of.attribute[0], *found)


class WarcReader(S.DataSourceReader):
    def __init__(self, options):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() == "true"
        self.split_bytes, self.tests = int(options.get("splitbytes", SPLIT_BYTES)), [tuple(x) for x in json.loads(options.get("where", "[]"))]

    def partitions(self) -> list[Part]:
        system, root = _file_system(self.path)
        files = [x for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file] if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        runs = []
        indexes = [x for x in files if x.base_name.startswith("_index-")]
        if indexes:
            for x in indexes:
                with system.open_input_stream(x.path) as f:
                    for name, size, places in json.loads(f.read()):
                        at = f"{x.path.rsplit('/', 1)[0]}/{name}"
                        runs += [(at, a, b) for a, b in zip(places, [*places[1:], size], strict=True)]
        else:
            runs = [(x.path, 0, None) for x in files if x.base_name.endswith((".warc", ".warc.gz"))]
        sizes = {x.path: x.size for x in files}
        out, room = [], 0
        for run in sorted(runs, key=lambda r: r[:2]):
            size = (run[2] or sizes[run[0]]) - run[1]
            if not out or size > room:
                out.append(Part([]))
                room = self.split_bytes
            out[-1].runs.append(run)
            room -= size
        return out or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(self.path)
        rows, size = [], 0
        for path, start, end in partition.runs:
            with system.open_input_file(path) as f:
                for row in self._records(f, start, f.size() if end is None else end):
                    rows.append(row)
                    size += len(row[-1] or b"") + HEAD
                    if size > BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    def _records(self, f, at: int, end: int) -> Iterator[tuple]:
        while at < end:
            f.seek(at)
            head = f.read(HEAD)
            length = skip_length(head)
            if length is None:  # no lengths of members: records one after another
                f.seek(at)
                packed = head[:2] == b"\x1f\x8b"
                yield from self._stream(gzip.GzipFile(fileobj=f) if packed else io.BufferedReader(f), None if packed else end)
                return
            member = zlib.decompressobj(31)
            data = member.decompress(head)
            while BLANK not in data and not member.eof and (more := f.read(HEAD)):
                data += member.decompress(more)
            top, _, body = data.partition(BLANK)
            headers = _headers(top)
            if self._wanted(headers):
                if not self.payload:
                    while BLANK not in body and not member.eof and headers.get("content-type", "").startswith("application/http") and (more := f.read(HEAD)):
                        body += member.decompress(more)
                elif not member.eof:
                    body += member.decompress(f.read(at + length - f.tell()))
                yield self._row(headers, body)
            at += length

    def _stream(self, f, end: int | None) -> Iterator[tuple]:
        """Records of a plain file, or of compressed members without lengths."""
        while end is None or f.tell() < end:
            line = f.readline()
            if not line:
                return
            if not line.strip():
                continue
            top = [line]
            while (line := f.readline()) and line not in (EOL, b"\n"):
                top.append(line)
            headers = _headers(b"".join(top))
            left = int(headers.get("content-length", 0))
            if self._wanted(headers):
                if self.payload:
                    body, left = f.read(left), 0
                else:
                    body = b""
                    while headers.get("content-type", "").startswith("application/http") and BLANK not in body and left:
                        more = f.read(min(HEAD, left))
                        if not more:
                            break
                        body, left = body + more, left - len(more)
                yield self._row(headers, body)
            f.seek(left, io.SEEK_CUR)

    def _wanted(self, headers: dict[str, str]) -> bool:
        return all(_passes(*t, headers) for t in self.tests)

    def _row(self, headers: dict[str, str], body: bytes) -> tuple:
        length = int(headers.get("content-length", 0))
        body, http = body[:length], None
        if headers.get("content-type", "").startswith("application/http"):
            top, _, body = body.partition(BLANK)
            http = list(_headers(top).items())
        return (*(headers.get(name) for name in FIELDS.values()), length, list(headers.items()), http, body if self.payload else None)


class PushingReader(WarcReader):
    """Takes the filters that Spark pushes down. Spark 4.1.2 keeps a source's last filters for all uses of one load, so each use needs its own."""

    def pushFilters(self, filters: list[S.Filter]) -> Iterator[S.Filter]:
        for f in filters:
            if (found := predicate(f)) is None:
                yield f
            else:
                self.tests.append(found)


def skip_length(head: bytes) -> int | None:
    """The length of a gzip member whose extra field tells it."""
    if len(head) < 12 or head[:3] != b"\x1f\x8b\x08" or not head[3] & 4:
        return None
    extra = head[12 : 12 + struct.unpack("<H", head[10:12])[0]]
    while len(extra) >= 4:
        size = struct.unpack("<H", extra[2:4])[0]
        if extra[:2] == SKIP_LENGTHS and size == 8:
            return struct.unpack("<I", extra[4:8])[0] or None
        extra = extra[4 + size :]
    return None


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field tells its length and that of its content (a value of a table is below 2 GB)."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(packed) + 8
    extra = SKIP_LENGTHS + struct.pack("<HII", 8, size, len(data))
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(headers: list[tuple[str, str | None]], body: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers if v is not None), b"Content-Length: %d" % len(body)]
    return EOL.join(lines) + BLANK + body + BLANK


@dataclass
class Written(S.WriterCommitMessage):
    files: list[tuple[str, int, list[int]]]


class WarcWriter(S.DataSourceArrowWriter):
    """Records of columns WRITTEN; ``payload_bytes`` is what a revisit's HTTP header tells of the payload that it leaves out."""

    def __init__(self, options):
        self.path, self.date, self.level = options["path"], options.get("date", "1970-01-01T00:00:00Z"), int(options.get("level", 6))
        self.split_bytes, self.file_bytes = int(options.get("splitbytes", SPLIT_BYTES)), int(options.get("filebytes", FILE_BYTES))

    def _record(self, record_id, kind, uri, refers_to, digest, payload, size) -> bytes:
        http = EOL.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % size]) + BLANK
        revisit = kind == "revisit"
        headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", self.date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest),
                   ("WARC-Refers-To", refers_to), ("WARC-Profile", IDENTICAL if revisit else None), ("Content-Type", "application/http; msgtype=response")]
        return record(headers, http if revisit else http + payload)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _file_system(self.path)
        files, out, size, places = [], None, 0, []
        for batch in iterator:
            for i in range(batch.num_rows):
                row = [batch.column(c)[i].as_py() for c in WRITTEN]
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, size, places = system.open_output_stream(f"{root}/{name}", compression=None), 0, [0]
                    data = member(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("WARC-Filename", name),
                                          ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"), self.level)
                    out.write(data)
                    size = len(data)
                if size - places[-1] >= self.split_bytes:
                    places.append(size)
                data = member(self._record(*row), self.level)
                out.write(data)
                size += len(data)
                if size >= self.file_bytes:
                    out.close()
                    files.append((name, size, places))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size, places))
        return Written(files)

    def commit(self, messages) -> None:
        system, root = _file_system(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/_index-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages) -> None:
        system, root = _file_system(self.path)
        for name, _, _ in (x for m in messages if m for x in m.files):
            system.delete_file(f"{root}/{name}")


class WarcSource(S.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return (PushingReader if self.options.get("pushdown") == "true" else WarcReader)(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        system, root = _file_system(self.options["path"])
        system.create_dir(root, recursive=True)
        return WarcWriter(self.options)


def read(spark: SparkSession, path: str, where: list[tuple] = (), payload: bool = True, split_bytes: int = SPLIT_BYTES, pushdown: bool = False) -> DataFrame:
    """The records of a file or folder, with columns SCHEMA; without ``payload`` that column is null and no payload is decoded.

    ``where``: predicates (name, test, value) that the source applies to a record's headers; name
    is a header column or any header, a test one of TESTS, ``null`` or ``not null``. They belong to this
    DataFrame, however it is used. With ``pushdown`` the source also takes the filters that
    Spark pushes, if the session has PUSHDOWN on; such a load must serve one filter only
    (see PushingReader). Header names are lower-cased; a repeated name has its last value.
    """
    spark.dataSource.register(WarcSource)
    asked = [[name, test, list(value) if isinstance(value, (tuple, set)) else value] for name, test, value in where]
    told = {"payload": str(payload).lower(), "pushdown": str(pushdown).lower(), "splitbytes": str(split_bytes), "where": json.dumps(asked)}
    return spark.read.format(FORMAT).options(**told).load(path)


def write(records: DataFrame, path: str, **options) -> None:
    """Add ``records`` (columns WRITTEN) to the archive at ``path``. Options: date, level, splitbytes, filebytes."""
    spark = records.sparkSession
    spark.dataSource.register(WarcSource)
    records.select(*WRITTEN).write.format(FORMAT).options(**options).mode("append").save(path)


def base32_sha1(data: Column) -> Column:
    """SHA-1 of bytes in upper-case base32."""
    digits = F.sha1(data)
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for i in range(8):
        number = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [letters.substr(F.shiftright(number, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def record_uri(value: Column) -> Column:
    """``<urn:page:...>`` of an id, ``<urn:nopage>`` of a null one."""
    return F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(value.cast("string")), F.lit(">")), F.lit("<urn:nopage>"))


def page_of(uri: Column, kind: T.DataType) -> Column:
    """The id that ``record_uri`` was made of."""
    return F.when(uri.startswith("<urn:page:"), F.url_decode(F.regexp_extract(uri, "^<urn:page:(.*)>$", 1)).cast(kind))


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, **options) -> None:
    """Write a record of each page, its payload the UTF-8 bytes of ``html`` (null: empty).

    Of records with equal payloads of ``least_bytes`` or more, those of the smallest id are
    responses, others revisit it and hold no payload; smaller ones are all responses, and so
    is a page with a null id, which none refers to. Repeated rows are records of their own.
    Line breaks and other control characters of a url are percent-encoded. An empty table gives an
    archive without records; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url).cast("string").alias("__url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload"))))
    large = rows.where((F.col("payload_bytes") >= least_bytes) & F.col("__id").isNotNull())
    # a row for each payload that two ids have; a written table, so a hot payload's pages can be split in the join
    firsts = large.groupBy("payload_digest", "payload_bytes").agg(F.min("__id").alias("__first"), F.max("__id").alias("__last")).where("__first < __last").drop("__last")
    joined = rows.join(kept_table(firsts, "firsts"), ["payload_digest", "payload_bytes"], "left")
    again = F.coalesce(F.col("__id") > F.col("__first"), F.lit(False))
    plain = F.col("__url")
    for code in (*range(32), 127):
        plain = F.replace(plain, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    safe = F.when(F.col("__url").rlike("[\\x00-\\x1F\\x7F]"), plain).otherwise(F.col("__url"))
    write(joined.select(
        record_uri(F.col("__id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), safe.alias("target_uri"),
        F.when(again, record_uri(F.col("__first"))).alias("refers_to"), "payload_digest", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes"), path, **options)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for an archive, below the shared one."""
    return f"{shared_folder(spark)}/llm-warc-{uuid.uuid4().hex}"
