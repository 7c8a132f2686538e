"""Web archives (WARC) as a PySpark Python data source, with a writer.

Reading: files are planned into partitions by size; filters on record type, ids, digests and the target URI are pushed
down and checked on the headers, before anything of the payload is inflated; payloads that are filtered out or not asked
for are skipped by seeking, where the compressed member says how long it is (an 'SL' extra field, which the writer
adds), else by reading over them. Writing: one gzip member per record, in files of bounded size, moved into place when
the whole job commits.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringContains, StringStartsWith, WriterCommitMessage

from tapeloom.llm.common import materialise, scratch_path, small

SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload", T.BinaryType()),
    ]
)
#: The header behind each column that filters are pushed down on.
_HEADER = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
_WRITTEN = ("record_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to", "payload")
_CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f\u2028\u2029]")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field holds its own compressed and uncompressed lengths, 64 bits each."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    total = 10 + 2 + 20 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 20) + b"SL" + struct.pack("<HQQ", 16, total, len(record))
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def header_value(text: str) -> str:
    """A value that stays on its line: control characters are written as % and two hexadecimal digits."""
    return _CONTROL.sub(lambda m: f"%{ord(m.group()):02X}", text)


def record(kind: str, record_id: str, uri: str, digest: str, payload: bytes, refers_to: str | None = None, payload_length: int | None = None) -> bytes:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", _DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload) if payload_length is None else payload_length))]
    if refers_to is not None:
        fields += [("WARC-Refers-To", refers_to), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    block = _HTTP % len(payload) + payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "\r\n".join(["WARC/1.1", *(f"{k}: {header_value(v)}" for k, v in fields)]).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Stream:
    """A file as a run of bytes, inflated member by member; `drop` leaves the rest of a member unread. A file that ends
    inside a member, a header or a payload raises ValueError."""

    def __init__(self, file, compressed: bool):
        self.file, self.compressed = file, compressed
        self.buffer, self.z, self.next_at, self.pending = bytearray(), None, None, b""
        file.seek(0, 2)
        self.size = file.tell()
        file.seek(0)

    def _cut(self):
        return ValueError(f"the archive ends at byte {self.size}, inside a record")

    def _more(self) -> bool:
        """Read on; False at the end of the file."""
        if not self.compressed:
            got = self.file.read(1 << 16)
            self.buffer += got
            return bool(got)
        while True:
            if self.z is None and not self._open():
                return False
            raw = self.pending or self.file.read(1 << 15)
            self.pending = b""
            if not raw:
                raise self._cut()
            self.buffer += self.z.decompress(raw)
            if self.z.eof:
                self.file.seek(self.file.tell() - len(self.z.unused_data))
                self.z = None
                return True
            if self.buffer:
                return True

    def _open(self) -> bool:
        start = self.file.tell()
        head = self.file.read(32)
        if not head:
            return False
        self.next_at = None
        if len(head) == 32 and head[3] & 4 and head[12:16] == b"SL\x10\0":
            self.next_at = start + struct.unpack("<Q", head[16:24])[0]
        self.z, self.pending = zlib.decompressobj(31), head
        return True

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                raise self._cut()
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise self._cut()
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def drop(self, n: int) -> None:
        """Pass over n bytes; inside a member of known length that ends with them, by seeking."""
        if self.compressed and self.next_at is not None and self.z is not None:
            if self.next_at > self.size:
                raise self._cut()
            self.file.seek(self.next_at)
            self.buffer, self.z, self.pending = bytearray(), None, b""
            return
        if not self.compressed and len(self.buffer) < n:
            to = self.file.tell() + n - len(self.buffer)
            if to > self.size:
                raise self._cut()
            self.file.seek(to)
            self.buffer = bytearray()
            return
        while n > 0:
            n -= len(self.take(min(n, 1 << 16)))

    def between(self) -> bool:
        """Pass over the line ends between records; False at the end of the file."""
        while True:
            while self.buffer[:2] == b"\r\n":
                del self.buffer[:2]
            if len(self.buffer) >= 2:
                return True
            if not self._more():
                if self.buffer:
                    raise self._cut()
                return False


def records(file, compressed: bool, wanted=lambda h: True, payloads: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers by lower-case name, payload or None) of the records that `wanted` says yes to on their headers. A file that
    ends inside a record, or a record without a length, raises ValueError."""
    s = _Stream(file, compressed)
    while s.between():
        headers = {}
        for line in s.until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        if not headers.get("content-length", "").isdigit():
            raise ValueError("a record without a Content-Length")
        length, asked = int(headers["content-length"]), wanted(headers)
        if not asked or not payloads:
            s.drop(length)
            if asked:
                yield headers, None
            continue
        block = s.take(length)
        if headers.get("content-type", "").startswith("application/http"):
            block = block.partition(b"\r\n\r\n")[2]
        yield headers, block


def _column(headers: dict[str, str], name: str) -> str | None:
    value = headers.get(_HEADER[name])
    return value.removeprefix("sha1:") if value and name == "payload_digest" else value


@dataclass
class Files(InputPartition):
    paths: list = field(default_factory=list)


class WarcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options):
        self.schema, self.path = schema, options["path"]
        self.names = schema.names
        self.split = int(options.get("splitbytes", 64 << 20))
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kind = {EqualTo: "eq", In: "in", StringStartsWith: "starts", StringContains: "has", IsNotNull: "set"}.get(type(f))
            if name in _HEADER and kind:
                self.tests.append((kind, name, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        fs, root = pafs.FileSystem.from_uri(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if fs.get_file_info(root).type == pafs.FileType.Directory else [fs.get_file_info(root)]
        files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith((".warc", ".warc.gz")) and "/_temporary/" not in f.path)
        out, size = [], 0
        for path, n in files:
            if not out or size + n > self.split:
                out.append(Files(paths=[]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out or [Files(paths=[])]

    def wanted(self, headers: dict[str, str]) -> bool:
        for kind, name, value in self.tests:
            got = _column(headers, name)
            if got is None or kind == "eq" and got != value or kind == "in" and got not in value or kind == "starts" and not got.startswith(value) or kind == "has" and value not in got:
                return False
        return True

    def read(self, partition):
        fs, _ = pafs.FileSystem.from_uri(self.path)
        payloads = "payload" in self.names
        types = {"payload_bytes": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in self.names], names=self.names)

        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                for headers, payload in records(raw, path.endswith(".gz"), self.wanted, payloads or self.verify):
                    if self.verify and headers.get("warc-type") == "response" and base32_sha1(payload) != _column(headers, "payload_digest"):
                        raise ValueError(f"payload of {headers.get('warc-record-id')} in {path} differs from its digest")
                    row = {n: _column(headers, n) for n in _HEADER if n in self.names}
                    row["payload_bytes"] = int(headers["x-payload-length"]) if "x-payload-length" in headers else None if payload is None else len(payload)
                    row["headers"] = list(headers.items())
                    row["payload"] = payload
                    rows.append(row)
                    size += len(payload or b"") * payloads + 500
                    if size > 4 << 20:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    names: list


class WarcWriter(DataSourceArrowWriter):
    """Arrow batches of record_id, record_type, target_uri, payload_digest, payload_bytes, refers_to and payload; file names
    are new for every attempt, so that a task that runs twice leaves nothing behind."""

    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("filebytes", 64 << 20))

    def write(self, iterator):
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(f"{root}/_temporary", recursive=True)
        done, out, size = [], None, 0
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in _WRITTEN]
            for a in range(0, batch.num_rows, 256):
                for row in zip(*(c.slice(a, 256).to_pylist() for c in columns), strict=True):
                    if out is None or size > self.most:
                        if out:
                            out.close()
                        done.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{root}/_temporary/{done[-1]}", compression=None), 0
                    record_id, kind, uri, digest, length, refers_to, payload = row
                    data = member(record(kind, record_id, uri or "", digest, payload or b"", refers_to, length))
                    out.write(data)
                    size += len(data)
        if out:
            out.close()
        return Written(names=done)

    def commit(self, messages):
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        for m in messages:
            for name in m.names if m else ():
                fs.move(f"{root}/_temporary/{name}", f"{root}/{name}")

    def abort(self, messages):
        fs, root = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            for name in m.names if m else ():
                fs.delete_file(f"{root}/_temporary/{name}")


class WarcDataSource(DataSource):
    """format("warc"). Options: path; splitBytes (bytes of a read partition), verify (check payloads against digests),
    fileBytes (bytes of a written file). Give .schema(...) without payload to skip all payloads."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def page_records(pages: DataFrame, min_payload: int = 0, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One record per row: the row with the largest id among those of one payload (of min_payload bytes at least) is the
    response and the others revisit it; smaller payloads are responses all. Null html is an empty payload. If rows with
    that largest id repeat they are all responses. Rows without an id revisit a row that has one, else are responses.
    Null urls are empty; control characters in urls are written as % and two digits, so that no url breaks a header.

    Payloads are compared by their SHA-1; only digests that occur more than once are joined back.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).cast("string").alias("target_uri"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    n = F.octet_length("payload").cast("long")
    groups = rows.where(n >= min_payload).groupBy("sha").agg(F.max("id").alias("top"), F.count("*").alias("copies")).where("copies > 1 and top is not null").select("sha", "top")
    rows = rows.join(small(materialise(groups, "copies")), "sha", "left")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    again = (n >= min_payload) & F.col("top").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("top")))
    digits = F.array(*(F.lit(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))
    five = lambda i: F.conv(F.substring("sha", 5 * i + 1, 5), 16, 10).cast("int")  # noqa: E731  20 bits are four base-32 digits
    base32 = F.concat(*(F.element_at(digits, F.shiftright(five(i), s).bitwiseAND(31) + 1) for i in range(8) for s in (15, 10, 5, 0)))
    return rows.select(urn(F.col("id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", base32.alias("payload_digest"), n.alias("payload_bytes"), F.when(again, urn(F.col("top"))).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"))


def archive(pages: DataFrame, path: str | None = None, min_payload: int = 0, **columns) -> str:
    """Write a record per row of pages to WARC files under path (by default a new shared scratch folder)."""
    spark = pages.sparkSession
    register(spark)
    path = path or scratch_path(spark, "warc")
    page_records(pages, min_payload, **columns).write.format("warc").mode("append").option("path", path).save()
    return path


def read_archive(spark: SparkSession, path: str, columns: list[str] | None = None, verify: bool = False) -> DataFrame:
    """The records under path; only the named columns, and no payloads unless asked for."""
    register(spark)
    names = columns or [n for n in SCHEMA.names if n != "payload"]
    return spark.read.format("warc").schema(T.StructType([SCHEMA[n] for n in names])).option("path", path).option("verify", str(verify).lower()).load()


def page_id_of(column):
    """The id in a record id that `page_records` made."""
    return F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def from_bytes(data: bytes) -> list[tuple[dict[str, str], bytes | None]]:
    """All records of one archive in memory (for small ones)."""
    return list(records(io.BytesIO(data), data[:2] == b"\x1f\x8b"))
