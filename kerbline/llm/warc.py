"""WARC archives as a Python data source of Spark, for reading and writing.

``spark.read.format("warc").load(folder)`` plans one partition per file (the writer rolls files at
``rollBytes``), takes over equality and IN predicates on record_type, record_id, target_uri and
payload_digest, parses a record's headers first and decodes its block only where the predicates hold
and a payload is wanted (option ``payload``, default true). Each record is a gzip member whose extra field
"sl" has its compressed and plain lengths, as the format's annex on compression proposes; an unwanted
record is skipped by it without decompression. Files without it, or plain ones, are read through.

Files are opened through pyarrow's file systems, so a folder may be a URI of a shared store.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from .common import spread_join, staged

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
SCHEMA_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
ROLL = 64 << 20
ROWS, BYTES = 1000, 16 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
HEADER_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest"}


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes) -> bytes:
    """``data`` as a gzip member with the "sl" extra field."""
    z = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    whole = 10 + 14 - 2 + 2 + len(body) + 8  # header, XLEN and field, deflated data, trailer
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, whole, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _line(value: str) -> str:
    """A header's value on one line: carriage returns, newlines and percent signs are percent-encoded."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(kind: str, record_id: str, uri: str | None, date: str, payload: bytes | None, known: tuple[str, int] | None = None, refers_to: str | None = None) -> bytes:
    """A record's bytes; a revisit has no payload but its digest and length in ``known``."""
    name, size = known if payload is None else (digest(payload), len(payload))
    block = HTTP + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{name}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_line(uri)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode(errors="replace") + block + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in head.decode(errors="replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs if k}


class _Plain:
    """Reads through one stream of records, gzip members or plain."""

    def __init__(self, stream, wanted):
        self.stream, self.wanted, self.buffer, self.at, self.skipped = stream, wanted, b"", 0, 0

    def _more(self, n: int) -> bool:
        """Whether ``n`` bytes from ``at`` on are in the buffer; it moves on only where it must be filled."""
        while len(self.buffer) - self.at < n:
            got = self.stream.read(max(1 << 20, n))
            if not got:
                return False
            self.buffer, self.at = self.buffer[self.at :] + got, 0
        return True

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while self._more(10):
            if self.buffer.startswith(b"\x1f\x8b\x08", self.at):
                yield from self._member()
            else:
                yield from self._bare()

    def _member(self):
        size = None
        if self.buffer[self.at + 3] & 4 and self._more(24) and self.buffer[self.at + 12 : self.at + 14] == b"sl":
            size = struct.unpack_from("<I", self.buffer, self.at + 16)[0]
        z, data, fed = zlib.decompressobj(31), b"", 0

        def inflated(n: int) -> bytes:
            nonlocal fed
            if not self._more(fed + 1):
                raise EOFError("a record is cut short")
            part = self.buffer[self.at + fed : self.at + fed + n]
            fed += len(part)
            return z.decompress(part)

        while b"\r\n\r\n" not in data and not z.eof:
            data += inflated(512)
        head, _, rest = data.partition(b"\r\n\r\n")
        headers = _headers(head)
        if size is not None and not self.wanted(headers):
            if not self._more(size):
                raise EOFError("a record is cut short")
            self.at, self.skipped = self.at + size, self.skipped + 1
            return
        parts = [rest]
        while not z.eof:
            parts.append(inflated(1 << 16))
        self.at += fed - len(z.unused_data)
        if self.wanted(headers):
            yield headers, b"".join(parts)[: int(headers["content-length"])]

    def _bare(self):
        while (end := self.buffer.find(b"\r\n\r\n", self.at)) < 0:
            if not self._more(len(self.buffer) - self.at + 1):
                raise EOFError("a record ends within its headers")
        headers = _headers(self.buffer[self.at : end])
        self.at, n = end + 4, int(headers["content-length"])
        if not self._more(n):
            raise EOFError("a record is cut short")
        block = self.buffer[self.at : self.at + n]
        self.at += n
        if self._more(4) and self.buffer.startswith(b"\r\n\r\n", self.at):
            self.at += 4
        if self.wanted(headers):
            yield headers, block


@dataclass
class FilePart(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.payload, self.verify = options["path"], options.get("payload", "true") == "true", options.get("verify", "false") == "true"
        self.wants: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in HEADER_OF:
                self.wants.append((column, (f.value,) if isinstance(f, EqualTo) else tuple(f.value)))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, root = _fs(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=False))
        return [FilePart(x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and x.base_name.endswith((".warc", ".warc.gz")) and not x.base_name.startswith((".", "_"))] or [FilePart("")]

    def _wanted(self, headers: dict[str, str]) -> bool:
        return all(_column(headers, c) in values for c, values in self.wants)

    def read(self, part: FilePart):
        """Record batches of at most ``ROWS`` records or about ``BYTES`` of payload."""
        rows, held = [], 0
        for row in self._rows(part) if part.path else ():
            rows.append(row)
            held += len(row[-1] or b"")
            if len(rows) == ROWS or held >= BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _rows(self, part: FilePart) -> Iterator[tuple]:
        with _fs(self.path)[0].open_input_stream(part.path, compression=None) as stream:
            for h, block in _Plain(stream, self._wanted).records():
                payload = None
                if h.get("warc-type") == "response" and (self.payload or self.verify):
                    payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
                    if self.verify and (digest(payload), len(payload)) != (_column(h, "payload_digest"), int(h.get("x-payload-length", len(payload)))):
                        raise ValueError(f"{h.get('warc-record-id')}: its payload does not have the digest and length of its headers")
                size = h.get("x-payload-length")
                yield (*(_column(h, c) for c in ("record_type", "record_id", "target_uri")), _bare_id(h.get("warc-refers-to")), _column(h, "payload_digest"), int(size) if size else len(payload) if payload is not None else None, payload if self.payload else None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], SCHEMA_NAMES)


def _bare_id(value: str | None) -> str | None:
    return value.strip("<>") if value is not None else None


def _column(headers: dict[str, str], column: str) -> str | None:
    value = headers.get(HEADER_OF[column])
    if value is None:
        return None
    return {"record_id": _bare_id, "target_uri": _unline, "payload_digest": lambda v: v.rpartition(":")[2]}.get(column, str)(value)


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class WarcWriter(DataSourceWriter):
    """Rows in ``SCHEMA`` to files that get their names when the whole job commits: a lost task leaves none that readers list, and what it has left then goes."""

    def __init__(self, options: dict[str, str]):
        self.job = uuid.uuid4().hex
        self.path, self.roll, self.date = options["path"], int(options.get("rollbytes", ROLL)), options.get("date", "1970-01-01T00:00:00Z")

    def write(self, rows):
        system, root = _fs(self.path)
        system.create_dir(root, recursive=True)
        paths, out = [], None
        for r in rows:
            payload = None if r.record_type == "revisit" else bytes(r.payload or b"")
            data = member(record(r.record_type, r.record_id, r.target_uri, self.date, payload, (r.payload_digest, r.payload_bytes), r.refers_to))
            if out is None or out.tell() + len(data) > self.roll > 0 < out.tell():
                if out is not None:
                    out.close()
                paths.append(f"{root}/_{self.job}-{uuid.uuid4().hex}.warc.gz")
                out = system.open_output_stream(paths[-1], compression=None)
            out.write(data)
        if out is not None:
            out.close()
        return Written(paths)

    def commit(self, messages):
        system, root = _fs(self.path)
        system.create_dir(root, recursive=True)
        for m in messages:
            for p in m.paths if m else ():
                system.move(p, p.replace("/_", "/part-"))
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self) -> None:
        """Files of this job's tasks that failed or ran twice go; other jobs' stay."""
        from pyarrow import fs

        system, root = _fs(self.path)
        for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(f"_{self.job}-"):
                system.delete_file(f.path)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes format "warc" known to the session and lets Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive(pages: DataFrame, folder: str, least: int = 0) -> None:
    """Writes a record per row of (page_id, url, html) to ``folder``.

    Of the pages with equal payloads of at least ``least`` bytes, that with the smallest page_id is a response, the
    others are revisits of it; shorter ones and rows without an id are responses. Null html is empty.
    Repeated rows of a response are responses too; a page_id with several payloads gives a record for each. Only ids and digests are grouped: the one
    shuffle that carries html is dealt by page_id.
    """
    register(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.cast("binary").alias("payload"))
    ids = pages.select("page_id", "url", F.sha1("payload").alias("sha"), F.length("payload").cast("long").alias("payload_bytes"))
    firsts = ids.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = staged(firsts)
    again = spread_join(ids.where(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= least)), firsts.select("sha", "first"), ["sha"], firsts.select("sha", "n"), F.col("page_id"))
    again = again.where(F.col("page_id") != F.col("first"))
    sha = F.to_binary("sha", F.lit("hex"))
    again = again.select(F.lit("revisit").alias("record_type"), _name("page_id"), F.col("url").alias("target_uri"), _name("first").alias("refers_to"), _base32(sha).alias("payload_digest"), "payload_bytes", F.lit(None).cast("binary").alias("payload"))
    keys = firsts.select(F.col("first").alias("page_id"), "sha")
    whole = pages.withColumn("sha", F.sha1("payload")).join(keys, ["page_id", "sha"], "left_semi").drop("sha").unionByName(pages.where(F.col("page_id").isNull() | (F.length("payload") < least)))
    none = F.lit(None).cast("string")
    whole = whole.select(F.lit("response").alias("record_type"), _name("page_id"), F.col("url").alias("target_uri"), none.alias("refers_to"), none.alias("payload_digest"), F.lit(None).cast("long").alias("payload_bytes"), "payload")
    order = SCHEMA_NAMES
    whole.select(*order).unionByName(again.select(*order)).write.format("warc").mode("append").save(folder)


def _name(column: str):
    return F.concat(F.lit("urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit(""))).alias("record_id")


def _base32(sha):
    """Base32 of 20 bytes by built-in functions: 160 bits in 32 fives."""
    bits = F.concat(*[F.lpad(F.conv(F.substring(F.hex(sha), 5 * i + 1, 5), 16, 2), 20, "0") for i in range(8)])
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(*[F.substring(letters, F.conv(F.substring(bits, 5 * i + 1, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(32)])


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to from the archives; responses' payloads are checked against their headers.

    Either kind is asked for by its type, which the source takes over: revisits are told by their headers alone, and the blocks of all other records are skipped.
    """
    register(spark)
    load = lambda kind, **options: spark.read.format("warc").options(payload="false", **options).load(folder).where(F.col("record_type") == kind)
    number = lambda c: F.nullif(F.regexp_extract(c, r"^urn:page:(-?\d*)$", 1), F.lit("")).cast("long")
    got = load("response", verify="true").unionByName(load("revisit"))
    return got.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


#: DuckDB's own computation of what ``archive`` and ``read_back`` give.
SQL = """
WITH h AS (SELECT CAST(page_id AS BIGINT) AS page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS sha FROM pages),
f AS (SELECT sha, min(page_id) AS first FROM h GROUP BY sha)
SELECT page_id, payload_bytes,
 list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(sha, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS BIGINT), 1) FOR i IN range(32)], 'string_agg', '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM h JOIN f USING (sha)
"""
