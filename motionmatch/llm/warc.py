"""WARC archives as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans partitions of whole files up to a target size. Predicates on the record type and on
headers are pushed down and judged on the parsed header block; the rest of an unwanted record is
skipped (sought past; in compressed files past the member, whose length stands in its header), not
decoded. A read whose schema has no ``payload`` never decodes one.

Writing makes one gzip member per record, in files of bounded size with names of their own. Only the
driver's commit lists them in a manifest, and readers of a folder with manifests read what these
list, so that records of lost or repeated tasks are never seen.

Files are opened through ``pyarrow.fs``, which takes local paths and the URIs of object stores.

Cases: null payloads are empty; null headers are left out and read back as null; control characters
in headers are percent-encoded; an empty table gives an archive without records; files without a
manifest are read by name; a record cut off at the end of a file is an error. Repeated rows are
written one by one.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual,
                                    StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage)
from pyspark.sql.types import StructType

from motionmatch.operators.facts import with_facts

SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
          "content_length bigint, payload_length bigint, headers map<string,string>, payload binary")
# Columns and the header each comes from (fixed names of the format).
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
           "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_length": "content-length"}
WRITTEN = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length bigint, payload binary"
DATE = "1970-01-01T00:00:00Z"     # archives of equal rows are equal
FILE_BYTES = 64 << 20
SALTS = 16                       # tasks that copies of one page are dealt to
SPLIT_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
CHUNK = 1 << 16
HEAD = 4096


def store(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


# ---------------------------------------------------------------- reading


class Plain:
    """Bytes of an uncompressed file, from a position."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.size, self.buffer = file, at, size, b""

    def read(self, n: int) -> bytes:
        self.file.seek(self.at)
        data = self.file.read(min(n, self.size - self.at))
        self.at += len(data)
        return data

    def skip(self, n: int) -> None:
        self.at += n


class Member:
    """Bytes of one gzip member. ``length`` is known if the writer put it into the member's header."""

    def __init__(self, file, at: int, size: int):
        self.file, self.begin, self.at, self.size = file, at, at, size
        self.inflater, self.pending, self.length = zlib.decompressobj(31), b"", member_length(file, at)
        self.given = 0

    def read(self, n: int) -> bytes:
        out = []
        while n > 0 and not self.inflater.eof:
            data = self.pending
            if not data:
                self.file.seek(self.at)
                data = self.file.read(min(CHUNK, self.size - self.at))
                self.at += len(data)
                if not data:
                    raise ValueError("a compressed record is cut off")
            part = self.inflater.decompress(data, n)
            self.pending = self.inflater.unconsumed_tail
            out.append(part)
            n -= len(part)
            self.given += len(part)
        return b"".join(out)

    def end(self) -> int:
        """Where the next member begins."""
        if self.length:
            return self.begin + self.length
        while not self.inflater.eof:                      # foreign file: inflate to the end, keep nothing
            self.read(CHUNK)
        return self.at - len(self.inflater.unused_data)


def member_length(file, at: int) -> int | None:
    """Length of the member at a position from its ``sl`` extra field, if there is one."""
    file.seek(at)
    head = file.read(12)
    if len(head) < 12 or head[:2] != b"\x1f\x8b" or not head[3] & 4:
        return None
    extra = file.read(struct.unpack("<H", head[10:12])[0])
    while len(extra) >= 4:
        size = struct.unpack("<H", extra[2:4])[0]
        if extra[:2] == b"sl" and size >= 4:
            return struct.unpack("<I", extra[4:8])[0]
        extra = extra[4 + size:]
    return None


def head_of(source, buffer: bytes) -> tuple[list[str] | None, bytes]:
    """Header lines, and what was read beyond them; None at the end."""
    buffer = buffer.lstrip(b"\r\n")
    while (at := buffer.find(b"\r\n\r\n")) < 0:
        more = source.read(HEAD)
        if not more:
            if buffer.strip(b"\r\n"):
                raise ValueError("a record header is cut off")
            return None, b""
        buffer = (buffer + more).lstrip(b"\r\n")
    return buffer[:at].decode("utf-8", "replace").split("\r\n"), buffer[at + 4:]


def parsed(lines: list[str]) -> dict[str, str]:
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records(file, size: int, compressed: bool, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records whose headers are wanted; the block is empty unless needed."""
    at, plain, rest = 0, Plain(file, 0, size), b""
    while at < size or rest:
        source = Member(file, at, size) if compressed else plain
        lines, rest = head_of(source, b"" if compressed else rest)
        body = source.given - len(rest) if compressed else 0
        if lines is None:
            if compressed:
                at = source.end()
                continue
            return
        headers = parsed(lines)
        length, take = int(headers.get("content-length", 0)), wanted(headers)
        need = length if with_payload else min(length, HEAD)  # the block's own head tells its length
        block = b""
        if take:
            block = rest[:need]
            while len(block) < need and (more := source.read(need - len(block))):
                block += more
            if len(block) < need:
                raise ValueError("a record is cut off")
        if compressed:
            at, rest = source.end(), b""
            if source.given > body + length + 4:
                raise ValueError("a compressed member holds more than one record")
        else:
            used = max(len(block), min(len(rest), length))
            rest = rest[length:] if len(rest) > length else b""
            plain.skip(length - used)
            at = plain.at
        if take:
            yield headers, block


def split_block(headers: dict[str, str], block: bytes) -> tuple[int | None, bytes]:
    """(length of the payload as its own head says, payload). Blocks without such a head are payload."""
    if not headers.get("content-type", "").startswith("application/http"):
        return int(headers.get("content-length", 0)), block
    head, mark, body = block.partition(b"\r\n\r\n")
    found = re.search(rb"\r\ncontent-length:\s*([0-9]+)", head, re.IGNORECASE)
    return int(found[1]) if found else len(body) if mark else None, body


TESTS = {
    EqualTo: lambda have, want: have is not None and have == want,
    EqualNullSafe: lambda have, want: have == want,
    GreaterThan: lambda have, want: have is not None and have > want,
    GreaterThanOrEqual: lambda have, want: have is not None and have >= want,
    LessThan: lambda have, want: have is not None and have < want,
    LessThanOrEqual: lambda have, want: have is not None and have <= want,
    In: lambda have, want: have is not None and have in want,
    IsNull: lambda have, want: have is None,
    IsNotNull: lambda have, want: have is not None,
    StringStartsWith: lambda have, want: have is not None and have.startswith(want),
    StringEndsWith: lambda have, want: have is not None and have.endswith(want),
    StringContains: lambda have, want: have is not None and want in have,
}


def header_value(headers: dict[str, str], name: str):
    value = headers.get(HEADERS[name])
    return int(value) if value is not None and name == "content_length" else value


@dataclass
class Files(InputPartition):
    """Files read by one task: (path, size)."""

    files: list[tuple[str, int]]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.arrow = schema
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):
        """Take the predicates that headers decide; hand back the others."""
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append((f.attribute[0], type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        plans, size = [Files([])], 0
        for path, length in listed_files(self.path):
            if size + length > self.split and plans[-1].files:
                plans.append(Files([]))
                size = 0
            plans[-1].files.append((path, length))
            size += length
        return plans

    def wanted(self, headers: dict[str, str]) -> bool:
        return all(TESTS[kind](header_value(headers, name), value) for name, kind, value in self.tests)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, rows, size = to_arrow_schema(self.arrow), [], 0
        filesystem = store(self.path)[0]
        for path, length in partition.files:
            with filesystem.open_input_file(path) as file:
                for headers, block in records(file, length, path.endswith(".gz"), self.wanted, "payload" in self.names):
                    own, payload = split_block(headers, block)
                    row = {name: header_value(headers, name) for name in HEADERS}
                    row |= {"payload_length": own, "headers": list(headers.items()), "payload": payload}
                    rows.append({n: row[n] for n in self.names})
                    size += len(block) + 500
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def listed_files(folder: str) -> list[tuple[str, int]]:
    """(path, size) of the archives that manifests list, or without any of all archives."""
    from pyarrow import fs

    filesystem, path = store(folder)
    info = filesystem.get_file_info(path)
    if info.is_file:
        return [(path, info.size)]
    found = {x.base_name: x for x in filesystem.get_file_info(fs.FileSelector(path)) if x.is_file}
    manifests = [x for n, x in found.items() if re.fullmatch(r"_manifest-[0-9a-f]+\.json", n)]
    names = {n for n in found if re.search(r"\.warc(\.gz)?$", n)}
    if manifests:
        names = set()
        for x in manifests:
            with filesystem.open_input_stream(x.path) as file:
                names |= set(json.loads(file.read()))
    return sorted((found[n].path, found[n].size) for n in names)


# ---------------------------------------------------------------- writing


def clean(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: quote(m[0]), value)


def record(row: dict) -> bytes:
    """One record. A payload goes behind an HTTP head that tells its full length, also where it is left out."""
    payload = row["payload"] or b""
    length = row["payload_length"] if row["payload_length"] is not None else len(payload)
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length)
    if row["record_type"] != "revisit":
        block += payload
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", DATE),
              ("WARC-Target-URI", row["target_uri"]), ("WARC-Refers-To", row["refers_to"]),
              ("WARC-Payload-Digest", row["payload_digest"]),
              ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
               if row["record_type"] == "revisit" else None),
              ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {clean(v)}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member whose extra field ``sl`` holds its own and the plain length."""
    deflater = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflater.compress(data) + deflater.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
            + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.limit = options["path"], int(options.get("filebytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        filesystem, folder = store(self.path)
        filesystem.create_dir(folder, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= self.limit:
                    if out:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = filesystem.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                data = member(record(row))
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        filesystem, folder = store(self.path)
        filesystem.create_dir(folder, recursive=True)
        names = sorted(n for m in messages if m for n in m.names)
        with filesystem.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}.json") as file:
            file.write(json.dumps(names).encode())

    def abort(self, messages: list[Written | None]) -> None:
        filesystem, folder = store(self.path)
        for m in messages:
            for n in m.names if m else ():
                filesystem.delete_file(f"{folder}/{n}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added to: mode append")
        return WarcWriter(self.options)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_warc(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    return registered(spark).read.format("warc").schema(schema).load(path)


# ---------------------------------------------------------------- pages


def page_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """One record per page. Of equal payloads of at least ``least`` bytes the least page id is the
    response and the others revisit it; rows that repeat that id are responses too.

    Classes of equal payloads are found by digest and least id alone. Payloads then meet one row a
    class, their copies dealt by id and url, so no class is one task's work."""
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumns({
        "digest": F.sha2("payload", 256), "length": F.octet_length("payload").cast("bigint")})
    repeated = base.where(F.col("length") >= least).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    # A page repeated very often sends its copies to as many tasks as there are salts, and Spark may split those.
    return with_facts(base, repeated, ["digest"], ["page_id", "url"], how="left", salts=SALTS).select(
        urn("page_id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"), F.when(again, urn("first")).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.col("length").alias("payload_length"),
        F.when(~again, F.col("payload")).alias("payload"))


def write_pages(pages: DataFrame, path: str) -> None:
    registered(pages.sparkSession)
    page_records(pages).write.format("warc").mode("append").save(path)
