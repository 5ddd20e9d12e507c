"""WARC as a PySpark Python data source: file partitions, header predicates, payloads decoded only where wanted."""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan,
    LessThanOrEqual, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .common import new_path, written

#: Columns of a record. payload_digest is bare lower-case hex SHA-1 of the full payload, refers_to a record id; payload
#: is null for revisits, whose payload_bytes still are those of the full payload.
SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Bytes of an archive from which a task begins another, of files read by one task, of payloads in one batch.
ROLL, PARTITION, BATCH = 512 << 20, 64 << 20, 8 << 20
LEVEL = 4
#: The list of the files that a finished write consists of; others in the folder are left over from lost tasks.
MANIFEST = "_committed.json"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def member(record: bytes) -> bytes:
    """A record as a gzip member whose extra field `SL` has the lengths of its data, so that readers can pass over it."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    extra = b"SL" + struct.pack("<HII", 8, len(body) & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + struct.pack("<I", 0) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _line(name: str, value: str) -> str:
    """A header line; line ends in a value are escaped as in a URI."""
    return f"{name}: {value.replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n"


def record(row: dict) -> bytes:
    """The bytes of one record; a revisit has the response's HTTP header alone."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + (b"" if row["record_type"] == "revisit" else payload)
    head = "WARC/1.1\r\n" + _line("WARC-Type", row["record_type"]) + _line("WARC-Record-ID", f"<{row['record_id']}>")
    if row["target_uri"] is not None:
        head += _line("WARC-Target-URI", row["target_uri"])
    head += _line("WARC-Date", row["date"] or DATE)
    if row["payload_digest"] is not None:
        head += _line("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode())
    if row["refers_to"] is not None:
        head += _line("WARC-Refers-To", f"<{row['refers_to']}>") + _line("WARC-Profile", PROFILE)
    head += _line("Content-Type", "application/http;msgtype=response") + _line("Content-Length", str(len(block)))
    return head.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """One archive a task, or several of ROLL bytes, under names of their own; the commit lists those that count."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, base = _open(self.path)
        system.create_dir(base, recursive=True)
        task, files, out, size = TaskContext.get(), [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= ROLL:
                    if out is not None:
                        out.close()
                    files.append(f"part-{task.partitionId() if task else 0:05d}-{len(files):03d}-{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{base}/{files[-1]}", compression=None), 0
                data = member(record(row))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = _open(self.path)
        system.create_dir(base, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        if not self.overwrite and system.get_file_info(f"{base}/{MANIFEST}").type != fs.FileType.NotFound:
            with system.open_input_stream(f"{base}/{MANIFEST}") as f:
                files = json.loads(f.read())["files"] + files
        with system.open_output_stream(f"{base}/{MANIFEST}.tmp") as f:
            f.write(json.dumps({"files": files}).encode())
        system.move(f"{base}/{MANIFEST}.tmp", f"{base}/{MANIFEST}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = _open(self.path)
        for m in messages:
            for f in m.files if m is not None else ():
                system.delete_file(f"{base}/{f}")


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)


class _Source:
    """A file that is read ahead in pieces and can be passed over."""

    def __init__(self, file):
        self.file, self.data, self.at = file, b"", 0

    def peek(self, n: int) -> bytes:
        if len(self.data) - self.at < n:
            self.data = self.data[self.at :] + self.file.read(max(n, 1 << 16))
            self.at = 0
        return self.data[self.at : self.at + n]

    def skip(self, n: int) -> None:
        inside = min(n, len(self.data) - self.at)
        self.at += inside
        if n > inside:
            self.file.seek(self.file.tell() + n - inside)

    def take(self, n: int) -> bytes:
        while len(self.data) - self.at < n:
            more = self.file.read(max(n - (len(self.data) - self.at), 1 << 16))
            if not more:
                raise ValueError("the archive ends within a record")
            self.data, self.at = self.data[self.at :] + more, 0
        out = self.data[self.at : self.at + n]
        self.at += n
        return out


def headers(text: bytes) -> dict[str, str]:
    """Header lines by lower-case name, without the first line."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in text.decode("utf-8", "replace").split("\r\n")[1:]) if k.strip()}


def records(file, wanted) -> Iterator[tuple[dict[str, str], object]]:
    """Headers and the block (bytes, None where `wanted`, called with the headers, is false) of each record.

    Handles plain archives, and gzip with a member for each record. Blocks that aren't wanted are passed over without
    reading them in plain archives and in members with lengths; other members must be inflated to find their end.
    """
    source = _Source(file)
    while start := source.peek(12):
        if start[:2] != b"\x1f\x8b":
            if start[:1] in b"\r\n":
                source.skip(1)
                continue
            n = 4096
            while b"\r\n\r\n" not in (seen := source.peek(n)):
                if len(seen) < n:
                    raise ValueError("the archive ends within a header")
                n *= 4
            head = source.take(seen.index(b"\r\n\r\n") + 4)
            h = headers(head)
            size = int(h.get("content-length", 0))
            if wanted(h):
                yield h, source.take(size)
            else:
                yield h, None
                source.skip(size)
            continue
        sizes = None
        if start[3] == 4:
            extra = source.peek(12 + struct.unpack("<H", start[10:12])[0])[12:]
            while len(extra) >= 4:
                n = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"SL" and n == 8:
                    sizes = struct.unpack("<II", extra[4:12])
                extra = extra[4 + n :]
        if sizes:
            source.skip(12 + struct.unpack("<H", start[10:12])[0])
            packer, first = zlib.decompressobj(-15), min(sizes[0], 2048)
            data, fed = packer.decompress(source.peek(first)), first
            while b"\r\n\r\n" not in data:
                if fed >= sizes[0]:
                    raise ValueError("a record without a header's end")
                more = min(sizes[0], fed * 4)
                data += packer.decompress(source.peek(more)[fed:more])
                fed = more
            h = headers(data[: data.index(b"\r\n\r\n")])
            if wanted(h):
                body = source.take(sizes[0])
                data += packer.decompress(body[fed:]) + packer.flush()
                if zlib.crc32(data) != struct.unpack("<I", source.take(8)[:4])[0]:
                    raise ValueError("a member's checksum is wrong")
                at = data.index(b"\r\n\r\n") + 4
                yield h, data[at : at + int(h.get("content-length", 0))]
            else:
                source.skip(sizes[0] + 8)
                yield h, None
            continue
        packer, parts = zlib.decompressobj(31), []
        while not packer.eof:
            piece = source.take(min(1 << 16, max(1, len(source.data) - source.at)))
            parts.append(packer.decompress(piece))
            if packer.eof and packer.unused_data:
                source.at -= len(packer.unused_data)
        data = b"".join(parts)
        at = data.index(b"\r\n\r\n") + 4
        h = headers(data[:at])
        yield h, data[at : at + int(h.get("content-length", 0))] if wanted(h) else None


def _bare(value: str | None) -> str | None:
    return None if value is None else value.strip("<>")


def _digest(value: str | None) -> str | None:
    if value is None or not value.lower().startswith("sha1:"):
        return None
    text = value[5:]
    return text.lower() if len(text) == 40 else base64.b32decode(text.upper()).hex()


#: Columns that a record's own header has: predicates on them are decided before its block is read.
_HEADER = {
    "record_type": lambda h: h.get("warc-type"), "record_id": lambda h: _bare(h.get("warc-record-id")), "target_uri": lambda h: h.get("warc-target-uri"),
    "date": lambda h: h.get("warc-date"), "payload_digest": lambda h: _digest(h.get("warc-payload-digest")), "refers_to": lambda h: _bare(h.get("warc-refers-to")),
}


def _holds(f: Filter, value) -> bool:
    if isinstance(f, IsNotNull):
        return value is not None
    if value is None:
        return False
    if isinstance(f, In):
        return value in f.value
    if isinstance(f, StringStartsWith):
        return value.startswith(f.value)
    return {EqualTo: value == f.value, GreaterThan: value > f.value, GreaterThanOrEqual: value >= f.value, LessThan: value < f.value, LessThanOrEqual: value <= f.value}[type(f)]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names, self.filters = path.rstrip("/"), [f.name for f in schema.fields], []
        if unknown := set(self.names) - {x.split()[0] for x in SCHEMA.split(", ")}:
            raise ValueError(f"no such columns in a WARC record: {sorted(unknown)}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            plain = isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))
            if plain and len(f.attribute) == 1 and f.attribute[0] in _HEADER:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, base = _open(self.path)
        info = system.get_file_info(base)
        if info.type == fs.FileType.File:
            found = [info]
        else:
            listed = [x for x in system.get_file_info(fs.FileSelector(base, recursive=True)) if x.type == fs.FileType.File]
            manifest = f"{base}/{MANIFEST}"
            if any(x.path == manifest for x in listed):
                with system.open_input_stream(manifest) as f:
                    names = set(json.loads(f.read())["files"])
                found = [x for x in listed if x.path.removeprefix(f"{base}/") in names]
            else:
                found = [x for x in listed if x.base_name.endswith((".warc", ".warc.gz"))]
        out, total = [], PARTITION
        for x in sorted(found, key=lambda x: x.path):
            if total + x.size > PARTITION:
                out.append([])
                total = 0
            out[-1].append(x.path)
            total += x.size
        return [Files(x) for x in out] or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        need_payload, need_bytes = "payload" in self.names, "payload_bytes" in self.names
        kinds = {"payload": pa.binary(), "payload_bytes": pa.int64()}
        types = [kinds.get(n, pa.string()) for n in self.names]

        def passes(h: dict[str, str]) -> bool:
            return all(_holds(f, _HEADER[f.attribute[0]](h)) for f in self.filters)

        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=self.names)

        for path in partition.value:
            with system.open_input_file(path) as file:
                for h, block in records(file, lambda h: (need_payload or need_bytes) and passes(h)):
                    if not passes(h):
                        continue
                    row = {n: _HEADER[n](h) for n in self.names if n in _HEADER}
                    if block is not None:
                        http = h.get("content-type", "").startswith("application/http")
                        end = block.find(b"\r\n\r\n") + 4 if http else 0
                        body = block[end:] if h.get("warc-type") != "revisit" else None
                        told = headers(block[:end]).get("content-length") if http else None
                        row["payload"] = body
                        row["payload_bytes"] = int(told) if body is None and told else None if body is None else len(body)
                    rows.append(tuple(row.get(n) for n in self.names))
                    size += 500 + len(block or b"")
                    if size >= BATCH:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class Warc(DataSource):
    """spark.read.format("warc").load(path), df.write.format("warc").mode("append" or "overwrite").save(path).

    A schema with some of SCHEMA's columns reads those alone: without payload and payload_bytes, blocks are passed over
    unread. Predicates on header columns are pushed down where spark.sql.python.filterPushdown.enabled is true.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive(pages: DataFrame, path: str, least: int = 1000) -> None:
    """Write a record for each row of pages (page_id, url, html): payload the html in UTF-8, null as empty.

    Of equal payloads of at least `least` bytes, that of the largest page_id is the response and the others revisit it.
    Who revisits whom is decided over digests, sizes and ids, and handed back by page_id: payloads are shuffled only if
    the table of revisits is too large for Spark to broadcast, and then by a key that no page shares. Null urls have no target URI, a null page_id an empty one in its record id. Rows that repeat the
    largest page_id are responses each. No rows: an empty archive.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.length("payload").cast("long")})
    told = written(rows.where(F.col("payload_bytes") >= least).select("page_id", "payload_digest", "payload_bytes"), "digests")
    again = told.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").drop("n")
    told = told.join(again, ["payload_digest", "payload_bytes"]).where(~F.col("page_id").eqNullSafe(F.col("top")))
    told = written(told.select(F.col("page_id").alias("__page"), F.col("payload_digest").alias("__digest"), "top").distinct(), "revisits")
    rows = rows.join(told, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("payload_digest") == F.col("__digest")), "left")
    own = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    revisit = F.col("__digest").isNotNull()
    out = rows.select(
        own("page_id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"), F.lit(DATE).alias("date"),
        "payload_digest", "payload_bytes", F.when(revisit, own("top")).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").save(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = new_path(spark, "warc")
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    page = lambda c: F.try_element_at(F.split(c, ":"), F.lit(-1)).try_cast("long")
    # revisits carry no payload: their scan passes over the blocks of all other records, as the predicate is pushed down
    heads = "record_id string, record_type string, payload_digest string, payload_bytes long, refers_to string"
    read = lambda columns, kind: spark.read.format("warc").schema(columns).load(path).where(F.col("record_type") == kind)
    wrong = F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("record_id"))).cast("string")
    whole = read(f"{heads}, payload binary", "response").withColumns({"payload_digest": F.when(F.sha1("payload") == F.col("payload_digest"), F.col("payload_digest")).otherwise(wrong), "payload_bytes": F.length("payload").cast("long")})
    rows = whole.drop("payload").unionByName(read(heads, "revisit"))
    return rows.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM t
"""
