"""WARC archives as a Spark data source: written per task, read by planned file partitions, headers before payloads.

Each record is a gzip member of its own whose extra field `sl` holds the member's and the record's lengths, so a reader that
does not want a record goes on to the next without inflating it; any gzip tool reads the files. The driver keeps the
names of the files of the tasks that succeeded in `_files.json`; files of lost attempts are never listed.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from voucherlake.session import fresh_path

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary"
#: Bytes after which a task starts its next file, and bytes of files in one partition of a reader.
FILE_BYTES = PARTITION_BYTES = 64 << 20
#: Bytes inflated at first, to see the header of a record.
HEAD_BYTES = 4096
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits."""
    parts = []
    for i in range(8):
        number = F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(ALPHABET), F.shiftright(number, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def member(record: bytes) -> bytes:
    """One gzip member with the extra field `sl`: lengths of the member and of what it holds."""
    squeeze = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    size = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(row) -> bytes:
    """A WARC 1.1 record of an HTTP response (or a revisit, which has the HTTP header alone)."""
    payload = bytes(row.payload or b"")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.payload_bytes}\r\n\r\n".encode()
    block = http + (payload if row.record_type != "revisit" else b"")
    uri = (row.target_uri or "").translate({13: "%0D", 10: "%0A"})
    lines = [
        "WARC/1.1", f"WARC-Type: {row.record_type}", f"WARC-Record-ID: <{row.record_id}>", f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{row.payload_digest}",
    ]
    if row.record_type == "revisit":
        lines += [f"WARC-Refers-To: <{row.refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> Written:
        system, folder = _place(self.path)
        system.create_dir(folder, recursive=True)
        files, out, size, name = [], None, 0, ""
        for row in iterator:
            if out is None:
                name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                out = system.open_output_stream(f"{folder}/{name}", compression=None)
            data = member(record(row))
            out.write(data)
            size += len(data)
            if size >= FILE_BYTES:
                out.close()
                files.append((name, size))
                out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages) -> None:
        system, folder = _place(self.path)
        system.create_dir(folder, recursive=True)
        files = sorted(f for m in messages if m is not None for f in m.files)
        with system.open_output_stream(f"{folder}/_files.json") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages) -> None:
        system, folder = _place(self.path)
        for name, _ in (f for m in messages if m is not None for f in m.files):
            system.delete_file(f"{folder}/{name}")


@dataclass
class Files(InputPartition):
    names: list[str]


class WarcReader(DataSourceReader):
    """Plans files into partitions; record types and other header columns are compared before a payload is inflated."""

    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.wanted = path, payload, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            column = one.attribute[0] if hasattr(one, "attribute") and len(one.attribute) == 1 else None
            if column in _HEADERS and isinstance(one, EqualTo):
                self.wanted.setdefault(column, []).append({one.value})
            elif column in _HEADERS and isinstance(one, In):
                self.wanted.setdefault(column, []).append(set(one.value))
            elif not (column == "record_type" and isinstance(one, IsNotNull)):
                yield one

    def partitions(self) -> list[Files]:
        system, folder = _place(self.path)
        with system.open_input_stream(f"{folder}/_files.json") as file:
            files = json.loads(file.read())
        parts, size = [], PARTITION_BYTES
        for name, length in files:
            if size + length > PARTITION_BYTES:
                parts.append(Files([]))
                size = 0
            parts[-1].names.append(name)
            size += length
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, folder = _place(self.path)
        for name in partition.names:
            with system.open_input_file(f"{folder}/{name}") as file:
                yield from self.records(file)

    def records(self, file) -> Iterator[tuple]:
        at, end = 0, file.size()
        while at < end:
            file.seek(at)
            first = file.read(24 + HEAD_BYTES)
            if first[:4] != b"\x1f\x8b\x08\x04" or first[12:14] != b"sl":
                raise ValueError(f"no record with skip lengths at byte {at}")
            size = struct.unpack("<I", first[16:20])[0]
            inflate = zlib.decompressobj(-15)
            seen = inflate.decompress(first[24 : min(len(first), size - 8)])
            while b"\r\n\r\n" not in seen:  # a header longer than usual
                more = file.read(HEAD_BYTES)
                if not more:
                    raise ValueError(f"a record ends within its header at byte {at}")
                seen += inflate.decompress(more)
            head, _, rest = seen.partition(b"\r\n\r\n")
            named = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in line)
            row = {c: named.get(h) for c, h in _HEADERS.items()}
            for c in ("record_id", "refers_to"):
                row[c] = row[c] and row[c][1:-1]
            row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha1:")
            if all(row[c] in values for c, asked in self.wanted.items() for values in asked):
                if self.payload or b"\r\n\r\n" not in rest:
                    file.seek(at + min(len(first), size - 8))
                    rest += inflate.decompress(file.read(max(0, size - 8 - min(len(first), size - 8)))) + inflate.flush()
                http, _, body = rest.partition(b"\r\n\r\n")
                length = next(int(x[16:]) for x in http.split(b"\r\n") if x[:16] == b"Content-Length: ")
                block = int(named["Content-Length"]) - len(http) - 4
                yield (*[row[c] for c in _HEADERS], length, body[:block] if self.payload else None)
            at += size


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of an archive folder. Filters by header columns reach the reader; payload=False never inflates one."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def to_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One record per row of pages (page_id, url, html), as read_warc() has them.

    Of rows with equal payloads of at least min_bytes the one with the smallest page_id is the response and the others
    revisit it; rows that repeat a page_id and its payload are responses each. A null html is an empty payload; a null page_id
    counts as larger than any. Other columns are not read.
    """
    slim = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    keyed = slim.withColumns({"key": F.sha2("payload", 256), "payload_bytes": F.length("payload").cast("long")})
    # counted before anything is shuffled; payloads that occur once need no join partner
    groups = keyed.where(F.col("payload_bytes") >= min_bytes).groupBy("key")
    firsts = groups.agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    joined = keyed.join(firsts, "key", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    named = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return joined.select(
        named("page_id").alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        base32(F.sha1("payload")).alias("payload_digest"),
        F.when(again, named("first")).alias("refers_to"),
        "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Writes a WARC record per row of pages into a folder that all executors see."""
    pages.sparkSession.dataSource.register(WarcSource)
    to_records(pages, min_bytes).write.format("warc").mode("append").save(path)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records of pages, written and read back.

    Length and digest of a response are those of the payload read back; a revisit has them in its headers.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(pages, path, min_bytes)
    whole = read_warc(spark, path).where("record_type = 'response'")
    whole = whole.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": base32(F.sha1("payload"))})
    again = read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) AS bigint)")
    both = whole.drop("payload").unionByName(again.drop("payload"))
    return both.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
