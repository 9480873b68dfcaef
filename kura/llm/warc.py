"""WARC archives as a PySpark data source.

Writing: each task streams its rows into one file of gzip members, one a record; with each commit the driver lists the files
of the attempts that succeeded in a manifest of its own, so what a lost or repeated task left is never read and a later write
adds to an earlier one. Mode overwrite deletes what the manifests before it list; a write that fails deletes its files. Each member
carries its own length in the gzip extra field, so a reader can step over it.

Reading: a partition for each file; record-type and header predicates are pushed down; headers are parsed
from the first bytes of a member, and the rest of a record that isn't wanted is not decompressed. With
option payload=false no payload is.

Defined results: a null payload is written as an empty one; a null url or refers_to leaves its header out; control
characters in a url are percent-encoded; an empty table gives an archive without records; rows that share a page_id and a
payload are each a response if that is the largest page_id; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from .common import materialize

FORMAT = "kura_warc"
MANIFEST = "_manifest"
DATE = "2024-01-01T00:00:00Z"
SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, refers_to string, payload_digest string, payload_length long, payload binary"
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
BATCH_BYTES = 8 << 20


def member(record: bytes) -> bytes:
    """A gzip member with its compressed and plain length in the extra field."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    total = 24 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str | None, refers_to: str | None, digest: str, payload: bytes, length: int) -> bytes:
    """One record; a revisit's block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{record_id}>\r\nWARC-Date: {DATE}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <{refers_to}>")
    head.append(f"WARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n")
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    name: str


class Writer(DataSourceArrowWriter):
    """Rows: kind, record_id, uri, refers_to, digest, payload."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = fs.FileSystem.from_uri(self.path)
        store.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            for batch in iterator:
                for kind, rid, uri, refers, digest, payload in zip(*(batch[c] for c in ("kind", "record_id", "uri", "refers_to", "digest", "payload")), strict=True):
                    body = payload.as_py() or b""
                    out.write(member(record(kind.as_py(), rid.as_py(), uri.as_py(), refers.as_py(), digest.as_py(), body, len(body))))
        return Written(name)

    def commit(self, messages: list) -> None:
        store, base = fs.FileSystem.from_uri(self.path)
        store.create_dir(base, recursive=True)
        old = manifests(store, base) if self.overwrite else []
        with store.open_output_stream(f"{base}/{MANIFEST}-{uuid.uuid4().hex}", compression=None) as out:
            out.write("\n".join(m.name for m in messages if m).encode())
        for path in old:
            gone = listed(store, path)
            store.delete_file(path)
            for name in gone:
                store.delete_file(f"{base}/{name}")

    def abort(self, messages: list) -> None:
        store, base = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{base}/{m.name}")


def manifests(store: fs.FileSystem, base: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(base))
    return sorted(x.path for x in found if x.base_name.startswith(MANIFEST))


def listed(store: fs.FileSystem, path: str) -> list[str]:
    with store.open_input_stream(path, compression=None) as f:
        return [x for x in f.read().decode().split("\n") if x]


@dataclass
class File(InputPartition):
    name: str


class Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload
        self.wanted: list[tuple[str, frozenset | None]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, membership and presence of what the headers hold; others go back to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.wanted.append((column, frozenset([f.value])))
            elif isinstance(f, In):
                self.wanted.append((column, frozenset(f.value)))
            elif isinstance(f, IsNotNull):
                self.wanted.append((column, None))
            else:
                yield f

    def partitions(self) -> list[File]:
        store, base = fs.FileSystem.from_uri(self.path)
        if known := manifests(store, base):
            return [File(x) for path in known for x in listed(store, path)]
        found = store.get_file_info(fs.FileSelector(base))
        return [File(x.base_name) for x in sorted(found, key=lambda x: x.base_name) if x.base_name.endswith(".warc.gz")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        with store.open_input_file(f"{base}/{partition.name}") as f:
            for head, rest in members(f):
                values = {c: head.get(h) for c, h in HEADERS.items()}
                for c in ("record_id", "refers_to"):
                    values[c] = values[c].strip("<>") if values[c] else None
                if any(values[c] is None or some is not None and values[c] not in some for c, some in self.wanted):
                    continue
                length = payload = None
                if values["record_type"] in ("response", "revisit"):
                    length, payload = rest(self.payload and values["record_type"] == "response")
                rows.append((*(values[c] for c in HEADERS), length, payload))
                size += len(payload or b"") + 200
                if size > BATCH_BYTES:
                    yield to_batch(rows)
                    rows, size = [], 0
        yield to_batch(rows)


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[*HEADERS, "payload_length", "payload"])


def fields(raw: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in raw.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def members(f):
    """For each record its headers and a function that decodes the rest: content length and body, or with False only
    as far as the HTTP header goes: content length and None."""
    at, end = 0, f.size()
    while at < end:
        f.seek(at)
        start = f.read(24)
        known = len(start) == 24 and start[3] == 4 and start[12:14] == b"sl"
        total = struct.unpack("<I", start[16:20])[0] if known else None
        stream = zlib.decompressobj(31)
        f.seek(at)
        left = total if known else end - at
        got = b""

        def more(least: int | None, f=f, stream=stream) -> bool:
            """Decompresses on; least is how much output will do."""
            nonlocal left, got
            if stream.eof:
                return False
            raw = stream.unconsumed_tail
            if not raw:
                raw = f.read(min(left, 1 << 16))
                left -= len(raw)
            if not raw:
                return False
            got += stream.decompress(raw, least or 0)
            return True

        while b"\r\n\r\n" not in got and more(1024):
            pass
        cut = got.find(b"\r\n\r\n")
        head = fields(got[:cut])

        def rest(whole=True, cut=cut, head=head, more=more):
            nonlocal got
            if not whole:
                while got.find(b"\r\n\r\n", cut + 4) < 0 and more(1024):
                    pass
                http = got[cut + 4 : max(cut + 4, got.find(b"\r\n\r\n", cut + 4))]
                return int(fields(http).get("content-length", 0)), None
            while more(None):
                pass
            block = got[cut + 4 : cut + 4 + int(head.get("content-length", 0))]
            http = block.find(b"\r\n\r\n")
            return int(fields(block[:http]).get("content-length", 0)), block[http + 4 :]

        yield head, rest
        if known:
            at += total
        else:
            while more(None):
                pass
            at = end if not stream.eof else f.tell() - len(stream.unused_data)


class WarcSource(DataSource):
    """Options: path; payload (true or false)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write(pages: DataFrame, path: str, html_col: str = "html", id_col: str = "page_id", url_col: str = "url", least: int = 1000, mode: str = "append") -> None:
    """An archive at path: of equal payloads of at least least bytes, that of the largest id is the response. Payloads are dealt by id
    and digest together, so copies of a page are in as many tasks as there are ids."""
    register(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("uri"), payload.alias("payload"))
    same = F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)).alias("same")
    keys = rows.select("id", same).where("same is not null")
    groups = keys.groupBy("same").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "first")
    groups = materialize(groups, "warc-groups")  # so that the join can split a group of many copies
    answer = keys.join(groups, "same").where("first is not null and not (id <=> first)").distinct()  # of each revisit, without its payload
    answer = answer.select(F.col("id").alias("again_id"), F.col("same").alias("again_same"), "first")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    again = F.col("first").isNotNull()
    held = rows.withColumn("same", same).join(answer, F.col("id").eqNullSafe(F.col("again_id")) & F.col("same").eqNullSafe(F.col("again_same")), "left")
    out = held.select(
        F.when(again, "revisit").otherwise("response").alias("kind"), urn(F.col("id")).alias("record_id"), "uri", F.when(again, urn(F.col("first"))).alias("refers_to"), F.sha1("payload").alias("digest"), "payload"
    )
    out.write.format(FORMAT).mode(mode).save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).option("payload", str(payload).lower()).load(path)


def page_id(record_id):
    return F.expr("try_cast(substring(x, 10) as bigint)".replace("x", record_id))
