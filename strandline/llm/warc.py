"""WARC archives: a writer, a normaliser for monolithic gzip files, and an indexed reader.

``decided`` marks every record as ``response`` or as ``revisit`` of the equal payload with
the smallest id.  ``monolithic`` writes records into archives that are one gzip stream each.
``normalised`` inflates such a stream once, in pieces, rewrites each record as a gzip member
of its own and makes the sidecar index (offset and length of each member).  ``read_back``
gets the records out of the members through the index.

A null or empty payload is a response of 0 bytes.  Payloads below ``least`` bytes never
become revisits.  Rows with equal ids stay separate records, and of equal payloads under the
least id (a tie) none becomes a revisit of itself.  Archives hold about ``archive_bytes`` of payload, or
one longer payload, so memory is bounded whatever the partition size.  An empty table gives no
archive and no record.  Other columns, whatever their names, are not read.

Archives travel as rows, which any store that Spark writes can hold; ``write_files`` and ``read_files`` keep
them as ``.warc.gz`` files with a sidecar file each, in a folder that all executors mount.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GZIP, CHUNK = 31, 1 << 18


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    block: bytes


def record_bytes(record_id: str, uri: str, date: str, kind: str, digest: str, size: int, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC/1.1 record.  The block of a revisit is the HTTP head alone, as the standard has
    it; its Content-Length still tells the length of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:strandline:{record_id}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {' '.join(uri.split())}"] * bool(uri.strip())
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:strandline:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(stream: Iterator[bytes]) -> Iterator[tuple[bytes, Record]]:
    """Records of an uncompressed WARC stream that comes in pieces, with their raw bytes."""
    held = bytearray()
    need, headers, head_end = 0, None, 0
    for piece in stream:
        held += piece
        while True:
            if headers is None:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                first, *lines = bytes(held[:at]).decode("utf-8").split("\r\n")
                if not first.startswith("WARC/"):
                    raise ValueError(f"no WARC record at {first[:40]!r}")
                headers = dict(x.split(": ", 1) for x in lines)
                head_end = at + 4
                need = head_end + int(headers["Content-Length"]) + 4
            if len(held) < need:
                break
            raw = bytes(held[:need])
            yield raw, Record(headers, raw[head_end:-4])
            del held[:need]
            headers = None
    if held:
        raise ValueError("the archive ends within a record")


def inflated(data: bytes) -> Iterator[bytes]:
    """A gzip file (of one member or many) in bounded pieces, each byte inflated once."""
    rest = data
    while rest:
        engine = zlib.decompressobj(GZIP)
        while not engine.eof:
            piece = engine.decompress(rest, CHUNK)
            rest = engine.unconsumed_tail if not engine.eof else engine.unused_data
            if piece:
                yield piece
            elif not engine.eof and not rest:
                raise ValueError("the gzip stream is cut off")


def member(raw: bytes, level: int = 1) -> bytes:
    engine = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return engine.compress(raw) + engine.flush()


def normalise(data: bytes, level: int = 1) -> tuple[bytes, list[tuple[int, int, str]]]:
    """(the archive with a gzip member for each record, its index: offset, length, record id)."""
    out, index, at = [], [], 0
    for raw, record in records(inflated(data)):
        part = member(raw, level)
        index.append((at, len(part), record.headers["WARC-Record-ID"][1:-1].rpartition(":")[2]))
        out.append(part)
        at += len(part)
    return b"".join(out), index


def decided(df: DataFrame, id_col: str = "page_id", payload_col: str = "html", uri_col: str = "url", least: int = 100) -> DataFrame:
    """Adds digest, record_type and refers_to.  Ids of equal payloads are reduced to their
    minimum before any join, and only digests that occur twice meet the rows again."""
    rows = df.select(df[id_col].alias("id"), df[uri_col].alias("uri"), F.coalesce(df[payload_col], F.lit("")).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    again = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    out = rows.join(again, "digest", "left")
    later = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return out.withColumn("record_type", F.when(later, "revisit").otherwise("response")).withColumn("refers_to", F.when(later, F.col("first"))).drop("first")


ARCHIVE = "archive bigint, data binary"


def monolithic(df: DataFrame, date: str = "2020-01-01T00:00:00Z", archive_bytes: int = 8 << 20, level: int = 1) -> DataFrame:
    """Archives, each one gzip stream, of the rows of ``decided``; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 32, 0
        engine, parts = zlib.compressobj(level, zlib.DEFLATED, GZIP), []
        for b in batches:
            for r in b.to_pylist():
                payload = r["payload"].encode()
                parts.append(engine.compress(record_bytes(str(r["id"]), r["uri"] or "", date, r["record_type"], r["digest"], r["size"], payload, str(r["refers_to"]))))
                size += len(payload) + 500
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([b"".join(parts) + engine.flush()], type=pa.binary())], names=["archive", "data"])
                    engine, parts, size, number = zlib.compressobj(level, zlib.DEFLATED, GZIP), [], 0, number + 1
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([b"".join(parts) + engine.flush()], type=pa.binary())], names=["archive", "data"])

    return df.select("id", "uri", "payload", "size", "digest", "record_type", "refers_to").mapInArrow(run, ARCHIVE)


def normalised(archives: DataFrame, level: int = 1) -> DataFrame:
    """Archives with a member for each record, and their sidecar index."""
    entry = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data, index = normalise(b.column("data")[i].as_py(), level)
                rows = pa.array([[{"offset": o, "length": n, "record_id": k} for o, n, k in index]], type=entry)
                yield pa.RecordBatch.from_arrays([b.column("archive").slice(i, 1), pa.array([data], type=pa.binary()), rows], names=["archive", "data", "sidecar"])

    return archives.mapInArrow(run, ARCHIVE + ", sidecar array<struct<offset:bigint,length:bigint,record_id:string>>")


FILES = "archive bigint, path string, bytes bigint, records bigint"


def write_files(archives: DataFrame, root: str) -> DataFrame:
    """Writes each row of ``normalised`` as an archive and its sidecar (a line of offset, length and record
    id for each member) below ``root``; a row a file.  Files are renamed when they are whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(root, exist_ok=True)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                path = os.path.join(root, f"part-{r['archive']:016x}.warc.gz")
                lines = "".join(f"{e['offset']}\t{e['length']}\t{e['record_id']}\n" for e in r["sidecar"])
                for to, data in ((path + ".idx", lines.encode()), (path, r["data"])):
                    part = f"{to}.{os.getpid()}.part"
                    with open(part, "wb") as f:
                        f.write(data)
                    os.replace(part, to)
                rows.append((r["archive"], path, len(r["data"]), len(r["sidecar"])))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=[x.split()[0] for x in FILES.split(", ")])

    return archives.mapInArrow(run, FILES)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """The archives of a folder with their sidecars, as ``normalised`` gives them."""
    whole = lambda pattern: spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root)
    name = F.regexp_extract("path", r"part-([0-9a-f]{16})\.warc\.gz", 1)
    archive = F.conv(name, 16, 10).cast("bigint")
    cells = lambda x: F.split(x, "\t")
    lines = F.filter(F.split(F.decode("content", "UTF-8"), "\n"), lambda x: x != "")
    entry = lambda x: F.struct(cells(x)[0].cast("bigint").alias("offset"), cells(x)[1].cast("bigint").alias("length"), cells(x)[2].alias("record_id"))
    index = whole("*.idx").select(archive.alias("archive"), F.transform(lines, entry).alias("sidecar"))
    return whole("*.warc.gz").select(archive.alias("archive"), F.col("content").alias("data")).join(index, "archive").select("archive", "data", "sidecar")


def read_back(archives: DataFrame, id_type: str = "bigint") -> DataFrame:
    """A row for each record, got from its member by the sidecar index."""
    schema = "record_id string, uri string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, archive bigint, offset bigint, member_bytes bigint, intact boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data, rows = b.column("data")[i].as_py(), []
                for e in b.column("sidecar")[i].as_py():
                    raw = zlib.decompress(data[e["offset"] : e["offset"] + e["length"]], GZIP)
                    ((_, r),) = records(iter([raw]))
                    http, _, payload = r.block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    h = r.headers
                    digest, revisit = h["WARC-Payload-Digest"].removeprefix("sha256:"), h["WARC-Type"] == "revisit"
                    intact = revisit or (len(payload) == size and hashlib.sha256(payload).hexdigest() == digest)
                    rows.append((e["record_id"], h.get("WARC-Target-URI"), size, digest, h["WARC-Type"], h["WARC-Refers-To"][1:-1].rpartition(":")[2] if revisit else None, b.column("archive")[i].as_py(), e["offset"], e["length"], intact))
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows))), schema=_arrow(schema))

    return archives.mapInArrow(run, schema).withColumn("refers_to", F.col("refers_to").try_cast(id_type)).withColumn("record_id", F.col("record_id").try_cast(id_type))


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])
