"""WARC archives: a writer with revisit records, and a splittable reader.

``write`` stores one record per page, each as its own gzip member.  Of pages with
equal payloads of at least ``min_bytes`` that with the largest id becomes the
response; the others become revisits that refer to it.  Tasks write files of
their own into a folder that all executors share, and a manifest written by
Spark names the files of the tasks that succeeded: files of lost or repeated
attempts are never read.

``read`` cuts the files into byte ranges.  A range's task scans it for the gzip
magic, checks each candidate by decoding its header, and owns exactly the
records that start inside, reading past its end to finish the last one.  A
candidate that does not decode to a WARC header whose length fits its block is
skipped; magic bytes inside compressed data are such.

An empty table gives an archive without records.  Null payloads are empty, very long ones are read whole.  Rows that repeat the largest id are all responses.
Null ids refer to the response like others and are responses where no id is
known.  A null url is left out of the record.  Files are reached through
pyarrow's file systems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.textcore import shared_dir, tune

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range that one task scans.
SPLIT_BYTES = 4 << 20
#: A payload of one page in so many is a hot key; so many can be hot at most.
HOT = 1024
#: Bytes read at a time.
READ_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response record, or a revisit of another one, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> dict | None:
    """Headers, block and payload of a decoded member; None if it is no whole WARC record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/1."):
        return None
    headers = {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
    size = headers.get("content-length", "")
    if not size.isdigit() or len(rest) != int(size) + 4 or not rest.endswith(b"\r\n\r\n"):
        return None
    http, _, payload = rest[: int(size)].partition(b"\r\n\r\n")
    told = {k.strip().lower().decode("latin-1"): v.strip().decode("latin-1") for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
    return {"headers": headers, "http": told, "payload": payload}


class Window:
    """The bytes of a file from ``base`` on, read as they are needed."""

    def __init__(self, handle, size: int, base: int):
        self.handle, self.size, self.base, self.held = handle, size, base, b""

    def reach(self, to: int) -> bool:
        """Holds the bytes up to file offset ``to``, or all there are; whether there are as many."""
        have = self.base + len(self.held)
        if to > have and have < self.size:
            self.handle.seek(have)
            self.held += self.handle.read(min(max(to - have, READ_BYTES), self.size - have))
        return self.base + len(self.held) >= to

    def forget(self, before: int) -> None:
        if before - self.base > 4 * READ_BYTES:
            self.held, self.base = self.held[before - self.base :], before

    def find(self, what: bytes, start: int, stop: int) -> int:
        """Offset of ``what`` if it begins in [start, stop), else -1."""
        self.reach(stop + len(what) - 1)
        at = self.held.find(what, start - self.base, stop - self.base + len(what) - 1)
        return at if at < 0 else at + self.base

    def some(self, at: int, n: int = 1 << 16) -> bytes:
        self.reach(at + 1)
        return self.held[at - self.base : at - self.base + n]


def records(handle, size: int, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """(offset, record) of the members that start in [start, end) of a file."""
    window, at = Window(handle, size, start), start
    while at < end:
        window.forget(at)
        stop = min(end, at + READ_BYTES)
        found = window.find(MAGIC, at, stop)
        if found < 0:
            at = stop
            continue
        data, length = decode(window, found)
        made = parse(data) if data else None
        if made:
            yield found, made
        at = found + (length if made else 1)


def decode(window: Window, at: int) -> tuple[bytes | None, int]:
    """(content, compressed length) of the member at an offset; no content where it is not a whole gzip member of a WARC record."""
    z, out, pos, checked = zlib.decompressobj(31), b"", at, False
    pieces = []
    try:
        while not z.eof:
            piece = window.some(pos)
            if not piece:
                return None, 0
            pieces.append(z.decompress(piece))
            pos += len(piece) - len(z.unused_data)
            if not checked:
                out = b"".join(pieces)
                if not (b"WARC/1.".startswith(out[:7]) if len(out) < 7 else out.startswith(b"WARC/1.")):
                    return None, 0
                checked = len(out) >= 7
    except zlib.error:
        return None, 0
    return b"".join(pieces), pos - at


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None, min_bytes: int = 0) -> str:
    """Writes the archive; returns its folder, which holds the files and their manifest."""
    spark = pages.sparkSession
    tune(spark)
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    out = _referred(src, min_bytes).select(F.col("id").cast("string").alias("id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        name = f"pages-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        size = n = 0
        sink = None
        for b in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sink = sink or system.open_output_stream(f"{path}/{name}", compression=None)
                data = member(record("" if page_id is None else page_id, url, payload, refers_to))
                sink.write(data)
                size, n = size + len(data), n + 1
        if sink:
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "bytes": [size], "records": [n]})

    out.mapInArrow(run, "file string, bytes long, records long").write.parquet(f"{folder}/manifest")
    return folder


def _referred(src: DataFrame, min_bytes: int) -> DataFrame:
    """src (id, url, payload) with refers_to: the id of the response with the same payload, null for responses.

    A payload that many pages share (an error page) would be one key of a join.
    Digests of at least 1 in ``HOT`` pages, of which there are at most HOT, are
    broadcast instead, and their pages are dealt by a hash of their own.
    """
    src = src.withColumn("digest", F.sha1("payload"))
    each = src.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.max("id").alias("best"), F.count("*").alias("n"))
    least = each.agg((F.sum("n") / HOT).alias("n")).scalar()
    many = each.where("n > 1").withColumn("hot", F.col("n") >= least)
    hot = many.where("hot").select(F.col("digest").alias("hot_digest"), F.col("best").alias("hot_best"))
    rest = many.where("not hot").select(F.col("digest").alias("rest_digest"), F.col("best").alias("rest_best"))
    src = src.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    key = F.when(F.col("hot_digest").isNull(), F.col("digest")).otherwise(F.hex(F.xxhash64("id", "url")))
    best = F.coalesce("hot_best", "rest_best")
    src = src.join(rest, key == F.col("rest_digest"), "left")
    return src.withColumn("refers_to", F.when(best != F.coalesce("id", best - 1), best))


SCHEMA = "file string, offset long, type string, record_id string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def read(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Rows of SCHEMA: digest and size are of the full payload, computed for responses and as told by revisits."""
    tune(spark)
    files = spark.read.schema("file string, bytes long, records long").parquet(f"{folder}/manifest")
    split = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    ranges = files.where("bytes > 0").select("file", "bytes", split)
    ranges = ranges.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        for b in batches:
            for file, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows: list[tuple] = []
                held = 0
                with system.open_input_file(f"{path}/{file}") as handle:
                    for offset, r in records(handle, size, start, min(start + split_bytes, size)):
                        h, payload = r["headers"], r["payload"]
                        own = h.get("warc-type") != "revisit"
                        digest = base32_sha1(payload) if own else h.get("warc-payload-digest", "").removeprefix("sha1:")
                        length = len(payload) if own else int(r["http"].get("content-length", 0))
                        rows.append((file, offset, h.get("warc-type"), _urn(h.get("warc-record-id")), h.get("warc-target-uri"), _urn(h.get("warc-refers-to")), digest, length, payload if own else None))
                        held += len(payload)
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return ranges.mapInArrow(run, SCHEMA)


def _urn(value: str | None) -> str | None:
    return None if value is None else value.strip("<>").removeprefix("urn:page:") or None


_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=names)
