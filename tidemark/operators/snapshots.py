"""Snapshots in chunks: cutting, and checking what arrives."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.codecs import crc32c_bytes

CHUNK = 1 << 20
MOST = 256 << 20
#: Rows and bytes of data that a worker hands on at once.
SOME, MOST_BYTES = 1 << 12, 1 << 24


def chunk_offsets(items: DataFrame, size: Column, chunk: int = CHUNK) -> DataFrame:
    """items with one row per chunk: offset, n_bytes, final; an empty item is one empty chunk."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(size - 1, F.lit(0)).cast("long"), F.lit(chunk).cast("long"))
    out = items.withColumn("_size", size.cast("long")).withColumn("offset", F.explode(starts))
    n = F.least(F.lit(chunk), F.col("_size") - F.col("offset"))
    return out.withColumn("n_bytes", n).withColumn("final", F.col("offset") + F.col("n_bytes") >= F.col("_size")).drop("_size")


def arrivals(rows: Iterable[dict]) -> Iterator[tuple[int, str, bytes | None]]:
    """(seq, status, data) of chunks in order of arrival (seq, identity, offset, data, total, checksum, final).

    Status is STORED, COMPLETE, or why it was refused.  Offset 0 starts over; a
    refusal after the size check discards what there was.
    """
    identity, held = None, b""
    for r in rows:
        own = (r["identity"], r["total"])
        if r["total"] > MOST:
            yield r["seq"], "TOO_LARGE", None
            continue
        if r["offset"] == 0:
            identity, held = own, b""
        data = bytes(r["data"])
        why = None
        if identity is None or own != identity:
            why = "OTHER_TRANSFER"
        elif r["offset"] != len(held):
            why = "GAP"
        elif crc32c_bytes(data) != r["checksum"]:
            why = "CHECKSUM"
        elif len(held) + len(data) > r["total"]:
            why = "OVERFLOW"
        elif r["final"] and len(held) + len(data) != r["total"]:
            why = "SHORT"
        if why:
            identity, held = None, b""
            yield r["seq"], why, None
            continue
        held += data
        if r["final"]:
            yield r["seq"], "COMPLETE", held
            identity, held = None, b""
        else:
            yield r["seq"], "STORED", None


def reassemble(chunks: DataFrame) -> DataFrame:
    """(receiver, seq, status, data) of chunks (receiver, seq, identity, offset, data, total, checksum, final).

    Chunks come in order of receiver and seq, so a worker holds what is there of one
    transfer, not all chunks of a receiver, and no receiver has a call of its own.
    """
    schema = T.StructType([T.StructField("receiver", chunks.schema["receiver"].dataType), *T.StructType.fromDDL("seq long, status string, data binary")])
    told = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for at in range(0, b.num_rows, SOME) for r in b.slice(at, SOME).to_pylist())
        out, size = [], 0
        for receiver, own in groupby(rows, key=lambda r: r["receiver"]):
            for seq, status, data in arrivals(own):
                out.append((receiver, seq, status, data))
                size += len(data or b"")
                if len(out) >= SOME or size >= MOST_BYTES:
                    yield _batch(out, told)
                    out, size = [], 0
        if out:
            yield _batch(out, told)

    fields = ["receiver", "seq", "identity", "offset", "data", "total", "checksum", "final"]
    return chunks.select(*fields).repartition("receiver").sortWithinPartitions("receiver", F.asc_nulls_last("seq")).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def digest(state: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of rows and an order-free digest of a state, for comparing replicas."""
    h = F.xxhash64(*columns)
    return state.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("digest"))
