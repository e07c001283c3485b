"""Sorted run files: blocks of entries, a sparse index, a bloom filter, a summary and a footer.

Fixed layout, all integers little-endian.  An entry is flags (bit 0: tombstone),
key length, value length, key, value; a block is entries in order of key and a
checksum.  The index has of each block the length of its first key, its offset, its
length and that key; the summary the number of entries and the least and greatest
key with their lengths; both end in a checksum.  The footer is the last 64 bytes:
magic, version, offset and length of index, filter and summary, and a checksum.
The eight bytes of magic name the system that wrote a file and are a parameter.

A file is one group and one task's work, held in its memory; callers deal long runs
into files by ranges of keys, whose number is one more column of the group.
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import codecs
from tidemark.functions.codecs import Reader

#: Bytes from which on a block is full, length of the footer, bounds of keys and values.
BLOCK, FOOTER = 4096, 64
#: Bytes of blocks that are checked and decoded at once.
SOME = 1 << 18
MOST_KEY, MOST_VALUE = 1 << 20, 64 << 20

Entry = tuple[bytes, bytes, bool]
_HEAD = struct.Struct("<BII")


def _checked(data: bytes) -> bytes:
    return data + struct.pack("<I", codecs.crc32c_bytes(data))


def _body(data: bytes) -> bytes:
    """data without its checksum; an error if that is wrong."""
    if len(data) < 4 or struct.unpack("<I", data[-4:])[0] != codecs.crc32c_bytes(data[:-4]):
        raise ValueError("short or bad checksum")
    return data[:-4]


def _body_of_block(entries: list[Entry]) -> bytes:
    out = []
    for key, value, dead in entries:
        value = b"" if dead else value
        if not 0 < len(key) <= MOST_KEY or len(value) > MOST_VALUE:
            raise ValueError("key or value out of bounds")
        out += [_HEAD.pack(dead, len(key), len(value)), key, value]
    return b"".join(out)


def encode_block(entries: list[Entry]) -> bytes:
    return _checked(_body_of_block(entries))


def _parsed(body: bytes) -> list[Entry]:
    out, at, end = [], 0, len(body)
    while at < end:
        if end - at < 9:
            raise ValueError(f"short: entry at {at}")
        flags, k, v = _HEAD.unpack_from(body, at)
        at += 9
        if not 0 < k <= MOST_KEY or v > MOST_VALUE or k + v > end - at:
            raise ValueError(f"length out of bounds at {at}")
        if flags & 1 and v:
            raise ValueError("tombstone with a value")
        out.append((body[at : at + k], body[at + k : at + k + v], bool(flags & 1)))
        at += k + v
    return out


def decode_block(data: bytes) -> list[Entry]:
    """Entries of a block; an error for damage, lengths out of bounds, or a tombstone with a value."""
    return _parsed(_body(data))


def search_block(entries: list[Entry], key: bytes) -> Entry | None:
    """The entry of a key, by bisection."""
    at = bisect.bisect_left(entries, key, key=lambda e: e[0])
    return entries[at] if at < len(entries) and entries[at][0] == key else None


def encode_index(blocks: list[tuple[bytes, int, int]]) -> bytes:
    return _checked(b"".join(struct.pack("<IQQ", len(k), at, n) + k for k, at, n in blocks))


def decode_index(data: bytes) -> list[tuple[bytes, int, int]]:
    """(first key, offset, length) of each block."""
    r, out = Reader(_body(data)), []
    while r.at < len(r.data):
        k, at, n = r.number(4), r.number(8), r.number(8)
        out.append((r.bytes(MOST_KEY, 1, k), at, n))
    return out


def encode_summary(n: int, least: bytes, greatest: bytes) -> bytes:
    return _checked(struct.pack("<QI", n, len(least)) + least + struct.pack("<I", len(greatest)) + greatest)


def decode_summary(data: bytes) -> tuple[int, bytes, bytes]:
    """(entries, least key, greatest key)."""
    r = Reader(_body(data))
    out = r.number(8), r.bytes(MOST_KEY, 1), r.bytes(MOST_KEY, 1)
    r.end()
    return out


def encode_footer(sections: list[tuple[int, int]], magic: bytes) -> bytes:
    return _checked(magic + struct.pack("<I6Q", codecs.VERSION, *(x for s in sections for x in s)))


def decode_footer(data: bytes, body: int, magic: bytes) -> list[tuple[int, int]]:
    """(offset, length) of index, filter and summary; an error unless each lies within the ``body`` bytes before the footer."""
    if len(data) != FOOTER or data[:8] != magic:
        raise ValueError("bad footer or magic")
    version, *told = struct.unpack_from("<I6Q", _body(data), 8)
    if version != codecs.VERSION:
        raise ValueError("unknown version")
    sections = list(zip(told[::2], told[1::2], strict=True))
    for at, n in sections:
        if not n or at > body or n > body - at:
            raise ValueError("section outside the file")
    return sections


def _checksums(bodies: list[bytes]) -> Iterator[int]:
    """Checksums of blocks, some taken together."""
    at = 0
    while at < len(bodies):
        end, size = at, 0
        while end < len(bodies) and (size < SOME or end == at):
            size += len(bodies[end])
            end += 1
        bounds = np.cumsum([0, *map(len, bodies[at:end])])
        yield from codecs.crc32c_many(np.frombuffer(b"".join(bodies[at:end]), np.uint8), bounds).tolist()
        at = end


def encode_run(entries: list[Entry], magic: bytes) -> bytes:
    """A file of entries whose keys rise strictly; an error for none, an empty key, or any other order."""
    if not entries:
        raise ValueError("a run has entries")
    if not entries[0][0] or any(a[0] >= b[0] for a, b in zip(entries, entries[1:], strict=False)):
        raise ValueError("keys must rise strictly")
    bodies, firsts, held, size = [], [], [], 0
    for i, e in enumerate(entries):
        held.append(e)
        size += 9 + len(e[0]) + (0 if e[2] else len(e[1]))
        if size >= BLOCK or i == len(entries) - 1:
            bodies.append(_body_of_block(held))
            firsts.append(held[0][0])
            held, size = [], 0
    out, at, index = [], 0, []
    for body, key, crc in zip(bodies, firsts, _checksums(bodies), strict=True):
        out += [body, struct.pack("<I", crc)]
        index.append((key, at, len(body) + 4))
        at += len(body) + 4
    m, k = codecs.bloom_size(len(entries))
    parts = [encode_index(index), codecs.encode_bloom(m, k, codecs.bloom_bits([e[0] for e in entries], m, k)), encode_summary(len(entries), entries[0][0], entries[-1][0])]
    sections = []
    for p in parts:
        sections.append((at, len(p)))
        at += len(p)
    return b"".join([*out, *parts, encode_footer(sections, magic)])


class Run:
    """A run file held as bytes: index, filter and summary are read at once, blocks as they are needed."""

    def __init__(self, data: bytes, magic: bytes):
        if len(data) < FOOTER:
            raise ValueError("short file")
        self.data = data
        (a, x), (b, y), (c, z) = decode_footer(data[-FOOTER:], len(data) - FOOTER, magic)
        self.index = decode_index(data[a : a + x])
        self.bits, self.hashes, self.filter = codecs.decode_bloom(data[b : b + y])
        self.n, self.least, self.greatest = decode_summary(data[c : c + z])

    def entries(self) -> Iterator[Entry]:
        """All entries in order of key, a block at a time, tombstones included."""
        for own in self.some():
            yield from own

    def some(self) -> Iterator[list[Entry]]:
        """The same in lists, each of blocks of ``SOME`` bytes or the last to pass it."""
        held, size = [], 0
        for i, (_, at, n) in enumerate(self.index):
            held.append(self.data[at : at + n])
            size += n
            if size >= SOME or i == len(self.index) - 1:
                told = _checksums([b[:-4] for b in held])
                if any(len(b) < 4 or struct.unpack("<I", b[-4:])[0] != crc for b, crc in zip(held, told, strict=True)):
                    raise ValueError("short or bad checksum")
                yield [e for b in held for e in _parsed(b[:-4])]
                held, size = [], 0

    def candidate(self, key: bytes) -> int:
        """The last block whose first key is not above the key; -1 if all are."""
        return bisect.bisect_right(self.index, key, key=lambda b: b[0]) - 1

    def get(self, keys: list[bytes]) -> list[tuple[str, bytes | None]]:
        """FOUND with the value, TOMBSTONE or NOT_FOUND of each key; a block is read once for all keys in it."""
        out: list[tuple[str, bytes | None]] = [("NOT_FOUND", None)] * len(keys)
        may = codecs.bloom_test(keys, self.bits, self.hashes, self.filter) if keys else []
        held: dict[int, list[Entry]] = {}
        for i, key in enumerate(keys):
            block = self.candidate(key) if may[i] else -1
            if block < 0:
                continue
            if block not in held:
                _, at, n = self.index[block]
                held[block] = decode_block(self.data[at : at + n])
            e = search_block(held[block], key)
            if e:
                out[i] = ("TOMBSTONE", None) if e[2] else ("FOUND", e[1])
        return out


def encode_runs(entries: DataFrame, groups: list[str], magic: bytes, key: str = "key", value: str = "value", tombstone: str = "tombstone") -> DataFrame:
    """One run file (content) per group of entries; keys must be unique within a group."""
    src = entries.select(*groups, F.col(key).cast("binary").alias("_k"), F.col(value).cast("binary").alias("_v"), F.col(tombstone).alias("_t"))
    schema = T.StructType([*[src.schema[g] for g in groups], T.StructField("content", T.BinaryType())])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("_k")
        rows = list(zip(t.column("_k").to_pylist(), (v or b"" for v in t.column("_v").to_pylist()), t.column("_t").to_pylist(), strict=True))
        return pa.Table.from_arrays([*(t.column(g).slice(0, 1) for g in groups), pa.array([encode_run(rows, magic)], pa.binary())], names=schema.names)

    return src.groupBy(*groups).applyInArrow(run, schema)


def _of_files(files: DataFrame, content: str, schema: T.StructType, magic: bytes, rows) -> DataFrame:
    """Rows of each file, after its other columns, by ``rows``."""
    others = [c for c in files.columns if c != content]
    at = files.columns.index(content)
    kept = [files.columns.index(c) for c in others]
    whole = T.StructType([*[files.schema[c] for c in others], *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                for part in rows(Run(b.column(at)[i].as_py() or b"", magic)):
                    n = len(part[0])
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array([i] * n, pa.int32())) for c in kept), *part], names=whole.names)

    return files.mapInArrow(run, whole)


def decode_runs(files: DataFrame, magic: bytes, content: str = "content") -> DataFrame:
    """Entries of run files: other columns, key, value, tombstone; blocks in order."""

    def rows(run: Run):
        for own in run.some():
            yield [pa.array([e[0] for e in own], pa.binary()), pa.array([None if e[2] else e[1] for e in own], pa.binary()), pa.array([e[2] for e in own])]

    return _of_files(files, content, T.StructType.fromDDL("key binary, value binary, tombstone boolean"), magic, rows)


def summaries(files: DataFrame, magic: bytes, content: str = "content") -> DataFrame:
    """Of each run file its entries, least and greatest key and blocks, without reading any block."""
    schema = T.StructType.fromDDL("n_entries long, min_key binary, max_key binary, n_blocks int")
    return _of_files(files, content, schema, magic, lambda r: [[pa.array([r.n]), pa.array([r.least], pa.binary()), pa.array([r.greatest], pa.binary()), pa.array([len(r.index)], pa.int32())]])


def get(files: DataFrame, probes: DataFrame, groups: list[str], magic: bytes, key: str = "key", content: str = "content", parts: int = 16) -> DataFrame:
    """Probes (groups, key) with result and value from the run file of their group; NOT_FOUND where there is none.

    Probes are dealt into ``parts`` a group, each with a copy of the group's file;
    no file is copied to where it has no probes.  Which parts of which groups have
    any goes to all files: one small row a group that is asked.
    """
    schema = T.StructType([*probes.schema.fields, *T.StructType.fromDDL("result string, value binary")])

    def run(own: pa.Table, f: pa.Table) -> pa.Table:
        own = own.drop_columns(["_part"])
        keys = [k if isinstance(k, bytes) else str(k).encode() for k in own.column(key).to_pylist()]
        found = Run(f.column("_content")[0].as_py(), magic).get(keys) if f.num_rows and keys else [("NOT_FOUND", None)] * len(keys)
        return own.append_column("result", pa.array([r for r, _ in found], pa.string())).append_column("value", pa.array([v for _, v in found], pa.binary()))

    dealt = probes.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    names = [f"_of_{i}" for i in range(len(groups))]  # other names: probes may come from the same entries
    asked = dealt.groupBy(*[F.col(g).alias(f"_asked_{i}") for i, g in enumerate(groups)]).agg(F.collect_set("_part").alias("_parts"))
    own = files.select(*[F.col(g).alias(x) for g, x in zip(groups, names, strict=True)], F.col(content).alias("_content"))
    same = [F.col(x).eqNullSafe(F.col(f"_asked_{i}")) for i, x in enumerate(names)]
    copies = own.join(F.broadcast(asked), same, "inner").select(*names, "_content", F.explode("_parts").alias("_at"))
    return dealt.groupBy(*groups, "_part").cogroup(copies.groupBy(*names, "_at")).applyInArrow(run, schema)
