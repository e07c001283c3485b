"""Checksums, hashes and binary records, batch by batch.

Checksums and hashes of a batch of values are taken together in numpy, one byte
position of all values at a time; longer values are cut into parts that count as
values and are joined afterwards.

Fixed values: CRC-32C is the reflected polynomial 0x82F63B78 with all bits set at
start and end; FNV-64 starts from 14695981039346656037 with prime 1099511628211.
All integers of the layouts below are little-endian.  Files begin with eight
bytes that name the system that wrote them, which are a parameter here.
"""

from __future__ import annotations

import hmac
import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a part that a checksum is taken of at once.
PART = 256


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = c >> 1 ^ np.where(c & 1, np.uint32(0x82F63B78), np.uint32(0)).astype(np.uint32)
    return c


_CRC = _crc_table()
_CRC_LIST = _CRC.tolist()


def _after_part() -> np.ndarray:
    """What a register becomes after PART zero bytes, by each of its four bytes."""
    out = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for _ in range(PART):
        out = out >> 8 ^ _CRC[out & 255]
    return out


_AFTER = _after_part()


def crc32c_bytes(data: bytes) -> int:
    if len(data) > 4 * PART:
        return int(crc32c_many(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0])
    c = 0xFFFFFFFF
    for b in data:
        c = c >> 8 ^ _CRC_LIST[(c ^ b) & 255]
    return c ^ 0xFFFFFFFF


def crc32c_many(buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """CRC-32C of values that lie one after another: value i is ``buf[bounds[i]:bounds[i + 1]]``."""
    return crc32c_spans(buf, bounds[:-1], bounds[1:])


def crc32c_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32C of the values from ``starts`` to ``ends`` of a buffer."""
    size = ends - starts
    parts = np.maximum(-(-size // PART), 1)
    value = np.repeat(np.arange(len(size)), parts)
    at = np.arange(len(value)) - np.repeat(np.cumsum(parts) - parts, parts)
    odd = size - (parts - 1) * PART  # the first part is the odd one, so all others are of one size
    a = np.where(at == 0, starts[value], starts[value] + odd[value] + (at - 1) * PART)
    n = np.where(at == 0, odd[value], PART)
    c = np.where(at == 0, np.uint32(0xFFFFFFFF), np.uint32(0)).astype(np.uint32)
    order = np.argsort(-n, kind="stable")
    longest_first, begin = n[order], a[order]
    own = c[order]
    live = len(order)
    for i in range(int(longest_first[0]) if len(order) else 0):
        while live and longest_first[live - 1] <= i:
            live = int(np.searchsorted(-longest_first, -i, side="left"))
        own[:live] = own[:live] >> 8 ^ _CRC[(own[:live] ^ buf[begin[:live] + i]) & 255]
    c[order] = own
    # join the parts: the register so far, after as many zero bytes, and the part's own
    first = np.cumsum(parts) - parts
    out = c[first] if len(first) else np.zeros(0, np.uint32)
    for k in range(1, int(parts.max(initial=1))):
        some = np.flatnonzero(parts > k)
        x = out[some]
        out[some] = _AFTER[0][x & 255] ^ _AFTER[1][x >> 8 & 255] ^ _AFTER[2][x >> 16 & 255] ^ _AFTER[3][x >> 24] ^ c[first[some] + k]
    return out ^ np.uint32(0xFFFFFFFF)


_FNV_START, _FNV_PRIME = np.uint64(14695981039346656037), np.uint64(1099511628211)


def fnv64_bytes(data: bytes, a: bool = True) -> int:
    """FNV-1a, or FNV-1, as an unsigned number."""
    return int(fnv64_many(np.frombuffer(data, np.uint8), np.array([0, len(data)]), a)[0])


def fnv64_many(buf: np.ndarray, bounds: np.ndarray, a: bool = True) -> np.ndarray:
    """FNV-1a, or FNV-1, of values that lie one after another."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    n, begin = size[order], bounds[:-1][order]
    h = np.full(len(order), _FNV_START, np.uint64)
    for i in range(int(n[0]) if len(n) else 0):
        live = int(np.searchsorted(-n, -i, side="left"))
        x = buf[begin[:live] + i].astype(np.uint64)
        h[:live] = (h[:live] ^ x) * _FNV_PRIME if a else h[:live] * _FNV_PRIME ^ x
    out = np.empty(len(order), np.uint64)
    out[order] = h
    return out


def _joined(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.zeros(len(data) + 1, np.int64)
    np.cumsum([len(x) for x in data], out=bounds[1:])
    return np.frombuffer(b"".join(data), np.uint8), bounds


def _of_batch(data: pd.Series, work) -> pd.Series:
    """work on the values that are not null."""
    out = pd.Series([None] * len(data), dtype="object")
    some = np.flatnonzero(data.notna().to_numpy())
    if len(some):
        out.iloc[some] = work(*_joined([bytes(x) for x in data.iloc[some]]))
    return out


@F.pandas_udf(T.LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """CRC-32C of binary values; null for null."""
    return _of_batch(data, lambda buf, bounds: crc32c_many(buf, bounds).astype(np.int64).tolist()).astype("Int64")


def _decimals(h: np.ndarray) -> list:
    from decimal import Decimal

    return [Decimal(x) for x in h.tolist()]


@F.pandas_udf(T.DecimalType(20, 0))
def fnv1a(data: pd.Series) -> pd.Series:
    return _of_batch(data, lambda buf, bounds: _decimals(fnv64_many(buf, bounds)))


@F.pandas_udf(T.DecimalType(20, 0))
def fnv1(data: pd.Series) -> pd.Series:
    return _of_batch(data, lambda buf, bounds: _decimals(fnv64_many(buf, bounds, a=False)))


def same_bytes(a: bytes, b: bytes) -> bool:
    """Equality in a time that does not tell where two values differ."""
    return hmac.compare_digest(a, b)


# -- write-ahead log records ---------------------------------------------------

#: Header is checksum, operation, key and value length, little-endian.
HEADER, HEADER_BYTES = "<IBII", 13
PUT, DELETE = 1, 2
MOST_KEY, MOST_VALUE = 1 << 20, 64 << 20


def encode_record(op: int, key: bytes, value: bytes = b"") -> bytes:
    """A record; the checksum covers all that follows it."""
    if op not in (PUT, DELETE) or not 0 < len(key) <= MOST_KEY or len(value) > MOST_VALUE:
        raise ValueError("bad operation, key or value")
    rest = struct.pack("<BII", op, len(key), len(value)) + key + value
    return struct.pack("<I", crc32c_bytes(rest)) + rest


def encode_records(records: list[tuple[int, bytes, bytes]]) -> bytes:
    """Records one after another, their checksums taken together."""
    rest = []
    for op, key, value in records:
        if op not in (PUT, DELETE) or not 0 < len(key) <= MOST_KEY or len(value) > MOST_VALUE:
            raise ValueError("bad operation, key or value")
        rest.append(struct.pack("<BII", op, len(key), len(value)) + key + value)
    sums = crc32c_many(*_joined(rest)).astype("<u4").tobytes()
    return b"".join(x for i, r in enumerate(rest) for x in (sums[4 * i : 4 * i + 4], r))


def scan_records(data: bytes) -> tuple[np.ndarray, str]:
    """Where the records of a log begin, with its end, as far as headers and lengths are right; and what stands there: END, TORN or CORRUPT.

    A bad header is corruption even at the end; only a short header or payload is torn.
    """
    at, out, size = 0, [0], len(data)
    while at < size:
        if size - at < HEADER_BYTES:
            return np.array(out), "TORN"
        _, op, k, v = struct.unpack_from(HEADER, data, at)
        if op not in (PUT, DELETE) or not 0 < k <= MOST_KEY or v > MOST_VALUE:
            return np.array(out), "CORRUPT"
        if at + HEADER_BYTES + k + v > size:
            return np.array(out), "TORN"
        at += HEADER_BYTES + k + v
        out.append(at)
    return np.array(out), "END"


def decode_columns(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, str]:
    """(offsets with the end, operations, key lengths, value lengths, what ends it) of a log's valid records."""
    bounds, end = scan_records(data)
    buf = np.frombuffer(data, np.uint8)
    at = bounds[:-1]
    if not len(at):
        return bounds, *(np.zeros(0, np.int64),) * 3, end
    number = lambda from_: sum(buf[at + from_ + i].astype(np.int64) << (8 * i) for i in range(4))
    bad = np.flatnonzero(crc32c_spans(buf, at + 4, bounds[1:]) != number(0))
    n = len(at)
    if len(bad):
        n, end = int(bad[0]), "CORRUPT"
    return bounds[: n + 1], buf[at[:n] + 4].astype(np.int64), number(5)[:n], number(9)[:n], end


def decode_records(data: bytes) -> Iterator[tuple[int, str | None, bytes | None, bytes | None, str]]:
    """(offset, op, key, value, status) of a log: OK rows, then one of TORN or CORRUPT unless it ends cleanly."""
    bounds, op, k, v, end = decode_columns(data)
    for a, b, o, n in zip(bounds[:-1].tolist(), bounds[1:].tolist(), op.tolist(), k.tolist(), strict=True):
        yield a, "PUT" if o == PUT else "DELETE", data[a + HEADER_BYTES : a + HEADER_BYTES + n], data[a + HEADER_BYTES + n : b], "OK"
    if end != "END":
        yield int(bounds[-1]), None, None, None, end


def valid_prefix(data: bytes) -> bytes:
    """A log without its torn tail; an error if it is corrupt, as then nothing after is to be trusted."""
    bounds, *_, end = decode_columns(data)
    if end == "CORRUPT":
        raise ValueError(f"corrupt at {int(bounds[-1])}")
    return data[: int(bounds[-1])]


def encode_log(records: DataFrame, keys: list[str], order: str, op: str = "op", key: str = "key", value: str = "value") -> DataFrame:
    """One log (content) per group, its records in order.  A group is one file, so one task writes it: the caller bounds it."""
    fields = [F.col(k) for k in keys]
    src = records.select(*fields, F.col(order).alias("_o"), F.col(op).alias("_op"), F.col(key).cast("binary").alias("_k"), F.col(value).cast("binary").alias("_v"))
    schema = T.StructType([*[src.schema[k] for k in keys], T.StructField("content", T.BinaryType())])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("_o")
        ops, names, values = (t.column(c).to_pylist() for c in ("_op", "_k", "_v"))
        data = encode_records([(PUT if o == "PUT" else DELETE, k, v or b"") for o, k, v in zip(ops, names, values, strict=True)])
        return pa.Table.from_arrays([*(t.column(k).slice(0, 1) for k in keys), pa.array([data], pa.binary())], names=schema.names)

    return src.groupBy(*keys).applyInArrow(run, schema)


def _slices(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values cut from a buffer without a step for each."""
    size = ends - starts
    bounds = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=bounds[1:])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - starts, size)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(buf[at].tobytes())]).cast(pa.binary())


#: Records of a log that are given out at once.
RECORDS = 50_000


def decode_log(files: DataFrame, content: str = "content") -> DataFrame:
    """Records of logs held as binary: other columns, offset, op, key, value, status.  Files in parallel, records in order."""
    others = [c for c in files.columns if c != content]
    schema = T.StructType([*[files.schema[c] for c in others], *T.StructType.fromDDL("offset long, op string, key binary, value binary, status string")])
    at = files.columns.index(content)
    kept = [files.columns.index(c) for c in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(at)[i].as_py() or b""
                bounds, op, k, _, end = decode_columns(data)
                buf = np.frombuffer(data, np.uint8)
                repeat = lambda n, i=i, batch=batch: [batch.column(c).take(pa.array(np.full(n, i))) for c in kept]
                for x in range(0, len(op), RECORDS):
                    a, b, n = bounds[:-1][x : x + RECORDS], bounds[1:][x : x + RECORDS], k[x : x + RECORDS]
                    names = pa.array(np.where(op[x : x + RECORDS] == PUT, "PUT", "DELETE").tolist(), pa.string())
                    yield pa.RecordBatch.from_arrays([*repeat(len(a)), pa.array(a), names, _slices(buf, a + HEADER_BYTES, a + HEADER_BYTES + n), _slices(buf, a + HEADER_BYTES + n, b), pa.array(["OK"] * len(a))], names=schema.names)
                if end != "END":
                    yield pa.RecordBatch.from_arrays([*repeat(1), pa.array([int(bounds[-1])]), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([end])], names=schema.names)

    return files.mapInArrow(run, schema)


def truncate_torn(files: DataFrame, content: str = "content") -> DataFrame:
    """Logs with a torn tail cut off, and ``cut``: the bytes that went.  A corrupt log ends the job in an error."""

    @F.pandas_udf(T.BinaryType())
    def cut(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else valid_prefix(bytes(b)))

    out = files.withColumn("_kept", cut(content))
    return out.withColumn("cut", F.octet_length(content) - F.octet_length("_kept")).withColumn(content, F.col("_kept")).drop("_kept")


# -- commands ------------------------------------------------------------------

OPS = {"PUT": 1, "DELETE": 2}
#: Bounds of a command's fields.
MOST_CLIENT, MOST_COMMAND_VALUE = 4096, 1 << 20


class Reader:
    """Fields of a layout, each checked against what is left and against its bound."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def number(self, size: int) -> int:
        if len(self.data) - self.at < size:
            raise ValueError(f"short: {size} bytes wanted at {self.at}")
        self.at += size
        return int.from_bytes(self.data[self.at - size : self.at], "little")

    def bytes(self, most: int, least: int = 0, size: int | None = None) -> bytes:
        """A value after its length (or of a length told before)."""
        n = self.number(4) if size is None else size
        if not least <= n <= most:
            raise ValueError(f"length {n} out of bounds at {self.at}")
        if len(self.data) - self.at < n:
            raise ValueError(f"short: {n} bytes wanted at {self.at}")
        self.at += n
        return self.data[self.at - n : self.at]

    def end(self) -> None:
        if self.at != len(self.data):
            raise ValueError(f"{len(self.data) - self.at} bytes too many")


def _sized(data: bytes) -> bytes:
    return struct.pack("<I", len(data)) + data


def encode_command(client: str, request: int, op: str, key: bytes, value: bytes) -> bytes:
    """Fixed layout: operation, client (with its length), request of eight bytes, key and value (with their lengths)."""
    c = client.encode()
    if op not in OPS or len(c) > MOST_CLIENT or len(key) > MOST_KEY or len(value) > MOST_COMMAND_VALUE:
        raise ValueError("unknown operation or field out of bounds")
    return bytes([OPS[op]]) + _sized(c) + struct.pack("<Q", request) + _sized(key) + _sized(value)


def decode_command(data: bytes) -> tuple[str, int, str, bytes, bytes]:
    """The command; an error for a short field, an unknown operation, a length out of bounds, or bytes left over."""
    r = Reader(data)
    names = {n: o for o, n in OPS.items()}
    op = r.number(1)
    if op not in names:
        raise ValueError(f"unknown operation {op}")
    client, request = r.bytes(MOST_CLIENT), r.number(8)
    key, value = r.bytes(MOST_KEY), r.bytes(MOST_COMMAND_VALUE)
    r.end()
    return client.decode(), request, names[op], key, value


_COMMAND = T.StructType([T.StructField("client_id", T.StringType()), T.StructField("request_id", T.LongType()), T.StructField("op", T.StringType()), T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()), T.StructField("error", T.StringType())])


@F.pandas_udf(_COMMAND)
def decoded_command(data: pd.Series) -> pd.DataFrame:
    rows = []
    for b in data:
        try:
            rows.append((*decode_command(bytes(b or b"")), None))
        except ValueError as e:
            rows.append((None, None, None, None, None, str(e)))
    return pd.DataFrame(rows, columns=["client_id", "request_id", "op", "key", "value", "error"])


@F.pandas_udf(T.BinaryType())
def encoded_command(client: pd.Series, request: pd.Series, op: pd.Series, key: pd.Series, value: pd.Series) -> pd.Series:
    return pd.Series([encode_command(c, int(r), o, bytes(k), b"" if v is None else bytes(v)) for c, r, o, k, v in zip(client, request, op, key, value, strict=True)])


# -- whole files: magic, version, body, checksum ---------------------------------

VERSION = 1


def seal(magic: bytes, body: bytes) -> bytes:
    """A file: eight bytes of magic, the version, the body, and the checksum of all of it."""
    if len(magic) != 8:
        raise ValueError("magic is eight bytes")
    data = magic + struct.pack("<I", VERSION) + body
    return data + struct.pack("<I", crc32c_bytes(data))


def unseal(magic: bytes, data: bytes, most: int) -> Reader:
    """A reader of the body; an error for a file too large, short, of another magic or version, or damaged."""
    if len(data) > most:
        raise ValueError("file too large")
    if len(data) < 16 or data[:8] != magic:
        raise ValueError("bad magic or short file")
    if struct.unpack_from("<I", data, 8)[0] != VERSION:
        raise ValueError("unknown version")
    if struct.unpack("<I", data[-4:])[0] != crc32c_bytes(data[:-4]):
        raise ValueError("bad checksum")
    return Reader(data[:-4], 12)


#: Bounds of the persisted state of a node.
MOST_VOTE, MOST_ENTRIES, MOST_COMMAND, MOST_STATE = 4096, 1 << 20, 1 << 20, 1 << 30


def encode_state(term: int, voted_for: str, log: list[tuple[int, int, bytes]], magic: bytes) -> bytes:
    """Fixed layout: term, vote, number of entries, then of each its index, term and command."""
    v = voted_for.encode()
    if len(v) > MOST_VOTE or len(log) > MOST_ENTRIES or any(len(c) > MOST_COMMAND for _, _, c in log):
        raise ValueError("field out of bounds")
    return seal(magic, struct.pack("<Q", term) + _sized(v) + struct.pack("<I", len(log)) + b"".join(struct.pack("<QQ", i, t) + _sized(c) for i, t, c in log))


def decode_state(data: bytes, magic: bytes) -> tuple[int, str, list[tuple[int, int, bytes]]]:
    """What was encoded; an error for damage, a field out of bounds, gaps, an index of 0, or terms that fall or pass the current one."""
    r = unseal(magic, data, MOST_STATE)
    term, voted, count = r.number(8), r.bytes(MOST_VOTE).decode(), r.number(4)
    if count > MOST_ENTRIES:
        raise ValueError("too many entries")
    log: list[tuple[int, int, bytes]] = []
    for _ in range(count):
        i, t, c = r.number(8), r.number(8), r.bytes(MOST_COMMAND)
        if i != (log[-1][0] + 1 if log else max(i, 1)) or (log and t < log[-1][1]):
            raise ValueError("gap, index 0 or falling term")
        log.append((i, t, c))
    r.end()
    if log and log[-1][1] > term:
        raise ValueError("term beyond the current one")
    return term, voted, log


#: Bounds of a snapshot's payload and file.
MOST_SNAPSHOT, MOST_SNAPSHOT_FILE = 1 << 28, 1 << 29


def encode_snapshot(idx: int, term: int, payload: bytes, magic: bytes) -> bytes:
    """Fixed layout: last index and term that the payload covers, and the payload."""
    if len(payload) > MOST_SNAPSHOT:
        raise ValueError("payload out of bounds")
    return seal(magic, struct.pack("<QQ", idx, term) + _sized(payload))


def decode_snapshot(data: bytes, magic: bytes) -> tuple[int, int, bytes]:
    r = unseal(magic, data, MOST_SNAPSHOT_FILE)
    out = r.number(8), r.number(8), r.bytes(MOST_SNAPSHOT)
    r.end()
    return out


#: Bounds of a manifest, and of any of its files.
MOST_TABLES, MOST_NAME = 1 << 20, 4096


def encode_manifest(next_id: int, tables: list[tuple[int, str]], magic: bytes) -> bytes:
    """Fixed layout: next id, number of tables, then of each its id and file name."""
    return seal(magic, struct.pack("<QI", next_id, len(tables)) + b"".join(struct.pack("<Q", i) + _sized(name.encode()) for i, name in tables))


def decode_manifest(data: bytes, magic: bytes) -> tuple[int, list[tuple[int, str]]]:
    r = unseal(magic, data, 1 << 33)
    next_id, n = r.number(8), r.number(4)
    if n > MOST_TABLES:
        raise ValueError("too many tables")
    tables = [(r.number(8), r.bytes(MOST_NAME, 1).decode()) for _ in range(n)]
    r.end()
    return next_id, tables


#: Codes of the error that a client's last result holds.
RESULT_ERRORS = {"none": 0, "conflict": 1, "stale": 2, "empty_key": 3}
MOST_KEYS, MOST_CLIENTS = 1 << 20, 1 << 20


def encode_machine(keys: list[tuple[bytes, bytes]], clients: list[tuple], magic: bytes) -> bytes:
    """A state machine: keys with values in order of key, then of each client in order of id
    (client, request, op, key, value, applied, replayed, result key, result value, error).  Equal states give equal bytes."""
    if len(keys) > MOST_KEYS or len(clients) > MOST_CLIENTS:
        raise ValueError("too many keys or clients")
    out = [struct.pack("<I", len(keys)), *(_sized(k) + _sized(v) for k, v in sorted(keys)), struct.pack("<I", len(clients))]
    for client, request, op, k, v, applied, replayed, rk, rv, error in sorted(clients, key=lambda c: c[0].encode()):
        out += [_sized(client.encode()), struct.pack("<QB", request, OPS[op]), _sized(k), _sized(v), bytes([applied, replayed]), _sized(rk), _sized(rv), bytes([RESULT_ERRORS[error]])]
    return seal(magic, b"".join(out))


def decode_machine(data: bytes, magic: bytes) -> tuple[list[tuple[bytes, bytes]], list[tuple]]:
    r = unseal(magic, data, MOST_SNAPSHOT_FILE)
    n = r.number(4)
    if n > MOST_KEYS:
        raise ValueError("too many keys")
    keys = [(r.bytes(MOST_KEY), r.bytes(MOST_COMMAND_VALUE)) for _ in range(n)]
    n = r.number(4)
    if n > MOST_CLIENTS:
        raise ValueError("too many clients")
    ops, errors = ({n: x for x, n in names.items()} for names in (OPS, RESULT_ERRORS))
    clients = []
    for _ in range(n):
        client, request, op = r.bytes(MOST_CLIENT).decode(), r.number(8), r.number(1)
        own = r.bytes(MOST_KEY), r.bytes(MOST_COMMAND_VALUE), r.number(1) != 0, r.number(1) != 0, r.bytes(MOST_KEY), r.bytes(MOST_COMMAND_VALUE)
        error = r.number(1)
        if op not in ops or error not in errors:
            raise ValueError("unknown operation or error")
        clients.append((client, request, ops[op], *own, errors[error]))
    r.end()
    return keys, clients


# -- bloom filters -------------------------------------------------------------

#: Fixed value: bits of a filter at most.
MOST_BITS = 1 << 34


def bloom_size(n: int, p: float = 0.01) -> tuple[int, int]:
    """(bits, hashes) for n keys at false positive rate p."""
    n = max(n, 1)
    m = max(64, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return m, min(30, max(1, math.floor(m / n * math.log(2) + 0.5)))


def probes(key: bytes, m: int, k: int) -> list[int]:
    """Bit positions of a key by double hashing."""
    return probes_many([key], m, k)[0].tolist()


def probes_many(keys: list[bytes], m: int, k: int) -> np.ndarray:
    """Bit positions of each key: h1 + i h2 in 64 bits, then by the number of bits."""
    buf, bounds = _joined(keys)
    a, b = fnv64_many(buf, bounds), fnv64_many(buf, bounds, a=False)
    return (a[:, None] + np.arange(k, dtype=np.uint64) * b[:, None]) % np.uint64(m)


def bloom_bits(keys: list[bytes], m: int, k: int) -> bytes:
    """Bit i of a filter is bit i % 8 of byte i // 8."""
    bits = np.zeros(m, bool)
    bits[probes_many(keys, m, k).ravel().astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def bloom_test(keys: list[bytes], m: int, k: int, bits: bytes) -> np.ndarray:
    """May each key be in: never false for one that is."""
    own = np.frombuffer(bits, np.uint8)
    at = probes_many(keys, m, k)
    return ((own[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)


def encode_bloom(m: int, k: int, bits: bytes) -> bytes:
    """Fixed layout: hashes, bits, bytes, the filter, a checksum."""
    data = struct.pack("<BQI", k, m, len(bits)) + bits
    return data + struct.pack("<I", crc32c_bytes(data))


def decode_bloom(data: bytes) -> tuple[int, int, bytes]:
    """(bits, hashes, filter); an error for damage or sizes that do not fit each other."""
    r = Reader(data)
    k, m, n = r.number(1), r.number(8), r.number(4)
    if not 0 < k <= 64 or not 0 < m <= MOST_BITS or n != -(-m // 8):
        raise ValueError("sizes do not fit")
    bits = r.bytes(n, size=n)
    if r.number(4) != crc32c_bytes(data[: 13 + n]):
        raise ValueError("bad checksum")
    r.end()
    return m, k, bits


def bloom_build(keys: DataFrame, column: str, groups: list[str], p: float = 0.01, parts: int = 16) -> DataFrame:
    """Filter of each group: groups, n_keys, bits (number), hashes, filter (binary).

    A group's keys are dealt into parts that set bits apart; the parts' filters,
    of the group's one size, are then joined, so no task holds all keys of a group.
    """
    own = keys.select(*groups, F.col(column).cast("string").cast("binary").alias("_key")).where("_key is not null").distinct()
    own = own.withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(parts)).cast("int"))
    n = own.groupBy(*groups, "_part").agg(F.count("*").alias("_n")).groupBy(*groups).agg(F.sum("_n").alias("n_keys"))
    sized = [*[keys.schema[g] for g in groups], *T.StructType.fromDDL("n_keys long, bits long, hashes int, filter binary")]
    schema = T.StructType(sized)

    def part(t: pa.Table, size: pa.Table) -> pa.Table:
        total = size.column("n_keys")[0].as_py()
        m, k = bloom_size(total, p)
        bits = bloom_bits(t.column("_key").to_pylist(), m, k)
        return pa.Table.from_arrays([*(size.column(i).slice(0, 1) for i in range(len(groups))), pa.array([total]), pa.array([m]), pa.array([k], pa.int32()), pa.array([bits], pa.binary())], names=schema.names)

    def join(t: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("filter").to_pylist()])
        return t.slice(0, 1).set_column(t.column_names.index("filter"), "filter", pa.array([bits.tobytes()], pa.binary()))

    names = [f"_of_{i}" for i in range(len(groups))]  # other names: both sides come from the same keys
    dealt = n.select(*[F.col(g).alias(x) for g, x in zip(groups, names, strict=True)], "n_keys", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_at"))
    made = own.groupBy(*groups, "_part").cogroup(dealt.groupBy(*names, "_at")).applyInArrow(part, schema)
    return made.groupBy(*groups).applyInArrow(join, schema)


def may_contain(filters: DataFrame, probes_df: DataFrame, column: str) -> DataFrame:
    """Each probe (few, stated: they go to every filter) with each filter: may_contain, never false for a key that is in."""
    kept = [c for c in filters.columns if c != "filter"]
    told = probes_df.limit(MOST_PROBES + 1).toArrow()
    if told.num_rows > MOST_PROBES:
        raise ValueError(f"more than {MOST_PROBES} probes: use may_contain_own")
    asked = probes_df.sparkSession.sparkContext.broadcast(told)
    schema = T.StructType([*[filters.schema[c] for c in kept], *probes_df.schema.fields, T.StructField("may_contain", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = asked.value.combine_chunks()
        keys = [str(x).encode() for x in rows.column(column).to_pylist()]
        for b in batches:
            for i, (m, k, bits) in enumerate(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("bits", "hashes", "filter")), strict=True)):
                own = [b.column(b.schema.get_field_index(c)).take(pa.array(np.full(len(keys), i))) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, *(c.combine_chunks() for c in rows.columns), pa.array(bloom_test(keys, m, k, bits) if keys else np.zeros(0, bool))], names=schema.names)

    return filters.mapInArrow(run, schema)


#: Probes that may go to every filter.
MOST_PROBES = 100_000


def may_contain_own(filters: DataFrame, probes_df: DataFrame, column: str, groups: list[str], parts: int = 16) -> DataFrame:
    """Probes with may_contain: each against the filter of its own group, false where the group has none.

    Probes are dealt into ``parts`` a group, each with a copy of the group's filter.
    """
    schema = T.StructType([*probes_df.schema, T.StructField("may_contain", T.BooleanType())])

    def run(own: pa.Table, f: pa.Table) -> pa.Table:
        own = own.drop_columns(["_part"])
        if own.num_rows and f.num_rows:
            m, k, bits = (f.column(c)[0].as_py() for c in ("bits", "hashes", "filter"))
            found = bloom_test([str(x).encode() for x in own.column(column).to_pylist()], m, k, bits)
        else:
            found = np.zeros(own.num_rows, bool)
        return own.append_column("may_contain", pa.array(found))

    dealt = probes_df.withColumn("_part", F.pmod(F.xxhash64(column), F.lit(parts)).cast("int"))
    names = [f"_of_{i}" for i in range(len(groups))]
    copies = filters.select(*[F.col(g).alias(x) for g, x in zip(groups, names, strict=True)], "bits", "hashes", "filter", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_at"))
    return dealt.groupBy(*groups, "_part").cogroup(copies.groupBy(*names, "_at")).applyInArrow(run, schema)


def little_endian(data: Column, at: int, n: int) -> Column:
    """Unsigned number of n bytes (7 at most) from byte ``at`` (counted from 1)."""
    byte = lambda i: F.conv(F.hex(F.substring(data, at + i, 1)), 16, 10).cast("long")
    out = byte(0)
    for i in range(1, n):
        out = out + byte(i) * (1 << (8 * i))
    return out
