"""Messages between nodes as protocol buffer bytes, and back to columns.

The wire format is the public one (version 3): a varint tag of field number and
type, then a varint or a length and bytes; fields at their default are left out,
unknown ones are passed over.

Fixed values: field numbers, names and kinds of each message.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES: dict[str, list[tuple[int, str, str]]] = {
    "LogEntry": [(1, "index", "uint"), (2, "term", "uint"), (3, "command", "bytes")],
    "RequestVoteRequest": [(1, "term", "uint"), (2, "candidate_id", "string"), (3, "last_log_index", "uint"), (4, "last_log_term", "uint")],
    "RequestVoteReply": [(1, "term", "uint"), (2, "vote_granted", "bool")],
    "AppendEntriesRequest": [(1, "term", "uint"), (2, "leader_id", "string"), (3, "prev_log_index", "uint"), (4, "prev_log_term", "uint"), (5, "entries", "LogEntry"), (6, "leader_commit", "uint")],
    "AppendEntriesReply": [(1, "term", "uint"), (2, "success", "bool")],
    "InstallSnapshotRequest": [(1, "term", "uint"), (2, "leader_id", "string"), (3, "last_included_index", "uint"), (4, "last_included_term", "uint"), (5, "data", "bytes"), (6, "chunked", "bool"), (7, "offset", "uint"), (8, "final", "bool"), (9, "total_size", "uint"), (10, "checksum", "uint")],
    "InstallSnapshotReply": [(1, "term", "uint"), (2, "success", "bool")],
}
_DEFAULT = {"uint": 0, "bool": False, "string": "", "bytes": b""}
_TYPES = {"uint": T.LongType(), "bool": T.BooleanType(), "string": T.StringType(), "bytes": T.BinaryType()}


def struct_of(message: str) -> T.StructType:
    """Columns of a message; repeated messages are arrays of structs."""
    return T.StructType([T.StructField(name, _TYPES.get(kind) or T.ArrayType(struct_of(kind))) for _, name, kind in MESSAGES[message]])


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def encode(message: str, row: dict) -> bytes:
    """The bytes of a message; null fields are at their default."""
    out = []
    for number, name, kind in MESSAGES[message]:
        value = row.get(name)
        if kind in MESSAGES:
            made = [encode(kind, x if isinstance(x, dict) else x.asDict()) for x in (value if value is not None else [])]
        elif value is None or value == _DEFAULT[kind]:
            continue
        elif kind in ("uint", "bool"):
            out.append(_varint(number << 3) + _varint(int(value)))
            continue
        else:
            made = [value.encode() if kind == "string" else bytes(value)]
        out += [_varint(number << 3 | 2) + _varint(len(x)) + x for x in made]
    return b"".join(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError(f"bad varint at {at}")
        n |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return n, at


def decode(message: str, data: bytes) -> dict:
    """Fields of a message, those that are left out at their default; an error for bytes that are none."""
    fields = {number: (name, kind) for number, name, kind in MESSAGES[message]}
    out = {name: [] if kind in MESSAGES else _DEFAULT[kind] for _, name, kind in MESSAGES[message]}
    at = 0
    while at < len(data):
        tag, at = _read_varint(data, at)
        name, kind = fields.get(tag >> 3, (None, None))
        if tag & 7 == 0:
            value, at = _read_varint(data, at)
        elif tag & 7 == 2:
            n, at = _read_varint(data, at)
            value, at = data[at : at + n], at + n
        elif tag & 7 in (1, 5):
            n = 8 if tag & 7 == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"unknown wire type {tag & 7}")
        if at > len(data):
            raise ValueError("short message")
        if name is None:
            continue
        if (kind in ("uint", "bool")) != (tag & 7 == 0):
            raise ValueError(f"wrong wire type of {name}")
        if kind in MESSAGES:
            out[name].append(decode(kind, value))
        else:
            out[name] = bool(value) if kind == "bool" else value.decode() if kind == "string" else value
    return out


def to_bytes(message: str, *columns: Column | str) -> Column:
    """Bytes of a message from columns in the order of its fields, batch by batch."""
    names = [name for _, name, _ in MESSAGES[message]]

    @F.pandas_udf(T.BinaryType())
    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([encode(message, {k: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else v for k, v in zip(names, row, strict=True)}) for row in rows.itertuples(index=False, name=None)], dtype="object")

    return run(F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(columns, names, strict=True)]))


def from_bytes(message: str, column: Column | str) -> Column:
    """The struct of a message; null for null, an error for bytes that are none."""
    names = [name for _, name, _ in MESSAGES[message]]

    @F.pandas_udf(struct_of(message))
    def run(data: pd.Series) -> pd.DataFrame:
        rows = [decode(message, bytes(b)) if b is not None else dict.fromkeys(names) for b in data]
        return pd.DataFrame(rows, columns=names)

    return run(column)
