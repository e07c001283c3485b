"""Vectorised text primitives shared by the operators of this subpackage.

An Arrow string column is one byte buffer with offsets, so a whole batch of
documents is tokenised and hashed with a handful of numpy passes instead of a
Python loop over documents.  All word definitions used here treat every byte
of a multi-byte UTF-8 character alike, which makes byte-level work exact.

Null text counts as empty text everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text handled at a time inside a task; bounds the numpy temporaries.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch between the JVM and Python.
BATCH_ROWS = 1000


def _table(members: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(members)] = True
    return t


#: Separators of the words ``[^\x20\x09-\x0D]+``.
SPACE = _table(b" \t\n\x0b\x0c\r")
#: Separators of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (of lower-cased text).
NON_ALNUM = _table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Texts:
    """The byte buffer of a batch of texts: text i is ``buf[offs[i]:offs[i+1]]``."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs = buf, offs

    def __len__(self) -> int:
        return len(self.offs) - 1

    @staticmethod
    def of(column: pa.Array | pa.ChunkedArray) -> Texts:
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
        if pa.types.is_null(column.type):
            column = column.cast(pa.string())
        if column.null_count:
            column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        n = len(column)
        if n == 0:
            return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        _, o, d = column.buffers()
        offs = np.frombuffer(o, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
        data = np.frombuffer(d, np.uint8) if d is not None else np.zeros(0, np.uint8)
        return Texts(data[offs[0] : offs[-1]], offs - offs[0])

    def part(self, a: int, b: int) -> Texts:
        return Texts(self.buf[self.offs[a] : self.offs[b]], self.offs[a : b + 1] - self.offs[a])

    def lower(self) -> Texts:
        return Texts(LOWER[self.buf], self.offs)

    def bytes(self, i: int) -> bytes:
        return self.buf[self.offs[i] : self.offs[i + 1]].tobytes()

    def slices(self, most: int = SLICE_BYTES, rows: int = 60_000) -> Iterator[tuple[int, int]]:
        """Ranges of whole texts of about ``most`` bytes; a longer text stands alone."""
        a, n = 0, len(self)
        while a < n:
            b = int(np.searchsorted(self.offs, self.offs[a] + most, side="right")) - 1
            b = min(max(b, a + 1), n, a + rows)
            yield a, b
            a = b


class Words:
    """Words of a batch: word j is ``buf[starts[j]:ends[j]]``; those of text i are bounds[i]..bounds[i+1]."""

    def __init__(self, texts: Texts, separators: np.ndarray):
        buf, offs = texts.buf, texts.offs
        self.buf = buf
        if len(buf) == 0:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.bounds = np.zeros(len(texts) + 1, np.int64)
            return
        word = ~separators[buf]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        stops = word.copy()
        stops[:-1] &= ~word[1:]
        inner = offs[1:-1]
        at = inner[inner < len(buf)]
        begins[at] = word[at]  # words do not run over the end of a text
        at = inner[inner > 0] - 1
        stops[at] = word[at]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.bounds = np.searchsorted(self.starts, offs)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc(self) -> np.ndarray:
        """Of each word, the text that holds it."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        n = len(self.buf)
        if not len(self):
            return np.zeros(0, np.uint64)
        power, inverse = _powers(n)
        c = np.empty(n + 1, np.uint64)
        c[0] = 0
        np.cumsum(_BYTE_CODES[self.buf] * power[:n], out=c[1:])
        h = (c[self.ends] - c[self.starts]) * inverse[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64))


def windows(h: np.ndarray, bounds: np.ndarray, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k items within one text: (index of the first item, hash)."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power, inverse = _powers(n + 1)
    c = np.empty(n + 1, np.uint64)
    c[0] = 0
    np.cumsum((mix(h + np.uint64(salt)) if salt else h) * power[:n], out=c[1:])
    w = (c[k:] - c[:-k]) * inverse[: n - k + 1]
    last = np.repeat(bounds[1:], np.diff(bounds))[: n - k + 1]
    at = np.flatnonzero(np.arange(n - k + 1) + k <= last)
    return at, mix(w[at] + np.uint64(k))


_GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (32, 0xD6E8FEB86659FD93)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(32)
    return x


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_GOLDEN))
_BASE = 0x5851F42D4C957F2D | 3
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << math.ceil(math.log2(n + 1)))
        made = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            a = np.full(size, b & _MASK, np.uint64)
            a[0] = 1
            made.append(np.multiply.accumulate(a))
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def group_starts(s: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array."""
    if not len(s):
        return np.zeros(0, np.int64)
    return np.concatenate(([0], np.flatnonzero(s[1:] != s[:-1]) + 1))


# -- packed numbers -----------------------------------------------------------


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending uint64 numbers as byte planes of their differences (which compress well)."""
    d = np.diff(a, prepend=np.uint64(0)) if len(a) else a
    return np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(a: np.ndarray) -> bytes:
    """Counts below 2**32 as byte planes."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack_counts(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


# -- Spark helpers ------------------------------------------------------------


def tune(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes; long texts otherwise make them large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less the columns that clash (in any case) with an operator's outputs: outputs replace them."""
    taken = {n.lower() for n in names}
    return df.select([f"`{c}`" for c in df.columns if c.lower() not in taken])


def attach(df: DataFrame, text_col: str, outputs: T.StructType, work: Callable[[pa.RecordBatch, Texts], list[pa.Array]]) -> DataFrame:
    """df with columns computed from whole texts, batch by batch.  Outputs replace columns of the same name."""
    tune(df.sparkSession)
    own = [f.name for f in outputs]
    if text_col.lower() in {n.lower() for n in own}:
        raise ValueError(f"{text_col} is both the text and an output")
    df = without(df, own)
    schema = T.StructType([*df.schema.fields, *outputs.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = work(b, Texts.of(b.column(b.schema.get_field_index(text_col))))
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *own])

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A name like this one that no column of df has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes of all texts, with 32 for each row; 1 for an empty table."""
    from pyspark.sql import functions as F

    return int(df.agg(F.sum(F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) + 32)).first()[0] or 1)


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own in the shared folder: computed once, and not again when an executor is lost."""
    import uuid

    folder = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset."""
    import tempfile

    jsc = spark.sparkContext._jsc.sc()
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told:
        at = jsc.getCheckpointDir()
        told = at.get() if at.isDefined() else None
    if not told:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", told)
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(told)
    return told.rstrip("/")
