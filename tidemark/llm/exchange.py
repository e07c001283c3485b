"""Bucketed exchange: batches of documents ask questions about the whole corpus.

Documents are dealt into buckets of a few MB by a hash of their content, and
buckets to partitions by their number, so no partition gets two while another has
none.  A bucket's task reduces its texts to sorted distinct keys (hashes of windows,
words, byte contexts) and sends each range of keys to a part as one packed row.
A part sees every bucket's keys of its range, decides, and answers each bucket
in the order it asked.  Buckets then read the answers next to their texts.

No key gets a row of its own, a key that many documents share costs one entry
per bucket, and nothing is collected on the driver.  The number of buckets and
parts follows the bytes of the texts themselves (not of the files, which may be
compressed to any degree), so a task's memory does not grow with the input.  All
rounds of an operator read one exchange of the texts.  Rows that are equal in all
columns share a bucket: give rows an id where very many may be equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.textcore import fresh, text_bytes, tune

#: Bytes of text that a bucket and a part stand for.
BUCKET_BYTES = 6 << 20
PART_BYTES = 12 << 20
#: Partitions at most; more buckets or parts than that share them evenly.
PARTITIONS = 20_000

Row = tuple[int, int, int, bytes, bytes]


class Exchange:
    def __init__(self, df: DataFrame, text_col: str, least: int = 48, bucket_bytes: int = BUCKET_BYTES, part_bytes: int = PART_BYTES):
        tune(df.sparkSession)
        size = text_bytes(df, text_col)
        self.buckets = max(least, -(-size // bucket_bytes))
        self.parts = max(24, -(-size // part_bytes))
        self.partitions = min(self.buckets, PARTITIONS)
        self.key = fresh(df, "_bucket")
        keys = [F.col(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, (T.StringType, T.NumericType, T.BooleanType, T.BinaryType))]
        self.docs = df.withColumn(self.key, F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")).repartitionById(self.partitions, self.key)
        self.text = self.docs.columns.index(text_col)

    def ask(self, work: Callable[[pa.Table], Iterator[Row]], answers: DataFrame | None = None) -> DataFrame:
        """Requests (kind, part, bucket, keys, notes) of all buckets, which may use earlier answers."""
        schema = "kind int, part int, bucket int, keys binary, notes binary"

        def rows(made: Iterator[Row]) -> pa.Table:
            cols = list(zip(*made, strict=True)) or [[]] * 5
            return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["kind", "part", "bucket", "keys", "notes"])

        if answers is None:
            return self.docs.groupBy(self.key).applyInArrow(lambda t: rows(work(t)), schema)
        return self._with(answers, lambda t, a: rows(work(t, a)), schema)

    def answer(self, requests: DataFrame, work: Callable[[int, int, list[bytes], list[bytes]], list[bytes]]) -> DataFrame:
        """Answers (kind, part, bucket, data): work gets a part's kind, number, keys and notes, and answers each in order."""

        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by("bucket")
            made = work(t.column("kind")[0].as_py(), t.column("part")[0].as_py(), t.column("keys").to_pylist(), t.column("notes").to_pylist())
            return pa.Table.from_arrays([t.column("kind"), t.column("part"), t.column("bucket"), pa.array(made, pa.binary())], names=["kind", "part", "bucket", "data"])

        dealt = requests.withColumn("slot", F.col("kind") * F.lit(self.parts) + F.col("part")).repartitionById(min(self.parts, PARTITIONS), "slot")
        return self.deal(dealt.groupBy("slot").applyInArrow(run, "kind int, part int, bucket int, data binary"))

    def deal(self, answers: DataFrame) -> DataFrame:
        """Answers next to the texts of their buckets.  A union of answers has to be dealt again: it loses its partitions, and the texts would be dealt anew."""
        return answers.repartitionById(self.partitions, "bucket")

    def finish(self, answers: DataFrame, work: Callable[[pa.Table, dict[int, list[bytes]]], pa.Table], schema: T.StructType) -> DataFrame:
        return self._with(answers, work, schema)

    def _with(self, answers, work, schema):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            told: dict[int, list[bytes]] = {}
            for kind, _, data in sorted(zip(right.column("kind").to_pylist(), right.column("part").to_pylist(), right.column("data").to_pylist(), strict=True), key=lambda r: r[:2]):
                told.setdefault(kind, []).append(data)
            return work(left, told)

        return self.docs.groupBy(self.key).cogroup(answers.groupBy("bucket")).applyInArrow(run, schema)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Range of keys that a 64-bit hash falls into; ascending with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def ranges(part: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, begin, end) of the parts that occur in a sorted array of part numbers."""
    at = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    for p in np.flatnonzero(at[1:] > at[:-1]).tolist():
        yield p, int(at[p]), int(at[p + 1])


def pack_bits(a: np.ndarray) -> bytes:
    """Flags with their number, which packing alone would lose."""
    return len(a).to_bytes(8, "little") + np.packbits(a).tobytes()


def unpack_bits(b: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8)[8:], count=int.from_bytes(b[:8], "little")).astype(bool)


def joined(bits: list[bytes]) -> np.ndarray:
    return np.concatenate([unpack_bits(b) for b in bits]) if bits else np.zeros(0, bool)


def member(a: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Which of a are in the sorted array ``within``."""
    if not len(within):
        return np.zeros(len(a), bool)
    at = np.searchsorted(within, a)
    at[at == len(within)] = 0
    return within[at] == a
