"""Tables as files of the fixed layouts of ``codecs``, and back: manifests, persisted node states, machine images.

A file is one group and one task's work, and the layouts bound what a file holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import codecs


def _schema(df: DataFrame, groups: list[str], ddl: str) -> T.StructType:
    return T.StructType([*[df.schema[g] for g in groups], *T.StructType.fromDDL(ddl)])


def _rows(files: DataFrame, groups: list[str], ddl: str, work) -> DataFrame:
    """Rows that ``work`` (bytes to columns) makes of each file, with the file's groups."""
    src, schema = files.select(*groups, "content"), _schema(files, groups, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                made = work(b.column(len(groups))[i].as_py())
                own = [b.column(c).take(pa.array([i] * len(made[0]), pa.int32())) for c in range(len(groups))]
                yield pa.RecordBatch.from_arrays([*own, *made], names=schema.names)

    return src.mapInArrow(run, schema)


def _named(df: DataFrame, groups: list[str], *columns):
    """df by its groups under other names: both sides of a cogroup may come from one table."""
    names = [f"_of_{i}" for i in range(len(groups))]
    return df.select(*[F.col(g).alias(x) for g, x in zip(groups, names, strict=True)], *columns).groupBy(*names)


def manifest_file(manifest: DataFrame, groups: list[str], magic: bytes) -> DataFrame:
    """One file (groups, content) per manifest (groups, table_id, file), tables in order of id, next id above all."""
    schema = _schema(manifest, groups, "content binary")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("table_id")
        ids = t.column("table_id").to_pylist()
        data = codecs.encode_manifest(ids[-1] + 1, list(zip(ids, t.column("file").to_pylist(), strict=True)), magic)
        return pa.Table.from_arrays([*(t.column(g).slice(0, 1) for g in groups), pa.array([data], pa.binary())], names=schema.names)

    return manifest.select(*groups, "table_id", "file").groupBy(*groups).applyInArrow(run, schema)


def manifest_rows(files: DataFrame, groups: list[str], magic: bytes) -> DataFrame:
    """(groups, next_id, table_id, file) of manifest files; damage ends the job in an error."""

    def work(data: bytes) -> list[pa.Array]:
        top, tables = codecs.decode_manifest(data, magic)
        return [pa.array([top] * len(tables), pa.int64()), pa.array([i for i, _ in tables], pa.int64()), pa.array([f for _, f in tables], pa.string())]

    return _rows(files, groups, "next_id long, table_id long, file string", work)


def state_file(log: DataFrame, states: DataFrame, groups: list[str], magic: bytes) -> DataFrame:
    """One file (groups, content) per node state (groups, current_term, voted_for) with its log (groups, idx, term, command)."""
    schema = _schema(states, groups, "content binary")

    def run(entries: pa.Table, state: pa.Table) -> pa.Table:
        if not state.num_rows:
            return pa.Table.from_arrays([*(entries.column(g).slice(0, 0) for g in groups), pa.array([], pa.binary())], names=schema.names)
        entries = entries.sort_by("idx")
        log = list(zip(*(entries.column(c).to_pylist() for c in ("idx", "term", "command")), strict=True))
        data = codecs.encode_state(state.column("current_term")[0].as_py(), state.column("voted_for")[0].as_py() or "", log, magic)
        return pa.Table.from_arrays([*(state.column(i).slice(0, 1) for i in range(len(groups))), pa.array([data], pa.binary())], names=schema.names)

    src = log.select(*groups, "idx", "term", F.col("command").cast("binary").alias("command"))
    return src.groupBy(*groups).cogroup(_named(states, groups, "current_term", "voted_for")).applyInArrow(run, schema)


def state_rows(files: DataFrame, groups: list[str], magic: bytes) -> DataFrame:
    """(groups, current_term, voted_for, idx, term, command) of state files; a file that breaks a rule ends the job in an error."""

    def work(data: bytes) -> list[pa.Array]:
        term, vote, log = codecs.decode_state(data, magic)
        return [pa.array([term] * len(log), pa.int64()), pa.array([vote] * len(log), pa.string()), pa.array([i for i, _, _ in log], pa.int64()), pa.array([t for _, t, _ in log], pa.int64()), pa.array([c for _, _, c in log], pa.binary())]

    return _rows(files, groups, "current_term long, voted_for string, idx long, term long, command binary", work)


_RECORD = ["client_id", "request_id", "op", "key", "value", "applied", "replayed", "result_key", "result_value", "error"]


def machine_file(keys: DataFrame, clients: DataFrame, groups: list[str], magic: bytes, snapshot: tuple[int, int, bytes] | None = None) -> DataFrame:
    """One image (groups, content) per group of keys (key, value) and client records.

    With ``snapshot`` (index, term, magic) the image is the payload of a snapshot file.  Equal states give equal bytes.
    """
    schema = _schema(keys, groups, "content binary")
    state = keys.select(*groups, F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    kinds = dict(zip(_RECORD, ("string", "long", "string", "binary", "binary", "boolean", "boolean", "binary", "binary", "string"), strict=True))
    held = _named(clients, groups, *[F.col(c).cast(k).alias(c) for c, k in kinds.items()])

    def run(own: pa.Table, records: pa.Table) -> pa.Table:
        pairs = [(k, v or b"") for k, v in zip(own.column("key").to_pylist(), own.column("value").to_pylist(), strict=True)]
        rows = [tuple(b"" if v is None and kinds[c] == "binary" else v for c, v in zip(_RECORD, r, strict=True)) for r in zip(*(records.column(c).to_pylist() for c in _RECORD), strict=True)]
        data = codecs.encode_machine(pairs, rows, magic)
        if snapshot:
            data = codecs.encode_snapshot(snapshot[0], snapshot[1], data, snapshot[2])
        some = own if own.num_rows else records
        return pa.Table.from_arrays([*(some.column(i).slice(0, 1) for i in range(len(groups))), pa.array([data], pa.binary())], names=schema.names)

    return state.groupBy(*groups).cogroup(held).applyInArrow(run, schema)


def machine_rows(files: DataFrame, groups: list[str], magic: bytes, snapshot: bytes | None = None) -> tuple[DataFrame, DataFrame]:
    """(keys, clients) of images; with the magic of snapshots, of images that are their payloads."""

    def image(data: bytes) -> tuple[list, list]:
        return codecs.decode_machine(codecs.decode_snapshot(data, snapshot)[2] if snapshot else data, magic)

    def keys(data: bytes) -> list[pa.Array]:
        own = image(data)[0]
        return [pa.array([k for k, _ in own], pa.binary()), pa.array([v for _, v in own], pa.binary())]

    def clients(data: bytes) -> list[pa.Array]:
        rows = list(zip(*image(data)[1], strict=True)) or [[]] * len(_RECORD)
        kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary(), pa.string())
        return [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]

    ddl = "client_id string, request_id long, op string, key binary, value binary, applied boolean, replayed boolean, result_key binary, result_value binary, error string"
    return _rows(files, groups, "key binary, value binary", keys), _rows(files, groups, ddl, clients)
