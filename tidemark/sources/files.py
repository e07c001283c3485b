"""Files of the domain: histories as JSON, versioned tables, snapshots, event logs.

A version of a table is a folder of its own, complete once Spark has committed
it; readers take the newest complete one.  A lost writer leaves at worst a
folder without its success marker, which no reader takes.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LONG, _TEXT = T.LongType(), T.StringType()
HISTORY = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in [
            ("history_id", _LONG), ("id", _LONG), ("client", _LONG), ("kind", _TEXT), ("key", _TEXT), ("value", _TEXT),
            ("invoke", _LONG), ("complete", _LONG), ("outcome", _TEXT), ("found", T.BooleanType()), ("result", _TEXT), ("err", _TEXT),
        ]
    ]
)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one in local mode alone."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def save_history(ops: DataFrame, path: str) -> None:
    """One JSON object per operation."""
    ops.select([f.name for f in HISTORY]).write.mode("error").json(path)


def load_history(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Operations of JSON lines, or of files that hold an array each; a malformed one is an error."""
    return spark.read.schema(HISTORY).option("multiLine", whole_files).option("mode", "FAILFAST").json(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a table, in order."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(at):
        return []
    found = [s.getPath() for s in fs.listStatus(at)]
    return sorted(int(p.getName()[1:]) for p in found if p.getName()[:1] == "v" and p.getName()[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def save_version(df: DataFrame, path: str) -> int:
    """Writes the next version of a table; an existing one of that number is an error."""
    n = (versions(df.sparkSession, path) or [0])[-1] + 1
    df.write.mode("error").parquet(f"{path}/v{n}")
    return n


def load_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a table, by default the newest."""
    held = versions(spark, path)
    n = version if version is not None else (held or [0])[-1]
    if n not in held:
        raise FileNotFoundError(f"{path} has no version {n}")
    return spark.read.parquet(f"{path}/v{n}")


def save_snapshot(state: DataFrame, clients: DataFrame, idx: int, term: int, path: str) -> int:
    """A state machine's snapshot: its keys, its record per client, and the boundary they stand at."""
    at = {"boundary_idx": F.lit(idx).cast("long"), "boundary_term": F.lit(term).cast("long")}
    rows = state.select(F.lit("key").alias("kind"), F.col("k"), F.col("v").cast("string").alias("v"), F.lit(None).cast("long").alias("client_id"), F.lit(None).cast("long").alias("request_id"), F.lit(None).cast("string").alias("op"))
    rows = rows.unionByName(clients.select(F.lit("client").alias("kind"), "k", F.col("v").cast("string").alias("v"), F.col("client_id").cast("long"), F.col("request_id").cast("long"), "op"))
    return save_version(rows.withColumns(at), path)


def load_snapshot(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(keys, client records) of a snapshot, each with its boundary."""
    rows = load_version(spark, path, version)
    return rows.where("kind = 'key'").select("k", "v", "boundary_idx", "boundary_term"), rows.where("kind = 'client'").select("client_id", "request_id", "op", "k", "v", "boundary_idx", "boundary_term")


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def tail_events(spark: SparkSession, path: str, order: str, n: int) -> DataFrame:
    """The last n events, in order: a report."""
    return spark.read.parquet(path).orderBy(F.desc(order)).limit(n).orderBy(order)


def read_blobs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Binary files (path, content), for the decoders of ``functions.codecs``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def trusted(hints: DataFrame, backends: DataFrame, column: str = "addr") -> DataFrame:
    """Hints whose address is a configured backend."""
    return hints.join(backends.select(column).distinct(), column, "left_semi")


def with_address(rows: DataFrame, peers: DataFrame, column: str) -> DataFrame:
    """rows with the addresses of the peer that ``column`` names; null where there is none."""
    return rows.join(peers.select(F.col("id").alias(column), "grpc_addr", "http_addr"), column, "left")


def valid_utf8(value: Column) -> Column:
    return F.is_valid_utf8(value)
