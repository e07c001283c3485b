"""State of a key-value store from its mutation log.

Recency is the log index.  PUT sets a key, DELETE leaves a tombstone, a later PUT
brings the key back, GET changes nothing.  A value may be empty; missing and
deleted are told apart and never become null values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """Last mutation of each key (tombstones included), by index up to ``as_of``: k, op, v, idx."""
    log = log.where("op <> 'GET'")
    if as_of is not None:
        log = log.where(F.col("idx") <= as_of)
    return log.groupBy("k").agg(F.max_by(F.struct("op", "v", "idx"), "idx").alias("m")).select("k", "m.op", "m.v", "m.idx")


def live(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """Keys that hold a value: k, v, idx."""
    return latest(log, as_of).where("op = 'PUT'").drop("op")


def get(log: DataFrame, key: Column | str) -> DataFrame:
    """Value of one key; no row if missing or deleted.  The filter reaches the scan."""
    return live(log.where(F.col("k") == key))


def stats(state: DataFrame) -> DataFrame:
    """n_keys and n_bytes (key and value bytes) of a live state."""
    size = F.octet_length("k") + F.octet_length(F.col("v").cast("string"))
    return state.agg(F.count("*").alias("n_keys"), F.coalesce(F.sum(size), F.lit(0)).alias("n_bytes"))


def lookup(probes: DataFrame, entries: DataFrame, key: list[str]) -> DataFrame:
    """Three-valued get: each probe with result FOUND, TOMBSTONE or NOT_FOUND, and the value if found."""
    found = entries.withColumn("_here", F.lit(True))
    result = F.when(F.col("_here").isNull(), "NOT_FOUND").when(F.col("tombstone"), "TOMBSTONE").otherwise("FOUND")
    return probes.join(found, key, "left").select(*key, result.alias("result"), F.when(result == "FOUND", F.col("v")).alias("v"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys whose presence or value differ: key, a_value, b_value, kind (ONLY_A, ONLY_B, CHANGED)."""
    x = a.select("key", F.col("value").alias("a_value"), F.lit(True).alias("_a"))
    y = b.select("key", F.col("value").alias("b_value"), F.lit(True).alias("_b"))
    kind = F.when(F.col("_b").isNull(), "ONLY_A").when(F.col("_a").isNull(), "ONLY_B").when(~F.col("a_value").eqNullSafe(F.col("b_value")), "CHANGED")
    return x.join(y, "key", "full_outer").withColumn("kind", kind).where("kind is not null").drop("_a", "_b")


def converged(replicas: dict[str, DataFrame]) -> DataFrame:
    """replica, n_keys, n_different (from the first), converged."""
    first = next(iter(replicas.values()))
    rows = None
    for name, state in replicas.items():
        n = state.agg(F.count("*").alias("n_keys"))
        d = difference(first, state).agg(F.count("*").alias("n_different"))
        row = n.select(F.lit(name).alias("replica"), "n_keys", F.lit(d.scalar()).alias("n_different"))
        rows = row if rows is None else rows.unionByName(row)
    return rows.withColumn("converged", F.col("n_different") == 0)


def restore_plan(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """What restoring a snapshot does to each key: PUT, DELETE or KEEP."""
    x = current.select("key", F.col("value").alias("old"), F.lit(True).alias("_a"))
    y = snapshot.select("key", F.col("value").alias("new"), F.lit(True).alias("_b"))
    action = F.when(F.col("_b").isNull(), "DELETE").when(F.col("_a").isNull() | ~F.col("old").eqNullSafe(F.col("new")), "PUT").otherwise("KEEP")
    return x.join(y, "key", "full_outer").select("key", action.alias("action"), F.when(action != "DELETE", F.col("new")).alias("value"))


def restored(snapshot: DataFrame, log: DataFrame, boundary: int) -> DataFrame:
    """Live state of a snapshot (k, v) taken at ``boundary`` and the log after it."""
    base = snapshot.select(F.lit(boundary).cast("long").alias("idx"), F.lit("PUT").alias("op"), "k", "v")
    return live(base.unionByName(log.where(F.col("idx") > boundary).select("idx", "op", "k", "v")))


def ready(log: DataFrame, sentinel: str = "ready", damaged: DataFrame | None = None) -> DataFrame:
    """One row: ready, found and reason of a probe that reads a key which need not be there.

    A store that reads without a fault is ready, whether or not it finds the key;
    ``damaged`` holds the faults of reading its log (status: TORN, CORRUPT), of which
    corruption makes it unready, with the status as the reason.
    """
    found = get(log, F.lit(sentinel)).agg((F.count("*") > 0).alias("found"))
    if damaged is None:
        return found.select(F.lit(True).alias("ready"), "found", F.lit(None).cast("string").alias("reason"))
    bad = damaged.agg(F.max(F.when(F.col("status") == "CORRUPT", F.col("status")))).scalar()
    return found.select(bad.isNull().alias("ready"), "found", bad.alias("reason"))


def recovered(records: DataFrame, files: list[str]) -> DataFrame:
    """Live state of a store from the decoded records of its logs (file, offset, op, key, value, status): k, v, idx.

    Torn tails are passed over: what was written before them counts.  A corrupt
    record ends the job in an error, as what follows it cannot be trusted.
    """
    sound = records.withColumn("status", F.when(F.col("status") == "CORRUPT", F.raise_error(F.concat(F.lit("corrupt log at "), F.col("offset").cast("string")))).otherwise(F.col("status"))).where("status = 'OK'")
    key = F.struct(*files, F.col("offset"))
    last = sound.groupBy("key").agg(F.max_by(F.struct("op", "value", "offset"), key).alias("m"))
    return last.where("m.op = 'PUT'").select(F.col("key").alias("k"), F.col("m.value").alias("v"), F.col("m.offset").alias("idx"))
