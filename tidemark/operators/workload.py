"""Workload and fault generators; all from arithmetic on row numbers, so every engine makes the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _spread(n: Column, seed: int, size: int) -> Column:
    """A fixed scatter of 0..size-1 (a linear congruence, taken high in its period)."""
    return F.floor(F.pmod((n + seed) * 48271 + 11, F.lit(2147483647)) * 69621 % 2147483647 / 1000) % size


def keys(spark: SparkSession, n: int, space: int, shape: str = "uniform", seed: int = 42) -> DataFrame:
    """(id, key): uniform, sequential, or hotset (80 % of accesses to the first fifth of keys)."""
    i = F.col("id")
    if shape == "sequential":
        at = i % space
    elif shape == "uniform":
        at = _spread(i, seed, space)
    else:
        hot = max(space // 5, 1)
        at = F.when(_spread(i, seed + 1, 100) < 80, _spread(i, seed, hot)).otherwise(hot + _spread(i, seed, max(space - hot, 1)))
    return spark.range(n).select(i, F.concat(F.lit("bench-key-"), F.lpad(at.cast("long").cast("string"), 6, "0")).alias("key"))


def mix(ids: DataFrame, write_percent: int, seed: int = 7) -> DataFrame:
    """ids with op: PUT for the given share, else GET."""
    return ids.withColumn("op", F.when(_spread(F.col("id"), seed, 100) < write_percent, "PUT").otherwise("GET"))


def values(ids: DataFrame, size: int) -> DataFrame:
    return ids.withColumn("value", F.repeat(F.lit("v"), size))


def compaction_inputs(spark: SparkSession, tables: int, keys_each: int, disjoint: bool, tombstone_every: int = 0) -> DataFrame:
    """Entries of ``tables`` runs: table_id, key, value, tombstone."""
    n = spark.range(tables * keys_each).select((F.floor(F.col("id") / keys_each) + 1).cast("int").alias("table_id"), (F.col("id") % keys_each).alias("i"))
    key = F.col("i") + ((F.col("table_id") - 1) * keys_each if disjoint else 0)
    dead = (F.col("i") % tombstone_every == 0) if tombstone_every else F.lit(False)
    return n.select("table_id", F.concat(F.lit("key-"), F.lpad(key.cast("long").cast("string"), 10, "0")).alias("key"), F.when(~dead, F.concat(F.lit("value-table"), F.col("table_id").cast("string"))).alias("value"), dead.alias("tombstone"))


#: Kinds of steps of a fault plan.
FAULTS = ["put", "delete", "get", "crash", "restart", "partition", "heal", "snapshot"]


def fault_plan(spark: SparkSession, steps: int, nodes: int, seed: int = 42) -> DataFrame:
    """(step, kind, node, key, value): a put has both, a delete and a get have a key, all others neither."""
    i = F.col("step")
    s = spark.range(steps).withColumnRenamed("id", "step")
    kind = F.element_at(F.array(*[F.lit(x) for x in FAULTS]), (_spread(i, seed, len(FAULTS)) + 1).cast("int"))
    key = F.concat(F.lit("k"), _spread(i, seed + 2, 5).cast("long").cast("string"))
    value = F.concat(F.lit("v"), _spread(i, seed + 3, 1000).cast("long").cast("string"))
    told = s.select("step", kind.alias("kind"), _spread(i, seed + 1, nodes).cast("int").alias("node"))
    return told.select("*", F.when(F.col("kind").isin("put", "delete", "get"), key).alias("key"), F.when(F.col("kind") == "put", value).alias("value"))


def classify(attempts: DataFrame) -> DataFrame:
    """attempts (accepted, applied, error) with outcome: OK, FAILED (surely without effect) or INCOMPLETE."""
    return attempts.withColumn("outcome", F.when(F.col("applied"), "OK").when(F.col("accepted"), "INCOMPLETE").otherwise("FAILED"))


def reachable(nodes: DataFrame) -> DataFrame:
    """Ordered pairs of nodes (node, grp, isolated) that reach each other: neither isolated, groups equal or one of them none.

    A cluster's nodes are few; the pairs are of nodes, not of data.
    """
    a = nodes.select(F.col("node").alias("from_node"), F.col("grp").alias("_ga"), F.col("isolated").alias("_ia"))
    b = nodes.select(F.col("node").alias("to_node"), F.col("grp").alias("_gb"), F.col("isolated").alias("_ib"))
    open_ = (F.col("from_node") != F.col("to_node")) & ~F.col("_ia") & ~F.col("_ib") & (F.col("_ga").isNull() | F.col("_gb").isNull() | (F.col("_ga") == F.col("_gb")))
    return a.join(b, open_).select("from_node", "to_node")


def candidate_order(backends: DataFrame, guess: str | None) -> DataFrame:
    """Backends (addr, pos) in the order of trial: the guess first, then as configured."""
    return backends.withColumn("_first", F.col("addr") == F.lit(guess)).orderBy(F.desc_nulls_last("_first"), "pos").drop("_first")


_MASK = 0xFFFFFFFF


def _times(a: Column, b: Column) -> Column:
    """Product of two unsigned 32-bit numbers, modulo 2 ** 32; no step passes 63 bits."""
    low, high = a * b.bitwiseAND(0xFFFF), (a * F.shiftright(b, 16)).bitwiseAND(0xFFFF)
    return (low + high * 65536).bitwiseAND(_MASK)


def mulberry(n: Column, seed: int) -> Column:
    """The n-th (from 0) number in [0, 1) of the public 32-bit generator Mulberry32: its state rises by a fixed step."""
    s = (F.lit(seed).cast("long") + (n + 1) * 0x6D2B79F5).bitwiseAND(_MASK)
    t = _times(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(1))
    t = ((t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(61))).bitwiseAND(_MASK)).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftright(t, 14)) / 4294967296.0


def series(spark: SparkSession, n: int, base: float, amplitude: float, jitter: float, seed: int = 1, places: int = 0) -> DataFrame:
    """(t, label, value): 1.2 waves with jitter, never below 0, rounded half up; labels count back to ``now``."""
    wave = F.sin(F.col("id") / n * F.lit(3.141592653589793) * 2.4) * amplitude
    value = F.greatest(F.lit(0.0), F.lit(base) + wave + (mulberry(F.col("id"), seed) - 0.5) * 2 * jitter)
    ago = F.lit(n - 1) - F.col("id")
    return spark.range(n).select(F.col("id").alias("t"), F.when(ago == 0, "now").otherwise(F.concat(F.lit("-"), ago.cast("string"), F.lit("m"))).alias("label"), (F.floor(value * 10**places + 0.5) / 10**places).alias("value"))


#: Operations of a history that may be under way at once, and faults it may meet.
PENDING, MOST_FAULTS = 3, 2


def random_history(spark: SparkSession, histories: int, operations: int, seed: int = 42, faults: bool = False, keys: int = 3) -> DataFrame:
    """Histories of a correct store (none is a violation): rows as ``operators.history`` takes them.

    Operation i takes effect at time 4 i + 6.  It begins up to PENDING - 1 operations
    earlier and completes up to as many later, so up to PENDING are under way at
    once.  With faults, up to MOST_FAULTS writes of a history fail (without effect)
    or stay incomplete (with or without one).  Results follow from the last write
    of the key that took effect, by a window over one history's key.
    """
    from pyspark.sql import Window

    n, i = F.col("id"), F.col("id") % operations
    reach = (PENDING - 1) * 2
    kind = F.element_at(F.array(F.lit("PUT"), F.lit("GET"), F.lit("DELETE")), (_spread(n, seed, 3) + 1).cast("int"))
    rows = spark.range(histories * operations).select(
        F.floor(n / operations).alias("history_id"), "id", (i % PENDING).alias("client"), kind.alias("kind"),
        F.concat(F.lit("k"), _spread(n, seed + 1, keys).cast("string")).alias("key"), F.concat(F.lit("v"), _spread(n, seed + 2, 1000).cast("string")).alias("_v"),
        (i * 4 + 1 + reach - _spread(n, seed + 3, reach + 1)).cast("long").alias("invoke"), (i * 4 + 3 + reach + _spread(n, seed + 4, reach + 1)).cast("long").alias("complete"),
    )
    # the first writes of a history that are drawn meet the faults
    drawn = F.lit(faults) & (F.col("kind") != "GET") & (_spread(F.col("id"), seed + 5, 4) == 0)
    count = F.sum(F.when(drawn, 1).otherwise(0)).over(Window.partitionBy("history_id").orderBy("id"))
    fault = F.when(drawn & (count <= MOST_FAULTS), _spread(F.col("id"), seed + 6, 3).cast("int"))
    rows = rows.withColumn("_fault", fault)  # 0: fails; 1: incomplete without effect; 2: incomplete with effect
    works = F.coalesce(F.col("_fault") == 2, F.lit(True))
    before = Window.partitionBy("history_id", "key").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when((F.col("kind") != "GET") & works, F.struct("kind", "_v")), ignorenulls=True).over(before)
    told = rows.withColumn("_last", last)
    found = F.coalesce((F.col("kind") == "GET") & (F.col("_last.kind") == "PUT"), F.lit(False))
    outcome = F.when(F.col("_fault") == 0, "FAILED").when(F.col("_fault").isNotNull(), "INCOMPLETE").otherwise("OK")
    return told.select(
        "history_id", "id", "client", "kind", "key", F.when(F.col("kind") == "PUT", F.col("_v")).otherwise("").alias("value"),
        "invoke", F.when(outcome == "INCOMPLETE", F.lit(0).cast("long")).otherwise(F.col("complete")).alias("complete"), outcome.alias("outcome"),
        found.alias("found"), F.when(found, F.col("_last._v")).otherwise("").alias("result"), F.when(outcome == "FAILED", "fault").otherwise("").alias("err"),
    )
