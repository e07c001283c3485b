"""Domain tables over the Parquet tables of a folder.

Timestamps are read without a zone and stay so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import WIDTH, numbered


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def command_log(spark: SparkSession, folder: str) -> DataFrame:
    """Replicated commands: idx, term, client_id, request_id, op, k, v.

    Indexes are even; a retry of every eleventh command stands at the odd one after it.
    """
    e = table(spark, folder, "events")
    e = numbered(e, ["user_id"], F.floor(F.col("event_id") / WIDTH), ["event_id"], "number")
    number = F.col("number")
    late = F.when(F.col("event_id") % 7 == 0, 2).when(F.col("event_id") % 3 == 0, 1).otherwise(0)
    op = F.when(F.col("event_type") == "error", "DELETE").when(F.col("event_type") == "view", "GET").otherwise("PUT")
    log = e.select(
        (F.col("event_id") * 2 + 2).alias("idx"),
        (F.datediff("ts", F.lit("2024-01-01").cast("date")) + 1).cast("long").alias("term"),
        F.col("user_id").alias("client_id"),
        (number - late).cast("long").alias("request_id"),
        op.alias("op"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("k"),
        F.when(op == "PUT", F.col("value").cast("decimal(18,2)")).alias("v"),
        F.col("event_id"),
    )
    again = log.where(F.col("event_id") % 11 == 0).withColumn("idx", F.col("idx") + 1)
    return log.unionByName(again).drop("event_id")


def writes(spark: SparkSession, folder: str) -> DataFrame:
    return command_log(spark, folder).where("op <> 'GET'")


def run_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of sorted runs: table_id, k1, k2 (the key), v, tombstone, seq (recency within the table)."""
    line = table(spark, folder, "lineitem")
    return line.select(
        F.year("l_shipdate").alias("table_id"),
        F.col("l_orderkey").alias("k1"),
        F.col("l_linenumber").alias("k2"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("v"),
        (F.col("l_returnflag") == "R").alias("tombstone"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("seq"),
    )


def raft_logs(spark: SparkSession, folder: str, every: bool = False) -> DataFrame:
    """Logs of three nodes: node_id, idx, term; every 101st order is missing.  With ``every`` none is, and each has a command."""
    o = table(spark, folder, "orders")
    o = numbered(o.withColumn("node_id", (F.col("o_custkey") % 3).cast("int")), ["node_id"], F.col("o_orderdate"), ["o_orderkey"], "idx")
    log = o.select("node_id", F.col("idx").cast("long").alias("idx"), F.year("o_orderdate").cast("long").alias("term"), F.col("o_orderkey").alias("order_key"))
    if every:
        return log.select("node_id", "idx", "term", F.concat(F.lit("c"), F.col("order_key").cast("string")).alias("command"))
    return log.where("order_key % 101 <> 0").drop("order_key")


def peer_match(spark: SparkSession, folder: str) -> DataFrame:
    """Highest replicated index of each peer, one per order: cluster, peer, match_idx."""
    o = table(spark, folder, "orders")
    return o.select((F.col("o_custkey") % 20).cast("int").alias("cluster"), F.col("o_orderkey").alias("peer"), (F.col("o_orderkey") * 7 % 1000).alias("match_idx"))


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Node states by step: node, step, incarnation, term, commit_idx, applied_idx, snapshot_idx, last_idx, role, leader."""
    e = table(spark, folder, "events")
    i = F.col("event_id")
    node = (F.col("user_id") % 5).cast("int")
    commit = i - F.when(i % 97 == 0, 50).otherwise(0)
    return e.select(
        node.alias("node"),
        i.alias("step"),
        (i / 2500).cast("long").alias("incarnation"),
        (F.floor(i / 500) + 1 - F.when(i % 191 == 0, 1).otherwise(0)).alias("term"),
        commit.alias("commit_idx"),
        (commit - i % 5 + F.when(i % 89 == 0, 7).otherwise(0)).alias("applied_idx"),
        (F.floor(i / 100) * 100 - F.when(i % 211 == 0, 100).otherwise(0)).alias("snapshot_idx"),
        (i + i % 3).alias("last_idx"),
        F.when((i % 50 == 0) | (i % 333 == 1), "leader").when(i % 50 == 1, "candidate").otherwise("follower").alias("role"),
        (F.floor(i / 400) % 5).cast("int").alias("leader"),
    )


def request_log(spark: SparkSession, folder: str) -> DataFrame:
    """Served requests: id, ts, method, route, status, latency_ms (2 decimals), component."""
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    method = F.when(F.col("event_type") == "view", "GET").when(F.col("event_type") == "error", "DELETE").otherwise("PUT")
    status = F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), 503).when(F.col("event_id") % 13 == 0, 404).when(F.col("event_id") % 17 == 0, 307).otherwise(200)
    route = F.element_at(F.array(*[F.lit(x) for x in ("/kv/{key}", "/status", "/metrics", "/ready")]), k % 4 + 1)
    return e.select(F.col("event_id").alias("id"), "ts", method.alias("method"), route.alias("route"), status.alias("status"), F.col("value").cast("decimal(18,2)").alias("latency_ms"), F.col("event_type").alias("component"))


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Daily readings of a counter per label, which restarts every ten days: day, label, value."""
    e = table(spark, folder, "events")
    daily = e.groupBy(F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("day"), F.col("event_type").alias("label")).agg(F.count("*").alias("n"))
    since = Window.partitionBy("label", F.floor(F.col("day") / 10)).orderBy("day")
    return daily.select("day", "label", F.sum("n").over(since).alias("value"))


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Operation histories of eight each: history_id, id, client, kind, key, value, invoke, complete, outcome, found, result, err."""
    e = table(spark, folder, "events")
    i = F.col("event_id")
    pos = i % 8
    kind = F.when(F.col("event_type") == "view", "GET").when(F.col("event_type") == "error", "DELETE").otherwise("PUT")
    outcome = F.when(i % 10 == 7, "FAILED").when(i % 10 == 3, "INCOMPLETE").otherwise("OK")
    invoke = pos * 4 - i % 3
    return e.select(
        F.floor(i / 8).alias("history_id"),
        i.alias("id"),
        (F.col("user_id") % 4).alias("client"),
        kind.alias("kind"),
        F.concat(F.lit("k"), (i % 2).cast("string")).alias("key"),
        F.when(kind == "PUT", F.concat(F.lit("v"), (i % 5).cast("string"))).otherwise("").alias("value"),
        invoke.alias("invoke"),
        F.when(outcome == "INCOMPLETE", F.lit(0).cast("long")).otherwise(invoke + F.when(i % 53 == 0, 0).otherwise(1 + i % 7)).alias("complete"),
        outcome.alias("outcome"),
        ((kind == "GET") & (outcome == "OK") & (i % 3 == 0)).alias("found"),
        F.when((kind == "GET") & (outcome == "OK") & (i % 3 == 0), F.concat(F.lit("v"), (i % 5).cast("string"))).otherwise("").alias("result"),
        F.when(outcome == "FAILED", "timeout").when(i % 301 == 0, "stray").otherwise("").alias("err"),
    )


def replicas(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two copies of a key-value state (key, value) that differ."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").cast("decimal(18,2)").alias("value"))
    a = c.where("key % 60 <> 7")
    b = c.where("key % 50 <> 0").withColumn("value", F.when(F.col("key") % 75 == 1, F.col("value") + 1).otherwise(F.col("value")).cast("decimal(18,2)"))
    return a, b
