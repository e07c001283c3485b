"""At most one execution per client request, with the outcome of every command.

One record is kept per client: a higher request id executes, a lower one is
stale, an equal one is a replay if operation, key and value are the same and a
conflict otherwise.  An empty key executes to an error that is recorded too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import kv
from tidemark.operators.scan import WIDTH, running

SHAPE = ["op", "k", "v"]


def outcomes(log: DataFrame, width: int = WIDTH) -> DataFrame:
    """Commands with outcome: APPLIED, EMPTY_KEY, REPLAYED, CONFLICT or STALE."""
    told = running(log, ["client_id"], "idx", F.col("request_id"), "_highest", "max", width=width)
    first = F.first(F.struct(*SHAPE)).over(Window.partitionBy("client_id", "request_id").orderBy("idx"))
    higher = F.col("_highest").isNull() | (F.col("request_id") > F.col("_highest"))
    outcome = (
        F.when(higher, F.when(F.octet_length("k") == 0, "EMPTY_KEY").otherwise("APPLIED"))
        .when(F.col("request_id") < F.col("_highest"), "STALE")
        .when(F.col("_first").eqNullSafe(F.struct(*SHAPE)), "REPLAYED")
        .otherwise("CONFLICT")
    )
    return told.withColumn("_first", first).withColumn("outcome", outcome).drop("_highest", "_first")


def counts(log: DataFrame) -> DataFrame:
    return outcomes(log).groupBy("outcome").agg(F.count("*").alias("n"))


def client_table(log: DataFrame) -> DataFrame:
    """The record kept per client: client_id, request_id, op, k, v, idx."""
    ran = outcomes(log).where("outcome in ('APPLIED', 'EMPTY_KEY')")
    return ran.groupBy("client_id").agg(F.max_by(F.struct("request_id", "op", "k", "v", "idx"), "request_id").alias("m")).select("client_id", "m.*")


def applied_state(log: DataFrame) -> DataFrame:
    """Live state after the commands that were applied."""
    return kv.live(outcomes(log).where("outcome = 'APPLIED'"))
