"""The committed log as a stream: exactly-once outcomes, live state, and an apply loop.

A batch's rows are put in log order before they are judged; state is kept per
client, so a restarted query goes on where its checkpoint stands.  Results go to
files, each batch once; nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTCOME = "client_id long, idx long, request_id long, op string, k string, v decimal(18,2), outcome string"
_STATE = "request_id long, op string, k string, v string, idx long"


def read_log(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Log files of a folder as they arrive; ``files_per_batch`` bounds what a batch holds."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def outcomes(log: DataFrame) -> DataFrame:
    """The stream of commands with outcomes, as ``operators.dedup`` gives them for a whole log.

    A row that arrives in a batch after rows of a higher index were judged is LATE:
    it changes nothing and its outcome in log order is not known any more.
    """

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values("idx", kind="stable")
        past = -1 if held is None else held[4]
        said = []
        for idx, request, op, k, v in zip(rows["idx"], rows["request_id"], rows["op"], rows["k"], rows["v"], strict=True):
            shape = (op, k, "" if v is None else str(v))
            if idx <= past:
                said.append("LATE")
            elif held is None or request > held[0]:
                held = (int(request), *shape, int(idx))
                said.append("APPLIED" if k else "EMPTY_KEY")
            elif request < held[0]:
                said.append("STALE")
            else:
                said.append("REPLAYED" if shape == tuple(held[1:4]) else "CONFLICT")
        if held is not None:
            state.update((*held[:4], max(past, int(rows["idx"].max()))))
        yield rows.assign(outcome=said)[["client_id", "idx", "request_id", "op", "k", "v", "outcome"]]

    return log.groupBy("client_id").applyInPandasWithState(judge, OUTCOME, _STATE, "append", GroupStateTimeout.NoTimeout)


def latest(log: DataFrame) -> DataFrame:
    """Running last mutation of each key, for update or complete output."""
    return log.where("op <> 'GET'").groupBy("k").agg(F.max_by(F.struct("op", "v", "idx"), "idx").alias("m")).select("k", "m.op", "m.v", "m.idx")


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches whose results are complete."""
    from tidemark.sources.files import versions

    return versions(spark, folder)


def drain(stream: DataFrame, folder: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs all there is now into files, and returns the result.

    Append: files of all batches.  Complete: the whole result after the last batch, as
    a version of its own per batch, which a repeated batch writes again.
    """
    spark = stream.sparkSession
    if mode == "append":
        append_to(stream, folder, checkpoint)
        return spark.read.schema(stream.schema).parquet(folder)

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/v{batch}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    held = _batches(spark, folder)
    return spark.read.parquet(f"{folder}/v{held[-1]}") if held else spark.createDataFrame([], stream.schema)


def append_to(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Runs all there is now into Parquet files, each batch once."""
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def apply_loop(log: DataFrame, folder: str, checkpoint: str) -> None:
    """Applies the committed log batch by batch, in order, and stops at the first fault without skipping it.

    Each batch writes the state after it (k, op, v, idx) as a version.  Faults: an
    operation that is none, an empty key, or an index that is not above all that
    batches before have applied.  A fault ends the query in an error before
    anything of its batch is written; a restart meets the same batch again.
    """
    spark = log.sparkSession

    def step(df: DataFrame, batch: int) -> None:
        before = [b for b in _batches(spark, folder) if b < batch]
        state = spark.read.parquet(f"{folder}/v{before[-1]}") if before else None
        top = -1 if state is None else (state.agg(F.max("idx")).first()[0] or -1)
        bad = F.when(~F.col("op").isin("PUT", "DELETE"), "unknown operation").when(F.coalesce(F.octet_length("k"), F.lit(0)) == 0, "empty key").when(F.col("idx") <= top, "index not above those applied")
        fault = df.withColumn("fault", bad).where("fault is not null").agg(F.min(F.struct("idx", "fault")).alias("m")).first()[0]
        if fault:
            raise ValueError(f"{fault.fault} at index {fault.idx}")
        rows = df.select("k", "op", "v", "idx")
        both = rows if state is None else state.unionByName(rows)
        both.groupBy("k").agg(F.max_by(F.struct("op", "v", "idx"), "idx").alias("m")).select("k", "m.op", "m.v", "m.idx").write.mode("overwrite").parquet(f"{folder}/v{batch}")

    log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def applied(spark: SparkSession, folder: str, at_least: int = 0) -> DataFrame:
    """The state that the loop has applied last: keys that hold a value (k, v, idx); an error if it has not come to ``at_least``."""
    held = _batches(spark, folder)
    state = spark.read.parquet(f"{folder}/v{held[-1]}") if held else None
    top = None if state is None else state.agg(F.max("idx")).first()[0]
    if state is None or top is None or top < at_least:
        raise RuntimeError(f"applied up to {top}, {at_least} wanted")
    return state.where("op = 'PUT'").select("k", "v", "idx")
