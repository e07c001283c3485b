"""Sorted runs: summaries, newest-wins merging, compaction, manifests.

Recency is (table_id, seq): a row of a newer table wins, within a table the
greater seq.  Tombstones hide older rows until nothing older can be left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import numbered, running

KEY = ["k1", "k2"]


def write_run(entries: DataFrame, path: str, partitions: int = 8) -> None:
    """Writes a run in key order, with Parquet statistics and bloom filters on the key."""
    ordered = entries.repartitionByRange(partitions, *KEY).sortWithinPartitions(*KEY)
    ordered.write.option("parquet.bloom.filter.enabled#k1", "true").mode("error").parquet(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """All entries of a run, tombstones included, in key order."""
    return spark.read.parquet(path).orderBy(*KEY)


def summary(entries: DataFrame) -> DataFrame:
    """Per table: entries with tombstones, tombstones, least and greatest key."""
    return entries.groupBy("table_id").agg(
        F.count("*").alias("n_entries"),
        F.count_if(F.expr("tombstone")).alias("n_tombstones"),
        F.min(F.struct(*KEY)).alias("_min"),
        F.max(F.struct(*KEY)).alias("_max"),
    ).select("table_id", "n_entries", "n_tombstones", F.col("_min.k1").alias("min_k1"), F.col("_min.k2").alias("min_k2"), F.col("_max.k1").alias("max_k1"), F.col("_max.k2").alias("max_k2"))


def unsorted(entries: DataFrame, position: str) -> DataFrame:
    """Entries that a run's writer refuses: table_id, position, k1, k2, problem.

    Entries are written by ``position``, unique within a table.  Refused are empty
    (null) keys and keys not above the last one accepted; those accepted so far
    hold the greatest key, which a refused entry does not move.
    """
    key = F.struct(*KEY)
    told = running(entries.where("k1 is not null"), ["table_id"], position, key, "_above", "max", width=None)
    problem = F.when(key == F.col("_above"), "repeated key").when(key < F.col("_above"), "key below the last")
    out = told.withColumn("problem", problem).where("problem is not null").select("table_id", position, *KEY, "problem")
    return out.unionByName(entries.where("k1 is null").select("table_id", position, *KEY, F.lit("empty key").alias("problem")))


def merge(entries: DataFrame) -> DataFrame:
    """Newest row of each key, tombstones included: k1, k2, v, tombstone, table_id."""
    newest = F.max_by(F.struct("v", "tombstone", "table_id"), F.struct("table_id", "seq")).alias("m")
    return entries.groupBy(*KEY).agg(newest).select(*KEY, "m.*")


def merge_by_rank(entries: DataFrame) -> DataFrame:
    """The same by ranking: a second way, for checks."""
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("table_id"), F.desc("seq")))
    return entries.withColumn("_rank", rank).where("_rank = 1").select(*KEY, "v", "tombstone", "table_id")


def droppable(active: DataFrame, inputs: list[int]) -> DataFrame:
    """One row: may tombstones go, since no active table outside the inputs is older than one inside."""
    older = active.where(~F.col("table_id").isin(inputs)).where(F.col("table_id") < min(inputs))
    return older.agg((F.count("*") == 0).alias("droppable"))


def compact(entries: DataFrame, inputs: list[int]) -> DataFrame:
    """Merged rows of the input tables; winning tombstones go if ``droppable``.

    The driver gets as many table ids as there are inputs, no more.  All of these end in an error: no inputs, repeated ones, one without a table.
    """
    if not inputs or len(set(inputs)) != len(inputs):
        raise ValueError("inputs must be distinct table ids, one at least")
    active = entries.select("table_id").distinct()
    missing = set(inputs) - {r[0] for r in active.where(F.col("table_id").isin(inputs)).collect()}
    if missing:
        raise ValueError(f"not active: {sorted(missing)}")
    merged = merge(entries.where(F.col("table_id").isin(inputs)))
    return merged.where(~(F.col("tombstone") & F.lit(droppable(active, inputs).scalar())))


def verify(rebuilt: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: rows of each side that the other lacks, counted with repeats."""
    lost = expected.exceptAll(rebuilt).agg(F.count("*").alias("n_missing"))
    return lost.select("n_missing", F.lit(rebuilt.exceptAll(expected).agg(F.count("*").alias("n")).scalar()).alias("n_extra"))


def output_name(ids: Column) -> Column:
    return F.concat(F.lit("compacted-"), F.array_join(F.array_sort(ids).cast("array<string>"), "-"), F.lit(".sst"))


def droppable_from(active: DataFrame) -> DataFrame:
    """(first_input, droppable) of every table as the oldest input of a compaction that takes all newer ones."""
    ids = active.select("table_id").distinct()
    return ids.select(F.col("table_id").alias("first_input"), (F.col("table_id") == ids.agg(F.min("table_id")).scalar()).alias("droppable"))


def block_index(entries: DataFrame, size: int, width: int = 1 << 16) -> DataFrame:
    """Sparse index of each table: blocks of ``size`` key positions with their first key (table_id, block, k1, k2).

    Positions are counted in ranges of ``width`` values of k1.
    """
    keys = entries.select("table_id", *KEY).distinct()
    at = numbered(keys, ["table_id"], F.floor(F.col("k1") / width), KEY, "_place").withColumn("block", F.floor((F.col("_place") - 1) / size))
    return at.groupBy("table_id", "block").agg(F.min(F.struct(*KEY)).alias("m")).select("table_id", "block", "m.k1", "m.k2")


#: Probes that may go to every table's index.
MOST_PROBES = 100_000


def candidate_block(index: DataFrame, probes: DataFrame) -> DataFrame:
    """The last block of each table whose first key is not above the probe; -1 where all are.

    Probes (p1, p2) are a stated set, at most MOST_PROBES, that is sent to the index; more end in an error.
    """
    if probes.limit(MOST_PROBES + 1).count() > MOST_PROBES:
        raise ValueError(f"more than {MOST_PROBES} probes")
    inside = F.struct("k1", "k2") <= F.struct(F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    found = index.join(F.broadcast(probes), F.lit(True), "inner").groupBy("table_id", "p1", "p2")
    return found.agg(F.coalesce(F.max(F.when(inside, F.col("block"))), F.lit(-1)).alias("block"))


def in_order(manifest: DataFrame) -> DataFrame:
    """The manifest by table id, oldest first."""
    return manifest.orderBy("table_id")


def add_table(manifest: DataFrame, file: str) -> DataFrame:
    """The manifest (table_id, file) with a new table of the next id."""
    top = manifest.agg(F.coalesce(F.max("table_id"), F.lit(0)) + 1)
    return manifest.unionByName(top.toDF("table_id").select(F.col("table_id").cast(dict(manifest.dtypes)["table_id"]), F.lit(file).alias("file")))


def remove_tables(manifest: DataFrame, ids: list[int]) -> DataFrame:
    """Ids that are not there are passed over."""
    return manifest.where(~F.col("table_id").isin(ids))


def replace_tables(manifest: DataFrame, ids: list[int], file: str) -> DataFrame:
    """The tables ``ids`` give way to one new table, whose id is above all there were."""
    top = manifest.agg((F.coalesce(F.max("table_id"), F.lit(0)) + 1).alias("table_id"))
    new = top.select(F.col("table_id").cast(dict(manifest.dtypes)["table_id"]), F.lit(file).alias("file"))
    return remove_tables(manifest, ids).unionByName(new)
