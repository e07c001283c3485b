"""Connected components of a graph held as a table of edges.

Rounds of hooking and contraction: every vertex takes the least of itself and
its neighbours as parent, parents are followed to the roots by doubling, and
edges are rewritten to roots until none joins two of them.  A root is less than
its neighbours, so each round leaves half of the vertices at most.  Only minima are aggregated,
so a vertex with very many neighbours is pre-aggregated where its edges lie, and
nothing is collected.  Rounds are checkpointed in the shared folder and forget
the planner's size estimates: a join's is the product of its sides', a checkpoint
hands it on, and over rounds its digits would double until they fill the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.llm.textcore import shared_dir


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (a, b): root is the least vertex of its component.

    Null ends, loops and repeated edges are ignored.  No edges give no rows.
    """
    shared_dir(edges.sparkSession)
    edges, n = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), F.count("*"))
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("p"))
        moved = n
        while moved:
            far = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            step, moved = kept(hook.join(far, "p").select("v", "p", "pp"), F.count_if(F.col("p") != F.col("pp")))
            hook = step.select("v", F.col("pp").alias("p"))
        if labels is None:
            labels = hook.select("v", F.col("p").alias("root"))
        else:
            labels = settled(labels.join(hook.select(F.col("v").alias("root"), "p"), "root", "left").select("v", F.coalesce("p", "root").alias("root")))
        if not n:
            return labels
        left = hook.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        right = hook.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        edges, n = kept(edges.join(left, "a").join(right, "b").where("pa <> pb").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct(), F.count("*"))
        if not n:
            return labels


def kept(df: DataFrame, count: Column) -> tuple[DataFrame, int]:
    """df settled, and a count over its rows that is taken on the way."""
    seen = Observation()
    held = settled(df.observe(seen, count.alias("n")))
    return held, seen.get["n"]


def settled(df: DataFrame) -> DataFrame:
    """df checkpointed, of the size that Spark takes for unknown (spark.sql.defaultSizeInBytes) whatever df was made of."""
    held = df.checkpoint()._jdf
    rows = held.queryExecution().toRdd()
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(rows, held.schema(), False), df.sparkSession)
