"""Safety invariants over node observations (node, step, incarnation, term, commit_idx, applied_idx, snapshot_idx, last_idx, role)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import WIDTH, previous


def decreases(obs: DataFrame, column: str, keys: list[str], width: int = WIDTH) -> DataFrame:
    """Steps at which a column fell: keys, step, value, previous_value."""
    p = previous(obs, keys, "step", [column], "_p", width)
    return p.where(F.col(column) < F.col(f"_p.{column}")).select(*keys, "step", F.col(column).alias("value"), F.col(f"_p.{column}").alias("previous_value"))


def term_decreases(obs: DataFrame) -> DataFrame:
    return decreases(obs, "term", ["node"])


def snapshot_decreases(obs: DataFrame) -> DataFrame:
    return decreases(obs, "snapshot_idx", ["node"])


def commit_decreases(obs: DataFrame) -> DataFrame:
    """Within one incarnation: a restart may lose volatile state."""
    return decreases(obs, "commit_idx", ["node", "incarnation"])


def applied_decreases(obs: DataFrame) -> DataFrame:
    return decreases(obs, "applied_idx", ["node", "incarnation"])


def applied_beyond_commit(obs: DataFrame) -> DataFrame:
    return obs.where("applied_idx > commit_idx").select("node", "step", "applied_idx", "commit_idx")


def rival_leaders(obs: DataFrame) -> DataFrame:
    """Terms with more than one leader: term, n_leaders."""
    return obs.where("role = 'leader'").groupBy("term").agg(F.count_distinct("node").alias("n_leaders")).where("n_leaders > 1")


def violations(obs: DataFrame) -> DataFrame:
    """Every violation: message, node, step."""
    say = lambda df, text: df.select(F.concat(F.lit(text + " on node "), F.col("node").cast("string")).alias("message"), "node", "step")
    out = say(term_decreases(obs), "term fell")
    for df, text in ((snapshot_decreases(obs), "snapshot index fell"), (commit_decreases(obs), "commit index fell"), (applied_decreases(obs), "applied index fell"), (applied_beyond_commit(obs), "applied beyond commit")):
        out = out.unionByName(say(df, text))
    return out


def first_violations(obs: DataFrame) -> DataFrame:
    """Each message once, with the step at which it was first seen and how often."""
    return violations(obs).groupBy("message").agg(F.min("step").alias("first_step"), F.count("*").alias("n"))


def observed(obs: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """One row per step: the nodes that were seen (struct of their state, by node), those isolated, and the leaders.

    A step has as many entries as a cluster has nodes.
    """
    state = F.struct("node", "role", "term", "leader", "commit_idx", "applied_idx", "snapshot_idx", "last_idx")
    per = obs.groupBy("step").agg(F.array_sort(F.collect_list(state)).alias("nodes"), F.array_sort(F.collect_list(F.when(F.col("role") == "leader", F.col("node")))).alias("leaders"))
    if isolated is None:
        return per
    cut = isolated.groupBy("step").agg(F.array_sort(F.collect_set("node")).alias("isolated"))
    return per.join(cut, "step", "left").withColumn("isolated", F.coalesce("isolated", F.array().cast(cut.schema["isolated"].dataType)))


def live(nodes: DataFrame, crashes: DataFrame) -> DataFrame:
    """nodes (node) with crashed, from the last of their events (node, step, kind: crash, restart); live are the others."""
    last = crashes.groupBy("node").agg(F.max_by("kind", "step").alias("_kind"))
    return nodes.join(last, "node", "left").withColumn("crashed", F.coalesce(F.col("_kind") == "crash", F.lit(False))).drop("_kind")


def first_reached(obs: DataFrame, targets: DataFrame, rounds: int | None = None) -> DataFrame:
    """targets (node, field, target, from_step) with reached: the first step from then on at which the node's field is that high.

    Null where it is not within ``rounds`` steps (if given).  Fields: commit_idx, applied_idx, snapshot_idx.
    """
    fields = ["commit_idx", "applied_idx", "snapshot_idx"]
    long = obs.select("node", "step", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("_value")) for f in fields])))
    met = targets.join(long, ["node", "field"]).where((F.col("step") >= F.col("from_step")) & (F.col("_value") >= F.col("target")))
    if rounds is not None:
        met = met.where(F.col("step") <= F.col("from_step") + rounds)
    first = met.groupBy("node", "field", "target", "from_step").agg(F.min("step").alias("reached"))
    return targets.join(first, ["node", "field", "target", "from_step"], "left")


def first_leader(obs: DataFrame, from_step: int = 0) -> DataFrame:
    """One row: the first step from then on with a leader, and that leader (null if there is none)."""
    led = obs.where((F.col("role") == "leader") & (F.col("step") >= from_step))
    return led.agg(F.min(F.struct("step", "node")).alias("m")).select("m.step", "m.node")


def changes(obs: DataFrame, column: str, keys: list[str], width: int = WIDTH) -> DataFrame:
    """Steps at which a column took another value: keys, step, value, previous_value."""
    p = previous(obs, keys, "step", [column], "_p", width)
    return p.where(F.col("_p").isNotNull() & ~F.col(column).eqNullSafe(F.col(f"_p.{column}"))).select(*keys, "step", F.col(column).alias("value"), F.col(f"_p.{column}").alias("previous_value"))


def rounds(obs: DataFrame, size: int) -> DataFrame:
    """Per round of ``size`` steps and per node its last observation."""
    at = obs.withColumn("round", F.floor(F.col("step") / size))
    last = F.max_by(F.struct("commit_idx", "applied_idx", "last_idx"), "step").alias("m")
    return at.groupBy("round", "node").agg(last).select("round", "node", "m.*")


def converged_rounds(obs: DataFrame, size: int, within: int) -> DataFrame:
    """Per round: nodes, how many are synced to ``within`` of the highest, whether all are."""
    r = rounds(obs, size)
    top = r.groupBy("round").agg(F.max("applied_idx").alias("top"))
    n = r.join(top, "round").groupBy("round").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("top") - F.col("applied_idx") <= within).alias("n_synced"))
    return n.withColumn("converged", F.col("n_nodes") == F.col("n_synced"))


def first_converged(obs: DataFrame, size: int, within: int) -> DataFrame:
    return converged_rounds(obs, size, within).where("converged").agg(F.min("round").alias("first_round"))
