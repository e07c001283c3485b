"""Consensus logs as tables (node_id, idx, term): slices, surgery, checks, commitment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import WIDTH, previous, running


def suffix(log: DataFrame, start: int) -> DataFrame:
    return log.where(F.col("idx") >= start)


def between(log: DataFrame, start: int, end: int, base: int = 0) -> DataFrame:
    """Entries from start to end, both included and clamped to what follows the boundary ``base``."""
    return log.where(F.col("idx").between(max(start, base + 1), end))


def committed(log: DataFrame, start: int, commit: int) -> DataFrame:
    return log.where(F.col("idx").between(start, commit))


def tail(log: DataFrame) -> DataFrame:
    """Per node: last index and its term."""
    return log.groupBy("node_id").agg(F.max("idx").alias("last_idx"), F.max_by("term", "idx").alias("last_term"))


def entry_at(log: DataFrame, idx: int, boundary: tuple[int, int] | None = None) -> DataFrame:
    """Per node: idx and term of one entry; those of the boundary (idx, term) where nothing else is there."""
    own = log.where(F.col("idx") == idx).select("node_id", "idx", "term")
    if boundary is None or boundary[0] != idx:
        return own
    rest = log.select("node_id").distinct().join(own, "node_id", "left_anti")
    return own.unionByName(rest.select("node_id", F.lit(idx).cast(log.schema["idx"].dataType).alias("idx"), F.lit(boundary[1]).cast(log.schema["term"].dataType).alias("term")))


def gaps(log: DataFrame, width: int = WIDTH) -> DataFrame:
    """Places where an index does not follow the one before: node_id, idx, previous_idx."""
    p = previous(log, ["node_id"], "idx", ["idx"], "_p", width)
    return p.where("idx - _p.idx <> 1").select("node_id", "idx", F.col("_p.idx").alias("previous_idx"))


def term_regressions(log: DataFrame, width: int = WIDTH) -> DataFrame:
    """Entries of a term below that of the one before: node_id, idx, term, previous_term."""
    p = previous(log, ["node_id"], "idx", ["term"], "_p", width)
    return p.where("term < _p.term").select("node_id", "idx", "term", F.col("_p.term").alias("previous_term"))


def validate(log: DataFrame, current_term: int) -> DataFrame:
    """Per node: gaps, term regressions, and whether its last term is above the current one."""
    g = gaps(log).groupBy("node_id").agg(F.count("*").alias("n_gaps"))
    r = term_regressions(log).groupBy("node_id").agg(F.count("*").alias("n_regressions"))
    t = tail(log).select("node_id", (F.col("last_term") > current_term).alias("ahead"))
    return t.join(g, "node_id", "left").join(r, "node_id", "left").select("node_id", F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"), F.coalesce("n_regressions", F.lit(0)).alias("n_regressions"), "ahead")


def conflict_point(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row: the first incoming index that the local log lacks or has with another term; null if none."""
    own = local.select("idx", F.col("term").alias("_own"))
    return incoming.join(own, "idx", "left").where("_own is null or _own <> term").agg(F.min("idx").alias("cut"))


def matches(local: DataFrame, prev_idx: int, prev_term: int) -> DataFrame:
    """One row: has the log the entry that a leader names as the one before its entries."""
    return local.where((F.col("idx") == prev_idx) & (F.col("term") == prev_term)).agg(((F.count("*") > 0) | F.lit(prev_idx == 0)).alias("matches"))


def append_after(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """The local log after an accepted append: kept up to the conflict, then the incoming entries.

    Entries that match are kept as they are, and a shorter message that matches cuts nothing.
    """
    cut = conflict_point(local, incoming).scalar()
    kept = local.withColumn("_cut", cut).where("_cut is null or idx < _cut").drop("_cut")
    new = incoming.withColumn("_cut", conflict_point(local, incoming).scalar()).where("idx >= _cut").drop("_cut")
    return kept.unionByName(new)


def compact(log: DataFrame, cut: int) -> DataFrame:
    """Entries after the boundary, and the boundary itself marked as such."""
    return log.where(F.col("idx") >= cut).withColumn("boundary", F.col("idx") == cut)


def install_boundary(log: DataFrame, idx: int, term: int) -> DataFrame:
    """What stays when a snapshot up to (idx, term) is installed: the suffix where the log has that entry, else nothing."""
    has = log.where((F.col("idx") == idx) & (F.col("term") == term)).select("node_id").distinct()
    return log.where(F.col("idx") > idx).join(has, "node_id", "left_semi")


def majority(n: Column) -> Column:
    return F.floor(n / 2) + 1


def commit_index(match: DataFrame, terms: DataFrame, cluster: DataFrame) -> DataFrame:
    """New commit index per cluster.

    match: (cluster, match_idx) of all members with the leader.  The greatest index
    that a majority holds counts if its term (terms: cluster, idx, term) is the
    leader's (cluster: cluster, commit_idx, current_term); it never goes back.
    """
    # members with an index are counted, so a cluster of any size is one small row per index
    n = match.groupBy("cluster", "match_idx").agg(F.count("*").alias("n"))
    down = Window.partitionBy("cluster").orderBy(F.desc("match_idx"))
    held = n.withColumn("held", F.sum("n").over(down)).withColumn("members", F.sum("n").over(Window.partitionBy("cluster")))
    kth = held.where(F.col("held") >= majority(F.col("members"))).groupBy("cluster").agg(F.max("match_idx").alias("kth"))
    at = terms.select("cluster", F.col("idx").alias("kth"), F.col("term").alias("_term"))
    out = cluster.join(kth, "cluster", "left").join(at, ["cluster", "kth"], "left")
    new = F.when((F.col("kth") > F.col("commit_idx")) & (F.col("_term") == F.col("current_term")), F.col("kth")).otherwise(F.col("commit_idx"))
    return out.select("cluster", "kth", new.alias("commit_idx"))


def follower_commit(commit: Column, leader_commit: Column, last_new: Column) -> Column:
    return F.greatest(commit, F.least(leader_commit, last_new))


def lag(last: Column, match: Column) -> Column:
    return F.greatest(last - match, F.lit(0))


def retained(last: Column, snapshot: Column) -> Column:
    return F.greatest(last - snapshot, F.lit(0))


def vote_grants(requests: DataFrame) -> DataFrame:
    """requests (voter, term, seq, candidate, c_term, c_idx, v_term, v_idx) with granted.

    A voter grants its first request of a term whose log is at least up to date,
    and the same candidate again; requests of a term below one it saw are refused.
    """
    fit = F.struct("c_term", "c_idx") >= F.struct(F.col("v_term").alias("c_term"), F.col("v_idx").alias("c_idx"))
    told = running(requests, ["voter"], "seq", F.col("term"), "_seen", "max").withColumn("_ok", fit & F.coalesce(F.col("term") >= F.col("_seen"), F.lit(True)))
    first = told.where("_ok").groupBy("voter", "term").agg(F.min_by("candidate", "seq").alias("_first"))
    granted = F.col("_ok") & F.coalesce(F.col("_first") == F.col("candidate"), F.lit(False))
    return told.join(first, ["voter", "term"], "left").withColumn("granted", granted).drop("_ok", "_seen", "_first")


def elected(grants: DataFrame, members: int) -> DataFrame:
    """(term, candidate, votes, won): distinct voters that granted, against the majority of members."""
    n = grants.where("granted").groupBy("term", "candidate").agg(F.count_distinct("voter").alias("votes"))
    return n.withColumn("won", F.col("votes") >= members // 2 + 1)


def quorum_reads(acks: DataFrame, members: int) -> DataFrame:
    """(read_id, acks, valid): a read index counts if a majority, the leader with it, acknowledged in its term."""
    n = acks.groupBy("read_id").agg((F.count_if(F.expr("same_term and acked")) + 1).alias("acks"))
    return n.withColumn("valid", F.col("acks") >= members // 2 + 1)


def progress(replies: DataFrame) -> DataFrame:
    """Replies (peer, seq, success, prev_idx, n) with match_idx and next_idx after each.

    A success raises match to prev_idx + n at least; a failure takes next one back, to 1 at least.
    """
    failed = F.when(F.col("success"), 0).otherwise(1)
    told = running(replies, ["peer"], "seq", F.when(F.col("success"), F.col("prev_idx") + F.col("n")), "match_idx", "max", inclusive=True)
    told = running(told, ["peer"], "seq", failed, "_failed", "sum", inclusive=True)
    # failures up to the last success: their count never falls, so it is the greatest at a success
    told = running(told, ["peer"], "seq", F.when(F.col("success"), F.col("_failed")), "_upto", "max", inclusive=True)
    match = F.coalesce("match_idx", F.lit(0))
    since = F.col("_failed") - F.coalesce("_upto", F.lit(0))
    return told.withColumn("next_idx", F.greatest(F.lit(1), match + 1 - since)).withColumn("match_idx", match).drop("_failed", "_upto")
