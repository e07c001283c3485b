"""Transitions of consensus nodes over recorded rows: what each rule makes of a state and a message.

A node's state is a row (node_id, term, voted_for, role, commit_idx, applied_idx,
boundary_idx, boundary_term, last_idx, last_term); messages and logs are tables
beside it.  Every rule is a join on the node (and an index), so a table of many
clusters' states is judged at once.  Spark guesses the size of a log from what it
was made of, which may be far less, so joins with logs are hinted to sort and merge:
none is sent whole to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import numbered, running


def step_down(states: DataFrame, seen: DataFrame) -> DataFrame:
    """States after messages (node_id, term): a higher term makes a node a follower of that term without a vote."""
    top = seen.groupBy("node_id").agg(F.max("term").alias("_top"))
    told = states.join(top, "node_id", "left").withColumn("stepped_down", F.coalesce(F.col("_top") > F.col("term"), F.lit(False)))
    down = F.col("stepped_down")
    after = {
        "term": F.when(down, F.col("_top")).otherwise(F.col("term")),
        "voted_for": F.when(~down, F.col("voted_for")),
        "role": F.when(down, "follower").otherwise(F.col("role")),
    }
    return told.withColumns(after).drop("_top")


def start_elections(states: DataFrame, members: int) -> DataFrame:
    """States of nodes whose timer ran out: next term, a vote for themselves, candidate, or leader where that vote is a majority."""
    return states.withColumns({"term": F.col("term") + 1, "voted_for": F.col("node_id"), "role": F.lit("leader" if members == 1 else "candidate")})


def leader_progress(leaders: DataFrame, peers: DataFrame) -> DataFrame:
    """(node_id, peer, next_idx, match_idx) of new leaders: next past their own log, nothing known to match.

    peers: (node_id, peer) of each node's cluster, without itself.
    """
    return leaders.select("node_id", "last_idx").join(peers, "node_id").select("node_id", "peer", (F.col("last_idx") + 1).alias("next_idx"), F.lit(0).cast("long").alias("match_idx"))


def judge_appends(requests: DataFrame, states: DataFrame, log: DataFrame) -> DataFrame:
    """requests (request_id, node_id, term, prev_idx, prev_term, n_entries, leader_commit) with reply_term, reason, success and commit_idx.

    Reasons: STALE_TERM (of a term that is over), NO_PREVIOUS (the entry before is
    not there), OTHER_TERM (it is of another term), ACCEPTED.  The boundary and
    index 0 count as entries.  An accepted request raises the commit index to the
    leader's, no further than its own last entry.
    """
    own = states.select("node_id", F.col("term").alias("_term"), F.col("commit_idx").alias("_commit"), F.col("boundary_idx").alias("_b"), F.col("boundary_term").alias("_bt"))
    at = log.select("node_id", F.col("idx").alias("prev_idx"), F.col("term").alias("_at"))
    told = requests.join(own.hint("merge"), "node_id").join(at.hint("merge"), ["node_id", "prev_idx"], "left")
    held = F.when(F.col("prev_idx") == F.col("_b"), F.col("_bt")).when(F.col("prev_idx") > F.col("_b"), F.col("_at"))
    reason = F.when(F.col("term") < F.col("_term"), "STALE_TERM").when(held.isNull(), "NO_PREVIOUS").when(held != F.col("prev_term"), "OTHER_TERM").otherwise("ACCEPTED")
    told = told.withColumn("reason", reason).withColumn("success", F.col("reason") == "ACCEPTED").withColumn("reply_term", F.greatest("term", "_term"))
    commit = F.when(F.col("success"), F.greatest("_commit", F.least("leader_commit", F.col("prev_idx") + F.col("n_entries")))).otherwise(F.col("_commit"))
    return told.withColumn("commit_idx", commit).drop("_term", "_commit", "_b", "_bt", "_at")


def propose(states: DataFrame, proposals: DataFrame, width: int = 1 << 16) -> DataFrame:
    """proposals (node_id, seq, command) with status, idx and term: leaders append them in order of seq, others refuse."""
    own = states.select("node_id", F.col("role").alias("_role"), F.col("last_idx").alias("_last"), F.col("term").alias("_term"))
    told = numbered(proposals.join(own, "node_id"), ["node_id"], F.floor(F.col("seq") / width), ["seq"], "_n")
    leads = F.col("_role") == "leader"
    return told.select(*proposals.columns, F.when(leads, "APPENDED").otherwise("NOT_LEADER").alias("status"), F.when(leads, F.col("_last") + F.col("_n")).alias("idx"), F.when(leads, F.col("_term")).alias("term"))


def mark_applied(marks: DataFrame) -> DataFrame:
    """marks (node_id, seq, idx, commit_idx) with status: MARKED, NOT_ABOVE (an index already applied) or NOT_COMMITTED.

    A refused mark changes nothing, so what is applied is the greatest committed index marked before.
    """
    fit = F.col("idx") <= F.col("commit_idx")
    told = running(marks, ["node_id"], "seq", F.when(fit, F.col("idx")), "applied_idx", "max")
    told = told.withColumn("applied_idx", F.coalesce("applied_idx", F.lit(0)))
    return told.withColumn("status", F.when(F.col("idx") <= F.col("applied_idx"), "NOT_ABOVE").when(~fit, "NOT_COMMITTED").otherwise("MARKED"))


def snapshot_status(idx: Column, boundary: Column, applied: Column, commit: Column) -> Column:
    """What becomes of a snapshot taken at idx: CREATED, or why not."""
    return F.when(idx == 0, "ZERO").when(idx <= boundary, "NOT_ABOVE_BOUNDARY").when(idx > applied, "NOT_APPLIED").when(idx > commit, "NOT_COMMITTED").otherwise("CREATED")


def install_snapshots(states: DataFrame, sent: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(states, log) after snapshots (node_id, term, idx, idx_term), one a node at most.

    Status: STALE_TERM, HAVE_IT (the boundary is there or past), INSTALLED, or null
    where none was sent.  An installed one moves the boundary, raises the commit
    index, is pending until ``confirm``, and keeps the log after it only where the
    log has its last entry.
    """
    told = states.join(sent.select("node_id", F.col("term").alias("_t"), F.col("idx").alias("_i"), F.col("idx_term").alias("_it")).hint("merge"), "node_id", "left")
    status = F.when(F.col("_t").isNull(), None).when(F.col("_t") < F.col("term"), "STALE_TERM").when(F.col("_i") <= F.col("boundary_idx"), "HAVE_IT").otherwise("INSTALLED")
    told = told.withColumn("status", status)
    new = F.coalesce(F.col("status") == "INSTALLED", F.lit(False))
    after = told.withColumns({
        "term": F.greatest("term", F.coalesce("_t", "term")),
        "boundary_idx": F.when(new, F.col("_i")).otherwise(F.col("boundary_idx")),
        "boundary_term": F.when(new, F.col("_it")).otherwise(F.col("boundary_term")),
        "commit_idx": F.when(new, F.greatest("commit_idx", "_i")).otherwise(F.col("commit_idx")),
        "pending_idx": F.when(new, F.col("_i")),
    }).drop("_t", "_i", "_it")
    moved = after.where("status = 'INSTALLED'").select("node_id", F.col("boundary_idx").alias("_b"), F.col("boundary_term").alias("_bt"))
    entries = log.select("node_id", F.col("idx").alias("_b"), F.col("term").alias("_bt"))
    matched = moved.join(entries.hint("merge"), ["node_id", "_b", "_bt"], "left_semi").select("node_id", F.lit(True).alias("_has"))
    kept = log.join(moved.hint("merge"), "node_id", "left").join(matched.hint("merge"), "node_id", "left").where("_b is null or (_has and idx > _b)").drop("_b", "_bt", "_has")
    return after, kept


def confirm(states: DataFrame, confirmed: DataFrame) -> DataFrame:
    """States after a restored snapshot was confirmed (node_id, idx): it must be the pending one and committed."""
    told = states.join(confirmed.select("node_id", F.col("idx").alias("_i")), "node_id", "left")
    fit = F.coalesce((F.col("_i") == F.col("pending_idx")) & (F.col("_i") <= F.col("commit_idx")), F.lit(False))
    return told.withColumns({"applied_idx": F.when(fit, F.greatest("applied_idx", "_i")).otherwise(F.col("applied_idx")), "pending_idx": F.when(~fit, F.col("pending_idx")), "confirmed": fit}).drop("_i")


def election_ticks(heard: DataFrame, timeout: int, until: int) -> DataFrame:
    """(node_id, tick): when the timers of followers run out.

    heard: (node_id, tick) of resets (heartbeats, granted votes).  A timer runs out
    ``timeout`` ticks after the last reset and, as each election resets it, every
    ``timeout`` ticks from then on, up to the next reset or ``until``.
    """
    from tidemark.operators.scan import previous

    ticks = heard.select("node_id", "tick").distinct().withColumn("_back", -F.col("tick"))
    after = previous(ticks, ["node_id"], "_back", ["tick"], "_next", width=None)
    end = F.coalesce(F.col("_next.tick"), F.lit(until + 1))
    fired = F.when(F.col("tick") + timeout < end, F.sequence(F.col("tick") + timeout, end - 1, F.lit(timeout).cast(heard.schema["tick"].dataType)))
    return after.select("node_id", F.explode(fired).alias("tick"))


def heartbeat_ticks(terms: DataFrame, interval: int) -> DataFrame:
    """(node_id, tick): a leader's heartbeats in its terms of office (node_id, from_tick, to_tick): at once, then every ``interval``."""
    kind = terms.schema["from_tick"].dataType
    return terms.select("node_id", F.explode(F.sequence("from_tick", "to_tick", F.lit(interval).cast(kind))).alias("tick"))


def notified(advances: DataFrame, order: str, value: str, every: int) -> DataFrame:
    """(node_id, wake, value): what a listener that wakes every so many steps finds, where anything advanced since.

    Advances in between are told once: only the highest value is there to be read.
    """
    top = advances.groupBy("node_id", F.floor(F.col(order) / every).alias("wake")).agg(F.max(value).alias("value"))
    before = running(top, ["node_id"], "wake", F.col("value"), "_past", "max")
    return before.where("_past is null or value > _past").drop("_past")
