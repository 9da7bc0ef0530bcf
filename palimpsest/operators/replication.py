"""Replicated logs as tables: what is committed, where replicas part, who gets votes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.scratch import materialise


def last_info(log: DataFrame) -> DataFrame:
    """(replica, last_index, last_term) of each replica's log."""
    top = log.groupBy("replica").agg(F.max(F.struct("index", "term")).alias("top"))
    return top.select("replica", F.col("top.index").alias("last_index"), F.col("top.term").alias("last_term"))


def entries_after(log: DataFrame, index: int) -> DataFrame:
    return log.where(F.col("index") > index)


def truncate(log: DataFrame, index: int) -> DataFrame:
    """Without the entries from ``index`` on."""
    return log.where(F.col("index") < index)


def term_at(log: DataFrame, index: int) -> DataFrame:
    return log.where(F.col("index") == index).select("replica", "term")


def append(log: DataFrame, batch: DataFrame, replica: str, term: int, last_index: int) -> DataFrame:
    """The leader's log with the batch's commands (at: 1, 2, ...) after its last entry."""
    new = batch.select(F.lit(replica).alias("replica"), (F.col("at") + last_index).cast("long").alias("index"), F.lit(term).cast("long").alias("term"), "command")
    return log.unionByName(new)


def quorum_index(progress: DataFrame) -> DataFrame:
    """(group, quorum_index): the highest index that a majority of the group's replicas, the leader too, has.

    Of n replicas in ascending order of match it is the one at (n - 1) div 2; n div 2 would not be a majority for even n.
    A group has as many rows as it has replicas.
    """
    sorted_match = F.sort_array(F.collect_list("match_index"))
    return progress.groupBy("group").agg(F.get(sorted_match, F.floor((F.count("*") - 1) / 2).cast("int")).alias("quorum_index"))


def commit_index(progress: DataFrame, log: DataFrame, current_term: int, committed: int = 0) -> DataFrame:
    """(group, commit_index): moves on only to an entry of the current term."""
    at = quorum_index(progress)
    terms = log.select(F.col("group").alias("g"), F.col("index").alias("i"), "term")
    found = at.join(terms, (F.col("g") == F.col("group")) & (F.col("i") == F.col("quorum_index")), "left")
    ok = (F.col("quorum_index") > committed) & (F.col("term") == current_term)
    return found.select("group", F.when(F.coalesce(ok, F.lit(False)), F.col("quorum_index")).otherwise(F.lit(committed).cast("long")).alias("commit_index"))


def to_apply(log: DataFrame, last_applied: int, commit: int) -> DataFrame:
    return log.where((F.col("index") > last_applied) & (F.col("index") <= commit))


def replica_tail(leader: DataFrame, progress: DataFrame) -> DataFrame:
    """(peer, index, term, command): what each peer has still to get, from its next_index on."""
    # Peers are few, entries many: the entries stay where they are.
    peers = progress.select("peer", "next_index")
    return leader.select("index", "term", "command").join(peers, F.col("index") >= F.col("next_index")).select("peer", "index", "term", "command")


def divergence(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """(replica, first_conflict, missing): of each follower the least index where terms differ, and how many of the
    leader's entries it hasn't."""
    replicas = follower.select("replica").distinct()
    both = follower.select("replica", "index", F.col("term").alias("f")).join(leader.select("index", F.col("term").alias("l")), "index", "left")
    per = both.groupBy("replica").agg(F.min(F.when(F.col("l").isNotNull() & (F.col("l") != F.col("f")), F.col("index"))).alias("first_conflict"), F.count("l").alias("shared"))
    total = leader.agg(F.count("*").alias("total"))
    return replicas.join(per, "replica").crossJoin(total).select("replica", "first_conflict", (F.col("total") - F.col("shared")).alias("missing"))


def follow(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """(replica, index, term, command) of each follower's log after it took the leader's entries.

    A follower keeps what it has up to its first entry of another term than the leader's, drops the rest, and takes the
    leader's entries from there on; without a conflict it takes those after its last. A follower without any entry isn't in
    the table, so it isn't in the result.
    """
    columns = ["replica", "index", "term", "command"]
    other = leader.select("index", F.col("term").alias("_term"))
    conflict = F.min(F.when(F.col("term") != F.col("_term"), F.col("index")))
    cut = follower.select("replica", "index", "term").join(other, "index", "left").groupBy("replica").agg(F.coalesce(conflict, F.max("index") + 1).alias("cut"))
    cut = materialise(cut, "cuts")  # a row for each replica, read twice
    # Replicas are few, entries many: the entries stay where they are.
    own = follower.join(cut, "replica").where(F.col("index") < F.col("cut"))
    new = leader.select("index", "term", "command").join(cut, F.col("index") >= F.col("cut"))
    return own.select(*columns).unionByName(new.select(*columns))


def accept_entries(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Of each request (replica, term, current_term, prev_index, prev_term, leader_commit): success, and the replica's commit
    index after it. A lower term is refused; so is an entry before the first new one that is missing or of another term."""
    at = log.select(F.col("replica").alias("r"), F.col("index").alias("i"), F.col("term").alias("t"))
    found = requests.join(at, (F.col("r") == F.col("replica")) & (F.col("i") == F.col("prev_index")), "left")
    fits = (F.col("prev_index") == 0) | F.coalesce(F.col("t") == F.col("prev_term"), F.lit(False))
    ok = (F.col("term") >= F.col("current_term")) & fits
    ends = last_info(log).select(F.col("replica").alias("q"), "last_index")
    out = found.withColumn("success", ok).join(ends, F.col("q") == F.col("replica"), "left")
    return out.withColumn("commit", F.when(F.col("success"), F.least("leader_commit", F.coalesce("last_index", F.lit(0))))).drop("r", "i", "t", "q", "last_index")


def grant_votes(requests: DataFrame, voters: DataFrame) -> DataFrame:
    """Each request (candidate, term, last_log_index, last_log_term) at each voter (voter, current_term, voted_for, last_index,
    last_term): granted unless the term is lower, the voter chose another in this term, or the candidate's log is older."""
    free = (F.col("term") > F.col("current_term")) | F.col("voted_for").isNull() | (F.col("voted_for") == F.col("candidate"))
    recent = F.struct("last_log_term", "last_log_index") >= F.struct(F.col("last_term"), F.col("last_index"))
    granted = (F.col("term") >= F.col("current_term")) & free & recent
    return requests.join(voters, F.col("candidate") != F.col("voter")).withColumn("granted", granted)


def elected(votes: DataFrame) -> DataFrame:
    """(candidate, granted, quorum, elected); the candidate votes for itself, and its peers don't include it."""
    got = votes.groupBy("candidate").agg(F.count_if("granted").alias("granted"), F.count("*").alias("peers"))
    quorum = F.floor((F.col("peers") + 1) / 2) + 1
    return got.select("candidate", (F.col("granted") + 1).alias("granted"), quorum.alias("quorum"), (F.col("granted") + 1 >= quorum).alias("elected"))


def current_terms(messages: DataFrame) -> DataFrame:
    """(node, term): the highest term that each node has seen; it follows any higher one."""
    return messages.groupBy("node").agg(F.max("term").alias("term"))


def silent_spells(beats: DataFrame, gap: str = "300 milliseconds") -> DataFrame:
    """(node, first, last, beats): sessions of heartbeats (node, at) with no pause longer than ``gap``."""
    s = beats.groupBy("node", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("beats"))
    return s.select("node", F.col("w.start").alias("first"), F.col("w.end").alias("last"), "beats")
