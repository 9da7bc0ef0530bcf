"""Compaction: which runs to merge, and which versions a retention horizon lets go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.codec import PUT
from palimpsest.operators import snapshot

FAN_IN = 4


def retain(log: DataFrame, horizon: int, retention: str = "key") -> DataFrame:
    """All versions after ``horizon``, and of those up to it each key's newest if it is a put.

    ``retention="key"`` decides over all runs together, so a tombstone that goes takes the puts below it along.
    ``retention="run"`` decides within each ``run_id``, as engines do that look at one run at a time: what a tombstone
    in one run had hidden in another comes back. Reads as of a number before the horizon may miss history either way.
    """
    by = ["key"] if retention == "key" else ["run_id", "key"]
    old = F.col("seq") <= horizon
    # Of the old versions a task sends on one for each of its keys; the others don't move at all.
    newest = log.where(old).groupBy(*by).agg(F.max_by(F.struct(*log.columns), F.struct("seq", "op")).alias("_top"))
    kept = newest.where(F.col("_top.op") == PUT).select(*(F.col("_top")[c].alias(c) for c in log.columns))
    return log.where(~old).unionByName(kept)


def choose(runs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The oldest ``fan_in`` runs (run_id, ordinal), or none while there are fewer."""
    oldest = runs.orderBy("ordinal").limit(fan_in)
    enough = runs.agg((F.count("*") >= fan_in).alias("enough"))
    return oldest.join(F.broadcast(enough), F.col("enough")).drop("enough")


def compact(log: DataFrame, runs: list, new_run, horizon: int, retention: str = "key") -> DataFrame:
    """``log`` with its ``runs`` merged into ``new_run``. A tombstone may go only if no run outside those merged has an
    older version of its key, so with a part of the runs the newest tombstone of a key stays where others hold it."""
    inside, outside = log.where(F.col("run_id").isin(runs)), log.where(~F.col("run_id").isin(runs))
    kept = retain(inside, horizon, retention)
    if retention == "key":
        last = snapshot.newest(inside, horizon).where(F.col("op") != PUT)
        elsewhere = outside.groupBy("key").agg(F.min("seq").alias("least"))
        still = last.join(elsewhere, "key").where(F.col("least") < F.col("seq")).drop("least").withColumn("run_id", F.lit(None).cast(log.schema["run_id"].dataType))
        kept = kept.unionByName(still.select(*kept.columns))
    return outside.unionByName(kept.withColumn("run_id", F.lit(new_run).cast(log.schema["run_id"].dataType)))


def reclaimed(log: DataFrame, horizon: int) -> DataFrame:
    """(before, after_key, after_run): entries under either rule."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    one = n(log, "before").crossJoin(n(retain(log, horizon), "after_key"))  # one row each
    return one.crossJoin(n(retain(log, horizon, "run"), "after_run"))


def resurrected(log: DataFrame, horizon: int) -> DataFrame:
    """Keys that the rule by run brings back: there as of the horizon after it, but not before it."""
    before = snapshot.snapshot(log.drop("run_id"), horizon).select("key")
    after = snapshot.snapshot(retain(log, horizon, "run").drop("run_id"), horizon)
    return after.join(before, "key", "left_anti").select("key", "seq", "value")
