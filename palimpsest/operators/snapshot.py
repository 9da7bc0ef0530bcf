"""The state of keys as of a sequence number: the newest version up to it, and nothing where that is a tombstone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.codec import PUT


def newest(log: DataFrame, upto: int | None = None) -> DataFrame:
    """The newest version of each key, tombstones too. The bound is written below the aggregate, so it reaches the scan;
    what a task sends on is one row for each of its keys."""
    if upto is not None:
        log = log.where(F.col("seq") <= upto)
    top = log.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("top")) if _ordered(log) else log.groupBy("key").agg(F.max_by(F.struct("seq", "op", "value"), F.struct("seq", "op")).alias("top"))
    return top.select("key", "top.seq", "top.op", "top.value")


def _ordered(log: DataFrame) -> bool:
    return log.schema["value"].dataType.typeName() not in ("map", "variant", "void")


def snapshot(log: DataFrame, upto: int | None = None) -> DataFrame:
    """(key, seq, value) of all keys that are there."""
    return newest(log, upto).where(F.col("op") == PUT).drop("op")


def get(log: DataFrame, keys: list, upto: int | None = None) -> DataFrame:
    """As ``snapshot``, of some keys; the condition is pushed to the scan."""
    return snapshot(log.where(F.col("key").isin(keys)), upto)


def tombstones(log: DataFrame, upto: int | None = None) -> DataFrame:
    """Keys whose newest version is a delete."""
    return newest(log, upto).where(F.col("op") != PUT).select("key", "seq")


def diff(log: DataFrame, before: int, after: int) -> DataFrame:
    """(key, change, old_value, new_value) between two snapshots, by one pass over the log and one shuffle."""
    old = F.max(F.when(F.col("seq") <= before, F.struct("seq", "op", "value"))).alias("old")
    both = log.where(F.col("seq") <= after).groupBy("key").agg(old, F.max(F.struct("seq", "op", "value")).alias("new"))
    was, now = F.coalesce(F.col("old.op") == PUT, F.lit(False)), F.col("new.op") == PUT
    change = F.when(~was & now, "added").when(was & ~now, "removed").when(was & now & (F.col("old.seq") != F.col("new.seq")), "changed")
    out = both.select("key", change.alias("change"), F.when(was, F.col("old.value")).alias("old_value"), F.when(now, F.col("new.value")).alias("new_value"))
    return out.where(F.col("change").isNotNull())


def multi_get(log: DataFrame, probes: DataFrame, width: int = 1 << 20) -> DataFrame:
    """For each probe (key, at): the value as of it, with found. Probes may repeat and have more columns.

    Versions and probes are sorted together within stretches of ``width`` numbers of a key; each stretch starts from the
    newest version before it, found from one row a stretch. So a key with a third of all rows is many stretches, and no
    probe is compared with every version.
    """
    version = F.struct("seq", "op", "value")
    kind = log.select(version.alias("s")).schema["s"].dataType
    extra = [c for c in probes.columns if c not in ("key", "at")]
    v = log.select("key", F.col("seq").alias("pos"), F.lit(0).alias("probe"), version.alias("s"), F.lit(None).cast(probes.select(F.struct(F.lit(1), *extra).alias("x")).schema["x"].dataType).alias("x"))
    p = probes.select("key", F.col("at").alias("pos"), F.lit(1).alias("probe"), F.lit(None).cast(kind).alias("s"), F.struct(F.lit(1), *extra).alias("x"))
    rows = v.union(p).withColumn("stretch", F.floor(F.col("pos") / width))
    ends = rows.groupBy("key", "stretch").agg(F.max_by("s", F.when(F.col("probe") == 0, F.struct("s.seq", "s.op"))).alias("end"))
    earlier = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("key", "stretch", F.last("end", ignorenulls=True).over(earlier).alias("start"))
    w = Window.partitionBy("key", "stretch").orderBy("pos", "probe", F.col("s.op")).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("got", F.last("s", ignorenulls=True).over(w)).where("probe = 1").join(starts, ["key", "stretch"])
    got = F.coalesce("got", "start")
    there = F.coalesce(got["op"] == PUT, F.lit(False))
    return found.select("key", F.col("pos").alias("at"), *(F.col(f"x.{c}") for c in extra), there.alias("found"), F.when(there, got["value"]).alias("value"))
