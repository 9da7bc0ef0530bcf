"""The change log: rows of (key, seq, op, value), each write a new version, each delete a tombstone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.codec import DELETE, PUT
from palimpsest.operators.order import numbered


def changelog(df: DataFrame, key: Column, seq: Column, value: Column, deleted: Column | None = None) -> DataFrame:
    """Any table as a log; ``deleted`` says which rows are tombstones, whose value is null."""
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    return df.select(key.alias("key"), seq.cast("long").alias("seq"), F.when(gone, DELETE).otherwise(PUT).alias("op"), F.when(~gone, value).alias("value"))


def last_seq(log: DataFrame) -> int:
    return log.agg(F.max("seq")).first()[0] or 0


def number_rows(batch: DataFrame, order: list[str], base: int) -> DataFrame:
    """``batch`` with seq = base + 1, 2, ... in the given order, whatever its size; see ``order.numbered``."""
    return numbered(batch, order, base, "seq")


def put(log: DataFrame, batch: DataFrame, order: list[str], base: int | None = None) -> DataFrame:
    """``log`` with the batch's (key, value) as new versions, numbered after the log's last in the given order."""
    rows = number_rows(batch, order, last_seq(log) if base is None else base)
    return log.unionByName(rows.select("key", "seq", F.lit(PUT).alias("op"), "value"))


def delete(log: DataFrame, keys: DataFrame, order: list[str], base: int | None = None) -> DataFrame:
    """``log`` with a tombstone for each key; deleting a key that isn't there writes one too."""
    rows = number_rows(keys, order, last_seq(log) if base is None else base)
    value = log.schema["value"].dataType
    return log.unionByName(rows.select("key", "seq", F.lit(DELETE).alias("op"), F.lit(None).cast(value).alias("value")))


def replay(*logs: DataFrame) -> DataFrame:
    """One log of several that may overlap; an entry written twice counts once."""
    out = logs[0]
    for more in logs[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates(["key", "seq", "op"])


def history(log: DataFrame) -> DataFrame:
    """Every version with the number from which it no longer holds."""
    w = Window.partitionBy("key").orderBy("seq", "op")
    return log.withColumn("until", F.lead("seq").over(w)).withColumn("version", F.row_number().over(w).cast("long"))


def changes_between(log: DataFrame, after: int, upto: int) -> DataFrame:
    return log.where((F.col("seq") > after) & (F.col("seq") <= upto))


def reput_after_delete(log: DataFrame) -> DataFrame:
    """Puts that follow a tombstone of their key."""
    w = Window.partitionBy("key").orderBy("seq", "op")
    return log.withColumn("before", F.lag("op").over(w)).where((F.col("op") == PUT) & (F.col("before") == DELETE)).drop("before")
