"""Rows in a total order, over parts that were cut once: numbers, and what the last row before carries on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.scratch import materialise

_PLACE = (1 << 33) - 1


def parts(rows: DataFrame, order: list[str | Column], name: str = "order") -> DataFrame:
    """``rows`` range-partitioned and sorted by ``order``, with _part and _at, a row's part and its place in it.

    They are written once to the shared folder, with both columns, as another job might cut the parts elsewhere: bounds are
    sampled anew in each job, and adaptive execution merges parts by the columns that it reads.
    """
    cut = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The low 33 bits of the id are the row's place in its partition.
    cut = cut.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)))
    return materialise(cut, name)


def numbered(rows: DataFrame, order: list[str | Column], base: int = 0, name: str = "number") -> DataFrame:
    """``rows`` with ``name`` = base + 1, 2, ... in the given order; no task sorts or counts more than a part.

    Ties are numbered in any order; nulls come first. To the driver comes a row for each part.
    """
    cut = parts(rows, order)
    before, starts = base, []
    for r in sorted(cut.groupBy("_part").count().collect()):
        starts.append((r["_part"], before))
        before += r["count"]
    first = rows.sparkSession.createDataFrame(starts, "_part int, _first long")
    out = cut.join(F.broadcast(first), "_part")  # a row for each part
    return out.withColumn(name, F.col("_first") + F.col("_at") + 1).drop("_part", "_at", "_first")


def last_before(rows: DataFrame, within: list[str], order: list[str | Column], value: str) -> DataFrame:
    """``rows`` with ``value`` filled up by the last one that isn't null at or before each row of its group, in ``order``.

    A group may be any share of the rows: parts are filled each for itself, and start from what the parts before carry on,
    a row for each group and part.
    """
    cut = parts(rows, [*within, *order])
    place = Window.partitionBy("_part", *within).orderBy("_at")
    ends = cut.where(F.col(value).isNotNull()).groupBy("_part", *within).agg(F.max_by(value, "_at").alias("_end"))
    groups = cut.select("_part", *within).distinct().join(ends, ["_part", *within], "left")
    earlier = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("_part", *within, F.last("_end", ignorenulls=True).over(earlier).alias("_start"))
    own = F.last(value, ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, 0))
    filled = cut.withColumn("_own", own).join(starts, ["_part", *within])
    return filled.withColumn(value, F.coalesce("_own", "_start")).select(*rows.columns)


def running_sum(rows: DataFrame, within: list[str], order: list[str | Column], value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over its group's rows up to each, in ``order``; a group may be any share of the rows."""
    cut = parts(rows, [*within, *order])
    sums = cut.groupBy("_part", *within).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", *within, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    place = Window.partitionBy("_part", *within).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumn("_own", F.sum(value).over(place)).join(starts, ["_part", *within])
    return summed.withColumn(out, F.col("_own") + F.col("_start")).select(*rows.columns, out)
