"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import materialise, release

#: Nodes that are sent to all tasks, at most (16 bytes each), and rows of a node that one task may hold in any case.
HUBS, SMALL = 100_000, 10_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(rows: DataFrame, least: Column, n: int, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``link`` of ``rows`` (u, v) with ``m``, the least that ``least`` takes of each u's rows; written to the shared folder.

    A node may have a third of all links. Nodes with more than 2 ``n`` / ``HUBS`` rows, of which there are at most ``HUBS``
    as there are at most 2 ``n`` rows, are sent to the rows' own tasks; only the others' rows meet by node.
    """
    per = materialise(rows.groupBy("u").agg(least.alias("m"), F.count("*").alias("n")), "least")
    many = F.col("n") > max(SMALL, 2 * n // HUBS)
    hubs, others = per.where(many).select("u", "m"), per.where(~many).select("u", "m")
    if hubs.isEmpty():
        found = rows.join(others, "u")
    else:
        found = rows.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(others, "u").unionByName(rows.join(F.broadcast(hubs), "u"))
    made = materialise(link(found).distinct(), "links")
    release(per)
    return made


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both, F.least(F.col("u"), F.min("v")), n, lambda r: r.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    # The row of the least itself keeps the node's own link to it.
    return _star(edges, F.min("v"), n, lambda r: r.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); root is the least node that it reaches.

    Empty links, null ends and links from a node to itself give no row; repeated links change nothing. Each round writes
    its links to the shared folder, so that no round depends on the executors that made the round before.
    """
    a, b = F.col("a"), F.col("b")
    edges = links.where("a <> b").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = materialise(edges, "links")
    mark = _mark(edges)
    while mark[0]:
        large = _large_star(edges, mark[0])
        release(edges)
        after = _small_star(large, mark[0])
        release(large)
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
