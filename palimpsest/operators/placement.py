"""Consistent hashing: a ring of tokens, the node of each key, and how even the shards are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ring(nodes: DataFrame, vnodes: int = 3) -> DataFrame:
    """(token, node) from (node, ordinal): ``vnodes`` tokens a node; of equal tokens the last node's counts."""
    tokens = nodes.select("node", "ordinal", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("i"))
    token = F.crc32(F.concat_ws(":", F.col("node"), F.col("i").cast("string")).cast("binary"))
    return tokens.groupBy(token.alias("token")).agg(F.max_by("node", F.struct("ordinal", "i")).alias("node"))


def add_node(nodes: DataFrame, node: str) -> DataFrame:
    last = nodes.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("last"))
    return nodes.unionByName(last.select(F.lit(node).alias("node"), (F.col("last") + 1).cast(nodes.schema["ordinal"].dataType).alias("ordinal")))


def route(keys: DataFrame, tokens: DataFrame, key: str = "key", most: int = 1 << 20) -> DataFrame:
    """``keys`` with the crc32 of the key and the node of the first token not below it, or else of the first token; on an
    empty ring the node is empty.

    The ring is one sorted array, looked up by a search that stays in the JVM; it has at most ``most`` tokens.
    """
    got = sorted((r.token, r.node) for r in tokens.limit(most + 1).collect())
    if len(got) > most:
        raise ValueError(f"a ring of more than {most} tokens")
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    if not got:
        return keys.withColumn("hash", h).withColumn("node", F.lit(""))
    spark = keys.sparkSession
    # Intervals by the high bits of the hash: a key meets the tokens of its slice and the next one after it.
    bits = max(1, len(got).bit_length())
    width = (1 << 32) >> bits
    first = [next((i for i, (t, _) in enumerate(got) if t >= s * width), len(got)) for s in range((1 << bits) + 1)]
    slices = [(s, [t for t, _ in got[first[s] : first[s + 1]]], [n for _, n in got[first[s] : first[s + 1]]] + [got[first[s + 1] % len(got)][1]]) for s in range(1 << bits)]
    table = F.broadcast(spark.createDataFrame(slices, "slice long, tokens array<long>, nodes array<string>"))
    out = keys.withColumn("hash", h).withColumn("slice", F.floor(F.col("hash") / width)).join(table, "slice")
    return out.withColumn("node", F.get("nodes", F.size(F.filter("tokens", lambda t: t < F.col("hash"))))).drop("slice", "tokens", "nodes")


def balance(routed: DataFrame, size: str | None = None) -> DataFrame:
    """(node, keys, bytes, skew): skew is the node's share of keys over an even one."""
    per = routed.groupBy("node").agg(F.count("*").alias("keys"), (F.sum(size) if size else F.count("*")).cast("long").alias("bytes"))
    w = Window.partitionBy(F.lit(1))  # a row for each node
    return per.withColumn("skew", F.col("keys") * F.count("*").over(w) / F.sum("keys").over(w))
