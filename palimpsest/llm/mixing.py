"""Mixing sources to target weights: a multivariate-hypergeometric tree deals exact block quotas to output shards, which draw permuted blocks."""

from __future__ import annotations

import math
import re
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.llm.common import WORD, materialise

WEIGHTS = (5, 2, 1)
#: Documents in a permuted block, at most about; output shards.
BLOCK_ROWS, SHARDS = 512, 64
#: Sources whose rows are sent to all tasks, at most; beyond, they are joined by a shuffle.
SOURCES = 10_000
#: Bits of the key that name blocks at most, and those by which the blocks of a stretch differ.
_BITS, _STRETCH = 60, 12


def targets(sizes: list[int], weights: list[int], total: int | None = None, most: int = 3) -> list[float]:
    """Shares of ``total`` (all sizes by default) by weight; none is above ``most`` times its size, and the excess goes to
    the others by weight. Sources in order of most * size / weight reach their bound first, so one pass finds those that do."""
    left, weight = float(sum(sizes) if total is None else total), sum(weights)
    out = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    for at, i in enumerate(order):
        if most * sizes[i] / weights[i] >= left / weight:
            for j in order[at:]:
                out[j] = weights[j] * left / weight
            break
        out[i] = float(most * sizes[i])
        left, weight = left - out[i], weight - weights[i]
    return out


def _hypergeometric(rng: np.random.Generator, have: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` draws without return are of each kind, of ``have`` of each: exact up to a billion in all. Beyond,
    each kind's number is the nearest whole one to a normal draw of the same mean and variance, within what is possible."""
    if have.sum() < 1_000_000_000:
        return rng.multivariate_hypergeometric(have, n, method="marginals") if len(have) else have
    out, rest, left = np.zeros_like(have), int(have.sum()), n
    for i, k in enumerate(map(int, have)):
        share = k / rest if rest else 0.0
        spread = math.sqrt(max(0.0, left * share * (1 - share) * (rest - left) / max(1, rest - 1)))
        got = round(rng.normal(left * share, spread))
        out[i] = min(k, left, max(0, left - (rest - k), got))
        rest, left = rest - k, left - int(out[i])
    return out


def split_quotas(quotas: list[int], shards: int, seed: int = 0) -> np.ndarray:
    """(shards, sources): how many blocks of each source go to each shard; the columns add up to ``quotas``.

    The tree halves the shards; each node draws its left half's blocks from a multivariate hypergeometric, so each shard
    has its fair number of blocks in all, and any of them may come from any source. Same input, same draw.
    """
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def node(a: int, b: int, have: np.ndarray) -> None:
        if b - a == 1:
            out[a] = have
            return
        mid = (a + b) // 2
        left = _hypergeometric(np.random.default_rng((seed, a, b)), have, int(have.sum()) * (mid - a) // (b - a))
        node(a, mid, left)
        node(mid, b, have - left)

    if shards and len(quotas):
        node(0, shards, np.asarray(quotas, dtype=np.int64))
    return out


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, carried: list[str]) -> DataFrame:
    """(row, source, size, key): what is carried of each row, and what decides on it. Rows without an id are told apart by their text."""
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")).cast("binary"))
    return docs.select(F.struct(*carried).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size"), key.alias("key"))


def _in_blocks(sized: DataFrame, src: DataFrame) -> DataFrame:
    """With the number of each row's source and block: the first bits of its key."""
    there = sized.join(src, sized["source"].eqNullSafe(src["of"])).drop("of")
    first = F.conv(F.substring("key", 1, _BITS // 4), 16, 10).cast("long")
    return there.withColumn("block", F.call_function("shiftright", first, F.lit(_BITS) - F.col("bits")))


def draws(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3, shards: int = SHARDS, seed: int = 0, carried: list[str] | None = None) -> tuple[DataFrame, list[dict]]:
    """(row, source, size, source_size, target, key, block, draws) for every row of ``docs``, and the quotas.

    A source's documents are permuted by the MD5 of their id and cut into blocks of ``BLOCK_ROWS`` at most, about. The mix
    goes through the blocks in order, again from the start when they end, until the source's target is reached; so each
    source has an exact quota of draws of a block. ``split_quotas`` deals the quotas to the shards, and each shard draws
    the next blocks of a source's order that its quota allows, so no draw of a block is in two shards. ``draws`` lists
    those of the row's block: shard, round and the words that it takes of the row, which is all of them, but for the
    draw that reaches the target: it ends with the first words of a document, so that the words taken are the target,
    rounded. Sums over blocks are made in stretches and over stretches; no task holds a source.
    """
    sized = materialise(_sized(docs, id_col, text_col, source_col, [id_col]), "sized")
    per = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    per.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    sizes = [r["size"] for r in per]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(per))], most=most)
    words = [math.floor(g + 0.5) for g in goal]
    rounds = [w // s if s else 0 for w, s in zip(words, sizes)]
    rest = [w - e * s for w, e, s in zip(words, rounds, sizes)]
    bits = [min(_BITS, max(0, math.ceil(math.log2(max(1, r.n / BLOCK_ROWS))))) for r in per]
    spark = docs.sparkSession
    src = spark.createDataFrame([(i, r.source, s, g, e, x, d) for i, (r, s, g, e, x, d) in enumerate(zip(per, sizes, goal, rounds, rest, bits))], "at int, of string, source_size long, target double, rounds long, rest long, bits int")
    few = F.broadcast if len(per) <= SOURCES else lambda df: df
    src = few(src.withColumn("of", F.col("of").cast(dict(sized.dtypes)["source"])))

    blocks = _in_blocks(sized, src).groupBy("at", "block").agg(F.sum("size").alias("words"), F.first("rounds").alias("rounds"), F.first("rest").alias("rest"))
    blocks = materialise(blocks.withColumn("stretch", F.shiftright("block", _STRETCH)), "blocks")
    stretches = blocks.groupBy("at", "stretch").agg(F.sum("words").alias("words"), F.count("*").alias("n"))
    over = Window.partitionBy("at").orderBy("stretch")
    stretches = stretches.select("at", "stretch", (F.sum("words").over(over) - F.col("words")).alias("words_before"), (F.sum("n").over(over) - F.col("n")).alias("n_before"))
    within = Window.partitionBy("at", "stretch").orderBy("block")
    blocks = blocks.withColumn("before", F.sum("words").over(within) - F.col("words")).withColumn("rank", F.row_number().over(within) - 1)
    blocks = blocks.join(stretches, ["at", "stretch"]).withColumn("before", F.col("before") + F.col("words_before")).withColumn("rank", F.col("rank") + F.col("n_before"))
    blocks = materialise(blocks.select("at", "block", "before", "rank", "rounds", (F.col("rounds") + (F.col("before") < F.col("rest")).cast("long")).alias("draws")), "ranked_blocks")
    count = {r["at"]: (r.n, r.draws) for r in blocks.groupBy("at").agg(F.count("*").alias("n"), F.sum("draws").alias("draws")).collect()}
    n_blocks, quotas = ([count.get(i, (0, 0))[k] for i in range(len(per))] for k in (0, 1))
    dealt = split_quotas(quotas, shards, seed)
    ends = np.cumsum(dealt, axis=0)
    edges = spark.createDataFrame([(i, n_blocks[i], [int(x) for x in ends[:, i]]) for i in range(len(per))], "at int, n_blocks long, ends array<long>")
    # Draw t of a source is block t mod n_blocks of its order, in round t div n_blocks; a shard has the draws up to its end.
    shard = lambda t: F.size(F.filter("ends", lambda e: e <= t))
    drawn = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rounds")), lambda e: F.struct(e.alias("round"), shard(F.col("rank") + e * F.col("n_blocks")).alias("shard")))
    blocks = blocks.join(few(edges), "at").select("at", "block", "before", F.filter(drawn, lambda d: d["shard"] < shards).alias("drawn"))

    rows = _in_blocks(sized if carried is None else _sized(docs, id_col, text_col, source_col, carried), src)
    rows = rows.join(blocks, ["at", "block"])
    inner = Window.partitionBy("at", "block").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("cum", F.col("before") + F.sum("size").over(inner) - F.col("size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("cum")))
    taken = F.transform("drawn", lambda d: F.struct(d["shard"].alias("shard"), d["round"].alias("round"), F.when(d["round"] < F.col("rounds"), F.col("size")).otherwise(part).alias("words")))
    rows = rows.withColumn("draws", F.filter(taken, lambda d: d["words"] > 0))
    named = [{"source": r.source, "blocks": n, "quota": q, "shards": [int(x) for x in dealt[:, i]]} for i, (r, n, q) in enumerate(zip(per, n_blocks, quotas))]
    return rows.select("row", "source", "size", "source_size", "target", "key", "at", "block", "draws"), named


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """What the shards draw of each row: (doc_id, source, size, source_size, target, taken, n_draws, block, draws).

    ``taken`` is the sum of the words of the row's ``draws``, which come from the shards' quotas. Null texts have size 0
    and take nothing; null sources are one source, the last; ties and repeated rows are drawn each for itself, in the
    order of key, id and size. Sources are listed on the driver, one short row each. An empty table gives an empty plan.
    Other columns are not read.
    """
    rows, _ = draws(docs, id_col, text_col, source_col, **how)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return rows.select(F.col(f"row.{id_col}").alias("doc_id"), "source", "size", "source_size", "target", taken.alias("taken"), F.size("draws").cast("long").alias("n_draws"), "block", "draws")


@F.pandas_udf(StringType())
def _first_words(text: pd.Series, n: pd.Series) -> pd.Series:
    def cut(t: str | None, k: int) -> str | None:
        if t is None:
            return None
        end = next(islice(re.finditer(WORD, t), int(k) - 1, None)).end()
        return t[:end]

    return pd.Series([cut(t, k) for t, k in zip(text, n)], dtype=object)


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **how) -> DataFrame:
    """(row, words, size, shard, place): a row for each draw of each row of ``docs``, shard by shard, in order of place.

    A shard is shuffled by a hash of seed, key and round. Parts are ranges of (shard, place), so a shard may be as large
    as it likes and its rows still follow one another.
    """
    rows, _ = draws(docs, id_col, text_col, source_col, seed=seed, carried=docs.columns, **how)
    rows = rows.select("row", "size", "key", "at", F.explode("draws").alias("d"))
    rows = rows.select("row", "d.words", "size", "d.shard", F.xxhash64(F.lit(seed), "key", "at", "d.round").alias("place"))
    return rows.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs`` as the shards draw them: a row for each draw, shard by shard and shuffled within, the last one of a source
    cut after its last word taken.

    Columns and texts stay as they are otherwise. Rows of size 0 (null and empty texts), and rows that no shard draws, go;
    repeated rows and rows with a null id are drawn each for itself. An empty table gives an empty result.
    """
    rows = sharded(docs, id_col, text_col, source_col, **how)
    short, text = F.col("words") < F.col("size"), F.col("row")[text_col]
    cut = _first_words(F.when(short, text), F.col("words"))  # whole texts don't leave the JVM
    return rows.select(*((F.when(short, cut).otherwise(text) if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))
