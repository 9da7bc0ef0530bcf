"""Sorted runs: segmentation by size, zone maps, sparse indexes, Bloom filters, and which runs a probe must read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import codec
from palimpsest.operators import order
from palimpsest.scratch import materialise, ship


def with_size(log: DataFrame) -> DataFrame:
    return log.withColumn("size", codec.entry_size(F.col("key").cast("string"), F.col("value").cast("string"), F.col("op")))


def running_size(log: DataFrame, shard: list[str] | None = None) -> DataFrame:
    """With the bytes that the entries so far of each shard count for; a shard with most of the log is summed in parts."""
    return order.running_sum(with_size(log), shard or ["key"], ["seq", "op"], "size", "running")


def _greedy(size: np.ndarray, limit: int, held: int) -> tuple[np.ndarray, int]:
    """Segment of each entry, from 0, where a segment closes after the entry that brings it to ``limit``; and what the last
    open one holds. ``held`` bytes are in segment 0 already."""
    total = np.cumsum(size)
    out, at, base, k = np.zeros(len(size), dtype=np.int64), 0, -held, 0
    while at < len(size):
        end = int(np.searchsorted(total, base + limit))
        out[at : end + 1] = k
        if end >= len(size):
            return out, int(total[-1] - base)
        at, base, k = end + 1, int(total[end]), k + 1
    return out, 0


def segment(rows: DataFrame, shard: str, by: list[str], limit: int, size: str = "size", out: str = "segment") -> DataFrame:
    """``rows`` with the number of their run within the shard: entries are taken in order, and a run closes once its sizes
    reach ``limit``; the overshoot isn't carried on, so the number isn't a function of the running sum.

    The fold is sequential in a shard. A task reads its shards as a stream and keeps three numbers, whatever their length.
    """
    ship(rows.sparkSession)
    schema = f"{', '.join(f'`{c}` {t}' for c, t in rows.dtypes)}, `{out}` long"
    columns = list(rows.columns)
    at_shard, at_size = columns.index(shard), columns.index(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, k = None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column(at_shard).dictionary_encode() if not pa.types.is_dictionary(b.column(at_shard).type) else b.column(at_shard)
            idx = np.asarray(codes.indices.fill_null(-1))
            cuts = np.concatenate(([0], np.flatnonzero(idx[1:] != idx[:-1]) + 1, [len(idx)]))
            sizes, seg = b.column(at_size).to_numpy(zero_copy_only=False), np.zeros(b.num_rows, dtype=np.int64)
            for lo, hi in zip(cuts, cuts[1:]):
                name = b.column(at_shard)[int(lo)].as_py()
                if name != now:
                    now, held, k = name, 0, 0
                own, held = _greedy(sizes[lo:hi], limit, held)
                closed = held == 0 and hi > lo
                seg[lo:hi] = own + k
                k += int(own[-1]) + closed
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seg)], [*columns, out])

    return rows.repartition(shard).sortWithinPartitions(shard, *by).mapInArrow(run, schema)


def flush_runs(log: DataFrame, limit: int = 4 << 20) -> DataFrame:
    """(…, size, segment): which flush of its key's shard each entry belongs to."""
    return segment(with_size(log), "key", ["seq", "op"], limit)


def zone_map(runs: DataFrame, key: str = "key") -> DataFrame:
    return runs.groupBy("run_id").agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count("*").alias("entries"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))


def prune(probes: DataFrame, zones: DataFrame) -> DataFrame:
    """Which runs each probe (key) may be in.

    Keys are ranked among the runs' bounds: a bound has an even rank, what lies between two an odd one, so a run covers a
    range of ranks. The range is cut into its aligned blocks of powers of two, two of each size at most; a probe is in one
    block of each size. So they meet by equal blocks, and no probe is compared with a run that it isn't in.
    """
    bounds = materialise(order.numbered(zones.select(F.explode(F.array("min_key", "max_key")).alias("bound")).distinct().where("bound is not null"), ["bound"]).withColumn("number", F.col("number") * 2), "bounds")
    bits = max(2, (2 * bounds.count() + 1).bit_length() + 1)
    lo, hi = (bounds.select(F.col("bound").alias(c), F.col("number").alias(n)) for c, n in (("min_key", "_lo"), ("max_key", "_hi")))
    ranges = zones.join(lo, "min_key").join(hi, "max_key").select("run_id", "_lo", "_hi")
    # At level b, of what is left of the range, the first block if it is a right one, and the last if it is a left one.
    none = F.array().cast("array<struct<level:int,block:bigint>>")
    state = F.struct(F.col("_lo").alias("lo"), (F.col("_hi") + 1).alias("hi"), none.alias("out"))
    block = lambda take, b, at: F.when(take, F.array(F.struct(b.alias("level"), at.alias("block")))).otherwise(none)

    def step(s: F.Column, b: F.Column) -> F.Column:
        left = s["lo"] < s["hi"]
        got = F.concat(s["out"], block(left & (s["lo"] % 2 == 1), b, s["lo"]), block(left & (s["hi"] % 2 == 1), b, s["hi"] - 1))
        return F.struct(F.floor((s["lo"] + 1) / 2).alias("lo"), F.floor(s["hi"] / 2).alias("hi"), got.alias("out"))

    cover = ranges.select("run_id", F.explode(F.aggregate(F.sequence(F.lit(0), F.lit(bits)), state, step, lambda s: s["out"])).alias("x")).select("run_id", "x.level", "x.block")
    keys = probes.select("key").distinct().where("key is not null")
    marks = bounds.select(F.col("bound").alias("key"), F.col("number").alias("_rank"), F.lit(0).alias("_probe")).unionByName(keys.select("key", F.lit(None).cast("long").alias("_rank"), F.lit(1).alias("_probe")))
    marks = order.last_before(marks.withColumn("_all", F.lit(0)).withColumn("_last", F.when(F.col("_probe") == 0, F.struct("_rank", "key"))), ["_all"], ["key", "_probe"], "_last")
    rank = F.when(F.col("_last.key") == F.col("key"), F.col("_last._rank")).otherwise(F.col("_last._rank") + 1)
    ranked = marks.where("_probe = 1 and _last is not null").select("key", rank.alias("_rank"))
    ranked = ranked.select("key", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda b: F.struct(b.alias("level"), F.floor(F.col("_rank") / F.pow(F.lit(2), b)).cast("long").alias("block")))).alias("x"))
    found = ranked.select("key", "x.level", "x.block").join(cover, ["level", "block"]).select("key", "run_id")
    return probes.join(found, "key").select(*probes.columns, "run_id")


def block_index(rows: DataFrame, run: str = "run_id", block: int = 4096) -> DataFrame:
    """(run, block, first_key, entries): the sparse index of sorted runs. A block closes once its records reach ``block`` bytes."""
    record = F.octet_length(F.col("key").cast("string")) + codec.KEY_SUFFIX + F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0)) + 8
    sized = rows.select(run, "key", "seq", "op", record.cast("long").alias("size"))
    # Within a run records come in the order of internal keys: newest first.
    ordered = sized.withColumn("down", -F.col("seq")).withColumn("op_down", -F.col("op"))
    cut = segment(ordered, run, ["key", "down", "op_down"], block, out="block")
    return cut.groupBy(run, "block").agg(F.min("key").alias("first_key"), F.count("*").alias("entries"), F.sum("size").alias("bytes"))


def block_of(probes: DataFrame, index: DataFrame, run: str = "run_id") -> DataFrame:
    """For each different probe (run, key) the block where a search starts: the last whose first key is not greater; null if
    there is none. Probes and first keys are sorted together, so no probe meets more than one block."""
    firsts = index.select(run, F.col("first_key").alias("key"), "block", F.lit(0).alias("_probe"))
    wanted = probes.select(run, "key").distinct().select(run, "key", F.lit(None).cast(index.schema["block"].dataType).alias("block"), F.lit(1).alias("_probe"))
    found = order.last_before(firsts.unionByName(wanted), [run], ["key", "_probe", "block"], "block")
    return found.where("_probe = 1").select(run, "key", "block")


def bloom_build(keys: DataFrame, run: str = "run_id", key: str = "key") -> DataFrame:
    """(run, position): the bits that are set, a row each; at most as many for a run as the filter has bits."""
    return keys.select(run, F.explode(codec.bloom_positions(F.col(key))).alias("position")).distinct()


def bloom_test(probes: DataFrame, bloom: DataFrame, run: str = "run_id", key: str = "key") -> DataFrame:
    """(run, key, might_contain) for each distinct probe; a run without any bit set has no filter, so it may hold all."""
    wanted = probes.select(run, key).distinct()
    bits = wanted.select(run, key, F.explode(F.array_distinct(codec.bloom_positions(F.col(key)))).alias("position"))
    hit = bits.join(bloom.withColumn("set", F.lit(True)), [run, "position"], "left")
    have = bloom.select(run).distinct().withColumn("filter", F.lit(True))
    return hit.groupBy(run, key).agg(F.bool_and(F.coalesce("set", F.lit(False))).alias("all_set")).join(have, run, "left").select(run, key, (F.col("all_set") | F.col("filter").isNull()).alias("might_contain"))


def write_runs(rows: DataFrame, path: str, key_bloom: bool = True) -> None:
    """Each run as files of its own, sorted by internal key, with a Parquet Bloom filter on the key. A large run is written
    by several tasks, each a range of its keys."""
    by = ["run_id", *codec.internal_order()]
    writer = rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("append").partitionBy("run_id")
    if key_bloom:
        writer = writer.option("parquet.bloom.filter.enabled#key", "true")
    writer.parquet(path)


def merge(*runs: DataFrame) -> DataFrame:
    """All entries of the runs in the order of internal keys, range-partitioned: the k-way merge."""
    out = runs[0]
    for more in runs[1:]:
        out = out.unionByName(more)
    return out.orderBy(*codec.internal_order())


def position(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """With each entry's place among its key's in internal order."""
    w = Window.partitionBy(*(by or ["key"])).orderBy(F.col("seq").desc(), F.col("op").desc())
    return rows.withColumn("position", F.row_number().over(w).cast("long"))


