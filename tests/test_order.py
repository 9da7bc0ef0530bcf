"""Numbers and carried values over parts, at sizes and settings at which jobs would cut parts differently."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import changelog, order, runs


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_a_million_wide_rows_without_gaps(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        rows = spark.range(1_000_000).select(F.xxhash64("id").alias("key"), F.repeat(F.col("id").cast("string"), 20).alias("value"))
        got = changelog.number_rows(rows, ["key"], 500)
        n, distinct, low, high, null = got.agg(F.count("*"), F.countDistinct("seq"), F.min("seq"), F.max("seq"), F.count_if(F.col("seq").isNull())).first()
        assert (n, distinct, low, high, null) == (1_000_000, 1_000_000, 501, 1_000_500, 0)
        assert got.select((F.col("seq") - 501).alias("k"), "key").sample(0.001, 1).join(rows.select("key"), "key").count() > 0
        first = [r.key for r in got.where("seq <= 600").orderBy("seq").collect()]
        assert first == [r.key for r in rows.orderBy("key").limit(100).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_numbers_nothing_nulls_and_ties(spark):
    rows = spark.createDataFrame([(None,), (1,), (1,), (None,)], "a int")
    assert sorted((r.a or 0, r.seq) for r in changelog.number_rows(rows, ["a"], 0).collect()) == [(0, 1), (0, 2), (1, 3), (1, 4)]
    assert changelog.number_rows(rows.where("a = 7"), ["a"], 3).collect() == []


def test_last_before_and_running_sum_carry_over_parts(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aaaaaab"), i, rng.choice([None, None, rng.randrange(99)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(8)
    last, total = {}, {}
    filled, summed = {}, {}
    for g, i, v in rows:
        last[g] = v if v is not None else last.get(g)
        total[g] = total.get(g, 0) + i
        filled[i], summed[i] = last[g], total[g]
    assert {r.i: r.v for r in order.last_before(df, ["g"], ["i"], "v").collect()} == filled
    assert {r.i: r.s for r in order.running_sum(df, ["g"], ["i"], "i", "s").collect()} == summed


def test_pruning_against_all_pairs(spark):
    rng = random.Random(5)
    zones = [(f"r{i}", *sorted((rng.randrange(200), rng.randrange(200)))) for i in range(60)] + [("one", 7, 7), ("all", -5, 500), ("none", None, None)]
    keys = [rng.randrange(-10, 210) for _ in range(400)] + [None]
    got = runs.prune(spark.createDataFrame([(k,) for k in keys], "key int"), spark.createDataFrame(zones, "run_id string, min_key int, max_key int"))
    want = sorted((k, r) for k in keys if k is not None for r, lo, hi in zones if lo is not None and lo <= k <= hi)
    assert sorted((r.key, r.run_id) for r in got.collect()) == want


def test_pruning_without_runs(spark):
    none = spark.createDataFrame([], "run_id string, min_key int, max_key int")
    assert runs.prune(spark.createDataFrame([(1,)], "key int"), none).collect() == []
