import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import mixing


def slow_targets(sizes, weights):
    """Fills and reshares until none is above its bound."""
    left, out, open_ = float(sum(sizes)), {}, set(range(len(sizes)))
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * left / w > 3 * sizes[i] + 1e-9]
        if not over:
            out |= {i: weights[i] * left / w for i in open_}
            break
        for i in over:
            out[i] = 3.0 * sizes[i]
            open_.discard(i)
        left = sum(sizes) - sum(v for i, v in out.items())
    return [out.get(i, 0.0) for i in range(len(sizes))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=12))
def test_targets(sizes):
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    got = mixing.targets(sizes, weights)
    assert got == pytest.approx(slow_targets(sizes, weights), rel=1e-9, abs=1e-6)
    assert sum(got) == pytest.approx(sum(sizes)) and all(g <= 3 * s + 1e-6 for g, s in zip(got, sizes))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=8), st.integers(1, 33))
def test_quotas_are_exact_and_fair(quotas, shards):
    got = mixing.split_quotas(quotas, shards, seed=5)
    assert got.shape == (shards, len(quotas)) and (got >= 0).all() and (got.sum(0) == quotas).all()
    assert got.sum(1).max() - got.sum(1).min() <= max(1, int(np.ceil(np.log2(shards))) if shards > 1 else 1)
    assert (got == mixing.split_quotas(quotas, shards, seed=5)).all()


def test_plan_meets_its_targets(docs):
    rows = mixing.plan(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5
        assert own[0].source_size == sum(r["size"] for r in own)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.plan(docs).collect()))


def test_mix_holds_what_the_plan_takes(docs):
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()}
    planned = {r.source: r.n for r in mixing.plan(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert words(mixed) == {k: v for k, v in planned.items() if v}
    whole = {(r.doc_id, r.text) for r in docs.collect()}
    cut = [r for r in mixed.collect() if (r.doc_id, r.text) not in whole]
    texts = dict(docs.select("doc_id", "text").collect())
    assert len(cut) <= docs.select("source").distinct().count() and all(texts[r.doc_id].startswith(r.text) for r in cut)


def test_odd_rows(odd, empty):
    rows = mixing.plan(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.taken <= 3 * r["size"] for r in rows)
    assert mixing.mix(odd).columns == odd.columns
    mixing.mix(odd).count()
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_quotas_beyond_a_billion():
    quotas = [5_000_000_000, 3, 2_000_000_001, 0]
    got = mixing.split_quotas(quotas, 7, seed=1)
    assert (got >= 0).all() and got.sum(0).tolist() == quotas and got.sum(1).max() - got.sum(1).min() <= 3
    assert abs(got[:, 0] / 5e9 - 1 / 7).max() < 1e-4


def test_shards_draw_their_quotas_and_nothing_twice(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 4)
    rows, named = mixing.draws(docs, shards=5, seed=3)
    names = {n["source"]: n for n in named}
    drawn, by = {}, {}
    for r in rows.collect():
        rounds = [d["round"] for d in r.draws]
        assert len(set(rounds)) == len(rounds)
        for d in r.draws:
            assert drawn.setdefault((r.source, r.block, d["round"]), d["shard"]) == d["shard"]
    for (source, _, _), shard in drawn.items():
        by.setdefault(source, [0] * 5)[shard] += 1
    for source, own in by.items():
        # A block whose share of the last round is empty has a quota but no row to show it.
        assert all(0 <= q - n <= 1 for q, n in zip(names[source]["shards"], own)) and sum(names[source]["shards"]) == names[source]["quota"]
        assert names[source]["blocks"] > 1
    assert len({s for s in drawn.values()}) == 5


def test_other_quotas_give_other_shards(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 4)
    shard = lambda seed: {(r.doc_id, d["round"]): d["shard"] for r in mixing.plan(docs, shards=5, seed=seed).collect() for d in r.draws}
    monkeypatch.setattr(mixing, "split_quotas", lambda quotas, shards, seed: np.array([[q // 2 if s == 0 else 0 for q in quotas] for s in range(shards)]))
    half = mixing.plan(docs, shards=5).collect()
    assert {d["shard"] for r in half for d in r.draws} == {0}
    monkeypatch.undo()
    assert sum(r.taken for r in half) < 0.7 * sum(r.taken for r in mixing.plan(docs).collect())
    assert shard(1) != shard(2)


def test_shards_follow_one_another_and_are_shuffled(docs):
    rows = mixing.sharded(docs, shards=4).select("row.doc_id", "shard", "place", F.spark_partition_id().alias("p")).collect()
    at = [(r.shard, r.place) for r in rows]
    assert at == sorted(at) and len({r.shard for r in rows}) > 1
    for p in {r.p for r in rows}:
        own = [r.doc_id for r in rows if r.p == p]
        assert len(own) < 5 or own != sorted(own)
