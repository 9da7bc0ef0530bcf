import numpy as np
import xxhash

from palimpsest.llm import simhash
from palimpsest.llm.components import components


def slow_fingerprint(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    if not words:
        return 0
    k = min(4, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), seed=42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps, distance):
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    keys = sorted(parent)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                parent[root(b)] = root(a)
    return {f: root(f) for f in keys}


def test_fingerprints_agree_with_the_definition(docs):
    for r in docs.limit(40).collect():
        assert simhash.fingerprint(r.text) == slow_fingerprint(r.text)
    for text in (None, "", " \n", "one", "One TWO", "É é É", "a b c d", "a b c d e"):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_cover_never_misses_a_close_pair():
    rng = np.random.default_rng(1)
    for n in (10, 1 << 20, 1 << 30, 1 << 60):
        masks = simhash.cover(4, n)
        for _ in range(300):
            a = int(rng.integers(0, 1 << 63))
            b = a
            for bit in rng.choice(64, 4, replace=False):
                b ^= 1 << int(bit)
            assert any(a & m == b & m for m in masks)


def test_components_agree_with_all_pairs(docs):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {i: slow_fingerprint(t) for i, t in docs.select("doc_id", "text").collect()}
    root = groups(set(fps.values()), 4)
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    for i, f in fps.items():
        assert got[i].fp % (1 << 64) == f
        assert got[i].component_id == least[root[f]]


def test_hot_buckets_lose_no_link(spark):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 7)), replace=False)) for _ in range(400)})
    df = spark.createDataFrame([((f - (1 << 64)) if f >> 63 else f,) for f in fps], "fp long")
    want = groups(fps, 4)
    for hot in (5, 10_000):
        links = simhash.near_links(df, 4, hot)
        root = {r.node % (1 << 64): r.root for r in components(links).collect()}
        own = {f: root.get(f, (f - (1 << 64)) if f >> 63 else f) for f in fps}
        same = {}
        for f in fps:
            assert same.setdefault(want[f], own[f]) == own[f]
        assert len(set(own.values())) == len(set(want.values()))


def test_long_chains_become_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0


def test_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    zero = [r for r in got if r.fp == 0]
    assert {r.component_id for r in zero} == {1} and len(zero) == 4
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 2 and 1 in ids and 2 not in ids and ids.count(None) == 1
    assert simhash.keep_one(empty).count() == 0


def test_hubs_change_no_component(spark, monkeypatch):
    from palimpsest.llm import components as c

    rng = np.random.default_rng(5)
    pairs = [(7, i) for i in range(10, 90)] + [(100 + i, 500) for i in range(60)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1060, (50, 2))] + [(500, 89), (None, 3)]
    links = spark.createDataFrame(pairs, "a long, b long")
    want = sorted((r.node, r.root) for r in components(links).collect())
    parent = {x: x for p in pairs for x in p if x is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    linked = {x for a, b in pairs if a is not None and a != b for x in (a, b)}
    assert want == sorted((x, root(x)) for x in linked)
    monkeypatch.setattr(c, "SMALL", 3)
    monkeypatch.setattr(c, "HUBS", 20)
    assert sorted((r.node, r.root) for r in components(links).collect()) == want


def test_rows_that_share_an_id_stay_with_their_own_components(spark):
    texts = [f"{w} one two three four five six seven eight nine ten {w} {w} eleven {w}" for w in ("red", "green", "blue", "white")]
    rows = [(1, texts[0], "a"), (1, texts[1], "a"), (2, texts[2], "a"), (2, texts[2], "a"), (3, texts[0], "b"), (None, texts[3], "a"), (None, texts[3], "a"), (None, texts[2], "c"), (4, None, "a"), (5, "", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_id string")
    got = sorted(((r.doc_id or 0, r.text or "") for r in simhash.keep_one(df).collect()))
    assert got == sorted([(1, texts[0]), (1, texts[1]), (2, texts[2]), (0, texts[3]), (4, "")])
    assert simhash.keep_one(df).columns == df.columns and simhash.keep_one(df.limit(0)).count() == 0
