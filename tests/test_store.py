"""The store end to end, and against a model in plain Python."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import codec
from palimpsest.operators import changelog, compaction, placement, replication, runs, snapshot
from palimpsest.sources import frames, manifest
from palimpsest.store import Sharded, Store
from palimpsest.streaming import ingest

LOG = "key string, seq long, op int, value string"


def log_of(spark, rows, schema=LOG):
    return spark.createDataFrame(rows, schema)


def values(df):
    return {r.key: r.value for r in df.collect()}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), value="string")


def batch(spark, *pairs):
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(pairs)], "key string, value string, at int")


def test_put_overwrite_delete_and_reput(spark, store):
    store.put(batch(spark, ("hello", "world"), ("k", "v1"), ("k", "v2"), ("k", "v3"), ("empty", "")), ["at"])
    assert values(store.get(["hello", "k", "empty", "nonexistent"])) == {"hello": "world", "k": "v3", "empty": ""}
    store.delete(spark.createDataFrame([("k",), ("never",)], "key string"))
    at = store.next_seq()
    assert values(store.get(["k", "never"])) == {}
    store.put(batch(spark, ("k", "reborn")))
    assert values(store.get(["k"])) == {"k": "reborn"}
    assert values(store.get_at(["k"], at)) == {} and values(store.get_at(["k"], at - 2)) == {"k": "v3"}
    again = Store(spark, store.folder, value="string")
    assert values(again.snapshot()) == {"hello": "world", "empty": "", "k": "reborn"}


def test_time_travel_is_inclusive(spark, store):
    seqs = []
    for status in ("offline", "online", "busy", "away"):
        store.put(batch(spark, ("user", status)))
        seqs.append(store.next_seq())
    for at, status in zip(seqs, ("offline", "online", "busy", "away")):
        assert values(store.get_at(["user"], at)) == {"user": status}
    assert values(store.get_at(["user"], seqs[0] - 1)) == {}


def test_large_values(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), value="binary")
    s.put(spark.createDataFrame([("big", bytearray(b"\xab" * 65536))], "key string, value binary"))
    assert bytes(s.get(["big"]).first().value) == b"\xab" * 65536


def test_a_commit_fails_if_another_was_first(spark, store):
    store.put(batch(spark, ("a", "1")))
    base = store.catalog.version()
    store.put(batch(spark, ("a", "2")))
    with pytest.raises(RuntimeError):
        store.catalog.commit([{"path": "x"}], [], base)


def test_random_histories_against_a_model(spark, store):
    rng, model, seq = random.Random(4), [], 0
    for _ in range(6):
        rows = []
        for _ in range(rng.randrange(1, 12)):
            k = rng.choice("abcdef")
            rows.append((k, f"v{rng.randrange(99)}"))
        if rng.random() < 0.3:
            keys = sorted({k for k, _ in rows})
            store.delete(spark.createDataFrame([(k,) for k in keys], "key string"), ["key"])
            for k in keys:
                seq += 1
                model.append((k, seq, None))
        else:
            store.put(batch(spark, *rows), ["at"])
            for k, v in rows:
                seq += 1
                model.append((k, seq, v))
    horizon = seq // 2
    assert store.compact(horizon, fan_in=4) and store.next_seq() == seq
    assert not store.compact(horizon, fan_in=40)
    for at in range(horizon, seq + 1):
        state = {}
        for k, s, v in model:
            if s <= at:
                state[k] = v
        assert values(store.snapshot(at)) == {k: v for k, v in state.items() if v is not None}
    assert len(store.vacuum(0)) == 4 and store.snapshot().count() >= 0


def test_a_merge_of_some_runs_keeps_the_tombstones_that_others_need(spark):
    log = log_of(spark, [("k", 1, 1, "old", "r1"), ("k", 2, 0, None, "r2"), ("j", 3, 1, "x", "r3")], LOG + ", run_id string")
    out = compaction.compact(log, ["r2", "r3"], "m", 10)
    assert values(snapshot.snapshot(out.drop("run_id"))) == {"j": "x"}
    assert {r.key for r in compaction.resurrected(log, 10).collect()} == {"k"}
    assert values(snapshot.snapshot(compaction.retain(log, 10).drop("run_id"))) == {"j": "x"}


def test_dispatch(spark, store):
    rows = [(0, 1, "k", None), (1, 2, "k", "v"), (2, 1, "k", None), (3, 3, "k", None), (4, 1, "k", None), (5, 9, "k", None), (6, 2, "e", ""), (7, 1, "e", None)]
    got = {r.pos: (r.status, r.value) for r in store.dispatch(spark.createDataFrame(rows, "pos long, op int, key string, value string")).collect()}
    assert got == {0: (1, None), 1: (0, None), 2: (0, "v"), 3: (0, None), 4: (1, None), 5: (2, None), 6: (0, None), 7: (0, "")}


def test_probes_of_many_stretches(spark):
    rng = random.Random(1)
    rows = [(k, s, int(rng.random() > 0.3), f"{k}{s}") for s, k in enumerate(rng.choices("abc", k=300))]
    log = log_of(spark, [(k, s, op, v if op else None) for k, s, op, v in rows])
    probes = [(k, at) for k in "abcd" for at in range(-1, 301, 7)]
    got = snapshot.multi_get(log, spark.createDataFrame(probes, "key string, at long"), width=16).collect()
    assert len(got) == len(probes)
    for r in got:
        seen = [x for x in rows if x[0] == r.key and x[1] <= r["at"]]
        want = seen[-1][3] if seen and seen[-1][2] else None
        assert r.value == want and r.found == (want is not None)


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(7)
    assert {r.x: r.seq for r in changelog.number_rows(df, ["x"], 50).collect()} == {i: 51 + i for i in range(1000)}


@pytest.mark.parametrize(("key", "prefix", "n", "limit", "full", "left"), [("flush_test", "value_", 40, 1024, 5, 5), ("compact_key", "old_", 60, 512, 15, 0), ("persistent_key", "old_val_", 50, 1024, 7, 1)])
def test_flushes(spark, key, prefix, n, limit, full, left):
    log = log_of(spark, [(key, i, 1, f"{prefix}{i}") for i in range(n)])
    seg = [r.segment for r in runs.flush_runs(log, limit).orderBy("seq").collect()]
    held, want = 0, []
    k = 0
    for i in range(n):
        held += len(key) + len(f"{prefix}{i}") + 139
        want.append(k)
        if held >= limit:
            held, k = 0, k + 1
    assert seg == want and k == full and n - sum(w < full for w in want) == left


def test_segments_of_many_shards(spark):
    rng = random.Random(2)
    rows = [(f"s{rng.randrange(5)}", i, 1, "x" * rng.randrange(300)) for i in range(2000)]
    got = {r.seq: r.segment for r in runs.flush_runs(log_of(spark, rows), 1500).collect()}
    state = {}
    for k, i, _, v in rows:
        held, seg = state.get(k, (0, 0))
        assert got[i] == seg
        held += len(k) + len(v) + 139
        state[k] = (0, seg + 1) if held >= 1500 else (held, seg)


def test_key_codec_golden_bytes(spark):
    row = spark.createDataFrame([(bytearray(b"abc"), 42, 1)], "k binary, s long, o int")
    r = row.select(F.hex(codec.encode_key(F.col("k"), F.col("s"), F.col("o"))).alias("h"), codec.parse_key(codec.encode_key(F.col("k"), F.col("s"), F.col("o"))).alias("p"), codec.parse_key(F.unhex(F.lit("0102"))).alias("short")).first()
    assert r.h == "616263000000000000002A01" and bytes(r.p.key) == b"abc" and (r.p.seq, r.p.op) == (42, 1) and r.short is None
    keys = [("a", 1, 1), ("a", 9, 0), ("a", 9, 1), ("ab", 1, 1), ("b", 5, 1), ("", 3, 1)]
    got = [tuple(x)[:3] for x in runs.merge(log_of(spark, [(*k, "") for k in keys])).collect()]
    assert got == sorted(keys, key=lambda k: (k[0].encode(), -k[1], -k[2]))


def test_hashes(spark):
    r = spark.range(1).select(codec.fnv1a(F.lit("hello")).alias("f"), codec.bloom_positions(F.lit("hello")).alias("p"), codec.crc32(F.lit("demo_key")).alias("c"), codec.fnv1a(F.lit("")).alias("e"), codec.fnv1a(F.lit(bytearray(b"\xff\x80"))).alias("b")).first()
    assert (r.f, r.p, r.c, r.e) == (1335831723, [11435, 9828, 8221], 2713355069, 2166136261)
    h = 2166136261
    for x in b"\xff\x80":
        h = ((h ^ x) * 16777619) & 0xFFFFFFFF
    assert r.b == h


def test_bloom_has_no_false_negatives(spark):
    keys = spark.createDataFrame([(1, k) for k in ("hello", "world", "third")] + [(2, "x")], "run_id int, key string")
    bloom = runs.bloom_build(keys)
    assert runs.bloom_test(keys, bloom).where("not might_contain").count() == 0
    probes = spark.createDataFrame([(1, "a key that is not there"), (3, "any")], "run_id int, key string")
    assert {r.run_id: r.might_contain for r in runs.bloom_test(probes, bloom).collect()} == {1: False, 3: True}


def test_log_files_end_at_the_first_bad_frame(spark, tmp_path):
    def frame(key, seq, op, value):
        k = key + seq.to_bytes(8, "big") + bytes([op])
        body = len(k).to_bytes(4, "little") + k + len(value).to_bytes(4, "little") + value
        return zlib.crc32(body).to_bytes(4, "little") + body

    good = [frame(b"key1", 1, 1, b"v1"), frame(b"key2", 2, 1, b"v2"), frame(b"key1", 3, 0, b"")]
    (tmp_path / "whole.wal").write_bytes(b"".join(good))
    (tmp_path / "torn.wal").write_bytes(good[0] + good[1][:-1])
    bad = bytearray(b"".join(good))
    bad[len(good[0]) + 9] ^= 1
    (tmp_path / "corrupt.wal").write_bytes(bytes(bad))
    rows = frames.read_log(spark, str(tmp_path)).collect()
    n = {name: sum(r.path.endswith(name) for r in rows) for name in ("whole.wal", "torn.wal", "corrupt.wal")}
    assert n == {"whole.wal": 3, "torn.wal": 1, "corrupt.wal": 1}
    made = log_of(spark, [("key1", 1, 1, "v1")]).select(codec.log_frame(codec.encode_key(F.col("key"), F.col("seq"), F.col("op")), F.col("value")).alias("f")).first().f
    assert bytes(made) == good[0]


def test_run_files(spark, tmp_path):
    entries = sorted(((f"k{i:03d}".encode(), i, i % 2, b"v" * i) for i in range(200)), key=lambda e: (e[0], -e[1]))
    (tmp_path / "a.sst").write_bytes(frames.encode_run_file(entries))
    got = [(bytes(r.key), r.seq, r.op, bytes(r.value)) for r in frames.read_run_files(spark, str(tmp_path / "a.sst")).orderBy("pos").collect()]
    assert got == entries
    with pytest.raises(ValueError):
        list(frames.run_records(b"\0" * 32))


def test_run_folders(spark, tmp_path):
    log = log_of(spark, [(f"k{i % 7}", i, 1, str(i)) for i in range(50)]).withColumn("run_id", F.col("seq") % 3)
    runs.write_runs(log, str(tmp_path / "runs"))
    back = spark.read.parquet(str(tmp_path / "runs"))
    assert back.count() == 50 and runs.zone_map(back).count() == 3


def test_catalog_replay(spark, tmp_path):
    lines = [("ADD", "a"), ("ADD", "b"), ("REMOVE", "a"), ("REMOVE", "zzz"), ("ADD", "a"), ("ADD", "c"), ("REMOVE", "b")]
    text = "\n".join(f'{{"action":"{x}","path":"{p}","min_key":"q\\"","max_key":"z"}}' for x, p in lines)
    (tmp_path / "m.log").write_text(text + '\n\nnot json\n{"action":"ADD","path":"late","min_key":"","max_key":""}\n')
    got = manifest.live(manifest.parse(manifest.read_lines(spark, str(tmp_path / "m.log")))).orderBy("pos").collect()
    assert [r.path for r in got] == ["a", "c"] and got[0].min_key == 'q"'


def test_wire(spark):
    rows = [(2, "key", "value"), (1, "k", None), (3, "x" * 65534, None)]
    df = spark.createDataFrame(rows, "op int, key string, value string")
    got = df.select(codec.encode_request(F.col("op"), F.col("key"), F.col("value")).alias("f")).collect()
    assert bytes(got[0].f) == (10).to_bytes(4, "big") + b"\x02" + (3).to_bytes(2, "big") + b"keyvalue" and got[2].f is None
    raw = [bytes(got[0].f), bytes(got[1].f), b"\0\0\0", (20 << 20).to_bytes(4, "big") + b"\1\0\0", (4).to_bytes(4, "big") + b"\1\0\x09ab", (90).to_bytes(4, "big") + b"\1\0\1a"]
    d = spark.createDataFrame([(bytearray(x),) for x in raw], "f binary").select(codec.decode_request(F.col("f")).alias("d")).collect()
    assert [r.d.status for r in d] == ["ok", "ok", "short", "too_large", "bad_key_length", "short"]
    assert (d[0].d.op, bytes(d[0].d.key), bytes(d[0].d.value)) == (2, b"key", b"value")
    assert bytes(spark.range(1).select(codec.encode_response(F.lit(0), F.lit("v")).alias("r")).first().r) == b"\0\0\0\2\0v"


def test_ring_golden_counts(spark):
    nodes = spark.createDataFrame([(f"127.0.0.1:{p}", i) for i, p in enumerate((8081, 8082, 8083))], "node string, ordinal int")
    keys = spark.range(100).select(F.col("id").alias("w")).crossJoin(spark.range(1000).select(F.col("id").alias("i"))).select(F.concat(F.lit("user_"), "w", F.lit("_data_"), "i").alias("key"))
    got = {r.node[-4:]: r["keys"] for r in placement.balance(placement.route(keys, placement.ring(nodes, 3))).collect()}
    assert got == {"8081": 42153, "8082": 16833, "8083": 41014}
    assert placement.route(keys.limit(3), placement.ring(nodes.limit(0))).select("node").distinct().first().node == ""
    more = placement.add_node(nodes, "n4")
    assert more.where("node = 'n4'").first().ordinal == 3
    assert Sharded(placement.ring(more)).split(keys.limit(50)).count() == 50


def test_replicas(spark):
    p = spark.createDataFrame([("g", f"p{i}", m) for i, m in enumerate((5, 7, 9, 3))], "group string, peer string, match_index long")
    assert replication.quorum_index(p).first().quorum_index == 5
    log = spark.createDataFrame([("a", i, 1 + i // 4, f"c{i}") for i in range(1, 9)], "replica string, index long, term long, command string")
    assert replication.last_info(log).first().last_term == 3
    assert replication.truncate(log, 5).count() == 4 and replication.entries_after(log, 5).count() == 3 and replication.term_at(log, 4).first().term == 2
    more = replication.append(log, spark.createDataFrame([(1, "x"), (2, "y")], "at long, command string"), "a", 3, 8)
    assert [r["index"] for r in more.where("index > 8").orderBy("index").collect()] == [9, 10]
    terms = replication.current_terms(spark.createDataFrame([("n", 1), ("n", 4)], "node string, term long"))
    assert terms.first().term == 4


def test_stream_commits_each_batch_once(spark, store, tmp_path):
    src = tmp_path / "in"
    log_of(spark, [("a", 1, 1, "x"), ("b", 2, 1, "y")]).write.parquet(str(src))
    run = lambda: ingest.ingest(spark.readStream.schema(LOG).parquet(str(src)), store, str(tmp_path / "cp")).awaitTermination()
    run()
    log_of(spark, [("a", 3, 0, None), ("c", 4, 1, "z")]).write.mode("append").parquet(str(src))
    run()
    run()
    assert values(store.snapshot()) == {"b": "y", "c": "z"} and len(store.catalog.runs()) == 2
    assert values(ingest.live(store.log().drop("run_id"))) == {"b": "y", "c": "z"}


def test_vacuum_counts_from_the_removal(spark, store):
    import time

    for i in range(4):
        store.put(batch(spark, ("k", f"v{i}")))
    time.sleep(3)  # the runs are older than the delay before they leave the catalog
    held, at = store.log(), store.next_seq()
    store.compact(horizon=at)
    assert store.vacuum(2500) == []
    assert held.count() == 4
    time.sleep(3)
    assert len(store.vacuum(2500)) == 4 and values(store.get(["k"])) == {"k": "v3"}
    assert store.vacuum(0) == []


def test_vacuum_leaves_a_write_that_is_not_committed(spark, store):
    store.put(batch(spark, ("k", "v")))
    batch(spark, ("a", "b")).write.parquet(f"{store.folder}/runs/{'0' * 32}")
    assert store.vacuum(0) == []
    assert store.catalog.vacuum(f"{store.folder}/runs", 0, abandoned_ms=0) == [f"{store.folder}/runs/{'0' * 32}"]


def test_of_two_writers_at_once_one_fails(spark, store):
    from concurrent.futures import ThreadPoolExecutor

    def write(i):
        try:
            return store.catalog.commit([{"path": f"x{i}", "max_seq": i}], [], 0)
        except RuntimeError:
            return None

    with ThreadPoolExecutor(8) as pool:
        done = [v for v in pool.map(write, range(8)) if v]
    assert done == [1] and len(store.catalog.runs(1)) == 1


def test_reads_of_other_keys_skip_runs(spark, tmp_path):
    s = Store(spark, str(tmp_path / "n"), value="string", key="long")
    for lo in (0, 100, 1000):
        s.put(spark.range(lo, lo + 9).select(F.col("id").alias("key"), F.lit("v").alias("value")))
    assert len(s.log([104]).select("run_id").distinct().collect()) == 1 and s.get([104]).count() == 1
