"""Files of other engines, written by executors: their bytes, and what comes to the driver."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from palimpsest import catalog, scratch
from palimpsest.sources import frames

SF = "/root/testdata/sf0.001"


@pytest.fixture
def brought(spark, monkeypatch):
    """How many rows each call brought to the driver."""
    counts, kind = [], type(spark.range(0))

    def counted(whole):
        def call(self, *a, **b):
            rows = list(whole(self, *a, **b))
            counts.append(len(rows))
            return iter(rows) if whole.__name__ == "toLocalIterator" else rows

        return call

    for name in ("collect", "toLocalIterator"):
        monkeypatch.setattr(kind, name, counted(getattr(kind, name)))
    return counts


def files(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


@pytest.mark.parametrize("name", ["run_files_read", "log_files_recovered"])
def test_no_entry_comes_to_the_driver(spark, brought, name):
    catalog.QUERIES[name](spark, SF)
    assert sum(brought) <= spark.read.parquet(f"{SF}/nation.parquet").count()


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_run_files_byte_by_byte(spark, tmp_path, adaptive):
    rng = random.Random(6)
    runs = ["r1", "r2", "", "a/b%2F c", "é=x", None]
    rows = [(rng.choice(runs), rng.randbytes(rng.randrange(9)), i, i % 2, rng.choice([None, b"", rng.randbytes(200), b"plain" * 40])) for i in range(3000)]
    rows += [("one long", b"k", i, 1, bytes([i]) * 700_000) for i in range(9)] + [("no place to cut", b"k", i, 1, b"a" * 700_000) for i in range(9)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        frames.write_run_files(spark.createDataFrame(rows, "run_id string, key binary, seq long, op int, value binary").repartition(5), str(tmp_path))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    want = {}
    for run in {r[0] for r in rows}:
        own = sorted(((k, s, o, v or b"") for x, k, s, o, v in rows if x == run), key=lambda e: (e[0], -e[1], -e[2]))
        want[f"{run}.run"] = frames.encode_run_file(own)
    assert files(tmp_path) == want


def test_footer_and_index_of_a_run_file():
    entries = [(f"k{i:04d}".encode(), i, 1, b"v" * 90) for i in range(500)]
    raw = frames.encode_run_file(entries)
    bloom, index, meta, magic = struct.unpack("<IIII", raw[-16:])
    assert magic == frames.MAGIC and index - bloom == 4096
    records = {(at := 0): entries[0][0]}
    for key, _, end in frames.run_records(raw):
        records[at], at = key[:-9], end
    assert at == bloom
    (n,), at, found = struct.unpack_from("<I", raw, index), index + 4, []
    for _ in range(n):
        (m,) = struct.unpack_from("<I", raw, at)
        found.append((raw[at + 4 : at + 4 + m], struct.unpack_from("<I", raw, at + 4 + m)[0]))
        at += 8 + m
    assert at == meta and all(records[i] == key for key, i in found)
    assert all(b - a >= 4096 for (_, a), (_, b) in zip(found, found[1:])) and n == -(-bloom // (found[1][1]))
    assert raw[meta:-16] == struct.pack("<I", 5) + b"k0000" + struct.pack("<I", 5) + b"k0499"
    none = frames.encode_run_file([])
    assert none == bytes(4096) + bytes(4) + bytes(8) + struct.pack("<IIII", 0, 4096, 4100, frames.MAGIC)


def test_log_files_of_any_last_byte(spark, tmp_path):
    rng = random.Random(7)
    rows = [(f"l{i % 12}", rng.randrange(40), rng.randbytes(rng.randrange(4))) for i in range(400)]
    rows += [("nul", 1, b"a\0"), ("nul", 2, b"b\0"), ("line", 1, b"a\n\n"), ("high", 1, b"\xff\xff"), ("empty", 1, b""), ("empty at the end", 1, b"x"), ("empty at the end", 2, b""), ("d/e", 1, b"z"), (None, 1, b"z")]
    rows += [("long", i, b"abc\n" * 100_000) for i in range(9)]
    frames.write_logs(spark.createDataFrame(rows, "log string, pos long, frame binary").repartition(5), str(tmp_path))
    want = {}
    for log, _, frame in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        want[f"{log}.log"] = want.get(f"{log}.log", b"") + frame
    assert files(tmp_path) == want


def test_a_file_that_is_there_stays(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"old")
    with pytest.raises(FileExistsError):
        frames.write_logs(spark.createDataFrame([("a", 1, b"new")], "log string, pos long, frame binary"), str(tmp_path))
    assert files(tmp_path) == {"a.log": b"old"}
    with pytest.raises(Exception, match="a frame is null"):
        frames.write_logs(spark.createDataFrame([("b", 1, None)], "log string, pos long, frame binary"), str(tmp_path))


def test_pieces(monkeypatch):
    monkeypatch.setattr(scratch, "PIECE", 10)
    rng = random.Random(8)
    for _ in range(500):
        chunks = [bytes(rng.choices(b"abc", k=rng.randrange(6))) for _ in range(rng.randrange(12))]
        whole = b"".join(chunks)
        if whole:
            assert b"".join(p + whole[-1:] for p in scratch._pieces(chunks, whole[-1])) == whole
    assert list(scratch._pieces([b"", b""], 1)) == []
    assert max(map(len, scratch._pieces([b"ab"] * 1000, ord("b")))) <= 12
    with pytest.raises(ValueError):
        list(scratch._pieces([b"ab"], ord("a")))


def test_a_table_in_folders(spark):
    rows = scratch.materialise(spark.range(10).select("id", (F.col("id") % 3).cast("int").alias("m")), "t", by="m")
    assert sorted(map(tuple, rows.where("m = 1").collect())) == [(1, 1), (4, 1), (7, 1)]
    scratch.release(rows)
