"""Binary files of other engines: checksummed log frames and sorted run files, as DataFrames."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.scratch import create, create_files, materialise, release, ship

MAGIC = 0xABCD1234
#: Entries that a task hands on at once.
CHUNK = 65_536
ENTRY = "path string, pos long, key binary, seq long, op int, value binary"


def split_key(raw: bytes) -> tuple[bytes, int, int] | None:
    return (raw[:-9], int.from_bytes(raw[-9:-1], "big"), raw[-1]) if len(raw) >= 9 else None


def log_frames(raw: bytes) -> Iterator[tuple[bytes, bytes, int]]:
    """(internal key, value, end) of each whole frame with a right checksum, up to the first that isn't."""
    at = 0
    while at + 8 <= len(raw):
        crc, key_n = struct.unpack_from("<II", raw, at)
        if at + 12 + key_n > len(raw):
            return
        (value_n,) = struct.unpack_from("<I", raw, at + 8 + key_n)
        end = at + 12 + key_n + value_n
        if end > len(raw) or zlib.crc32(raw[at + 4 : end]) != crc:
            return
        yield raw[at + 8 : at + 8 + key_n], raw[at + 12 + key_n : end], end
        at = end


def run_records(raw: bytes) -> Iterator[tuple[bytes, bytes, int]]:
    """(internal key, value, end) of each record of a run file; a file without its magic number is an error."""
    if len(raw) < 16:
        raise ValueError("a run file is shorter than its footer")
    bloom, _, _, magic = struct.unpack("<IIII", raw[-16:])
    if magic != MAGIC:
        raise ValueError("not a run file")
    at = 0
    while at < bloom:
        (n,) = struct.unpack_from("<I", raw, at)
        (m,) = struct.unpack_from("<I", raw, at + 4 + n)
        end = at + 8 + n + m
        yield raw[at + 4 : at + 4 + n], raw[at + 8 + n : end], end
        at = end


def _read(spark: SparkSession, path: str, records) -> DataFrame:
    ship(spark)
    names = [f.split()[0] for f in ENTRY.split(",")]
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                rows = ((name, i, *key, v) for i, (k, v, _) in enumerate(records(raw)) if (key := split_key(k)) is not None)
                while some := list(islice(rows, CHUNK)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), kinds)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ENTRY)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The valid prefix of each log file. A file is one value of one task, so it may have 2 GB; entries leave it in chunks."""
    return _read(spark, path, log_frames)


def read_run_files(spark: SparkSession, path: str) -> DataFrame:
    """The entries of each run file, in its order; of the size of a file the same holds as for a log's."""
    return _read(spark, path, run_records)


def valid_prefix(frames: DataFrame, crc: str = "crc", payload: str = "payload", order: str = "pos", log: str | None = None) -> DataFrame:
    """Of frames that are rows already, those before the first of their log whose checksum is wrong."""
    bad = F.crc32(F.col(payload).cast("binary")) != F.col(crc)
    by = [log] if log else []
    first = frames.groupBy(*by).agg(F.min(F.when(bad, F.col(order))).alias("_first_bad"))
    joined = frames.join(first, log) if log else frames.join(F.broadcast(first))
    return joined.where(F.col("_first_bad").isNull() | (F.col(order) < F.col("_first_bad"))).drop("_first_bad")


def set_bits(bits: bytearray, key: bytes, hashes: int = 3) -> None:
    """Puts a key into a Bloom filter."""
    h = 2166136261
    for c in key:
        h = ((h ^ c) * 16777619) & 0xFFFFFFFF
    for i in range(hashes):
        p = ((h + i * 0x9E3779B9) & 0xFFFFFFFF) % (8 * len(bits))
        bits[p // 8] |= 1 << (p % 8)


def run_file(entries: Iterable[tuple[bytes, int, int, bytes]], block: int = 4096, bloom: int = 4096) -> Iterator[bytes]:
    """A run file of (key, seq, op, value) in internal order, a record at a time, then Bloom filter, block index, key range and
    footer. Of the records only the first key of each block is kept."""
    at, index, bits, in_block, lo, hi = 0, [], bytearray(bloom), 0, None, b""
    le = lambda n: struct.pack("<I", n)
    for key, seq, op, value in entries:
        if not in_block:
            index.append((key, at))
        raw = key + seq.to_bytes(8, "big") + bytes([op])
        rec = le(len(raw)) + raw + le(len(value)) + value
        yield rec
        set_bits(bits, key)
        lo, hi = key if lo is None else min(lo, key), max(hi, key)
        at += len(rec)
        in_block = 0 if in_block + len(rec) >= block else in_block + len(rec)
    lo = lo or b""
    blocks = le(len(index)) + b"".join(le(len(k)) + k + le(i) for k, i in index)
    index_at = at + len(bits)
    yield bytes(bits) + blocks + le(len(lo)) + lo + le(len(hi)) + hi + le(at) + le(index_at) + le(index_at + len(blocks)) + le(MAGIC)


def encode_run_file(entries: Iterable[tuple[bytes, int, int, bytes]], block: int = 4096) -> bytes:
    """A run file of (key, seq, op, value) in internal order: records, Bloom filter, block index, key range, footer."""
    return b"".join(run_file(entries, block))


def write_logs(frames: DataFrame, folder: str, log: str = "log", order: str = "pos", frame: str = "frame") -> None:
    """A file ``<log>.log`` in ``folder`` for each log, with its frames in order; of one place, in the order of their bytes.

    A log is one file, so one task writes it, as a stream. Files with the same last byte are written together (see
    ``create_files``), in 256 jobs at most that share the frames among them. To the driver come the logs' names and last bytes.
    """
    spark = frames.sparkSession
    some = F.coalesce(F.col(frame).cast("binary"), F.raise_error(F.lit("a frame is null")))
    rows = materialise(frames.select(F.col(log).cast("string").alias("log"), F.col(order).alias("pos"), some.alias("frame")), "frames")
    last = F.max(F.when(F.octet_length("frame") > 0, F.struct("pos", "frame"))).getField("frame")
    ends = [(r.log, r.end[0] if r.end else None) for r in rows.groupBy("log").agg(F.substring(last, -1, 1).alias("end")).collect()]
    for name in (name for name, end in ends if end is None):
        create(spark, f"{folder}/{name}.log", [])
    known = spark.createDataFrame([x for x in ends if x[1] is not None], "name string, end int")
    dealt = rows.join(F.broadcast(known), F.col("log").eqNullSafe(F.col("name"))).select("log", "pos", "frame", "end")  # a row for each log
    dealt = materialise(dealt, "frames", by="end")
    release(rows)
    for end in sorted({end for _, end in ends if end is not None}):
        own = dealt.where(F.col("end") == end).repartition("log").sortWithinPartitions("log", "pos", "frame")
        create_files(own.select("log", "frame"), lambda some: (raw for (raw,) in some), end, folder, ".log")
    release(dealt)


def write_run_files(entries: DataFrame, folder: str, run: str = "run_id", block: int = 4096) -> None:
    """A file ``<run>.run`` in ``folder`` for each run of (key, seq, op, value: binary). A run is one file, so one task writes
    it, as a stream; what comes after the records takes a key for each block. To the driver come the files' names."""
    rows = entries.select(F.col(run).cast("string").alias("run"), F.col("key").cast("binary").alias("key"), "seq", "op", F.coalesce(F.col("value").cast("binary"), F.expr("X''")).alias("value"))
    ordered = rows.repartition("run").sortWithinPartitions("run", F.col("key"), F.col("seq").desc(), F.col("op").desc())
    create_files(ordered, lambda own: run_file(own, block), MAGIC >> 24, folder, ".run")
