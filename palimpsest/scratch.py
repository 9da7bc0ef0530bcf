"""The folder that all executors share, what is left there until the end, and the library's own code, sent to executors."""

from __future__ import annotations

import atexit
import contextlib
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that a task hands to its writer at once, if it finds a place to cut.
PIECE = 1 << 20

_own: dict[str, str] = {}
_left: list[tuple[SparkSession, str]] = []
_sent: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see: ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a temporary folder and any other master a folder in the warehouse.
    """
    if set_dir := spark.conf.get("spark.checkpoint.dir", None):
        return set_dir.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if app not in _own:
        local = master.startswith("local") and not master.startswith("local-cluster")
        _own[app] = tempfile.mkdtemp(prefix="palimpsest-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return _own[app]


def leave(spark: SparkSession, path: str) -> None:
    """Has ``path`` deleted when the driver's Python ends."""
    _left.append((spark, path))


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        fs, p = _at(spark, path)
        fs.delete(p, True)


def materialise(df: DataFrame, name: str, compression: str = "snappy", by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors, and is read with pushdown.
    ``by`` is its last column, if it is to have a folder for each of that column's values."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by, compression=compression)
    leave(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(df: DataFrame | None) -> None:
    """Deletes a table of ``materialise`` that nothing will read again."""
    if df is not None and (path := getattr(df, "_scratch", None)):
        delete(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    for spark, path in _left:
        delete(spark, path)


def create(spark: SparkSession, path: str, chunks: Iterable[bytes]) -> None:
    """A new file with the chunks, one after another, anywhere Spark writes."""
    fs, p = _at(spark, path)
    out = fs.create(p, False)
    try:
        for chunk in chunks:
            out.write(bytearray(chunk))
    finally:
        out.close()


def _pieces(chunks: Iterable[bytes], end: int) -> Iterator[bytes]:
    """What ``chunks`` have, cut after bytes that are ``end``, without these; the last byte must be one."""
    held, seen = bytearray(), 0
    for chunk in chunks:
        held += chunk
        if len(held) < PIECE:
            continue
        if (at := held.rfind(end, seen)) >= 0:
            yield bytes(held[:at])
            del held[: at + 1]
        seen = len(held)
    if held:
        if held[-1] != end:
            raise ValueError("a file ends with another byte than was said")
        yield bytes(held[:-1])


def create_files(rows: DataFrame, encode: Callable[[Iterator[tuple]], Iterable[bytes]], end: int, folder: str, suffix: str) -> None:
    """A new file ``<name><suffix>`` in ``folder`` for each name, the first column of ``rows``. ``encode`` makes its bytes from
    the other columns of the name's rows, which must lie in one partition, one after another.

    Executors write the files, anywhere Spark writes and as it commits; the driver only moves them to their names. Of Spark's
    writers that of text alone adds nothing but a separator after each row. So the separator is ``end``, the byte that all of
    these files end with, and a row is a stretch of a file up to such a byte.
    """
    spark, stage = rows.sparkSession, f"{folder}/_write-{uuid.uuid4().hex}"
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        for name, own in groupby(every, key=lambda row: row[0]):
            file = "null" if name is None else f"={name}"
            for i, piece in enumerate(_pieces(encode(row[1:] for row in own), end)):
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([i]), pa.array([piece], pa.binary())], ["file", "i", "piece"])

    # Not null, so that the writer takes this order and doesn't sort by the file again.
    cut = rows.mapInArrow(run, "file string not null, i long not null, piece binary not null").sortWithinPartitions("file", "i")
    writer = cut.select("file", F.col("piece").cast("string").alias("value")).write.partitionBy("file").option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 0)
    try:
        writer.text(stage, compression="none", lineSep=chr(end))
        fs, p = _at(spark, stage)
        for made in fs.listStatus(p):
            if made.isDirectory():
                name = unquote(made.getPath().getName().removeprefix("file="))
                _, to = _at(spark, f"{folder}/{None if name == 'null' else name[1:]}{suffix}")
                (part,) = (f.getPath() for f in fs.listStatus(made.getPath()) if f.getPath().getName().startswith("part-"))
                fs.mkdirs(to.getParent())
                if fs.exists(to) or not fs.rename(part, to):
                    raise FileExistsError(f"{to} is there already")
    finally:
        delete(spark, stage)


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python of all executors, once in an application, so that it needs no installation there.

    The archive is written to the shared folder and handed out as Spark hands out any Python file. A package that is in
    an archive itself is there already.
    """
    context, here = spark.sparkContext, os.path.dirname(os.path.abspath(__file__))
    if context.applicationId in _sent or not os.path.isdir(here):
        return
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(here)))
    path = f"{shared_dir(spark)}/palimpsest-{uuid.uuid4().hex}.zip"
    create(spark, path, [raw.getvalue()])
    leave(spark, path)
    context.addPyFile(path)
    _sent.add(context.applicationId)
