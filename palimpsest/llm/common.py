"""What the operators share: shared scratch tables, sampling of labelled rows, folds, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.scratch import materialise, release  # noqa: F401

#: ASCII white space, as the contracts take it: space and \x09 to \x0D; bytes.split() splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
#: Words that a worker remembers in each of two generations; longer words aren't remembered.
REMEMBERED, LONGEST = 80_000, 48


class Memory:
    """What has been worked out for words, in two generations: a full young one becomes the old one, whose words come back
    when they are met again. So what is common stays, and no more than twice ``REMEMBERED`` are held."""

    def __init__(self) -> None:
        self.young: dict[str, Any] = {}
        self.old: dict[str, Any] = {}

    def all(self, words: list[str], work: Callable[[list[str]], Sequence]) -> list:
        """What is known of each of the distinct ``words``; ``work`` makes those that aren't remembered."""
        young, old = self.young, self.old
        got = list(map(young.get, words))
        left = [i for i, x in enumerate(got) if x is None]
        new = []
        for i in left:
            w = words[i]
            if w in old:
                got[i] = young[w] = old[w]
            else:
                new.append(i)
        asked = [words[i] for i in new]
        for i, w, x in zip(new, asked, work(asked) if new else ()):
            got[i] = x
            if len(w) <= LONGEST:
                young[w] = x
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        return got


def give_back() -> None:
    """Returns what Arrow and the C library have freed to the system: a worker lives through many stages beside its executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def fold(doc_id: Column, n: int, held: int) -> Column:
    """Whether crc32 of the id as text leaves ``held`` modulo ``n``; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n == held, F.lit(True))


def chance(doc_id: Column, salt: int) -> Column:
    """A number from 0 to 1 that depends on the id alone."""
    return F.pmod(F.xxhash64(F.lit(salt), doc_id), F.lit(1 << 30)) / F.lit(float(1 << 30))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, n: int, held: int, limit: int) -> DataFrame:
    """(doc_id, text, y) of about ``limit`` labelled rows outside the held-out fold, chosen by a hash of the id.

    ``limit`` bounds what a classifier is fitted on, in expectation; a doc_id with several labels counts once, with the
    largest, and one with several rows once, with the text of the least hash. Null ids, labels and texts take no part.
    """
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~fold(F.col("doc_id"), n, held))
    y = y.groupBy(F.col("doc_id").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    total = y.count()
    y = y.where(chance(F.col("doc_id"), 17) < F.lit(limit / max(total, 1)))
    small = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    found = small.join(F.broadcast(y), "doc_id")  # at most about ``limit`` pairs of numbers
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str) -> DataFrame:
    """mapInArrow, one batch at a time."""
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_arrays([out[n] if isinstance(out[n], pa.Array) else pa.array(out[n]) for n in names], names)
                del batch, out
                give_back()

    return df.mapInArrow(run, schema)
