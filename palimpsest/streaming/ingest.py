"""Streams: micro-batches committed as runs, and the latest state of keys kept as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.functions.codec import PUT


def latest(log: DataFrame) -> DataFrame:
    """(key, seq, op, value) of each key's newest version. The state is the largest version of each key, so late rows
    change nothing that a newer one has settled."""
    return log.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("top")).select("key", "top.seq", "top.op", "top.value")


def live(log: DataFrame) -> DataFrame:
    return latest(log).where(F.col("op") == PUT).drop("op")


def ingest(log: DataFrame, store, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Commits each micro-batch of a streamed log as a run of ``store``. A batch that was committed before a failure is
    known by its number in the catalog and isn't committed twice. How much a batch takes is the source's option
    (maxFilesPerTrigger), which holds writers back."""

    def commit(batch: DataFrame, number: int) -> None:
        if number > store.last_batch():
            store._commit(batch, batch=number)

    writer = log.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
