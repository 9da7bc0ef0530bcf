"""A store in a folder: runs as Parquet, and a catalog of versions; puts, deletes, reads as of a number, compaction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import codec
from palimpsest.operators import changelog, compaction, placement, snapshot
from palimpsest.sources.manifest import Catalog


#: Types of keys whose text in the catalog gives the key again, in the order that Spark has for them.
_COMPARED = {"string": str, "byte": int, "short": int, "int": int, "long": int, "bigint": int}


class Store:
    """``put``, ``delete`` and ``dispatch`` commit a run each; all of it survives a reopening, and nothing is seen by halves.

    Numbers continue after the highest in the catalog, whatever the clock says.
    """

    def __init__(self, spark: SparkSession, folder: str, value: str = "binary", key: str = "string") -> None:
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), f"key {key}, seq long, op int, value {value}"
        self.catalog = Catalog(spark, f"{self.folder}/catalog")

    def close(self) -> None:
        """Nothing is open between calls."""

    def log(self, keys: list | None = None) -> DataFrame:
        """The live runs, with ``run_id``; with keys, only runs whose key range may hold one of them."""
        listed = self.catalog.runs()
        if keys is not None and (of := _COMPARED.get(self.schema.split()[1].rstrip(","))):
            zones = [(r, of(r["min_key"]), of(r["max_key"])) for r in listed]
            listed = [r for r, lo, hi in zones if any(lo <= k <= hi for k in map(of, keys) if k is not None)]
        empty = self.spark.createDataFrame([], self.schema + ", run_id string")
        out = empty
        if listed:
            out = self.spark.read.schema(self.schema).parquet(*(r["path"] for r in listed)).withColumn("run_id", F.regexp_extract(F.input_file_name(), r"runs/([0-9a-f]+)/", 1))
        return out

    def next_seq(self) -> int:
        """The last number given out: a snapshot to read as of."""
        return max((r["max_seq"] for r in self.catalog.runs()), default=0)

    def last_batch(self) -> int:
        """The last micro-batch of a stream that was committed."""
        return max((r.get("batch", -1) for r in self.catalog.runs()), default=-1)

    def _commit(self, rows: DataFrame, remove: list[str] = (), base: int | None = None, front: bool = False, batch: int = -1) -> int:
        path = f"{self.folder}/runs/{uuid.uuid4().hex}"
        columns = ["key", "seq", "op", "value"]
        rows.select(*columns).repartitionByRange("key").sortWithinPartitions(*codec.internal_order()).write.option("parquet.bloom.filter.enabled#key", "true").parquet(path)
        zone = self.spark.read.schema(self.schema).parquet(path).agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.max("seq").alias("seq"), F.count("*").alias("n")).first()
        if not zone.n:
            return self.catalog.commit([], list(remove), base) if remove else self.catalog.version()
        entry = {"path": path, "min_key": str(zone.lo), "max_key": str(zone.hi), "max_seq": max(zone.seq, self.next_seq()), "entries": zone.n, "batch": max([batch, *(r.get("batch", -1) for r in self.catalog.runs(base) if r["path"] in remove)])}
        return self.catalog.commit([entry], list(remove), base, front)

    def put(self, batch: DataFrame, order: list[str] | None = None) -> int:
        """Adds the batch's (key, value) as versions, numbered in the given order of its columns."""
        base = self.catalog.version()
        rows = changelog.number_rows(batch.select(*{c: None for c in ("key", "value", *(order or []))}), order or ["key"], self.next_seq())
        return self._commit(rows.select("key", "seq", F.lit(codec.PUT).alias("op"), "value"), base=base)

    def delete(self, keys: DataFrame, order: list[str] | None = None) -> int:
        base = self.catalog.version()
        rows = changelog.number_rows(keys, order or ["key"], self.next_seq())
        kind = self.schema.split("value ")[1]
        return self._commit(rows.select("key", "seq", F.lit(codec.DELETE).alias("op"), F.lit(None).cast(kind).alias("value")), base=base)

    def get(self, keys: list) -> DataFrame:
        return self.get_at(keys, None)

    def get_at(self, keys: list, seq: int | None) -> DataFrame:
        """(key, seq, value) of those keys that are there as of ``seq``, itself included."""
        return snapshot.get(self.log(keys).drop("run_id"), keys, seq)

    def snapshot(self, seq: int | None = None) -> DataFrame:
        return snapshot.snapshot(self.log().drop("run_id"), seq)

    def dispatch(self, requests: DataFrame) -> DataFrame:
        """Answers (pos, op, key, value) in order of pos: status 0 or 1 for reads found or not, 0 for writes, 2 for an unknown
        op. Reads see the writes before them; the writes are one commit, whose numbers are those of their pos."""
        base, first = self.catalog.version(), self.next_seq()
        writes = requests.where(F.col("op").isin(codec.PUT_REQUEST, codec.DELETE_REQUEST))
        put = F.col("op") == codec.PUT_REQUEST
        kind = self.schema.split("value ")[1]
        new = writes.select("key", (F.col("pos") + first + 1).alias("seq"), F.when(put, codec.PUT).otherwise(codec.DELETE).alias("op"), F.when(put, F.col("value")).cast(kind).alias("value"))
        self._commit(new, base=base)
        probes = requests.where(F.col("op") == codec.GET_REQUEST).select("key", (F.col("pos") + first).alias("at"), "pos")
        read = snapshot.multi_get(self.log().drop("run_id"), probes)
        answers = read.select("pos", F.when(F.col("found"), 0).otherwise(1).alias("status"), "value")
        known = F.col("op").isin(codec.PUT_REQUEST, codec.DELETE_REQUEST)
        others = requests.where(F.coalesce(F.col("op") != codec.GET_REQUEST, F.lit(True))).select("pos", F.when(F.coalesce(known, F.lit(False)), 0).otherwise(2).alias("status"), F.lit(None).cast(kind).alias("value"))
        return answers.unionByName(others)

    def compact(self, horizon: int, fan_in: int = compaction.FAN_IN, retention: str = "key") -> bool:
        """Merges the oldest ``fan_in`` runs into one at the front; says whether there were as many."""
        base, listed = self.catalog.version(), self.catalog.runs()
        if len(listed) < fan_in:
            return False
        old = [r["path"] for r in listed[:fan_in]]
        ids = [p.rsplit("/", 1)[1] for p in old]
        rows = compaction.compact(self.log(), ids, "", horizon, retention).where(F.col("run_id") == "")
        self._commit(rows, old, base, front=True)
        return True

    def vacuum(self, older_than_ms: int = 10_000) -> list[str]:
        return self.catalog.vacuum(f"{self.folder}/runs", older_than_ms)


class Sharded:
    """Rows with the shard that a gateway would send them to, dealt so that a shard's rows are together."""

    def __init__(self, tokens: DataFrame) -> None:
        self.tokens = tokens

    def route(self, rows: DataFrame, key: str = "key") -> DataFrame:
        return placement.route(rows, self.tokens, key)

    def split(self, rows: DataFrame, key: str = "key") -> DataFrame:
        return self.route(rows, key).repartition("node", key)


