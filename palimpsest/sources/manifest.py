"""The run catalog: an append-only log of JSON lines, replayed to find the live runs, with one atomic file for each commit."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "action string, path string, min_key string, max_key string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of a catalog file, in its order. A catalog has a line for each flush or compaction, so it is one file and
    one task."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    return lines.where(F.col("line") != "")


def parse(lines: DataFrame) -> DataFrame:
    """(pos, action, path, min_key, max_key) up to the first line that isn't a valid entry."""
    rows = lines.withColumn("e", F.from_json("line", ENTRY + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("e").isNull() | F.col("e._bad").isNotNull() | F.col("e.action").isNull() | ~F.coalesce(F.col("e.action").isin("ADD", "REMOVE"), F.lit(False))
    first = rows.agg(F.min(F.when(bad, F.col("pos"))).alias("first_bad"))
    good = rows.join(F.broadcast(first), F.col("first_bad").isNull() | (F.col("pos") < F.col("first_bad")))  # one row
    return good.select("pos", "e.action", "e.path", "e.min_key", "e.max_key")


def encode(entries: DataFrame) -> DataFrame:
    return entries.select("pos", F.to_json(F.struct("action", "path", "min_key", "max_key")).alias("line"))


def live(entries: DataFrame) -> DataFrame:
    """(pos, path, min_key, max_key) of the live runs, oldest first by pos: an ADD lives unless the next entry of its path is
    a REMOVE. A path that is added again is a new entry, and an unknown REMOVE does nothing."""
    later = Window.partitionBy("path").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    rows = entries.withColumn("next_add", F.min(F.when(F.col("action") == "ADD", F.col("pos"))).over(later)).withColumn("next_remove", F.min(F.when(F.col("action") == "REMOVE", F.col("pos"))).over(later))
    dead = F.col("next_remove").isNotNull() & (F.col("next_add").isNull() | (F.col("next_remove") < F.col("next_add")))
    return rows.where((F.col("action") == "ADD") & ~dead).select("pos", "path", "min_key", "max_key")


class Catalog:
    """Versions of the list of live runs in a folder, ``v<number>.json`` each. A version's file appears whole or not at all,
    and of two writers of the same version one fails.

    A commit writes a file of its own and gives it the version's name by a step that fails if the name is taken: a hard
    link on a local file system, a rename without overwriting elsewhere, which HDFS does in one step. A store whose
    renames aren't atomic needs a lock of its own around commits. All file access goes through Hadoop's file systems.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(self.folder))

    def _listed(self) -> list[tuple[int, int]]:
        """(version, time of its commit in milliseconds), ascending."""
        found = []
        for s in self._fs.listStatus(self._path(self.folder)):
            n = s.getPath().getName()
            if n.startswith("v") and n.endswith(".json"):
                found.append((int(n[1:-5]), s.getModificationTime()))
        return sorted(found)

    def version(self) -> int:
        return max((v for v, _ in self._listed()), default=0)

    def _file(self, version: int):
        return self._path(f"{self.folder}/v{version:012d}.json")

    def runs(self, version: int | None = None) -> list[dict]:
        v = self.version() if version is None else version
        if not v:
            return []
        stream = self._fs.open(self._file(v))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [json.loads(line) for line in text.splitlines() if line]

    def _claim(self, temp, target) -> bool:
        """Gives ``temp`` the name ``target``; false if that is taken."""
        try:
            if self._fs.getUri().getScheme() == "file":
                files, of = self._jvm.java.nio.file.Files, lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                files.createLink(of(target), of(temp))
                self._fs.delete(temp, False)
            else:
                plain = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), self._conf).rename(temp, target, plain)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def commit(self, add: list[dict], remove: list[str], base: int | None = None, front: bool = False) -> int:
        """The version after ``base``, with runs added at the end, or at the front as a merge of the oldest is."""
        base = self.version() if base is None else base
        kept = [r for r in self.runs(base) if r["path"] not in set(remove)]
        runs = [*add, *kept] if front else [*kept, *add]
        temp = self._path(f"{self.folder}/.{uuid.uuid4().hex}")
        out = self._fs.create(temp, False)
        try:
            out.write(bytearray("".join(json.dumps(r) + "\n" for r in runs), "utf-8"))
        finally:
            out.close()
        if not self._claim(temp, self._file(base + 1)):
            self._fs.delete(temp, False)
            raise RuntimeError(f"version {base + 1} was committed by another writer")
        return base + 1

    def vacuum(self, root: str, older_than_ms: int, abandoned_ms: int = 7 * 86_400_000) -> list[str]:
        """Deletes the run folders under ``root`` that left the catalog so many milliseconds ago or more, and the versions
        before that time.

        A version is in use until another has followed it for so long, and a run while a version in use names it; so a
        reader who holds a version has that long to read it, however old its runs are. A folder that no version ever named
        is a write that isn't committed yet; it goes only when nothing has been written to it for ``abandoned_ms``.
        """
        now = int(self._jvm.java.lang.System.currentTimeMillis())
        listed = self._listed()
        used, known, past = set(), set(), []
        for i, (v, _) in enumerate(listed):
            paths = {r["path"] for r in self.runs(v)}
            known |= paths
            if i + 1 == len(listed) or now - listed[i + 1][1] < older_than_ms:
                used |= paths
            else:
                past.append(v)
        gone = []
        for s in self._fs.listStatus(self._path(root)):
            p = s.getPath()
            name = f"{root.rstrip('/')}/{p.getName()}"
            left = name in known or now - s.getModificationTime() >= abandoned_ms
            if s.isDirectory() and name not in used and left:
                self._fs.delete(p, True)
                gone.append(name)
        for v in past:  # after the runs that only they name
            self._fs.delete(self._file(v), False)
        return gone
