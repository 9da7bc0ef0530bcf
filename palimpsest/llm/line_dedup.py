"""Line dedup: winnowed line hashes, whole windows joined with their first position, extended both ways; later repeated runs go. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import fresh, materialise

#: A run of lines goes if it has so many words and any earlier one is equal.
MIN_WORDS = 50
_SPACE = r"[\x20\x09-\x0D]+"


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each distinct (id, text): the order's key, and of each line its hash and words. Lines without words have 0."""
    lines = F.transform(
        F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1),
        lambda s: F.struct(F.xxhash64(s).alias("h"), F.size(F.filter(F.split(s, _SPACE), lambda w: w != "")).cast("long").alias("w")),
    )
    one = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"), lines.alias("lines"))
    one = one.select("id", "t", F.col("lines.h").alias("h"), F.col("lines.w").alias("w"))
    return one.groupBy("id", "t").agg(F.any_value("h").alias("h"), F.any_value("w").alias("w"))


def _order(prefix: str = "") -> F.Column:
    """Documents come by id, those without one last; then by the hash of the text."""
    return F.struct(F.col(f"{prefix}id").isNull().alias("no_id"), F.col(f"{prefix}id").alias("id"), F.col(f"{prefix}t").alias("t"))


def _units(h: F.Column, w: F.Column) -> F.Column:
    """The lines as (lo, hi, h, w): one for each line with words, one for each stretch of lines without."""
    n = F.size(h)
    start = lambda i: (F.get(w, i) > 0) | (i == 0) | (F.get(w, i - 1) > 0)
    starts = F.filter(F.sequence(F.lit(0), n - 1), start)
    # A lambda's argument is worked out once; a column that another lambda refers to would be worked out at each of its steps.
    ends = lambda at, i, k: F.coalesce(F.get(at, k + 1), n) - 1
    unit = lambda at, i, k: F.struct(i.alias("lo"), ends(at, i, k).alias("hi"), F.when(F.get(w, i) > 0, F.get(h, i)).otherwise(F.xxhash64(F.slice(h, i + 1, ends(at, i, k) - i + 1))).alias("h"), F.get(w, i).alias("w"))
    return F.flatten(F.transform(F.array(starts), lambda at: F.transform(at, lambda i, k: unit(at, i, k))))


def windows(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, t, lo, hi, at, h, run): from each line on and up to each line, the least run of lines with ``min_words`` words.

    ``h`` is the least hash of a line in it and ``at`` that line, the last of equals: the winnowed fingerprint. ``run`` is
    a hash of all its lines in order. Equal windows have the same ``h`` and ``run``, and ``at`` in the same place.
    """
    rows = lines.select("id", "t", F.explode(_units(F.col("h"), F.col("w"))).alias("x")).select("id", "t", "x.lo", "x.hi", "x.h", "x.w")
    doc = Window.partitionBy("id", "t")
    rows = rows.withColumn("after", F.sum("w").over(doc.orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)))
    # Words before or after a line, and its number: a range of the former is also one of the latter.
    step = 1 << 31
    rows = rows.withColumn("from", (F.col("after") - F.col("w")) * step + F.col("lo")).withColumn("to", F.col("after") * step + F.col("lo"))
    on, up = doc.orderBy("from").rangeBetween(0, min_words * step - 1), doc.orderBy("to").rangeBetween(1 - min_words * step, 0)
    held = lambda over: F.struct(F.min("lo").over(over).alias("lo"), F.max("hi").over(over).alias("hi"), F.sum("w").over(over).alias("w"), F.min(F.struct("h", (-F.col("lo")).alias("last"))).over(over).alias("least"), F.collect_list("h").over(over).alias("hs"))
    rows = rows.select("id", "t", held(on).alias("on"), held(up).alias("up"))
    rows = rows.select("id", "t", F.explode(F.array("on", "up")).alias("x")).where(F.col("x.w") >= min_words)
    return rows.select("id", "t", "x.lo", "x.hi", (-F.col("x.least.last")).alias("at"), F.col("x.least.h").alias("h"), F.xxhash64("x.hs").alias("run"))


def repeated_lines(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, t, gone): for each document with any, the numbers of the lines that repeat an earlier run.

    Windows whose fingerprint is chosen at one position only are unlike any other and leave first. The rest are joined with
    the first position of the same whole window, whatever stands around it there; each later one goes. A line of a repeated
    run has a window within the run, on from it, up to it or across it, so together the windows extend to all of the run,
    wherever each was first. A line's first position anywhere is in no later window, so no line is lost altogether.
    """
    every = materialise(windows(lines, min_words), "windows")
    chosen = F.xxhash64("id", "t", "at")
    again = every.groupBy("h").agg(F.min(chosen).alias("a"), F.max(chosen).alias("b")).where("a < b").select(F.col("h").alias("ah"))
    some = materialise(every.join(again.hint("shuffle_hash"), F.col("h") == F.col("ah"), "left_semi"), "candidates")
    position = F.struct(_order().alias("doc"), F.col("lo").alias("lo"))
    first = some.groupBy(F.col("h").alias("fh"), F.col("run").alias("frun")).agg(F.min(position).alias("s"), F.max(position).alias("e")).where("s < e")
    first = materialise(first.select("fh", "frun", "s"), "sources")
    later = some.join(first, (F.col("h") == F.col("fh")) & (F.col("run") == F.col("frun"))).where(F.col("s") < position)
    return later.select("id", "t", F.explode(F.sequence("lo", "hi")).alias("line")).groupBy("id", "t").agg(F.collect_set("line").alias("gone"))


def _marked(docs: DataFrame, id_col: str, text_col: str, min_words: int, mark: str) -> DataFrame:
    """``docs`` with the numbers of the lines that go in ``mark``, null where none do."""
    lines = materialise(_lines(docs, id_col, text_col), "lines")
    gone = materialise(repeated_lines(lines, min_words), "gone")
    gid, gt, key = fresh(docs, "gone_id", "gone_t", "text_hash")
    gone = gone.select(F.col("id").alias(gid), F.col("t").alias(gt), F.col("gone").alias(mark))
    left = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    # The table of what goes grows with the input, so it is dealt out with the texts and built up by task, never broadcast.
    return left.join(gone.hint("shuffle_hash"), (left[key] == gone[gt]) & left[id_col].eqNullSafe(gone[gid]), "left").select(*docs.columns, mark)


def _left(text_col: str, mark: str) -> F.Column:
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda s, i: ~F.array_contains(F.col(mark), i)), "\n")
    return F.when(F.col(mark).isNull(), F.col(text_col)).otherwise(kept)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the lines that repeat an earlier run of ``min_words`` words or more; all rows and columns stay.

    Earlier: in a document with a smaller id (null ids last, then by the text's hash), or above in the same one. Rows with
    the same id and text count as one document and stay equal. Null texts stay null and empty texts empty; a document that
    is a copy is left with what no earlier one has, perhaps nothing. Lines are compared by 64-bit hashes, and runs by two. Lines without words that follow one
    another count as one line. Very long texts are taken whole; an empty table gives an empty result.
    """
    (mark,) = fresh(docs, "gone_lines")
    return _marked(docs, id_col, text_col, min_words, mark).withColumn(text_col, _left(text_col, mark)).select(*docs.columns)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text, n_lines, n_removed): what ``dedup_lines`` leaves of every row, and how many lines it took. Null texts
    stay null with one line and none removed, as empty ones do; repeated rows have equal results and all stay; an empty
    table gives an empty result; no other columns are read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = _marked(rows, "doc_id", "text", min_words, "gone")
    n_lines = F.size(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).cast("long")
    return out.select("doc_id", _left("text", "gone").alias("text"), n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
