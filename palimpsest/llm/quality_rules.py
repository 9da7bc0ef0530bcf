"""Quality rules of documents, and of their hosts: rates of failure, shrunk by an empirical beta prior."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, fresh, materialise

#: A host whose shrunk rate of failures is above this loses all its documents.
HOST_RATE = 0.5
_SYMBOLS = "#*$%&|<>"
_SPACES = str.maketrans("", "", " \t\n\x0b\x0c\r")


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; a null text has none."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = sum(map(text.count, _SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    repeat = 0
    if len(words) > 3:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=len(words))
        if len(ids) < len(w):
            code = (w[:-2] * len(ids) + w[1:-1]) * len(ids) + w[2:]  # under 2**63 for two million distinct words
            if len(ids) >= 2_000_000:
                pair = np.unique(w[:-2] * len(ids) + w[1:-1], return_inverse=True)[1]
                code = pair * len(ids) + w[2:]
            _, at, n = np.unique(code, return_inverse=True, return_counts=True)
            hit = np.flatnonzero(n[at] > 1)
            mark = np.zeros(len(w), dtype=bool)
            for d in range(3):
                mark[hit + d] = True
            repeat = int(mark.sum())
    return len(words), chars, symbols, dup, repeat


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) for every row."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def batch(b: pa.RecordBatch) -> dict:
        cols = np.array([measures(t) for t in b.column(2).to_pylist()], dtype=np.int64).reshape(-1, 5)
        return {"doc_id": b.column(0), "host": b.column(1)} | {n: pa.array(cols[:, i]) for i, n in enumerate(names)}

    kinds = dict(docs.dtypes)
    out = arrow_map(docs.select(id_col, host_col, text_col), batch, f"doc_id {kinds[id_col]},host {kinds[host_col]}," + ",".join(f"{n} long" for n in names))
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def host_verdicts(rows: DataFrame, rate: float = HOST_RATE) -> DataFrame:
    """(host, n, failed, shrunk, host_failed) from rows with host and base_failed.

    The prior's mean and strength are those of a beta distribution with the mean and variance of the hosts' rates, after
    taking off the variance that chance alone gives. Hosts that vary no more than by chance get a strength of 1,000
    documents, and one host alone is its own prior. Rows without a host are one host that never fails.
    """
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    named = hosts.where(F.col("host").isNotNull())
    total = named.agg(F.sum("failed").alias("f"), F.sum("n").alias("n"), F.count("*").alias("hosts")).first()
    n, f, many = total.n or 0, total.f or 0, total.hosts
    mean = f / n if n else 0.0
    spread, noise = named.agg(F.sum(F.col("n") * F.pow(F.col("failed") / F.col("n") - mean, 2)), F.sum(F.lit(mean * (1 - mean)))).first()
    variance = ((spread or 0.0) - (noise or 0.0)) / n if n else 0.0
    strength = min(1000.0, max(1.0, mean * (1 - mean) / variance - 1)) if many > 1 and variance > 0 else 1000.0
    shrunk = (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.withColumn("shrunk", shrunk).withColumn("host_failed", F.col("host").isNotNull() & (F.col("shrunk") > rate))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rate: float = HOST_RATE) -> DataFrame:
    """The measures of every row, base_failed, and kept: false if the row or its host fails.

    Null texts have no word, so they fail; repeated rows count each. Failed hosts are joined back without a hint: few of
    them are sent to all tasks, many are joined by a shuffle that splits the largest hosts. An empty table gives an
    empty result.
    """
    rows = materialise(measured(docs, id_col, text_col, host_col), "measures")
    bad = materialise(host_verdicts(rows, rate).where("host_failed").select(F.col("host").alias("bad"), F.lit(True).alias("host_failed")), "hosts")
    out = rows.join(bad, rows.host == bad.bad, "left")
    kept = ~(F.col("base_failed") | F.coalesce("host_failed", F.lit(False)))
    return out.withColumn("kept", kept).drop("bad", "host_failed", "host")
