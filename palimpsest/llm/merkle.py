"""Document fingerprints: a Merkle tree over sentences, paragraphs and sections."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import materialise

#: The first code points of a text, cut into leaves of up to the second number of them; beyond, of up to the third.
START, FINE, COARSE = 256, 32, 96
#: Documents in a part of the order, about, and parts at most (a part is read as a stream, so it may grow).
PART_ROWS, MOST_PARTS = 4096, 20_000


def _h(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


# A leaf ends after a space as soon as it is long enough, beyond the start after a word that ends so, and never is longer
# than this; so cuts before an edit stay, those after it fall into step again, and words without spaces are cut too.
_FINE = re.compile(rf".{{10,{FINE}}}?(?:(?<= )|\Z)|.{{1,{FINE}}}", re.S)
_COARSE = re.compile(rf".{{24,{COARSE}}}?(?:(?<=[nrs,] )|\Z)|.{{1,{COARSE}}}", re.S)
_SENTENCE = re.compile(r"(?<=\. )")


def _leaves(line: str, fine: int = 0) -> list[str]:
    """The line in pieces: short ones up to ``fine``, then sentences, the long ones in pieces. Joined they are the line, so
    equal leaves mean equal lines; and what follows a piece has no part in where it ends, but for the piece itself."""
    out, at = [], 0
    if fine > 0:
        for m in _FINE.finditer(line):
            out.append(m[0])
            if (at := m.end()) >= fine:
                break
    if at < len(line) or not out:
        for s in _SENTENCE.split(line[at:]):
            if len(s) > COARSE:
                out += _COARSE.findall(s)
            elif s or not out:
                out.append(s)
    return out


@dataclass
class Tree:
    """``sections``: for each, its digest and the digests of its paragraphs; a paragraph has the digests of its sentences."""

    root: bytes
    sections: list[tuple[bytes, list[tuple[bytes, list[bytes]]]]]

    def text(self) -> str:
        """The root, then each section with the leaves of its paragraphs: root:section(leaf.leaf,leaf)section(...)"""
        return self.root.hex() + ":" + "".join(s.hex()[:8] + "(" + ",".join(".".join(x.hex()[:8] for x in leaves) for _, leaves in ps) + ")" for s, ps in self.sections)


def tree(text: str | None) -> Tree:
    """Paragraphs are lines. A section ends after a blank line, or after a paragraph whose digest says so, one in eight,
    so that an edit leaves the other sections as they are. A null text counts as empty."""
    sections, paragraphs = [], []
    left = START
    for line in (text or "").split("\n"):
        leaves = [_h(s.encode("utf-8", "surrogatepass")) for s in _leaves(line, left)]
        left -= len(line) + 1
        digest = _h(b"".join(leaves))
        paragraphs.append((digest, leaves))
        if digest[0] < 32 or not line.strip():
            sections.append((_h(b"".join(d for d, _ in paragraphs)), paragraphs))
            paragraphs = []
    if paragraphs:
        sections.append((_h(b"".join(d for d, _ in paragraphs)), paragraphs))
    # Numbers of children go into the root, so that equal roots mean equal trees.
    shape = ";".join(",".join(str(len(leaves)) for _, leaves in ps) for _, ps in sections)
    return Tree(_h(b"".join(d for d, _ in sections) + shape.encode()), sections)


def fingerprint(text: str | None) -> str:
    return tree(text).text()


_LEAVES = re.compile(r"[0-9a-f]{8}(?=[.,)])")


def likeness(a: str, b: str) -> float:
    """1 if the roots are equal, else the share of leaves that two fingerprints have in common, with multiplicity."""
    if a[:32] == b[:32]:
        return 1.0
    x, y = Counter(_LEAVES.findall(a)), Counter(_LEAVES.findall(b))
    total = x.total() + y.total()
    return min(2.0 * (x & y).total() / total, 1.0 - 1.0 / (1 + total)) if total else 1.0


def differences(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """(section, paragraph) of ``b`` that no like branch of ``a`` has; sections with equal digests aren't opened."""
    if a.root == b.root:
        return []
    known = {d for d, _ in a.sections}
    leaves = Counter(p for d, ps in a.sections for p, _ in ps)
    out = []
    for i, (d, ps) in enumerate(b.sections):
        if d not in known:
            for j, (p, _) in enumerate(ps):
                if leaves[p]:
                    leaves[p] -= 1
                else:
                    out.append((i, j))
    return out


def with_next(docs: DataFrame, id_col: str, text_col: str, fn, schema: str) -> DataFrame:
    """Calls ``fn(id, text, next_text)`` on every row, in descending order of the id (null last), then of the text's hash;
    the next of the last row is the first.

    The order is cut at quantiles of the id into parts; an id that fills several is cut by the text's hash too. Each part
    also gets a copy of the rows that begin the next one, so texts move once and a task holds two of them at a time.
    """
    low = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("i"), F.xxhash64(text_col).alias("h"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = rows.count()
    parts = max(1, min(MOST_PARTS, math.ceil(n / PART_ROWS)))
    cuts = rows.agg(F.percentile_approx("i", [k / parts for k in range(1, parts)], max(10_000, 20 * parts)).alias("q")).first()["q"] if parts > 1 else []
    # Bounds (id, hash), ascending; the highest rows are part 0. An id that is r quantiles is cut r times.
    at = [(v, low + k * (1 << 64) // r) for v, r in sorted(Counter(cuts or []).items()) for k in range(r)]
    bound_i, bound_h = (np.array(x, dtype=np.int64) for x in (zip(*at) if at else ((), ())))

    def place(i: np.ndarray, h: np.ndarray) -> np.ndarray:
        """How many bounds are at or below each (id, hash)."""
        below, upto = np.searchsorted(bound_i, i, side="left"), np.searchsorted(bound_i, i, side="right")
        for v in np.unique(i[upto > below]):
            own = np.flatnonzero(i == v)
            a, b = below[own[0]], upto[own[0]]
            below[own] += np.searchsorted(bound_h[a:b], h[own], side="right")
        return below

    @F.pandas_udf("int")
    def part(i: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(len(bound_i) - place(i.to_numpy(), h.to_numpy())).astype("int32")

    heads = {r.p: tuple(r.head) for r in rows.select("i", "h").groupBy(part("i", "h").alias("p")).agg(F.max(F.struct("i", "h")).alias("head")).collect()}
    there = sorted(heads)
    before = {heads[p]: there[k - 1] for k, p in enumerate(there)}  # the part that a head's copy goes to
    head_ids = np.array(sorted({i for i, _ in before}), dtype=np.int64)

    @F.pandas_udf("int")
    def copy_to(i: pd.Series, h: pd.Series) -> pd.Series:
        v, out = i.to_numpy(), np.full(len(i), -1, dtype=np.int32)
        if len(head_ids):
            near = np.minimum(np.searchsorted(head_ids, v), len(head_ids) - 1)
            for k in np.flatnonzero(head_ids[near] == v):
                out[k] = before.get((int(v[k]), int(h.iloc[k])), -1)
        return pd.Series(out)

    own = F.struct(F.col("own").alias("part"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.col("copy").alias("part"), F.lit(True).alias("ghost"))
    rows = rows.select("*", part("i", "h").alias("own"), copy_to("i", "h").alias("copy"))
    rows = rows.select("i", "h", "id", "text", F.explode(F.when(F.col("copy") >= 0, F.array(own, ghost)).otherwise(F.array(own))).alias("to"))
    rows = rows.select("to.part", "to.ghost", "i", "h", "id", "text").repartitionById(len(at) + 1, F.col("part"))
    rows = rows.sortWithinPartitions("part", "ghost", F.col("i").desc(), F.col("h").desc())
    names = [f.split()[0] for f in schema.split(",")]
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, False
        id_type = None
        for b in batches:
            id_type, out = b.schema.field("id").type, []
            for ghost, i, text in zip(b.column("ghost").to_pylist(), b.column("id").to_pylist(), b.column("text").to_pylist()):
                if done:
                    break
                if last is not None:
                    out.append((last[0], *fn(*last, text)))
                last, done = (i, text), ghost
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c) for c in cols[1:])], names)

    return rows.mapInArrow(run, schema.replace("doc_id ?", f"doc_id {kind}"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint) for every row; null texts count as empty, and repeated rows stay."""
    from palimpsest.llm.common import arrow_map

    def batch(b: pa.RecordBatch) -> dict:
        return {id_col: b.column(0), "fingerprint": [fingerprint(t) for t in b.column(1).to_pylist()]}

    return arrow_map(docs.select(id_col, text_col), batch, f"{id_col} {dict(docs.dtypes)[id_col]},fingerprint string")


def edited(text: str, other: str) -> str:
    """``text`` with its last half, in code points, replaced by the first as many of ``other``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    Null texts count as empty; rows with a null id come last in the order, and repeated rows follow one another. A single
    row is its own next. An empty table gives an empty result. Other columns are not read.
    """

    last: list = [None, ""]  # the row before has worked out this one's fingerprint

    def one(i, text, following) -> tuple:
        text, following = text or "", following or ""
        changed = edited(text, following)
        a = last[1] if last[0] is text else fingerprint(text)
        b, c = fingerprint(changed), fingerprint(following)
        last[:] = following, c
        return len(text), sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), a, b, likeness(a, b), likeness(a, c)

    return with_next(docs, id_col, text_col, one, "doc_id ?,n_chars long,edited_sha256 string,fingerprint string,edited_fingerprint string,near_edited double,near_next double")
