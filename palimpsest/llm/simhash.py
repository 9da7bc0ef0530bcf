"""SimHash near-duplicates: fingerprints, links by blocks that close pairs must share, and their components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, fresh, materialise
from palimpsest.llm.components import components

#: Buckets with more fingerprints than this are dealt anew, by more and longer blocks.
HOT_BUCKET = 4096


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; A-Z count as a-z, and no word gives 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    k, h = min(shingle, len(words)), xxhash.xxh64_intdigest
    hashes = np.array([h(flat[s:e], seed) for s, e in zip(starts, ends[k - 1 :])], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id_col, fp, text_hash) for every row: the fingerprint's bits as a long, and a hash of the text, which with the id
    names a row. A null text counts as empty, but for its hash; repeated rows stay."""

    def batch(b: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        return {id_col: b.column(0), "fp": pa.array(fps), "text_hash": b.column(2)}

    kind = dict(docs.dtypes)[id_col]
    return arrow_map(docs.select(id_col, text_col, F.xxhash64(text_col).alias("_h")), batch, f"`{id_col}` {kind},fp long,text_hash long")


def cover(distance: int, n: int) -> list[int]:
    """Masks such that two fingerprints within ``distance`` bits agree under one at least.

    64 bits are cut into m > distance blocks; a close pair differs in at most ``distance`` of them, so it agrees in some
    m - distance. m grows with the number of fingerprints, so that a mask has more bits than n has: strangers then share
    few buckets at any size, and no pair is lost at any m.
    """
    m = distance + 1
    while m < min(2 * distance + 2, 64) and (64 * (m - distance)) // m < max(n, 2).bit_length() + 2:
        m += 1
    cuts = [round(64 * i / m) for i in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << (64 - b) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, m - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _dealt(fps: DataFrame, masks: list[int]) -> DataFrame:
    """A row for each fingerprint and mask: which mask, the bits under it, the fingerprint."""
    keys = F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(masks)))
    return fps.select("fp", F.explode(keys).alias("k")).select("k.mask", "k.bits", "fp")


def _tree(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what a bucket's links of at most ``distance`` bits connect: each fingerprint with its component's first.

    A fingerprint leaves the list once it is reached, so memory is in proportion to the bucket and no pair is listed.
    """
    out, rest = [], fps.astype(np.uint64)
    while len(rest) > 1:
        root, rest, front = int(rest[0]), rest[1:], [rest[0]]
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= distance
            if near.any():
                found = rest[near]
                rest = rest[~near]
                front.extend(found)
                out += [(int(f), root) for f in found]
    return out


def _links(dealt: DataFrame, distance: int) -> DataFrame:
    """Links within buckets; a task reads its buckets one after another and holds one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, bits, fp = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def link(mask, bits, fp):
            new = np.flatnonzero((mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])) + 1
            starts, ends = np.concatenate(([0], new)), np.concatenate((new, [len(fp)]))
            many = np.flatnonzero(ends - starts > 1)
            pairs = [x for i in many for x in _tree(fp[starts[i] : ends[i]].view(np.uint64), distance)]
            a = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

        for b in batches:
            mask, bits, fp = (np.concatenate((x, b.column(i).to_numpy())) for i, x in enumerate((mask, bits, fp)))
            if len(fp):
                last = int(np.flatnonzero((mask != mask[-1]) | (bits != bits[-1]))[-1:].sum()) + 1
                if last > 1 or (mask[0], bits[0]) != (mask[-1], bits[-1]):
                    yield link(mask[:last], bits[:last], fp[:last])
                    mask, bits, fp = mask[last:], bits[last:], fp[last:]
        if len(fp):
            yield link(mask, bits, fp)

    return dealt.mapInArrow(run, "a long, b long")


def near_links(fps: DataFrame, distance: int = 4, hot: int = HOT_BUCKET) -> DataFrame:
    """(a, b): links that connect exactly what all pairs of distinct ``fp`` within ``distance`` bits connect.

    ``fps`` has one row for each distinct fingerprint. Buckets above ``hot`` are dealt anew under the finest cover,
    which loses no pair either.
    """
    n = fps.count()
    dealt = _dealt(fps, cover(distance, n))
    large = materialise(dealt.groupBy("mask", "bits").count().where(F.col("count") > hot).select("mask", "bits"), "hot")
    if large.isEmpty():
        return _links(_by_bucket(dealt), distance)
    again = dealt.join(large, ["mask", "bits"], "left_semi").select("fp").distinct()
    cold = dealt.join(large, ["mask", "bits"], "left_anti")
    return _links(_by_bucket(cold), distance).union(_links(_by_bucket(_dealt(again, cover(distance, 1 << 62))), distance))


def _by_bucket(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("mask", "bits").sortWithinPartitions("mask", "bits")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """(id, fp, text_hash) of every row, and a row for each fingerprint: root, least id, first row (that with the least id,
    null ids last, then by the text's hash), how many rows, and whether it is linked to another."""
    rows = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash")
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "text_hash")).alias("first")
    nodes = materialise(rows.groupBy("fp").agg(F.min(id_col).alias("least"), first, F.count("*").alias("n")), "nodes")
    roots = components(near_links(nodes.select("fp"), distance))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "first", "n", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
    return rows, materialise(rooted, "roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """(id_col, fp, component_id): every row with its fingerprint and the least id that it reaches by links.

    Texts without words have fingerprint 0 and link like any other; null texts count as empty. Equal fingerprints are
    one node, so copies cost nothing after the first count. Rows with a null id take part, and get the least id that
    is not null of their component, or null if it has none; repeated rows are returned as often as they come. An empty
    table gives an empty result. Other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    rows, roots = _grouped(docs, id_col, text_col, shingle, distance)
    # Only fingerprints that are shared or linked need a look-up.
    shared = roots.where("linked or n > 1")
    named = shared.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(shared.join(named, "root").select(F.col("fp").alias("node"), F.col("component_id").cast(kind).alias("component_id"), F.lit(True).alias("named")), "named")
    out = rows.join(named, rows.fp == named.node, "left")
    return out.select(id_col, "fp", F.when(F.col("named"), F.col("component_id")).otherwise(F.col(id_col)).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """``docs`` with one row of each component: the one with the least id; of rows that share that id, the one with the
    least hash of the text; of repeated rows with that text too, any one.

    A row is chosen as its component's, by id and text together, so rows that share an id but not a component all stay.
    Rows with a null id stay only if their component has no id at all, one of them. Null texts are one component with
    empty ones. All columns stay as they are; an empty table gives an empty result.
    """
    rows, roots = _grouped(docs, id_col, text_col, shingle, distance)
    chosen = roots.groupBy("root").agg(F.min("first").alias("first")).select("first.id", "first.text_hash")
    of, text, key = fresh(docs, "kept_id", "kept_text", "text_key")
    chosen = materialise(chosen.select(F.col("id").alias(of), F.col("text_hash").alias(text)), "chosen")
    keyed = docs.withColumn(key, F.xxhash64(text_col))

    def held(df: DataFrame, names: DataFrame, how: str) -> DataFrame:
        return df.join(names, df[id_col].eqNullSafe(names[of]) & (df[key] == names[text]), how)

    repeated = rows.groupBy(F.col(id_col).alias(of), F.col("text_hash").alias(text)).count().where("count > 1").drop("count")
    repeated = materialise(repeated, "repeated")
    out = held(keyed, chosen, "left_semi")
    if not repeated.isEmpty():
        out = held(out, repeated, "left_anti").unionByName(held(out, repeated, "left_semi").dropDuplicates([id_col, key]))
    return out.drop(key)
