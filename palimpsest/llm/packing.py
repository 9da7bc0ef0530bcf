"""Harmonic packing: pieces of reciprocal lengths, so many to a sequence, in every class for itself."""

from __future__ import annotations

import gc
import json
import os
import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache, cached_property
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Memory, arrow_map, give_back, materialise

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: A sequence's share of padding, at most, in the classes into which documents are cut.
PADDING = 1 / 32
#: Bytes of text that a worker takes at once, and rows in a bucket of a class, about.
AT_ONCE, BUCKET = 4 << 20, 8192
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


@cache
def _plain() -> frozenset[str]:
    """Characters that Python's classes and lower case treat as the tokenizer's do, whatever edition of Unicode either
    knows: those that have been in the same class since an early one. Other numbers than digits and the final sigma aren't."""
    old = unicodedata.ucd_3_2_0.category
    return frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if (k := unicodedata.category(c)) not in ("Cn", "No", "Nl") and old(c)[0] == k[0] and c != "\u03a3")


class WordIds:
    """Ids of whole texts. The tokenizer treats what stands between white space apart, and splits it into runs of letters,
    digits and other signs. Arrow finds the distinct words of many texts; those not met before are split into parts, parts
    not met before are encoded, many in one call, where a token says that it ends a part; and a text's ids are its words'."""

    def __init__(self, name: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            spec = json.load(f)
        self._whole = lambda: Tokenizer.from_file(public_tokenizers.path(name))
        # The same vocabulary for parts that are lower case, normal and split already.
        by_bytes = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "ByteLevel")
        self.plain = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, by_bytes]}}))
        vocab = self.plain.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words, self.parts = Memory(), Memory()

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """The tokenizer as it is, for what isn't plain; most tasks never need it."""
        return self._whole()

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(parts), 1024):
            some = parts[i : i + 1024]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                out += map(self._encode, some)
                continue
            raw, cuts = ids.tobytes(), (4 * ends).tolist()
            out += [raw[a:b] for a, b in zip([0, *cuts], cuts)]
        return out

    def _encode_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        single, at_single, split, at_split, plain = [], [], [], [], _plain()
        for i, w in enumerate(words):
            if not w.isascii() and not (plain.issuperset(w) and unicodedata.is_normalized("NFC", w)):
                out[i] = self._encode(w)
            elif (low := w.lower()).isalpha():
                single.append(low)
                at_single.append(i)
            else:
                split.append(_PARTS.findall(low))
                at_split.append(i)
        every = list(set(single).union(*split))
        ids = dict(zip(every, self.parts.all(every, self._encode_parts)))
        for i, w in zip(at_single, single):
            out[i] = ids[w]
        for i, ps in zip(at_split, split):
            out[i] = b"".join([ids[p] for p in ps])
        return out

    def _batch(self, texts: pa.Array) -> list[memoryview]:
        # Special tokens are found in whole texts, and Arrow splits at four controls that the tokenizer keeps.
        texts = texts.fill_null("")
        whole = pc.match_substring_regex(texts, "[\x1c-\x1f]|<\\|")
        split = pc.utf8_split_whitespace(pc.if_else(whole, "", texts))
        coded = split.flatten().dictionary_encode()
        ids = self.words.all(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self._encode_words)
        taken = pa.array(ids, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(taken.buffers()[1], dtype=np.int64, count=len(taken) + 1)
        raw = memoryview(taken.buffers()[2] or b"")
        cuts = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        docs = [raw[i:j] for i, j in zip(cuts, cuts[1:])]
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)):
            docs[i] = memoryview(self._encode(texts[int(i)].as_py()))
        return docs

    def batches(self, texts: pa.Array) -> Iterator[memoryview]:
        """Ids of each text as little-endian unsigned 32-bit numbers, null ones having none, some megabytes of texts at once."""
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size, dtype=np.int64) // AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        for i, j in zip(cuts, cuts[1:]):
            gc.disable()  # a collection would walk through all that is remembered, and there are no cycles here
            try:
                made = self._batch(texts.slice(i, j - i)) if j > i else []
            finally:
                gc.enable()
            yield from made
            del made
            give_back()


_words: dict[str, WordIds] = {}


@cache
def rests(capacity: int = 4096, padding: float = PADDING) -> tuple[tuple[int, ...], ...]:
    """For each length up to ``capacity`` the lengths into which it is cut, the fewest that class well.

    A length n is of class k = capacity // n, k of which make a sequence. It classes well if what k of them leave is at
    most ``padding`` of the sequence. Of equally few pieces those are taken that leave least. Lengths up to ``padding``
    of the capacity class well by themselves, so every length can be cut.
    """
    n = np.arange(1, capacity + 1)
    waste = (capacity - capacity // n * n) / (capacity // n)  # of one piece
    fits = np.flatnonzero(capacity - capacity // n * n <= padding * capacity) + 1
    many, cost, last = np.full(capacity + 1, capacity), np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    many[0] = 0
    many[fits], cost[fits], last[fits] = 1, waste[fits - 1], fits
    for m in range(1, capacity + 1):
        if many[m] > 1:
            a = fits[fits < m]
            count, more = many[m - a] + 1, cost[m - a] + waste[a - 1]
            best = np.lexsort((-a, more, count))[0]
            many[m], cost[m], last[m] = count[best], more[best], a[best]
    out: list[tuple[int, ...]] = [()]
    for m in range(1, capacity + 1):
        out.append(tuple(sorted((int(last[m]), *out[m - int(last[m])]), reverse=True)))
    return tuple(out)


def cut(n: int, capacity: int = 4096, padding: float = PADDING) -> list[int]:
    """Lengths of a document's pieces: whole sequences, then the rest, whole if it classes well, else in two or so that do."""
    return [capacity] * (n // capacity) + list(rests(capacity, padding)[n % capacity])


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", end: int = 2, capacity: int = 4096) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, salt): the pieces of every document with its end id.

    ``salt`` is a row's place in its batch, which tells pieces of repeated rows apart.
    """

    def batch(b: pa.RecordBatch) -> dict:
        if tokenizer not in _words:
            _words[tokenizer] = WordIds(tokenizer)
        row, start, length, crc, total = [], [], [], [], []
        last = end.to_bytes(4, "little")
        for i, ids in enumerate(_words[tokenizer].batches(b.column(1))):
            ids = memoryview(b"".join((ids, last)))
            at, of = 0, len(ids) // 4
            for n in cut(of, capacity):
                row.append(i)
                start.append(at)
                length.append(n)
                crc.append(zlib.crc32(ids[4 * at : 4 * (at + n)]))
                total.append(of)
                at += n
        long = pa.int64()
        return {"doc_id": b.column(0).take(pa.array(row, long)), "start": pa.array(start, long), "length": pa.array(length, long), "ids_crc32": pa.array(crc, long), "doc_tokens": pa.array(total, long), "salt": pa.array(row, long)}

    return arrow_map(docs.select(id_col, text_col), batch, f"doc_id {dict(docs.dtypes)[id_col]},start long,length long,ids_crc32 long,doc_tokens long,salt long")


def _ranked(made: DataFrame, capacity: int, n: int) -> DataFrame:
    """``made`` with each piece's class k, its number ``rank`` in the class, and how many the class has.

    A class's pieces are dealt into buckets by a hash that splits repeated ids too, numbered within each, and moved by how
    many come before the bucket. Those are summed in stretches of 1,024 buckets and over stretches, so no task holds
    more than a stretch of a class, or a row for each 8 million of its pieces.
    """
    keyed = made.withColumn("k", F.floor(F.lit(capacity) / F.col("length"))).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "salt"), F.lit(max(64, n // BUCKET))))
    counts = materialise(keyed.groupBy("k", "bucket").agg(F.count("*").alias("n")).withColumn("stretch", F.shiftright("bucket", 10)), "buckets")
    stretches = counts.groupBy("k", "stretch").agg(F.sum("n").alias("n"))
    of_class = Window.partitionBy("k")
    stretches = stretches.select("k", "stretch", (F.sum("n").over(of_class.orderBy("stretch")) - F.col("n")).alias("earlier"), F.sum("n").over(of_class).alias("of_class"))
    within = Window.partitionBy("k", "stretch").orderBy("bucket")
    counts = counts.withColumn("before", F.sum("n").over(within) - F.col("n")).join(stretches, ["k", "stretch"])
    counts = materialise(counts.select("k", "bucket", (F.col("before") + F.col("earlier")).alias("before"), "of_class"), "classes")
    inner = Window.partitionBy("k", "bucket").orderBy("doc_id", "start", "ids_crc32", "salt")
    return keyed.withColumn("rank", F.row_number().over(inner) - 1).join(counts, ["k", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", end: int = 2, capacity: int = 4096) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece of every row.

    Class k holds the lengths in (capacity/(k+1), capacity/k]; its pieces are numbered, and each k of them make a sequence.
    Documents are cut only so far as their pieces class well (``rests``): a third of the lengths under a sequence stay whole
    or are cut once. Numbers come from counts by class and bucket, so workers number their pieces for themselves, whatever
    a class's size. What no class can fill, under k pieces of each and so under 20,000 at any size of the input, is packed
    by first fit, longest first. Null and empty texts are the end id alone; rows with a null id and repeated rows are
    packed like any other, each for itself. An empty table gives an empty result. Other columns are not read.
    """
    made = materialise(pieces(docs, id_col, text_col, tokenizer, end, capacity), "pieces")
    made_columns = [c for c in made.columns if c != "salt"]
    ranked = _ranked(made, capacity, made.count())
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") / F.col("k"))).withColumn("full", F.col("bin") < F.floor(F.col("of_class") / F.col("k")))
    ranked = materialise(ranked.select(*made_columns, "k", "rank", "bin", "full"), "ranked")
    slot = Window.partitionBy("k", "bin").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    full = ranked.where("full").select(*made_columns, (F.col("k") * (1 << 44) + F.col("bin")).alias("sequence_id"), (F.sum("length").over(slot) - F.col("length")).alias("offset"))

    def first_fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "k", "rank"], ascending=[False, True, True], kind="stable")
        used: list[int] = []
        seq, off = [], []
        first = 0  # sequences before it are full
        for n in pdf["length"]:
            while first < len(used) and used[first] == capacity:
                first += 1
            at = next((i for i in range(first, len(used)) if used[i] + n <= capacity), len(used))
            if at == len(used):
                used.append(0)
            seq.append(at)
            off.append(used[at])
            used[at] += n
        return pdf[made_columns].assign(sequence_id=seq, offset=off)

    schema = f"{', '.join(f'{c} {t}' for c, t in made.dtypes if c != 'salt')}, sequence_id long, offset long"
    rest = ranked.where("not full").groupBy(F.lit(0).alias("one")).applyInPandas(first_fit, schema)
    return full.unionByName(rest)
