"""Toxicity: a noisy-channel decoder restores disguised words under a character language model; the restored text is scored."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import LONGEST, REMEMBERED, Memory, arrow_map, fold, labelled_sample, materialise, release

#: Labelled documents that the scorer is fitted on, about.
LIMIT = 20_000
#: Bytes of text that a worker takes at once.
AT_ONCE = 8 << 20
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâäãåæçèéêëìíîïñòóôöõœùúûüýÿ"
_S = len(LETTERS) + 2  # 0 is what is no letter, 1 a letter of another script
#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "*": "aeiou", "#": "aeiouh"}
#: Natural logarithms of the channel: a sign for a letter, a letter repeated, a sign between letters dropped, a sign kept,
#: and digits kept that end a word of two letters or more without any sign within, as numbers of names do.
SWAP, REPEAT, DROP, KEEP, NUMBER = -1.5, -0.5, -0.5, -4.0, -1.0

_TABLE = np.ones(65536, dtype=np.uint8)
for _i in range(65536):
    _c = chr(_i).lower() if not 0xD800 <= _i < 0xE000 else "?"
    _TABLE[_i] = LETTERS.index(_c) + 2 if len(_c) == 1 and _c in LETTERS else int(_c.isalpha())
_INDEX = {c: i + 2 for i, c in enumerate(LETTERS)}


def count_trigrams(texts: list[str | None]) -> np.ndarray:
    codes = [np.frombuffer((t or "").encode("utf-16-le", "surrogatepass"), dtype="<u2") for t in texts]
    c = np.concatenate([np.zeros(2, np.int64), *(np.concatenate((_TABLE[x].astype(np.int64), [0, 0])) for x in codes)])
    c = c[(c > 0) | np.append(c[1:] > 0, False) | np.concatenate(([False], c[:-1] > 0))]  # runs of non-letters count as two at most
    return np.bincount((c[:-2] * _S + c[1:-1]) * _S + c[2:], minlength=_S**3) if len(c) > 2 else np.zeros(_S**3, dtype=np.int64)


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities of a letter after two, from the counts over all texts, smoothed by those after one and none.

    Each task counts its own rows; what reaches the driver is at most one number for each trigram of the fixed alphabet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_S**3, dtype=np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for i in range(0, len(texts), 256):
                total += count_trigrams(texts[i : i + 256])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    got = docs.select(text_col).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(_S**3)
    counts[got["gram"].to_numpy(dtype=np.int64)] = got["n"].to_numpy()
    c3 = counts.reshape(_S, _S, _S)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 1) / (c1.sum() + _S)
    p2 = (c2 + 20 * p1) / (c2.sum(1, keepdims=True) + 20)
    return np.log((c3 + 10 * p2[None]) / (c3.sum(2, keepdims=True) + 10)).astype(np.float32)


# Within what stands between white space: single letters with signs between; signs within, before or after letters, bounded
# by what is neither letter nor digit; a letter twice. Over white space: single letters or signs, or pieces of a letter or two.
# The decoder says what each of them is.
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_]|[0134578@$!|](?=[\s.\-_*~/,]))(?:[\s.\-_*~/,]+(?:[^\W\d_]|[0134578@$!|])){2,}(?![^\W_])")
_PIECES = re.compile(r"(?<![^\W_])[^\W\d_]{1,2}(?:\s+[^\W\d_]{1,2}){2,}(?![^\W_])")
_SIGNED = re.compile(r"(?<![^\W_])(?<![@$!|+€£])(?:[0-9@$!|+€£]*[^\W\d_]+(?:[0-9@$!|+€£*#(._~\-]+[^\W\d_]+)+|[0-9@$!|+€£]+[^\W\d_]+|[^\W\d_]+(?=[0-9@$!|+€£]*[0-9@$|+€£]))[0-9@$!|+€£]*(?![^\W_])")
# What any span of _SIGNED has: a quicker look at texts that have none.
_HINT = re.compile(r"[^\W\d_](?:[0-9@$!|+€£*#(._~\-]+[^\W\d_]|!*[0-9@$|+€£])|[0-9@$!|+€£][^\W\d_]")
_DOUBLE = re.compile(r"([^\W\d_])\1", re.I)
_APART = re.compile(r"\s|[._~\-]{2}")
# A word with a number at its end; numbers that count something.
_NAMED = re.compile(r"[^\W\d_]{2,}[0-9]+\Z")
_ORDINAL = re.compile(r"[0-9]+(?:st|nd|rd|th|er|ère|e|ème|º|ª|s|am|pm|k|m|km|kg|g|cm|mm|h|x)\Z")
# A token that may be a piece of a word that is spelled apart.
_PIECE = re.compile(r"[.\-_*~/,!?;:]*(?:[^\W\d_]{1,2}|[0134578@$!|])[.\-_*~/,!?;:]*\Z|[.\-_*~/,]+\Z")
_MARKS = ".,;:!?\"'()[]{}«»“”„…"
#: Characters without width, which may stand within a word.
_UNSEEN = dict.fromkeys(map(ord, "\u00ad\u200b\u200c\u200d\u2060\ufeff"))
_WORDS = re.compile(r"[^\W\d_]+")


class Restorer:
    """Most probable reading of a disguised span; remembers what it has read."""

    def __init__(self, lm: np.ndarray) -> None:
        self.lm = lm.tolist()
        self.known: dict[str, str] = {}

    def lattice(self, span: str) -> list[list[tuple[str, float]]]:
        """For each run of equal characters its readings, with the channel's log probability; an empty reading drops it."""
        out, i, low = [], 0, span.lower()
        named = _NAMED.match(low)
        while i < len(low):
            c, j = low[i], i
            if named and c.isdigit():  # the number is kept whole or read whole
                letters = product(*(LEET[d] for d in low[i:])) if len(low) - i < 4 else ()
                out.append([("".join(x), SWAP * len(x)) for x in letters] + [(low[i:], NUMBER)])
                break
            while j < len(low) and low[j] == c:
                j += 1
            n, reads = j - i, []
            inner = 0 < i and j < len(low)
            if c.isalpha():
                reads = [(c, (n - 1) * REPEAT if n > 2 else -5.0 * (n - 1))]
                if n > 1:
                    reads.append((c * 2, (n - 2) * REPEAT))
                if n > 2:
                    reads.append((c * n, -3.0 * n))
            else:
                reads += [(r, SWAP * (1.0 if len(LEET[c]) < 3 else 1.6) + (n - 1) * REPEAT) for r in LEET.get(c, "")]
                if n > 1:  # two letters, alike or not
                    reads += [(r + q, 2 * SWAP * (1.0 if len(LEET[c]) < 3 else 1.6) + (n - 2) * REPEAT) for r in LEET.get(c, "") for q in LEET[c]]
                if inner and (c in ".-_*~/," or c.isspace()):
                    reads.append(("", DROP * n))
                kept = KEEP if inner or c in LEET and (c != "!" or i == 0) else -0.1
                reads.append((c * n, kept))
            out.append(reads)
            i = j
        return out

    def read(self, span: str) -> str:
        """Viterbi over the lattice; a state is the last two codes."""
        if (known := self.known.get(span)) is not None:
            return known
        lm, states = self.lm, {(0, 0): (0.0, None)}
        for reads in self.lattice(span):
            after: dict = {}
            for (a, b), (cost, back) in states.items():
                for text, channel in reads:
                    x, y, s = a, b, cost + channel
                    for c in text:
                        z = _INDEX.get(c, 1 if c.isalpha() else 0)
                        s += lm[x][y][z]
                        x, y = y, z
                    if (x, y) not in after or s > after[x, y][0]:
                        after[x, y] = (s, (back, text))
            states = after
        end = max(((s + lm[a][b][0], back) for (a, b), (s, back) in states.items()), key=lambda v: v[0])[1]
        parts = []
        while end is not None:
            end, text = end
            parts.append(text)
        said = "".join(reversed(parts))
        if len(span) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known = {}
            self.known[span] = said
        return said

    def _doubles(self, low: str) -> str:
        out, last = [], 0
        for m in _DOUBLE.finditer(low):
            a, b = m.span()
            if a >= last:  # the whole word around it
                while a > last and low[a - 1].isalpha():
                    a -= 1
                while b < len(low) and low[b].isalpha():
                    b += 1
                out += (low[last:a], self.read(low[a:b]))
                last = b
        return "".join(out) + low[last:] if out else low

    def token(self, token: str) -> str:
        """What stands between white space, in lower case, with disguised spans as read."""
        low = token.lower()
        if not low.isascii():
            low = low.translate(_UNSEEN)
        core = low.strip(_MARKS)
        if core.isalpha():
            if not _DOUBLE.search(core):
                return low
            at = low.index(core)
            return low[:at] + self.read(core) + low[at + len(core) :]
        if core.isdigit() or len(core) < 3 or _ORDINAL.match(core):
            return low
        end = len(low.rstrip("!"))
        low, rest = (low[:end], low[end:]) if _HINT.search(low[:end]) else (low, "")
        low = _SPACED.sub(self._apart, low)
        if _HINT.search(low):
            low = _SIGNED.sub(self._apart, low)
        return self._doubles(low) + rest

    def _apart(self, m: re.Match) -> str:
        """What stands apart is kept beside what it spells together."""
        return f"{m[0]} {self.read(m[0])}" if _APART.search(m[0]) else self.read(m[0])

    def run(self, pieces: list[str]) -> str:
        """What pieces that follow one another over white space spell together, and what stands between, in lower case."""
        low = " ".join(pieces).lower().translate(_UNSEEN)
        return _PIECES.sub(self._apart, _SPACED.sub(self._apart, low))

    def restore(self, text: str | None) -> str:
        """The text in lower case, with disguised spans as read."""
        out, pieces = [], []
        for token in (*(text or "").split(), None):
            if token is not None and _PIECE.match(token):
                pieces.append(token)
                continue
            if pieces:
                out.append(self.run(pieces) if len(pieces) > 2 else " ".join(map(self.token, pieces)))
                pieces = []
            if token is not None:
                out.append(self.token(token))
        return " ".join(out)


class Reader:
    """The sets that texts' restored words give by ``value``. Arrow finds the distinct tokens of many texts; each of them
    is read once and remembered, so is each run of pieces, and a text without any value costs no more than that."""

    def __init__(self, restorer: Restorer, value: Callable[[str], Iterable]) -> None:
        self.restorer, self.value, self.memory = restorer, value, Memory()

    def _tokens(self, tokens: list[str]) -> list[tuple[bool, tuple]]:
        out = []
        for t in tokens:
            piece = len(t) < 12 and _PIECE.match(t) is not None
            out.append((piece, tuple(self.value(self.restorer.token(t)))))
        return out

    def sets(self, texts: pa.Array) -> Iterator[set]:
        """The set of each text; a null text has none."""
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size, dtype=np.int64) // AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                yield from self._some(texts.slice(i, j - i))

    def _some(self, texts: pa.Array) -> list[set]:
        split = pc.utf8_split_whitespace(texts.fill_null(""))
        coded = split.flatten().dictionary_encode()
        tokens = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.memory.all(tokens, self._tokens)
        at = coded.indices.to_numpy(zero_copy_only=False)
        ends = split.offsets.to_numpy() - split.offsets[0].as_py()
        out: list[set] = [set() for _ in range(len(texts))]
        has = np.fromiter((bool(v) for _, v in known), dtype=bool, count=len(known))
        hits = np.flatnonzero(has[at])
        for d, k in zip((np.searchsorted(ends, hits, side="right") - 1).tolist(), at[hits].tolist()):
            out[d].update(known[k][1])
        piece = np.fromiter((p for p, _ in known), dtype=bool, count=len(known))[at]
        # Runs of three pieces or more within a text.
        new = np.zeros(len(at) + 1, dtype=bool)
        new[ends] = True
        change = np.flatnonzero(np.concatenate((piece[:1], piece[1:] != piece[:-1], [True])) | new)
        begin, stop = change[:-1], change[1:]
        some = (stop - begin > 2) & piece[begin] if len(at) else np.zeros(0, dtype=bool)
        begin, stop = begin[some], stop[some]
        for d, a, b in zip((np.searchsorted(ends, begin, side="right") - 1).tolist(), begin.tolist(), stop.tolist()):
            out[d].update(self.value(self.restorer.run([tokens[k] for k in at[a:b].tolist()])))
        return out


def words(restored: str) -> set[str]:
    return set(_WORDS.findall(restored))


def terms(words: set[str]) -> set[str]:
    """The words, and as stems the first 4, 5 and 6 letters of those that have more."""
    return words | {w[:n] + "~" for w in words for n in (4, 5, 6) if len(w) > n}


class Scorer:
    """A lexicon of terms with log odds, and a logistic regression on what a text's terms add up to."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights, self.beta, self.known = weights, np.array([-4.0, 1.5, 1.0, 0.0]), {}

    def hits(self, restored: str) -> set[str]:
        """The text's terms that the lexicon has; what a word has is remembered."""
        known, out = self.known, set()
        for w in set(_WORDS.findall(restored)):
            if (own := known.get(w)) is None:
                own = tuple(t for t in (w, *(w[:n] + "~" for n in (4, 5, 6) if len(w) > n)) if t in self.weights)
                if len(known) < 300_000:
                    known[w] = own
            if own:
                out.update(own)
        return out

    def traits(self, hits: set[str]) -> list[float]:
        w = [self.weights[t] for t in hits]
        return [1.0, max(w, default=0.0), math.log1p(math.fsum(w)), math.log1p(len(w))]

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        beta, prior = np.zeros(x.shape[1]), np.diag([1e-3, 0.05, 0.05, 0.05])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            g = x.T @ (p - y) + prior @ beta
            h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + prior
            beta = beta - np.clip(np.linalg.solve(h, g), -2, 2)
        self.beta = beta

    def score(self, hits: set[str]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.traits(hits), self.beta))))))


_restorers: dict[bytes, Restorer] = {}
_readers: dict[tuple, Reader] = {}


def _restorer(lm) -> Restorer:
    if lm.value not in _restorers:
        _restorers.clear()
        _restorers[lm.value] = Restorer(np.frombuffer(lm.value, dtype=np.float32).reshape(_S, _S, _S))
    return _restorers[lm.value]


def _reader(lm, of: object, value: Callable[[str], Iterable]) -> Reader:
    """The worker's reader of ``value`` under the model; one is held at a time."""
    key = (lm.value, of)
    if key not in _readers:
        _readers.clear()
        _readers[key] = Reader(_restorer(lm), value)
    return _readers[key]


def fit(docs: DataFrame, labels: DataFrame, lm, label: str = "toxic", n: int = 3, held: int = 1, limit: int = LIMIT) -> Scorer | None:
    """A scorer from about ``limit`` labelled documents outside the held-out fold, restored as the scored ones are.

    The sample is restored once, into a row of distinct words for each document. Terms are counted in the tasks and summed
    by a shuffle; all those come back that are in three toxic documents or more and stand out by 2.5 standard deviations,
    so as many as the sample's words can give. Null texts and ids take no part; a document with several labels counts
    once, with the largest. None without documents of both kinds.
    """

    def read(b: pa.RecordBatch) -> dict:
        return {"y": b.column(1), "words": pa.array([sorted(s) for s in _reader(lm, "words", words).sets(b.column(0))], pa.list_(pa.string()))}

    sample = labelled_sample(docs, labels, label, n, held, limit)
    sample = materialise(arrow_map(sample.select("text", "y"), read, "y int,words array<string>"), "restored")

    def count(b: pa.RecordBatch) -> dict:
        yes, no = Counter(), Counter()
        for y, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            (yes if y else no).update(terms(set(w)))
        every = list(yes.keys() | no.keys())
        return {"term": pa.array(every, pa.string()), "yes": pa.array([yes[t] for t in every], pa.int64()), "no": pa.array([no[t] for t in every], pa.int64())}

    total = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    y1, y0 = sum(v for k, v in total.items() if k), total.get(0, 0)
    if not y1 or not y0:
        return None
    got = arrow_map(sample, count, "term string,yes long,no long").groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    odds = lambda k, m: F.log((F.col(k) + 0.5) / (F.lit(float(m)) - F.col(k) + 0.5))
    delta = odds("yes", y1) - odds("no", y0)
    sd = F.sqrt(1 / (F.col("yes") + 0.5) + 1 / (F.col("no") + 0.5))
    got = got.where(F.col("yes") >= 3).select("term", delta.alias("w"), (delta / sd).alias("z")).where("z > 2.5 and w > 2.0")
    scorer = Scorer({r.term: r.w for r in got.orderBy(F.col("w").desc(), "term").collect()})

    def traits(b: pa.RecordBatch) -> dict:
        x = [scorer.traits(set().union(*map(scorer.hits, w))) for w in b.column(1).to_pylist()]
        return {"y": b.column(0), "x": pa.array(x, pa.list_(pa.float64()))}

    rows = arrow_map(sample, traits, "y int,x array<double>").toPandas()
    scorer.fit(np.array(rows["x"].tolist()), rows["y"].to_numpy(dtype=float))
    release(sample)
    return scorer


def score(docs: DataFrame, scorer: Scorer | None, lm, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row; a null text counts as empty, and without a scorer every score is 0. Repeated rows
    stay; an empty table gives an empty result; other columns are not read. The lexicon is sent to the tasks once."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def batch(b: pa.RecordBatch) -> dict:
        if (s := sent.value) is None:
            return {"doc_id": b.column(0), "score": pa.array([0.0] * b.num_rows, pa.float64())}
        reader = _reader(lm, (tuple(s.weights), tuple(s.beta)), s.hits)
        return {"doc_id": b.column(0), "score": pa.array([s.score(h) for h in reader.sets(b.column(1))], pa.float64())}

    return arrow_map(docs.select(id_col, text_col), batch, f"doc_id {dict(docs.dtypes)[id_col]},score double")


def restored(docs: DataFrame, lm, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with every text as the decoder reads it."""

    def batch(b: pa.RecordBatch) -> dict:
        r = _restorer(lm)
        return {"doc_id": b.column(0), "text": pa.array([r.restore(t) for t in b.column(1).to_pylist()], pa.string())}

    return arrow_map(docs.select(id_col, text_col), batch, f"doc_id {dict(docs.dtypes)[id_col]},text string")


def evaluate(docs: DataFrame, labels: DataFrame, cut: float = 0.7, n: int = 3, held: int = 1, limit: int = LIMIT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Null and empty texts are scored as texts without words; rows with a null id are held out; repeated rows stay; an
    empty table gives an empty result; no other columns are read. Texts with equal words have equal scores.
    """
    lm = docs.sparkSession.sparkContext.broadcast(language_model(docs).tobytes())  # 4 bytes for each trigram of the alphabet
    said = score(docs, fit(docs, labels, lm, n=n, held=held, limit=limit), lm)
    return said.select("doc_id", fold(F.col("doc_id"), n, held).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
