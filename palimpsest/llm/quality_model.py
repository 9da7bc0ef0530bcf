"""Quality classifier: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, fold, labelled_sample

#: Words in a passage, labelled documents that the model is fitted on, about, and passages of each of those at most.
PASSAGE, LIMIT, PASSAGES = 64, 4000, 128
_HIDDEN, _GATE = 32, 16

# Classes of bytes: lower, upper, digit, space, line end, full stop, comma, !, ?, bar, symbol, other mark, byte of a longer character.
_CLASS = np.full(256, 11, dtype=np.int64)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",", b"!", b"?", b"|", b"#*$%&<>=@_~^{}[]\\/+")):
    _CLASS[list(_bytes)] = _k
_CLASS[128:] = 12
_N = 13
DIMS = 256 + _N * _N + 4


def encode(text: str | None) -> np.ndarray:
    """A row for each passage of ``PASSAGE`` words: shares of bytes, of pairs of classes of bytes, and of repeats. No word, no row."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return np.zeros((0, DIMS), dtype=np.float32)
    b = np.frombuffer(raw, dtype=np.uint8)
    k = _CLASS[b]
    space = (b == 32) | ((b >= 9) & (b <= 13))
    starts = ~space & np.concatenate(([True], space[:-1]))
    at = np.maximum(np.cumsum(starts) - 1, 0) // PASSAGE
    n = int(at[-1]) + 1
    x = np.zeros((n, DIMS), dtype=np.float32)
    size = np.bincount(at, minlength=n).astype(np.float32)[:, None]
    x[:, :256] = np.bincount(at * 256 + b, minlength=n * 256).reshape(n, 256) / size
    x[:, 256 : 256 + _N * _N] = np.bincount(at[1:] * (_N * _N) + k[:-1] * _N + k[1:], minlength=n * _N * _N).reshape(n, -1) / size
    np.sqrt(x, out=x)
    seen: set[bytes] = set()
    lines: set[bytes] = set()
    for i in range(n):
        part = words[i * PASSAGE : (i + 1) * PASSAGE]
        own = set(part)
        x[i, -4] = 1 - len(own) / len(part)
        x[i, -3] = len(own & seen) / len(own)
        x[i, -2] = sum(map(len, part)) / len(part) / 10
        seen |= own
    dup = 0
    all_lines = [s for s in raw.split(b"\n") if s.strip()]
    for s in all_lines:
        dup += s in lines
        lines.add(s)
    x[:, -1] = dup / max(len(all_lines), 1)
    return x


class Attention:
    """score = sigmoid(c . z), z the mean of encoded passages h = tanh(W x + b), weighted by a gate on tanh(V h) * sigmoid(U h)."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        n = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": n(DIMS, _HIDDEN), "b": np.zeros(_HIDDEN, np.float32), "V": n(_HIDDEN, _GATE), "U": n(_HIDDEN, _GATE), "g": n(_GATE), "c": n(_HIDDEN), "d": np.zeros(1, np.float32)}
        self.mean, self.std = np.zeros(DIMS, np.float32), np.ones(DIMS, np.float32)

    def _forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        """``first``: where each document's passages begin."""
        p = self.p
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (v * u) @ p["g"]
        e = np.exp(e - np.maximum.reduceat(e, first)[of])
        a = e / np.add.reduceat(e, first)[of]
        z = np.add.reduceat(a[:, None] * h, first)
        return of, h, v, u, a, z, z @ p["c"] + p["d"][0]

    def _gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
        p = self.p
        of, h, v, u, a, z, s = self._forward(x, first)
        ds = (1 / (1 + np.exp(-s)) - y) / len(y)
        dz = ds[:, None] * p["c"]
        da = (h * dz[of]).sum(1)
        de = a * (da - np.add.reduceat(a * da, first)[of])
        dvu = de[:, None] * p["g"]
        dv, du = dvu * u * (1 - v * v), dvu * v * u * (1 - u)
        dh = (a[:, None] * dz[of] + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "g": (v * u).T @ de, "c": z.T @ ds, "d": ds.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, rounds: int = 24, batch: int = 64, rate: float = 3e-3, decay: float = 2e-4) -> Attention:
        flat = np.concatenate(bags)  # one copy, of which the bags are then parts
        cuts = np.cumsum([len(b) for b in bags])[:-1]
        bags.clear()
        self.mean, self.std = flat.mean(0), flat.std(0) + 1e-3
        flat -= self.mean
        flat /= self.std
        np.clip(flat, -8, 8, out=flat)
        bags = np.split(flat, cuts)
        rng = np.random.default_rng(3)
        m, q, t = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for r in range(rounds):
            order = rng.permutation(len(bags))
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                x = np.concatenate([bags[j] for j in some])
                first = np.concatenate(([0], np.cumsum([len(bags[j]) for j in some])[:-1])).astype(int)
                t += 1
                for k, g in self._gradient(x, first, y[some]).items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    q[k] = 0.999 * q[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (1 - r / rounds) * (m[k] / (1 - 0.9**t)) / (np.sqrt(q[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        """One score for each text; 0 for a text without words."""
        bags = [encode(t) for t in texts]
        out, have = np.zeros(len(texts)), [i for i, b in enumerate(bags) if len(b)]
        for at in range(0, len(have), 64):
            some = have[at : at + 64]
            x = np.clip((np.concatenate([bags[i] for i in some]) - self.mean) / self.std, -8, 8)
            first = np.concatenate(([0], np.cumsum([len(bags[i]) for i in some])[:-1])).astype(int)
            out[some] = 1 / (1 + np.exp(-np.clip(self._forward(x, first)[-1], -30, 30)))
        return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", n: int = 5, held: int = 0, limit: int = LIMIT) -> Attention | None:
    """A model from about ``limit`` labelled documents outside the held-out fold; None without any.

    Of a longer document ``PASSAGES`` passages are taken, evenly over its whole length, so what reaches the driver is
    bounded in bytes too. Scoring has no such bound. Null and empty texts, and null ids and labels, take no part.
    """
    sample = labelled_sample(docs, labels, label, n, held, limit)

    def some(x: np.ndarray) -> np.ndarray:
        return x if len(x) <= PASSAGES else x[np.linspace(0, len(x) - 1, PASSAGES).astype(int)]

    def batch(b: pa.RecordBatch) -> dict:
        return {"doc_id": b.column(0), "y": b.column(2), "x": pa.array([some(encode(t)).astype(np.float16).tobytes() for t in b.column(1).to_pylist()], pa.binary())}

    got = arrow_map(sample.select(F.col("doc_id").cast("long"), "text", "y"), batch, "doc_id long,y int,x binary").toPandas()
    got = got[got["x"].map(len) > 0].sort_values(["doc_id", "x"], kind="stable")
    if got.empty:
        return None
    bags, y = [np.frombuffer(x, dtype=np.float16).reshape(-1, DIMS).astype(np.float32) for x in got["x"]], got["y"].to_numpy(dtype=np.float32)
    del got
    return Attention().fit(bags, y)


def score(docs: DataFrame, model: Attention | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row. A text that is null or has no word has score 0; without a model, as where no row is
    labelled, any other has 0.5. Repeated rows stay; an empty table gives an empty result; other columns are not read."""

    def batch(b: pa.RecordBatch) -> dict:
        texts = b.column(1).to_pylist()
        s = np.concatenate([model.score(texts[i : i + 64]) for i in range(0, len(texts), 64)]) if model else np.array([0.5 if (t or "").split() else 0.0 for t in texts])
        return {"doc_id": b.column(0), "score": pa.array(s.astype(np.float64))}

    return arrow_map(docs.select(id_col, text_col), batch, f"doc_id {dict(docs.dtypes)[id_col]},score double")


def evaluate(docs: DataFrame, labels: DataFrame, cut: float = 0.3, n: int = 5, held: int = 0, limit: int = LIMIT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``. Null and empty texts have score 0, equal texts equal
    scores; a null id is held out; repeated rows stay; an empty table gives an empty result; no other columns are read."""
    said = score(docs, fit(docs, labels, n=n, held=held, limit=limit))
    return said.select("doc_id", fold(F.col("doc_id"), n, held).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.3, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs`` with a score of ``cut`` or more, all columns as they are. Null and empty texts go; rows without an
    id, ties at ``cut`` and repeated rows stay; without any label all texts with a word stay."""
    model = fit(docs, labels, limit=limit)

    @F.pandas_udf("double")
    def scored(text):
        import pandas as pd

        texts = [None if t is None or t != t else t for t in text]
        return pd.Series(np.concatenate([model.score(texts[i : i + 64]) for i in range(0, len(texts), 64)]) if model and texts else [0.5 if (t or "").split() else 0.0 for t in texts], dtype="float64")

    return docs.where(scored("text") >= cut)
