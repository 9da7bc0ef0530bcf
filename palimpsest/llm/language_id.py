"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, chance, fold

#: Families by ISO 639-1 code; codes that aren't listed form a family of their own, together.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi fo",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tt",
    "indic": "hi bn mr gu pa ne ur si",
    "semitic": "ar he am mt",
    "cjk": "zh ja ko",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
DIMS = 4096
#: Texts that the machines are fitted on, about, over all languages.
LIMIT = 4000

_CODE = np.zeros(256, dtype=np.uint32)
_CODE[97:123] = np.arange(1, 27)
_CODE[128:] = np.arange(27, 155)


def features(text: str) -> np.ndarray:
    """Square roots of the hashed counts of byte bigrams and trigrams of the lower-case letters, at length 1."""
    c = _CODE[np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)]
    c = np.concatenate(([0], c, [0])).astype(np.uint32)
    c = c[(c > 0) | (np.append(c[1:], 1) > 0)]  # a run of other characters counts as one
    two = c[:-1] * np.uint32(157) + c[1:]
    three = two[:-1] * np.uint32(157) + c[2:] + np.uint32(1 << 20)
    h = (np.concatenate((two, three)) * np.uint32(2654435761)) >> np.uint32(20)
    v = np.sqrt(np.bincount(h, minlength=DIMS).astype(np.float32))
    return v / max(float(np.linalg.norm(v)), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 3e-4, rounds: int = 300) -> np.ndarray:
    """Weights, and a bias at the end, of a linear machine with squared hinge loss; either class weighs a half."""
    w = np.zeros(x.shape[1] + 1, dtype=np.float32)
    if not len(y) or (y > 0).all() or (y < 0).all():
        w[-1] = 1.0 if len(y) and y[0] > 0 else -1.0
        return w
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum()).astype(np.float32)
    step, ahead, t = 1.0 / (4.0 + penalty), w.copy(), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1])) * y * share
        grad = np.append(penalty * ahead[:-1] - 2 * (slack @ x), -2 * slack.sum()).astype(np.float32)
        new, nt = ahead - step * grad, (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / nt * (new - w), new, nt
    return w


def _sure(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(3 * margin, -30, 30)))


class Languages:
    """Machines for families, one against the rest, and for pairs of languages within a family."""

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        y = np.array(langs, dtype=object)
        self.langs = sorted(set(langs))
        of = {c: FAMILY.get(c.lower().split("-")[0].split("_")[0], "other") for c in self.langs}
        self.families = sorted(set(of.values()))
        self.members = {f: [c for c in self.langs if of[c] == f] for f in self.families}
        fam = np.array([of[c] for c in langs], dtype=object)
        self.by_family = np.array([svm(x, np.where(fam == f, 1, -1).astype(np.float32)) for f in self.families]) if len(self.families) > 1 else None
        self.pairs = {}
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                own = (y == a) | (y == b)
                self.pairs[a, b] = svm(x[own], np.where(y[own] == a, 1, -1).astype(np.float32))

    def predict(self, x: np.ndarray) -> tuple[list[str], list[float]]:
        n = len(x)
        if self.by_family is None:
            family, sure = np.zeros(n, dtype=int), np.ones(n)
        else:
            m = x @ self.by_family[:, :-1].T + self.by_family[:, -1]
            family = m.argmax(axis=1)
            sure = _sure(m.max(axis=1))
        lang, score = [""] * n, [0.0] * n
        for k, f in enumerate(self.families):
            own, codes = np.flatnonzero(family == k), self.members[f]
            votes = np.zeros((len(own), len(codes)))
            for i, j in combinations(range(len(codes)), 2):
                w = self.pairs[codes[i], codes[j]]
                p = _sure(x[own] @ w[:-1] + w[-1])
                votes[:, i] += p
                votes[:, j] += 1 - p
            best = votes.argmax(axis=1)
            for r, o in enumerate(own):
                lang[o] = codes[best[r]]
                score[o] = float(sure[o] * (votes[r, best[r]] / (len(codes) - 1) if len(codes) > 1 else 1.0))
        return lang, score


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", limit: int = LIMIT) -> Languages | None:
    """Machines from about ``limit`` of ``rows``, as many of each language, by a hash of the id; None without any row. Of each
    language come 40 at least, so with more than a hundred languages the sample is about 40 for each. Rows without a text
    or a language take no part; rows without an id are one id, all in the sample or none."""
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[lang_col]: r["count"] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return None
    each = max(40, limit // len(counts))
    share = F.create_map(*(F.lit(v) for c, n in counts.items() for v in (c, min(1.0, each / n))))
    picked = rows.where(chance(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), 23) < share[F.col(lang_col)])

    def batch(b: pa.RecordBatch) -> dict:
        texts, langs = b.column(0).to_pylist(), b.column(1)
        return {"lang": langs, "x": pa.array([features(t).astype(np.float16).tobytes() for t in texts], pa.binary())}

    got = arrow_map(picked.select(text_col, lang_col), batch, "lang string,x binary").toPandas()
    if got.empty:
        return None
    got = got.sort_values(["lang", "x"], kind="stable")
    x = np.frombuffer(b"".join(got["x"]), dtype=np.float16).reshape(-1, DIMS).astype(np.float32)
    return Languages(x, got["lang"].tolist())


def identify(docs: DataFrame, model: Languages | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row; ``und`` with score 0 for a text that is null or has no letter, or without
    a model. Repeated rows stay; an empty table gives an empty result; other columns are not read."""

    def batch(b: pa.RecordBatch) -> dict:
        texts = b.column(1).to_pylist()
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        have = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model else []
        for at in range(0, len(have), 256):
            some = have[at : at + 256]
            for i, c, s in zip(some, *model.predict(np.array([features(texts[i]) for i in some]))):
                lang[i], score[i] = c, s
        return {"doc_id": b.column(0), "lang_pred": pa.array(lang), "score": pa.array(score, pa.float64())}

    return arrow_map(docs.select(id_col, text_col), batch, f"doc_id {dict(docs.dtypes)[id_col]},lang_pred string,score double")


def evaluate(docs: DataFrame, n: int = 4, held: int = 2, limit: int = LIMIT) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): fitted on rows outside the held-out fold, said of every row. Null and empty texts
    are ``und``, equal texts have equal answers; a null id is held out; repeated rows stay; an empty table gives an empty
    result."""
    model = fit(docs.where(~fold(F.col("doc_id"), n, held)), limit=limit)
    said = identify(docs, model)
    return said.select("doc_id", fold(F.col("doc_id"), n, held).alias("held_out"), "lang_pred", "score")
