import zlib

import numpy as np
import pytest

from palimpsest.llm import language_id, quality_model

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_passages_cover_the_whole_text():
    text = "\n".join(f"word{i} and more, here!" for i in range(400))
    x = quality_model.encode(text)
    assert len(x) == -(-len(text.split()) // quality_model.PASSAGE)
    shares = (x[:, :256] ** 2).sum(1)
    assert np.allclose(shares, 1, atol=1e-4)
    assert len(quality_model.encode(None)) == len(quality_model.encode(" \n")) == 0


def test_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    model = quality_model.Attention()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, first, y = rng.standard_normal((9, quality_model.DIMS)) * 0.1, np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = model._forward(x, first)[-1]
        return np.mean(np.log1p(np.exp(s)) - y * s)

    grad = model._gradient(x, first, y)
    for k, v in model.p.items():
        at = tuple(int(rng.integers(0, n)) for n in v.shape)
        before, h = v[at], 1e-5
        v[at] = before + h
        up = loss()
        v[at] = before - h
        down = loss()
        v[at] = before
        assert grad[k][at] == pytest.approx((up - down) / (2 * h), rel=1e-3, abs=1e-7)


def test_attention_weighs_passages_to_one():
    model = quality_model.Attention()
    x = np.random.default_rng(1).standard_normal((7, quality_model.DIMS)).astype(np.float32)
    a = model._forward(x, np.array([0, 5]))[4]
    assert a[:5].sum() == pytest.approx(1, abs=1e-5) and a[5:].sum() == pytest.approx(1, abs=1e-5)


def test_quality_of_the_held_out(tables):
    docs, labels = tables
    got = quality_model.evaluate(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id)
    yes, no = got.score[got.quality == 1], got.score[got.quality == 0]
    assert np.mean([(y > no).mean() for y in yes]) > 0.95
    assert (yes >= 0.3).mean() > 0.97 and got.score.between(0, 1).all()


def test_keep_good(tables):
    docs, labels = tables
    kept = quality_model.keep_good(docs, labels)
    assert kept.columns == docs.columns
    scored = quality_model.score(docs, quality_model.fit(docs, labels))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in scored.collect() if r.score >= 0.3}


def test_quality_of_odd_rows(odd, empty, labels, no_labels):
    rows = quality_model.evaluate(odd, no_labels).collect()
    assert len(rows) == odd.count() and {r.score for r in rows} == {0.0, 0.5}
    assert quality_model.evaluate(empty, labels).count() == 0
    got = quality_model.keep_good(odd, no_labels)
    assert got.columns == odd.columns and got.where("text is null").count() == 0


def test_languages_of_the_held_out(tables):
    docs, _ = tables
    got = language_id.evaluate(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_machine_separates():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 5)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x[:, 0] > 0.1 * x[:, 1], 1, -1).astype(np.float32)
    w = language_id.svm(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.95


def test_languages_of_odd_rows(odd, empty):
    rows = language_id.evaluate(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id in (1, 2, 3, 9):
            assert r.lang_pred == "und" and r.score == 0.0
    assert {r.lang_pred for r in rows} <= {"und", "en", "de"}
    assert language_id.evaluate(empty).count() == 0
