import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import toxicity

TEXT = "the loser was an idiot and the clown is a moron but worthless trash talk is pathetic and stupid people are disgusting scum too " * 30


@pytest.fixture(scope="module")
def restorer():
    s = toxicity._S
    c3 = toxicity.count_trigrams([TEXT]).astype(float).reshape(s, s, s)
    return toxicity.Restorer(np.log((c3 + 0.1) / (c3.sum(2, keepdims=True) + 0.1 * s)).astype(np.float32))


@pytest.mark.parametrize(
    ("shown", "meant"),
    [("1d10t", "idiot"), ("l0ser", "loser"), ("l.o.s.e.r", "loser"), ("i d i o t", "idiot"), ("mooooron", "moron"), ("w0rthless", "worthless"), ("tr@sh", "trash"), ("$tup1d", "stupid"), ("p-a-t-h-e-t-i-c", "pathetic"), ("IDIOOOOT", "idiot")],
)
def test_restores_disguised_words(restorer, shown, meant):
    assert meant in restorer.restore(f"so this {shown} here").split()


def test_leaves_plain_words(restorer):
    plain = "a plain sentence, with numbers 12 and 2024, a mail@example.com and e.g. nothing else"
    assert "plain sentence, with numbers 12 and 2024" in restorer.restore(plain)
    assert restorer.restore(None) == "" and restorer.restore("") == ""


def viterbi_by_hand(restorer, span):
    """The best of all paths, listed."""
    paths = [("", 0.0)]
    for reads in restorer.lattice(span):
        paths = [(t + x, c + y) for t, c in paths for x, y in reads]

    def cost(text):
        a = b = 0
        out = 0.0
        for ch in text:
            z = toxicity._INDEX.get(ch, 1 if ch.isalpha() else 0)
            out += restorer.lm[a][b][z]
            a, b = b, z
        return out + restorer.lm[a][b][0]

    return max(paths, key=lambda p: p[1] + cost(p[0]))[0]


@pytest.mark.parametrize("span", ["1d10t", "l.0.$.e.r", "mooorrron", "w0rthl3ss", "a-b", "!!", "tr@sh"])
def test_viterbi_finds_the_best_of_all_paths(restorer, span):
    assert restorer.read(span) == viterbi_by_hand(restorer, span)


def test_counts_are_those_of_the_letters(docs, spark):
    lm = toxicity.language_model(docs)
    texts = [r.text for r in docs.select("text").collect()]
    s = toxicity._S
    c3 = sum(toxicity.count_trigrams([t]) for t in texts).reshape(s, s, s)
    assert lm.shape == (s, s, s) and np.isfinite(lm).all()
    top = np.unravel_index(c3[2:, 2:, 2:].argmax(), (s - 2,) * 3)
    assert lm[tuple(i + 2 for i in top)] > np.median(lm)


def test_held_out_ranking(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity.evaluate(d, labels).join(labels, "doc_id").where("held_out").select("score", "toxic").toPandas()
    yes, no = got.score[got.toxic == 1], got.score[got.toxic == 0]
    assert np.mean([(y > no).mean() + 0.5 * (y == no).mean() for y in yes]) > 0.85
    assert got.score.between(0, 1).all()


def test_odd_rows(odd, empty, no_labels, labels):
    rows = toxicity.evaluate(odd, no_labels).collect()
    assert len(rows) == odd.count() and all(r.score == 0.0 and r.predicted == 0 for r in rows)
    assert toxicity.evaluate(empty, labels).count() == 0
    assert all(r.held_out for r in rows if r.doc_id is None)


@pytest.mark.parametrize(
    ("shown", "meant"),
    [(x, "loser") for x in ("l053r", "l0$3r", "l0ser***", "l....o....s....e....r")]
    + [(x, "worthless") for x in ("w0r7hl355", "w0rthl355", "w0rthl3$$")]
    + [(x, "idiot") for x in ('"1d10t"', "(1d10t)", "1d10t's", "you/1d10t", "id10t###", "iidiiot", "i * d * i * o * t", "i\nd\ni\no\nt")]
    + [("d15gu571ng", "disgusting"), ("p4th371c", "pathetic"), ("scuum", "scum"), ("s  t  u  p  i  d", "stupid"), ("st up id", "stupid"), ("5h17", "shit")],
)
def test_restores_runs_of_signs_in_any_surroundings(shown, meant):
    s = toxicity._S
    c3 = toxicity.count_trigrams([TEXT + "shit happens " * 30]).astype(float).reshape(s, s, s)
    r = toxicity.Restorer(np.log((c3 + 0.1) / (c3.sum(2, keepdims=True) + 0.1 * s)).astype(np.float32))
    assert meant in toxicity._WORDS.findall(r.restore(f"people, {shown}, people"))


def test_keeps_what_stands_apart(restorer):
    got = toxicity._WORDS.findall(restorer.restore("stupid...idiot! it is so and a letter"))
    assert {"stupid", "idiot", "it", "is", "so", "and"} <= set(got)


PLAIN = "2nd 3rd 4th h2o covid19 mp3 4k b2b v2 10am 90s x86 a4 1st html5 i18n s3 ipv4"
SHOWN = '"5tup1d" [5tup1d] *w0rthless* a$$ 7h15 y0u ar3 7h3 stuupiid st\u200bupid 1d10t!!!'
MEANT = {"stupid", "worthless", "as", "this", "you", "are", "the", "idiot"}


@pytest.fixture(scope="module")
def of_corpus(spark):
    lm = toxicity.language_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    return toxicity.Restorer(lm)


def test_numbers_and_names_stay_under_the_corpus_model(of_corpus):
    assert of_corpus.restore(PLAIN) == PLAIN


def test_disguises_are_read_under_the_corpus_model(of_corpus):
    assert toxicity.words(of_corpus.restore(SHOWN)) == MEANT


def test_reader_finds_what_restored_texts_have(of_corpus, docs, odd):
    texts = [r.text for df in (docs, odd) for r in df.select("text").collect()] + [SHOWN, "s t u p i d", "a i d i o t", "", None, "i\nd\ni\no\nt", "st up id it is so"]
    reader = toxicity.Reader(of_corpus, toxicity.words)
    assert list(reader.sets(pa.array(texts, pa.string()))) == [toxicity.words(of_corpus.restore(t)) for t in texts]
    assert list(reader.sets(pa.array([], pa.string()))) == []
