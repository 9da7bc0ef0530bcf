import re

from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import quality_rules


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", s)) and s in lines[:i] for i, s in enumerate(lines))
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + d for i, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t é#|\x0b", max_size=60))
def test_measures(text):
    assert quality_rules.measures(text) == slow(text)


def test_measures_of_documents(docs):
    for r in docs.limit(30).collect():
        assert quality_rules.measures(r.text) == slow(r.text)


def test_rates_are_shrunk(spark):
    rows = [("bad", True)] * 40 + [("bad", False)] * 2 + [("small", True)] * 2 + [("none", False)] * 60 + [(None, True)] * 30 + [(f"h{i}", i % 10 == j) for i in range(20) for j in range(10)]
    got = {r.host: r for r in quality_rules.host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()}
    assert got["bad"].host_failed and not got["none"].host_failed and not got[None].host_failed
    assert 0 < got["none"].shrunk < got["h1"].shrunk < got["small"].shrunk < 1.0
    assert got["bad"].shrunk < 40 / 42


def test_host_takes_its_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, "same " * 100, "bad.example") for i in range(50)] + [(100, good, "bad.example")] + [(200 + i, good, f"h{i % 5}.example") for i in range(50)] + [(300, good, None)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[100].base_failed and not got[100].kept
    assert got[200].kept and got[300].kept and got[0].base_failed and not got[0].kept


def test_odd_rows(odd, empty):
    rows = quality_rules.judge(odd).collect()
    assert len(rows) == odd.count() and all(not (r.base_failed and r.kept) for r in rows)
    assert quality_rules.judge(empty).count() == 0
    assert [r.n_words for r in rows if r.doc_id == 4] == [60_000]


