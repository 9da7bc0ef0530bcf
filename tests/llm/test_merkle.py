from collections import Counter
from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import merkle


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=60), st.text(alphabet="ab. \n", max_size=60))
def test_roots_test_equality(a, b):
    x, y = merkle.fingerprint(a), merkle.fingerprint(b)
    assert (x == y) == (a == b) and merkle.likeness(x, x) == 1.0
    assert 0.0 <= merkle.likeness(x, y) <= 1.0 and merkle.likeness(x, y) == merkle.likeness(y, x)
    assert (merkle.likeness(x, y) == 1.0) == (a == b)


def test_branches_locate_an_edit():
    lines = [f"Paragraph {i} says this. And that, number {i * i}." for i in range(200)]
    a = merkle.tree("\n".join(lines))
    lines[77] = "An edit."
    b = merkle.tree("\n".join(lines))
    found = merkle.differences(a, b)
    flat = [p for _, ps in b.sections for p, _ in ps]
    places = [sum(len(b.sections[k][1]) for k in range(s)) + p for s, p in found]
    assert places == [77] and len(flat) == 200
    assert merkle.differences(a, a) == []
    assert merkle.likeness(a.text(), b.text()) > 0.97


def test_report_agrees_with_plain_python(docs):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in merkle.edit_report(docs).collect()}
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == sha256(changed.encode()).hexdigest()
        assert r.fingerprint == merkle.fingerprint(text) and r.edited_fingerprint == merkle.fingerprint(changed)
        assert r.near_edited == merkle.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == merkle.likeness(r.fingerprint, merkle.fingerprint(after))


def test_parts_meet(docs, monkeypatch):
    whole = sorted(map(str, merkle.edit_report(docs).collect()))
    monkeypatch.setattr(merkle, "PART_ROWS", 7)
    assert sorted(map(str, merkle.edit_report(docs).collect())) == whole


def test_odd_rows(odd, empty):
    rows = merkle.edit_report(odd).collect()
    assert len(rows) == odd.count() and sum(r.doc_id is None for r in rows) == 3
    assert {r.n_chars for r in rows if r.doc_id == 1} == {0}
    assert merkle.edit_report(empty).count() == 0
    one = merkle.edit_report(odd.where("doc_id = 9")).first()
    assert one.near_next == 1.0
    assert merkle.fingerprints(odd).count() == odd.count()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="an. s\n", max_size=900))
def test_leaves_are_the_line(line):
    for fine in (0, 30, 2000):
        got = merkle._leaves(line, fine)
        assert "".join(got) == line and all(len(x) <= merkle.COARSE for x in got) and all(got) == bool(line)


def test_an_edit_of_the_second_half_leaves_likeness(docs):
    """Stutters, lines without a full stop or a space, and short texts too."""
    odd = ["Der " * 400, "x" * 5000, "one two three four five six seven eight nine ten " * 30, "A short line of some words here", "ab" * 40]
    for text in [*odd, *(r.text for r in docs.select("text").collect() if r.text and len(r.text) > 60)]:
        other = " ".join(reversed("Quite another text that has nothing in common, with words of its own.".split())) * (len(text) // 40 + 1)
        a, b, c = (merkle.fingerprint(t) for t in (text, merkle.edited(text, other), other))
        assert merkle.likeness(a, b) > merkle.likeness(a, c) or a == b, text[:80]


def test_an_id_that_most_rows_share_is_cut_by_text(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PART_ROWS", 10)
    rows = [(None if i % 3 else 5, f"text {i} of some") for i in range(300)] + [(i, f"other {i}") for i in range(100, 140)] + [(5, "twice")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = merkle.with_next(df, "doc_id", "text", lambda i, text, following: (text, following), "doc_id ?,text string,after string")
    got = out.withColumn("p", F.spark_partition_id()).collect()
    assert sorted(r.text for r in got) == sorted(t for _, t in rows) == sorted(r.after for r in got)
    assert max(Counter(r.p for r in got).values()) < 60
    order = df.withColumn("h", F.xxhash64("text")).orderBy(F.col("doc_id").desc_nulls_last(), F.col("h").desc()).collect()
    follows = Counter((a.text, b.text) for a, b in zip(order, order[1:] + order[:1]))
    assert Counter((r.text, r.after) for r in got) == follows
