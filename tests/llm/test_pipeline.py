
import pytest
from test_line_dedup import brute
from test_packing import checked
from test_simhash import groups, slow_fingerprint

import corpus_pipeline
from palimpsest.llm import mixing
from palimpsest.llm.common import materialise, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF, "documents")
    out = [docs]
    for name, fn in corpus_pipeline.STAGES:
        docs = materialise(fn(spark, docs, SF), name)
        out.append(docs)
    return out


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "mixing", "packing"]
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_quality_keeps_good_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.95 * len(good)


def test_lines_and_groups_against_plain_python(stages):
    before = sorted((r.doc_id, r.text) for r in stages[1].collect())
    lined = {r.doc_id: r.text for r in stages[2].collect()}
    assert lined == brute(before, 50)
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())
    fps = {i: slow_fingerprint(t) for i, t in lined.items()}
    root, least = groups(set(fps.values()), 4), {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    assert {r.doc_id for r in stages[3].collect()} == set(least.values())


def test_mix_and_pack(stages):
    taken = {r.doc_id: r.taken for r in mixing.plan(stages[3]).collect()}
    mixed = stages[4].collect()
    for i, n in taken.items():
        assert sum(len(r.text.encode().split()) for r in mixed if r.doc_id == i) == n
    rows = stages[5].collect()
    assert checked(rows, {}) < 0.05
    assert sum(r.length for r in rows if r.start == 0) >= len(mixed)


def test_run_is_the_stages(spark, stages):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, stages[-1].collect()))


def test_odd_rows_through_all_stages(spark, odd, empty, tmp_path):
    """Nulls, repeated rows, shared ids and clashing names, with a label for none of them."""
    from test_packing import TOKENIZER
    from test_simhash import slow_fingerprint

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    run = dict(corpus_pipeline.STAGES)
    good = materialise(run["quality"](spark, odd, str(tmp_path)), "q")
    assert sorted(r.doc_id or 0 for r in good.collect()) == [0, 0, 4, 5, 5, 5, 9, 10]
    lined = materialise(run["line_dedup"](spark, odd, str(tmp_path)), "l")
    assert sorted(map(str, lined.select("doc_id", "text").collect())) == sorted(map(str, odd.select("doc_id", "text").collect()))
    one = materialise(run["near_duplicates"](spark, lined, str(tmp_path)), "n")
    kept = one.collect()
    fps = {slow_fingerprint(r.text) for r in odd.collect()}
    assert len(kept) == len({slow_fingerprint(r.text) for r in kept}) == len(fps)
    mixed = materialise(run["mixing"](spark, lined, str(tmp_path)), "m")
    assert {r.doc_id for r in mixed.collect()} <= {4, 5, None, 9, 10} and mixed.count() >= 5
    packed = run["packing"](spark, lined, str(tmp_path)).collect()
    assert sum(r.length for r in packed) == sum(len(TOKENIZER.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    docs = [odd, good, lined, one, mixed]
    assert all(d.columns == odd.columns for d in docs)
    none = empty
    for _, fn in corpus_pipeline.STAGES:
        none = materialise(fn(spark, none, str(tmp_path)), "none")
        assert none.count() == 0
