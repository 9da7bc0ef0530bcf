import random
import re

import xxhash

from palimpsest.llm import line_dedup


def signed_hash(s):
    v = xxhash.xxh64_intdigest(s.encode(), seed=42)
    return v - (1 << 64) if v >> 63 else v


def brute(docs, min_words):
    """docs: (order, text) in order; the numbers of the lines that go, by document."""
    words = lambda s: len(s.encode().split())
    chosen, source, out = {}, {}, {}
    for key, text in docs:
        lines = text.split("\n")
        real = [i for i, s in enumerate(lines) if words(s)]
        picks = set()
        for a in range(len(real)):
            n, b = 0, a
            while b < len(real) and n < min_words:
                n += words(lines[real[b]])
                b += 1
            if n >= min_words:
                picks.add(-min((signed_hash(lines[i]), -i) for i in real[a:b])[1])
        chosen[key] = sorted(picks)
        for i in chosen[key]:
            source.setdefault(lines[i], (key, i))
    texts = dict(docs)
    for key, text in docs:
        lines, gone = text.split("\n"), set()
        for i in chosen[key]:
            where, j = source[lines[i]]
            if (where, j) == (key, i):
                continue
            other, shift, a, b = texts[where].split("\n"), i - j, i, i
            while a - 1 >= max(0, shift) and lines[a - 1] == other[a - 1 - shift]:
                a -= 1
            while b + 1 < len(lines) and b + 1 - shift < len(other) and lines[b + 1] == other[b + 1 - shift]:
                b += 1
            if sum(words(s) for s in lines[a : b + 1]) >= min_words:
                gone |= set(range(a, b + 1))
        out[key] = "\n".join(s for i, s in enumerate(lines) if i not in gone)
    return out


def test_agrees_with_plain_python(docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    for n in (50, 8):
        got = {r.doc_id: r.text for r in line_dedup.report(docs, min_words=n).collect()}
        assert got == brute(rows, n)


def test_a_long_passage_stays_once(spark):
    passage = "\n".join(" ".join(f"p{i}w{j}" for j in range(20)) for i in range(4))
    one_line = " ".join(f"q{j}" for j in range(55))
    rows = [(1, f"first own line\n{passage}\nlast own line"), (2, f"second own line\n{passage}\nits end"), (3, f"third\n{one_line}"), (4, f"fourth\n{one_line}\n{one_line}"), (5, "short\nshort\nshort")]
    got = {r.doc_id: r for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[1].n_removed == 0
    assert got[2].text == "second own line\nits end" and got[2].n_removed == 4
    assert got[3].text == rows[2][1] and got[4].text == "fourth" and got[5].text == rows[4][1]


def test_no_line_is_lost_altogether(docs):
    before = {s for r in docs.collect() for s in r.text.split("\n")}
    after = {s for r in line_dedup.dedup_lines(docs, min_words=8).collect() for s in r.text.split("\n")}
    assert {s for s in before if s.split()} <= after


def test_odd_rows(odd, empty):
    got = line_dedup.dedup_lines(odd, min_words=5)
    assert got.columns == odd.columns and got.count() == odd.count()
    rows = got.collect()
    assert sum(r.text is None for r in rows) == 2
    assert sum(r.text == "Some plain words stand here, and no more." for r in rows) == 2
    assert line_dedup.report(empty).count() == 0


def test_runs_no_python(docs):
    plan = line_dedup.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def exact(docs, min_words):
    """docs: (order, text) in order; what is left without each line that is in a run of so many words seen earlier, anywhere."""
    words = lambda s: len(s.encode().split())
    seen, out = {}, {}
    for key, text in docs:
        lines = text.split("\n")
        runs = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1) if sum(map(words, lines[a:b])) >= min_words]
        for a, b in runs:
            seen.setdefault(tuple(lines[a:b]), (key, a))
        gone = {i for a, b in runs if seen[tuple(lines[a:b])] < (key, a) for i in range(a, b)}
        out[key] = "\n".join(s for i, s in enumerate(lines) if i not in gone)
    return out


def test_any_earlier_run_counts_not_only_the_first_of_its_fingerprint(spark):
    line = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    names = sorted((line(f"n{i}w", 20) for i in range(30)), key=signed_hash)
    x = names[0]  # the least hash, so that every window with it chooses it
    y, p = line("y", 40), line("p", 40)
    rows = [(1, f"{x}\n{p}"), (2, f"{x}\n{y}"), (3, f"{x}\n{y}"), (4, f"own\n{x}\n{y}\n\nand its end")]
    rows += [(5, f"{line('z', 60)}\nother"), (6, f"{line('z', 60)}\ntail of three"), (7, f"{line('z', 60)}\ntail of three\nnew")]
    got = {r.doc_id: r.text for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == exact(rows, 50)
    assert got[3] == "" and got[4] == "own\n\nand its end" and got[7] == "new"


def test_agrees_with_all_runs(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["a", "b b", "c c c", "d d", ""] if i % 2 else ["a", "b b", "c c c"]) for _ in range(rng.randint(1, 14)))) for i in range(120)]
    rows = [(i, re.sub("\n\n+", "\n\n", t).strip("\n")) for i, t in rows]
    got = {r.doc_id: r.text for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string"), min_words=8).collect()}
    assert got == exact(rows, 8)
