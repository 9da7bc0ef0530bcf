import html
import re

import pytest

from palimpsest.llm import templates

PAGE = "<html><body><div class='top'>Site name</div><div class='wrap'><div class='crumb'>You are here</div><p>{a}</p><p>{b}</p></div><div class='foot'>All rights</div></body></html>"


def test_finds_articles(pages):
    got = {r.page_id: r for r in templates.extract(pages).collect()}
    for r in pages.collect():
        inner = r.html.split("<article>", 1)[1].split("</article>")[0]
        inner = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1|ul|li)[^>]*>", "\x00", inner)))
        want = "\n\n".join(s for s in (re.sub(r"\s+", " ", html.unescape(x)).strip() for x in inner.split("\x00")) if s)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>One &amp; two&nbsp;three</p><p>a<b>b</b>c</p>", "One & two three\n\nabc"),
        ("<nav>Menu</nav><article><header><h1>Title</h1></header><p>Text</p><div class='comments'><p>A reader</p></div></article><footer>F</footer>", "Title\n\nText"),
        ("<script>var a='<p>x</p>'</script><p>Text<style>p{}</style></p>", "Text"),
        ("<div class='ad'>Buy <div>now</div> more</div><p>Text</p>", "Text"),
        ("<form><p>Name</p></form><aside>Side</aside><div id='cookie-notice'>Cookies</div><p>Text", "Text"),
        ("<p hidden>No</p><p style='display: none'>No</p><p>Yes</p>", "Yes"),
        ("<ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul>", ""),
        ("<!-- <p>no</p> --><p>a < b</p>", "a < b"),
        ("", ""),
        (None, ""),
        ("plain text only", "plain text only"),
        ("<p>cut <b", "cut"),
    ],
)
def test_pages(page, want):
    assert templates.main_text(page) == want


def test_template_blocks_go(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.format(a=f"Page {i} says this.", b=f"And {i * i} more.")) for i in range(12)]
    rows += [(100 + i, f"https://few.example/{i}", PAGE.format(a=f"Few {i}", b="x")) for i in range(3)]
    got = {r.page_id: r.text for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[5] == "Page 5 says this.\n\nAnd 25 more."
    assert got[101] == "Site name\n\nYou are here\n\nFew 1\n\nx\n\nAll rights"


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.format(a="The same", b="page")) for i in range(40)]
    got = templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("The same\n\npage" in r.text for r in got)


def deduced(df):
    parsed = templates.parse(df)
    of = templates.groups(templates.page_counts(parsed))
    return {r.of: r.tokens for r in templates.deduce(parsed, of).collect()}


def test_classes_have_equal_vectors(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.format(a=f"A {i}", b=f"B {i}")) for i in range(9)]
    tokens = deduced(spark.createDataFrame(rows, "page_id long, url string, html string"))["h.example"]
    of = {t.token: t["class"] for t in tokens}
    key = templates._key
    assert of[key("div.top#")] == of[key("div.wrap#")] == of[key("=Site name")] != of[key("p.#")]
    assert key("=A 1") not in of
    page = templates.Page(rows[0][2])
    keys, at = page.keys(), [b[0] for b in page.blocks]
    slots = templates.slots(keys, page.up, at, {t.token: (t["class"], t.times) for t in tokens}, {keys[i] for i in at})
    assert len({s for s, _ in slots}) == 5 and [len(c) for _, c in slots] == [3, 4, 4, 4, 3]


def test_deduces_what_a_table_of_all_occurrences_says(spark, pages):
    rows = [(r.url, r.html) for r in pages.collect()] * 2 + [(None, "<p>x</p>"), ("http://a.example", None)]
    rows += [(f"http://b.example/{i}", PAGE.format(a=f"A {i}" * (i % 3), b="B")) for i in range(16)]
    got = deduced(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string"))
    host = lambda u: re.sub(r"^\w+://([^/]+).*", r"\1", u).lower() if u and "://" in u else None
    by = {}
    for u, h in rows:
        tokens = tuple(templates.Page(h).tokens)
        if tokens:
            by.setdefault(host(u), set()).add(tokens)
    few = [(h, p) for h, ps in by.items() if h is None or len(ps) < templates.PAGES for p in ps]
    sets = {h: [(h, p) for p in ps] for h, ps in by.items() if h is not None and len(ps) >= templates.PAGES} | ({"": few} if len(few) >= templates.PAGES else {})
    want = {}
    for of, own in sets.items():
        vectors = {}
        for i, (_, page) in enumerate(own):
            for t in set(page):
                vectors.setdefault(t, {})[i] = page.count(t)
        valid = {t: tuple(sorted(v.items())) for t, v in vectors.items() if len(v) >= templates.SUPPORT * len(own)}
        want[of] = {templates._key(t): (v, v[0][1] if len({n for _, n in v}) == 1 else 0) for t, v in valid.items()}
    assert set(got) == {k for k, v in want.items() if v} and {"b.example", ""} <= set(got)
    for of, tokens in got.items():
        assert {t.token: t.times for t in tokens} == {t: n for t, (_, n) in want[of].items()}
        classes, vectors = {}, {}
        for t in tokens:
            classes.setdefault(t["class"], set()).add(t.token)
            vectors.setdefault(want[of][t.token][0], set()).add(t.token)
        assert sorted(map(sorted, classes.values())) == sorted(map(sorted, vectors.values()))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div class="content with-sidebar"><article><p>A b</p></article></div>', "A b"),
        ('<div class="sidebar"><main><p>A b</p></main></div>', "A b"),
        ('<div id="page" class="no-sidebar"><main><p>A b</p></main></div>', "A b"),
        ('<article class="post has-comments"><p>A b</p></article>', "A b"),
        ('<div class="article-social-history"><p>A b</p></div>', "A b"),
        ('<article><p>x</p><div class="related-work"><p>y</p></div></article>', "x\n\ny"),
        ('<p>Text <button>Subscribe</button> more <span class="advert">Buy now</span></p>', "Text more"),
        ("<p>a <span hidden>no</span> b</p>", "a b"),
        ('<div class="comments"><article class="comment-body"><p>c</p></article></div>', ""),
        ('<article><p>x</p></article><div class="related-posts"><article><p>r</p></article></div>', "x"),
    ],
)
def test_names_are_evidence_of_whole_elements(page, want):
    assert templates.main_text(page) == want


def test_the_template_decides_where_tags_say_nothing(spark):
    """Pages of plain div elements: the menu and the advert differ from page to page and aren't named."""
    page = "<html><body><div><ul>{menu}</ul></div><div class=x7>Buy {a} today.</div><div><h1>Title {i}</h1>{body}</div><div>Copy {a} of {i}</div></body></html>"
    rows = []
    for i in range(24):
        menu = "".join(f"<li><a href=/{k}>Go {k + i}</a></li>" for k in range(3 + i % 3))
        body = "".join(f"<p>Paragraph {k} of {i} has a good many words to read in it.</p>" for k in range(3 + i % 5))
        rows.append((i, f"http://h.example/{i}", page.format(menu=menu, a=f"thing{i * 7}", i=i, body=body)))
    got = {r.page_id: r.text for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, html_ in rows:
        want = [f"Title {i}"] + [f"Paragraph {k} of {i} has a good many words to read in it." for k in range(3 + i % 5)]
        assert got[i] == "\n\n".join(want) != templates.main_text(html_)


def test_an_article_that_most_pages_copy_stays(spark):
    page = "<html><body><nav>Menu</nav><article><h1>Same</h1><p>The same words for all.</p>{more}</article><footer>Foot {i}</footer></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(i=i, more="<p>Own.</p>" if i > 8 else "")) for i in range(16)]
    got = {r.page_id: r.text for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Same\n\nThe same words for all." and got[9].endswith("Own.")


def test_odd_rows(spark):
    rows = [(1, None, "<p>a</p>"), (2, "no url", "<p>b</p>"), (None, "https://x.example", None), (4, "https://x.example", ""), (4, "https://x.example", ""), (5, None, None), (6, "https://x.example/long", "<p>" + "word " * 50_000 + "</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "page_id as host", "page_id as tokens", "url as text")
    got = templates.extract(df).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 0, 0, 1, 1, 249_999]
    assert templates.extract(df.limit(0)).count() == 0
