"""HTML extraction: templates of hosts deduced from classes of tokens with equal occurrence vectors; the slots between them are kept or not."""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import arrow_map, materialise

#: A class is valid if its tokens are on this share of a host's different pages, of which there are as many at least.
SUPPORT, PAGES = 0.8, 8
#: Parts that a host's tokens are dealt into before they meet its number of pages.
PARTS = 16
#: Templates are broadcast up to this size, and joined by a shuffle beyond.
BROADCAST_BYTES = 32 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|math|iframe|object|xmp)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<[a-zA-Z/!?](?:[^<>\"']+|\"[^\"]*\"|'[^']*')*+>|<[a-zA-Z/!?][^>]*(?:>|\Z)"
    r"|[^<]+|<",
    re.S | re.I,
)
_TAG = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never the article's.
_SKIP = frozenset("head title nav footer aside form button select option menu dialog header search label input".split())
#: What says that a block is no article's: nothing, an element of such a kind, a class or id with such a name.
FREE, HARD, SOFT = 0, 1, 2
# A class or id says what an element is if all of it does: words of the first list, alone or with one another, after a place
# and before a part of a page. A word within another name (no-sidebar, has-comments, related-work) says nothing.
_OWN = re.compile(
    r"(?:(?:site|page|global|main|top|left|right|bottom|sticky|fixed|inline|post|entry|article|js|the|div)[-_]+)*"
    r"(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|side-bar|aside|ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|"
    r"newsletter|subscri\w*|signup|sign-up|login|comments?|commentlist|disqus|reply|replies|respond|discussion|share|sharing|social|related|recommend\w*|breadcrumbs?|pagination|pager|widget|toolbar|skip-link|paywall|copyright)"
    r"(?:[-_]*(?:nav|menu|ads?|banner|cookies?|consent|notice|alert|popup|modal|overlay|newsletter|signup|form|comments?|reply|share|social|links?|posts?|articles?|stories|items?|lists?|box|block|wrap|wrapper|container|area|section|bar|buttons?|icons?|widgets?|inner|outer|left|right|top|bottom|body|content|text|author|meta|title|info|thread|slot|unit|\d+))*",
    re.I,
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_SPACE = re.compile(r"\s+")


def _key(token: str) -> int:
    v = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
    return v - (1 << 64) if v >= 1 << 63 else v


class Page:
    """``tokens``: the page's tags, with class and id, and its text blocks, in order; ``up``: of each the token of the element
    that it is in, or -1. ``blocks``: for each text block its place among the tokens, its text, what speaks against it
    (``FREE``, ``HARD``, ``SOFT``), whether an article's element is open, and the share of the text that is in links.

    Text within a part of a block that something speaks against isn't the block's, unless there is no other."""

    def __init__(self, html: str | None) -> None:
        self.tokens: list[str] = []
        self.up: list[int] = []
        self.blocks: list[tuple[int, str, int, bool, float]] = []
        self._text: list[tuple[str, int, bool]] = []
        self._open: list[tuple[str, int]] = []  # block elements that are open, with their tokens
        skip: list[list] = []  # name, depth of the name within it, kind
        main: list[list] = []
        link, found = 0, False
        for m in _TOKEN.finditer(html or ""):
            t = m[0]
            if t[0] != "<" or len(t) == 1:
                if not skip and main and not found and not t.isspace():
                    found = True
                self._text.append((_html.unescape(t), skip[-1][2] if skip else FREE, link > 0))
                continue
            if m["raw"] or t.startswith("<!"):
                continue
            tag = _TAG.match(t)
            if not tag:
                continue
            name = tag[1].lower()
            if t[1] == "/":
                if name in _BLOCK:
                    self._flush(bool(main))
                    self._add(f"/{name}")
                    for i in range(len(self._open) - 1, -1, -1):
                        if self._open[i][0] == name:
                            del self._open[i:]
                            break
                if name == "a":
                    link = max(0, link - 1)
                if name == "body" or name == "html":
                    skip.clear()
                for held in (skip, main):
                    if held and held[-1][0] == name:
                        held[-1][1] -= 1
                        if not held[-1][1]:
                            held.pop()
                continue
            attrs = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(t[len(tag[0]) :])}
            empty = name in _VOID or t.endswith("/>")
            if name in _BLOCK:
                self._flush(bool(main))
                if name == "p" and self._open and self._open[-1][0] == "p":
                    self._open.pop()  # a paragraph ends where the next begins
                self._add(f"{name}.{attrs.get('class', '')}#{attrs.get('id', '')}")
                if not empty:
                    self._open.append((name, len(self.tokens) - 1))
            elif name == "br":
                self._text.append((" ", skip[-1][2] if skip else FREE, False))
            if name == "a":
                link += 1
            if empty:
                continue
            kind = _kind(name, attrs, bool(main))
            if skip and name == "body":
                skip.clear()
            elif skip and name in ("article", "main") and kind == FREE:
                if skip[-1][0] in ("head", "title", "nav", "header", "label", "p"):
                    skip.clear()  # the element was not closed
                elif not found and all(k == SOFT for *_, k in skip):
                    skip.clear()  # it is wrapped around the article, whatever it is called
            for held in (skip, main):
                if held and held[-1][0] == name:
                    held[-1][1] += 1
            if kind != FREE:
                if not (skip and skip[-1][0] == name):
                    skip.append([name, 1, kind])
            elif name in ("article", "main") or attrs.get("itemprop", "").lower() == "articlebody" or attrs.get("role", "").lower() == "main":
                if not (main and main[-1][0] == name):
                    main.append([name, 1])
        self._flush(bool(main))

    def _add(self, token: str) -> None:
        self.tokens.append(token)
        self.up.append(self._open[-1][1] if self._open else -1)

    def _flush(self, main: bool) -> None:
        parts, self._text = self._text, []
        if not parts:
            return
        kind = min((k for t, k, _ in parts if not t.isspace()), default=None)
        if kind is None:
            return
        own = [(t, linked) for t, k, linked in parts if k == kind or k == FREE]
        text = _SPACE.sub(" ", "".join(t for t, _ in own)).strip()
        if text:
            linked = sum(len(t.strip()) for t, held in own if held)
            self.blocks.append((len(self.tokens), text, kind, main, min(1.0, linked / len(text))))
            self._add("=" + text)

    def keys(self) -> list[int]:
        return [_key(t) for t in self.tokens]


def _kind(name: str, attrs: dict[str, str], in_main: bool) -> int:
    if name in ("html", "body", "main"):
        return FREE
    named = any(_OWN.fullmatch(c) for c in (*attrs.get("class", "").split(), attrs.get("id", "")) if c)
    if name == "header" and in_main:
        named = any(_OWN.fullmatch(c) for c in attrs.get("class", "").split() if "header" not in c.lower())
        return SOFT if named else FREE
    if name in _SKIP or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in _ROLES:
        return HARD
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return HARD
    return SOFT if named else FREE


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


PARSED = "page_id ?,url ??,host string,page long,tokens array<long>,up array<int>,at array<int>,text array<string>,size array<int>,kind array<int>,main array<boolean>,linked array<double>"


def parse(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each row of ``pages``: its tokens' keys, where they stand, and its text blocks. Of those that something
    speaks against, which no text is made of, the length stands for the text.

    ``page`` is a hash of the tokens, so copies that differ in scripts, comments or attributes only are one page. A null
    or empty page has no token; a url that is null or without a host gives a null host.
    """
    kind = dict(pages.dtypes)
    schema = PARSED.replace("??", kind[url_col]).replace("?", kind[id_col])

    def batch(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {n: [] for n in ("page", "tokens", "up", "at", "text", "size", "kind", "main", "linked")}
        for html in b.column(2).to_pylist():
            page = Page(html)
            keys = page.keys()
            out["page"].append(_key(" ".join(map(str, keys))))
            out["tokens"].append(keys)
            out["up"].append(page.up)
            for i, n in ((0, "at"), (2, "kind"), (3, "main"), (4, "linked")):
                out[n].append([x[i] for x in page.blocks])
            out["text"].append([x[1] if x[2] == FREE else "" for x in page.blocks])
            out["size"].append([len(x[1]) for x in page.blocks])
        types = {"page": pa.int64(), "tokens": pa.list_(pa.int64()), "up": pa.list_(pa.int32()), "at": pa.list_(pa.int32()), "text": pa.list_(pa.string()), "size": pa.list_(pa.int32()), "kind": pa.list_(pa.int32()), "main": pa.list_(pa.bool_()), "linked": pa.list_(pa.float64())}
        return {"page_id": b.column(0), "url": b.column(1), "host": b.column(3)} | {n: pa.array(v, types[n]) for n, v in out.items()}

    host = host_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.when(host != "", host).alias("host"))
    return arrow_map(rows, batch, schema)


def page_counts(parsed: DataFrame) -> DataFrame:
    """(host, pages): how many different pages each host has."""
    return parsed.where("size(tokens) > 0").groupBy("host").agg(F.count_distinct("page").alias("pages"))


def groups(counts: DataFrame, pages: int = PAGES) -> DataFrame:
    """(of, pages): the hosts that have a template of their own, and from how many pages it is deduced.

    Those are hosts with ``pages`` different pages or more. The others, and pages without a host, follow the one named by
    the empty string, which is deduced from all of theirs together: what nearly all of those have in common.
    """
    own = F.coalesce(F.col("pages") >= pages, F.lit(False)) & F.col("host").isNotNull()
    few = counts.where(~own).agg(F.lit("").alias("of"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"))
    return counts.where(own).select(F.col("host").alias("of"), "pages").unionByName(few)


def deduce(parsed: DataFrame, of: DataFrame, support: float = SUPPORT, pages: int = PAGES) -> DataFrame:
    """(of, tokens: array of (token, class, times)): the valid classes of each template, from ``parse`` and ``groups``.

    Tokens are in one class if they occur equally often on each of the pages: the exclusive or of hashes of host, page and
    count is the same. It is summed up before any shuffle, so a host may have any number of pages. A class is valid if it
    is on ``support`` of ``pages`` or more different pages, so tokens on fewer than ``support * pages`` pages go at once,
    and what is left meets the number of pages in ``PARTS`` parts. ``times``: how often it occurs on each page that has it, or 0
    if that differs. A valid class's tokens are at most 1 / support times as many as an average page has, so a row stays as
    short as a page.
    """

    def count(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"at": [], "token": [], "n": []}
        for i, tokens in enumerate(b.column(2).to_pylist()):
            for t, n in Counter(tokens).items():
                out["at"].append(i)
                out["token"].append(t)
                out["n"].append(n)
        at = pa.array(out["at"], pa.int64())
        return {"host": b.column(0).take(at), "page": b.column(1).take(at), "token": pa.array(out["token"], pa.int64()), "n": pa.array(out["n"], pa.int32())}

    different = parsed.where("size(tokens) > 0").groupBy("host", "page").agg(F.any_value("tokens").alias("tokens"))
    seen = arrow_map(different, count, "host string,page long,token long,n int")
    vectors = seen.groupBy("host", "token").agg(F.bit_xor(F.xxhash64("host", "page", "n")).alias("class"), F.count("*").alias("on"), F.min("n").alias("least"), F.max("n").alias("most"))
    known = of.where("of <> ''").select("of")
    followed = vectors.join(known, vectors.host == known.of, "left").withColumn("of", F.coalesce("of", F.lit("")))
    vectors = followed.groupBy("of", "token").agg(F.bit_xor("class").alias("class"), F.sum("on").alias("on"), F.min("least").alias("least"), F.max("most").alias("most"))
    vectors = vectors.where(F.col("on") >= F.lit(support * pages)).withColumn("part", F.pmod("token", F.lit(PARTS)).cast("int"))
    per = of.where(F.col("pages") >= pages).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    valid = vectors.join(per, ["of", "part"]).where(F.col("on") >= F.lit(support) * F.col("pages"))
    times = F.when(F.col("least") == F.col("most"), F.col("most")).otherwise(0).alias("times")
    return valid.groupBy("of").agg(F.collect_list(F.struct("token", "class", times)).alias("tokens"))


def _role(token: int, nth: int) -> int:
    return (token * 31 + nth) & ((1 << 63) - 1)


def slots(tokens: list[int], up: list[int], at: list[int], template: dict[int, tuple[int, int]], texts: set[int]) -> list[tuple[int, tuple[int, ...]]]:
    """For each block its slot, and the template's elements that it is in, from the outside.

    A tag that occurs equally often on each page has a role of its own each time. The roles are the outermost class, of
    vector one on every page; they are the template's elements, and what lies between them its slots. Tags that repeat
    are classes nested in these slots. Two of them nest if, on this page, one's span is within the other's or apart from
    it; one whose span crosses that of one with more tokens isn't taken. A slot is named by the innermost element and the
    last tag before it, so it has the same name on every page, however often what is nested repeats.
    """
    places: dict[int, list[int]] = {}
    count = Counter(t for t in tokens if t in template and t not in texts)
    role: dict[int, int] = {}
    nth: Counter = Counter()
    for i, t in enumerate(tokens):
        if t in count:
            if template[t][1] == count[t]:
                role[i] = _role(t, nth[t])
                nth[t] += 1
            else:
                places.setdefault(template[t][0], []).append(i)
    taken: list[tuple[int, int]] = []
    cuts = set(role)
    for spots in sorted(places.values(), key=lambda s: (-len(s), s[0])):
        a, b = spots[0], spots[-1]
        if all(b < x or y < a or (x <= a and b <= y) or (a <= x and y <= b) for x, y in taken):
            taken.append((a, b))
            cuts.update(spots)
    order = sorted(cuts)
    out, k = [], 0
    for i in at:
        while k < len(order) and order[k] < i:
            k += 1
        chain, e = [], up[i]
        while e >= 0:
            if e in role:
                chain.append(role[e])
            e = up[e]
        last = role.get(order[k - 1], tokens[order[k - 1]]) if k else 0
        out.append((_role(chain[0] if chain else 0, last), tuple(reversed(chain))))
    return out


def _shares(size: list[int], kind: list[int], main: list[bool], linked: list[float], own: list[bool]) -> Iterator[tuple]:
    for n, k, m, share, held in zip(size, kind, main, linked, own):
        yield n, n if k else 0, n if m and not k else 0, n if held and not m else 0, round(n * share)


class Sizes:
    """Of one slot, over pages: characters, those that something speaks against, those in an article's element, those that
    the template has as they are, those in links; and the template's elements that it is in."""

    __slots__ = ("chain", "n")

    def __init__(self, chain: tuple[int, ...]) -> None:
        self.chain, self.n = chain, [0, 0, 0, 0, 0]


def keep(found: dict[int, Sizes]) -> set[int]:
    """The slots that hold the article.

    If any slot is mostly in an article's element, those are it. Else, of slots that vary, that nothing speaks against and
    that are mostly outside links: going down from the page to the element that still has four fifths of their text, all
    that are in the last such element.
    """
    of = {s: x for s, x in found.items() if x.n[0] and 2 * x.n[1] < x.n[0]}
    said = {s for s, x in of.items() if 2 * x.n[2] >= x.n[0] - x.n[1]}
    if said:
        return said
    open_ = {s: x for s, x in of.items() if 2 * x.n[3] < x.n[0] and 2 * x.n[4] < x.n[0]}
    size = {s: x.n[0] - x.n[1] - x.n[3] for s, x in open_.items()}
    depth = 0
    while open_:
        total, by = sum(size[s] for s in open_), Counter()
        for s, x in open_.items():
            if len(x.chain) > depth:
                by[x.chain[depth]] += size[s]
        if not by or 5 * (top := by.most_common(1)[0])[1] < 4 * total:
            break
        open_ = {s: x for s, x in open_.items() if len(x.chain) > depth and x.chain[depth] == top[0]}
        depth += 1
    return set(open_)


def by_evidence(text: list[str], kind: list[int], main: list[bool], linked: list[float]) -> str:
    """What a page without a template has: the blocks in its article's element, or else all that nothing speaks against and
    that are mostly outside links."""
    free = [(t, m, share) for t, k, m, share in zip(text, kind, main, linked) if k == FREE]
    inside = [t for t, m, _ in free if m]
    return "\n\n".join(inside or [t for t, _, share in free if share < 0.5])


def main_text(html: str | None, template: dict[int, tuple[int, int]] | None = None, kept: set[int] | None = None) -> str:
    """One page's text: of its slots those in ``kept``, or what its own tags say without a template."""
    page = Page(html)
    at, text, kind, main, linked = (list(x) for x in zip(*page.blocks)) if page.blocks else ([], [], [], [], [])
    return _text(page.keys(), page.up, at, text, kind, main, linked, template or {}, kept or set())


def _text(tokens, up, at, text, kind, main, linked, template, kept) -> str:
    if template and kept:
        texts = {tokens[i] for i in at}
        own = slots(tokens, up, at, template, texts)
        left = [t for t, k, m, i, (s, _) in zip(text, kind, main, at, own) if k == FREE and s in kept and (m or tokens[i] not in template)]
        if left:
            return "\n\n".join(left)
    return by_evidence(text, kind, main, linked)


_COLUMNS = ("tokens", "up", "at", "text", "kind", "main", "linked")


def _with(parsed: DataFrame, of: DataFrame, made: DataFrame, columns: list[str]) -> DataFrame:
    """``parsed`` with what its host follows: its own template, sent to all tasks if all of these are within a bound, else
    joined by host; or the common one, a single row."""
    own = of.where("of <> ''").join(made, "of", "left").select("of", *columns)
    total = own.agg(F.sum(sum(F.coalesce(F.size(c), F.lit(0)) for c in columns) * 24 + 128)).first()[0] or 0
    rows = parsed.join(F.broadcast(own) if total <= BROADCAST_BYTES else own, F.col("host") == F.col("of"), "left")
    common = made.where("of = ''").select(*(F.col(c).alias(f"common_{c}") for c in columns))
    rows = rows.join(F.broadcast(common), F.col("of").isNull(), "left")
    return rows.select(*parsed.columns, F.coalesce("of", F.lit("")).alias("of"), *(F.coalesce(c, f"common_{c}").alias(c) for c in columns))


def verdicts(parsed: DataFrame, of: DataFrame, made: DataFrame) -> DataFrame:
    """(of, kept: array of slots): what the pages that follow a template say of its slots, all of them summed up.

    A slot's sizes are summed in the tasks and by a shuffle; a template's slots, fewer than the square of a page's tags,
    meet in one group at the end.
    """
    columns = ("tokens", "up", "at", "size", "kind", "main", "linked")
    rows = _with(parsed.select("host", *columns), of, made.withColumnRenamed("tokens", "template"), ["template"]).where("template is not null").select("of", "template", *columns)

    def batch(b: pa.RecordBatch) -> dict:
        memo: dict[str, dict] = {}
        total: dict[tuple, Sizes] = {}
        for row in b.to_pylist():
            if row["of"] not in memo:
                memo[row["of"]] = {x["token"]: (x["class"], x["times"]) for x in row["template"]}
            template = memo[row["of"]]
            tokens, at = row["tokens"], row["at"]
            own = slots(tokens, row["up"], at, template, {tokens[i] for i in at})
            held = [tokens[i] in template for i in at]
            for (slot, chain), add in zip(own, _shares(row["size"], row["kind"], row["main"], row["linked"], held)):
                sizes = total.setdefault((row["of"], slot, chain), Sizes(chain))
                sizes.n = [x + y for x, y in zip(sizes.n, add)]
        at = list(total)
        return {"of": [k[0] for k in at], "slot": [k[1] for k in at], "chain": pa.array([list(k[2]) for k in at], pa.list_(pa.int64())), "n": pa.array([total[k].n for k in at], pa.list_(pa.int64()))}

    sums = arrow_map(rows, batch, "of string,slot long,chain array<long>,n array<long>")
    sums = sums.groupBy("of", "slot", "chain").agg(*(F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(5)))

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        found: dict[int, Sizes] = {}
        for r in pdf.sort_values("n0", ascending=False).itertuples():
            sizes = found.setdefault(r.slot, Sizes(tuple(r.chain)))  # where most of its text is
            sizes.n = [x + y for x, y in zip(sizes.n, (r.n0, r.n1, r.n2, r.n3, r.n4))]
        return pd.DataFrame({"of": [pdf["of"].iloc[0]], "kept": [sorted(keep(found))]})

    return sums.groupBy("of").applyInPandas(judge, "of string, kept array<long>")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row.

    Pages are taken apart once. Templates are deduced from them, by host; their slots are judged by what all of the host's
    pages have in them; and a page's text is what it has in the slots that hold the article. Tags, classes and ids are
    evidence of what a slot is, and take out parts within a slot that no template knows.

    Null and empty pages have an empty text. Hosts with fewer than ``PAGES`` different pages, and pages whose url is null
    or has no host, follow a template of all such pages together; where that has too few pages too, or no slot of the
    article, a page's own tags decide. Broken markup is read as far as it goes. Repeated rows stay, and copies of a page
    count once; an empty table gives an empty result; other columns are not read.
    """
    parsed = materialise(parse(pages, id_col, url_col, html_col), "parsed", "zstd")
    of = materialise(groups(page_counts(parsed)), "hosts")
    made = materialise(deduce(parsed, of), "templates")
    kept = materialise(verdicts(parsed, of, made), "slots")
    both = made.withColumnRenamed("tokens", "template").join(kept, "of", "left")
    rows = _with(parsed.select("page_id", "url", "host", *_COLUMNS), of, both, ["template", "kept"])

    def batch(b: pa.RecordBatch) -> dict:
        memo: dict[str, tuple] = {}
        texts = []
        names, tables, verdict = b.column("of").to_pylist(), b.column("template"), b.column("kept")
        for i, row in enumerate(b.select(list(_COLUMNS)).to_pylist()):
            if names[i] not in memo:
                memo[names[i]] = {x["token"]: (x["class"], x["times"]) for x in tables[i].as_py() or ()}, set(verdict[i].as_py() or ())
            texts.append(_text(*(row[c] for c in _COLUMNS), *memo[names[i]]))
        return {"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    kind = dict(pages.dtypes)
    return arrow_map(rows.select("page_id", "url", "of", "template", "kept", *_COLUMNS), batch, f"page_id {kind[id_col]},url {kind[url_col]},text string,n_chars long")
