"""Operator 7: the main text of a page as its best-scoring run of words and tags.

A page is read as a sequence of words, which score positive, and tags, which score negative; one linear scan finds the
contiguous run with the largest sum, and the blocks of text that this run reaches are the main text, whole where it
ends inside one. The weights are log-odds of standing inside or outside the main element, counted on labelled pages
(those with a single article or main element), in units of a word's. What the page itself marks counts besides: no run leaves
or enters an article or main element, whose inner tags cost a fiftieth (an article within an article is part of it; one within a main element has edges that enough words
outweigh); elements that are by tag, role or a whole class or id a menu, header, footer, sidebar,
notice, advert, form or comment neither score nor give text, but cost a little where a run passes them. A class that only holds such a word
(related-work) costs as much and gives its text. If all of a page is named so, names tell nothing.

Defined results: a null, empty or text-free page gives an empty text; an empty table gives no rows. Unclosed and truncated markup is read as
far as it goes. Without labelled pages, fixed weights are taken. Very long and deeply nested pages are read whole, in linear time. Rows
repeat as they come. A column of the table that has the name of the result (text) gives way to it, unless it is the page itself.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import prepare, spread, texts_of, trimmed, with_arrow

#: Pages that weights are learned from at most; the sample follows the hash of the page's id.
MAX_PAGES = 2000

# Elements by what they do to text.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
ASIDE = {"nav", "footer", "aside", "form", "menu", "select", "button", "dialog", "head", "fieldset"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "body", "html", "article", "main", "section", "div", "aside", "nav", "footer", "header", "form", "blockquote"}
#: Words that as a whole class or id name what stands beside the text; the first also together with words of layout.
ALWAYS = {
    "adsense", "advert", "adverts", "advertisement", "advertising", "banner", "banners", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disqus", "footer", "gdpr",
    "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter", "pagination", "popup", "promo", "promotion", "share", "sharing", "sidebar", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
ALONE = {"ad", "ads", "adv", "disclaimer", "discussion", "notice", "notices", "notification", "pager", "recommend", "recommended", "recommendations", "related", "replies", "reply", "respond", "side", "skip", "social"}
LAYOUT = {
    "area", "bar", "block", "bottom", "box", "buttons", "container", "content", "form", "global", "header", "icons", "inner", "item", "items", "left", "link", "links", "list", "local", "main", "page", "panel", "posts",
    "primary", "right", "secondary", "section", "signup", "site", "slot", "top", "widget", "wrap", "wrapper",
}
ROLES = re.compile(r"navigation|banner|contentinfo|complementary|search|form|alert|dialog|menu")
INLINE = dict.fromkeys(("b", "i", "em", "strong", "span", "h1", "h2", "h3", "h4", "br", "p", "sup", "sub", "code", "u", "small"), -0.1)
#: About what labelled pages teach.
DEFAULT = {"word": 1.0, "link": -0.5, "a": -12.0, "li": -6.0, "ul": -10.0, "ol": -10.0, "div": -10.0, "body": -10.0, "html": -10.0, "": -5.0} | INLINE
EDGE, INNER, PASSED, VOUCHED = -1e9, -15.0, -1.0, 0.02  # an article's edge; that of an article in main; an edge of what stands beside the text; the share that tags in an article cost
MAIN = ("article", "main")
ENDS = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)|[^<]+|<", re.S)
SPECIAL = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]*)")
HIDDEN = re.compile(r"(?<![^\s/])hidden(?![^\s/])")
SPACE = re.compile(r"\s+")


def standing(tag: str, attributes: str, inside: bool) -> str:
    """How an element stands to the main text: "beside" it, by its name, its role or a class or id that says so as a whole; "passed", where only a part of one does; or ""."""
    if tag in ASIDE or tag == "header" and not inside:
        return "beside"
    found = ""
    if "=" in attributes and tag not in ("body", "html", *MAIN):
        for m in SPECIAL.finditer(attributes):
            value = (m[1] or m[2] or m[3] or "").lower()
            if m[0][:4].lower() == "role":
                if ROLES.fullmatch(value):
                    return "beside"
                continue
            for token in value.split():
                words = [w for w in re.split(r"[_-]+", token) if w]
                told = [w for w in words if w in ALWAYS]
                if token in ALONE or told and all(w in ALWAYS or w in LAYOUT for w in words) or not inside and words and words[-1] == "header" and all(w in LAYOUT for w in words):
                    return "beside"
                if told or any(w in ALONE for w in words):
                    found = "passed"
    return "beside" if "hidden" in attributes.lower() and HIDDEN.search(VALUE.sub("", attributes.lower())) is not None else found


def parse(page: str, names: bool = True) -> tuple[list[tuple[str, int]], list[dict]]:
    """The scored sequence and the blocks of text in page order; without names, classes and ids tell nothing.

    An item of the sequence: word or, in links outside articles, link, and how many; or the name of a tag, for both its ends. A tilde before a tag: inside an
    article or main element. "|": an edge of such an element ("|in": of an article in main; one within an article has none), and "/beside" of one beside the text, whose
    items begin with "!", or of one whose class or id only holds a word for such elements.
    A block: text, first and last place in the sequence, the number of the outermost article or main element around it (or none), and whether
    it stands beside the main text.
    """
    items: list[tuple[str, int]] = []
    blocks: list[dict] = []
    stack: list[tuple[str, str]] = []  # name, standing
    opened: Counter = Counter()  # names in the stack
    pieces: list[str] = []
    first, tops, links, asides = 0, 0, 0, 0
    pos = 0

    def inside() -> int:
        return opened["article"] + opened["main"]

    def close() -> None:
        if pieces:
            text = SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                blocks.append({"text": text, "first": first, "last": len(items) - 1, "top": tops if inside() else None, "beside": asides > 0})
            pieces.clear()

    def leave() -> str:
        nonlocal links, asides
        name, how = stack.pop()
        opened[name] -= 1
        links -= name == "a"
        asides -= how == "beside"
        if how and not asides:
            items.append(("~/beside" if inside() else "/beside", 1))
        return name

    def edge(tag: str) -> None:
        """Where an article or main element begins or has ended, unless it stands in an article."""
        if not opened["article"] and (tag == "article" or not opened["main"]):
            items.append(("|in" if opened["main"] else "|", 1))

    while pos < len(page):
        m = TOKEN.match(page, pos)
        pos = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                if not pieces:
                    first = len(items)
                pieces.append(m[0])
                n = len(m[0].split())
                if n:
                    items.append(("!word" if asides else "link" if links and not inside() else "word", n))
            continue
        tag = tag.lower()
        opening = not m[1]
        if tag in RAW:
            if opening and not m[3].endswith("/"):
                end = ENDS[tag].search(page, pos)
                pos = len(page) if end is None else end.start()
            continue
        if tag in BLOCK:
            close()
        elif tag == "br":
            pieces.append(" ") if pieces else None
            continue
        known = opened[tag] > 0
        if tag not in MAIN:
            items.append((("!" if asides else "~" if inside() else "") + tag, 1))
        if tag in VOID:
            continue
        if opening:
            drop = CLOSES.get(tag, ())
            if tag in BLOCK and (opened["p"] or any(opened[d] for d in drop)):
                for i in range(len(stack) - 1, -1, -1):
                    name = stack[i][0]
                    if name == "p" or name in drop:
                        while len(stack) > i:
                            leave()  # no article or main element: the scope ends there
                        if name != "p":
                            break
                    elif name in SCOPE:
                        break
            how = standing(tag, m[3] if names else "", inside() > 0)
            tops += tag in MAIN and not inside()
            if how and not asides:
                items.append(("~/beside" if inside() else "/beside", 1))
            if tag in MAIN:
                edge(tag)
            stack.append((tag, how))
            opened[tag] += 1
            links += tag == "a"
            asides += how == "beside"
        elif known:
            while True:
                left = leave()
                if left in MAIN:
                    edge(left)
                if left == tag:
                    break
    close()
    return items, blocks


def best_run(items: list[tuple[str, int]], weights: dict[str, float]) -> tuple[int, int] | None:
    """First and last place of the run with the largest sum; the earliest among equals."""
    best, found, total, start = 0.0, None, 0.0, 0
    costs = {"|": EDGE, "|in": INNER, "/beside": PASSED, "~/beside": VOUCHED * PASSED}
    for i, (name, n) in enumerate(items):
        cost = costs.get(name)
        if cost is None:
            plain = name.lstrip("!~")
            share = 0.0 if name[0] == "!" else VOUCHED if name[0] == "~" else 1.0
            cost = costs[name] = share * weights.get(plain, weights.get("", DEFAULT[""]))
        total += n * cost
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, found = total, (start, i)
    return found


def main_text(page: str | None, weights: dict[str, float]) -> str:
    items, blocks = parse(page or "")
    run = best_run(items, weights)
    if run is None:  # all of it is named as something beside a text
        items, blocks = parse(page or "", names=False)
        run = best_run(items, weights)
    if run is None:
        return ""
    return "\n".join(b["text"] for b in blocks if b["last"] >= run[0] and b["first"] <= run[1] and not b["beside"])


def label_counts(page: str | None) -> Counter:
    """(name, inside) of each tag and word of a page with a single article or main element; else nothing."""
    out: Counter = Counter()
    items, blocks = parse(page or "")
    if len({b["top"] for b in blocks} - {None}) != 1:
        return out
    edges = [i for i, (name, _) in enumerate(items) if name[0] == "|"]
    first, last = edges[0], edges[-1] if len(edges) > 1 else len(items)
    for i, (name, n) in enumerate(items):
        if name[0] != "|" and not name.endswith("/beside"):
            out[name.lstrip("!~"), first <= i <= last and name[0] != "!"] += n
    return out


def fit(df: DataFrame, key: str = "page_id", text: str = "html", max_pages: int = MAX_PAGES) -> dict[str, float]:
    """Weights from the labelled ones of at most max_pages pages, those first by the hash of their ids."""
    prepare(df.sparkSession)
    ids = df.select(key).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(max_pages)
    sample = df.join(F.broadcast(ids.distinct()), key, "left_semi").select(text)  # max_pages ids at most

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for t in texts_of(batch, text):
                total.update(label_counts(t))
        names = [(n if n in BLOCK or n in VOID or n in DEFAULT or len(n) < 12 else "other", i) for n, i in total]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in names], pa.string()), pa.array([i for _, i in names], pa.bool_()), pa.array(list(total.values()), pa.int64())], names=["name", "inside", "n"])

    rows = sample.mapInArrow(trimmed(count), "name string, inside boolean, n bigint").groupBy("name", "inside").agg(F.sum("n").alias("n")).collect()
    got = {(r.name, r.inside): r.n for r in rows}
    if not got:
        return dict(DEFAULT)
    whole = {i: sum(n for (_, x), n in got.items() if x == i) + 1 for i in (True, False)}
    odds = {name: math.log((got.get((name, True), 0) + 0.5) / whole[True]) - math.log((got.get((name, False), 0) + 0.5) / whole[False]) for name in {n for n, _ in got}}
    unit = max(0.3, odds.get("word", 0.3))
    scaled = {name: x / unit for name, x in odds.items() if name != "word"}
    return DEFAULT | {name: min(0.5, max(-3.0, x)) if name == "link" else min(-0.1, max(-12.0, x)) for name, x in scaled.items()}


def extract(df: DataFrame, weights: dict[str, float], text: str = "html", into: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the main text of each page."""

    def make():
        return lambda batch: [pa.array([main_text(t, weights) for t in texts_of(batch, text)], pa.string())]

    return with_arrow(df, text, [T.StructField(into, T.StringType())], make, keep)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    out = extract(pages, fit(pages), keep=["page_id", "url"])
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op7_html": op7_html}
ORACLE: dict[str, str] = {}
