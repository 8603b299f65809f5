"""The best run decides what the main text is: pages without article, main and telling names; odd markup; weights."""

import html
import os
import re
import time

import pytest

from shelfspark.llm import html_text


def article(page):
    inside = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*(?:>|$)", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(x for x in parts if x)


def bare(page):
    """The same page in which nothing but the run tells where the article is: no article, nav, footer or class."""
    page = re.sub(r'<div class="[^"]*">', "<div>", page)
    return re.sub(r"<(/?)(?:article|nav|footer|aside|header)\b", r"<\1div", page)


@pytest.fixture(scope="module")
def pages(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    return spark.read.parquet(f"{folder}/pages.parquet")


@pytest.fixture(scope="module")
def weights(pages):
    return html_text.fit(pages)


def test_runs_find_the_article_by_themselves(pages, weights):
    whole = [r.html for r in pages.select("html").collect()]
    whole = [p for p in whole if "</article>" in p]  # what is cut off has no end to find
    same = sum(html_text.main_text(bare(p), weights) == article(p) for p in whole)
    assert same >= 0.97 * len(whole)
    assert all(html_text.main_text(p, weights) == article(p) for p in whole)


def test_weights_decide(pages, weights):
    whole = [r.html for r in pages.select("html").limit(60).collect()]
    got = [html_text.main_text(p, weights) for p in whole]
    dear = [html_text.main_text(p, weights | {"p": -4000.0}) for p in whole]
    assert sum(a != b for a, b in zip(got, dear, strict=True)) > 40
    assert all(set(b.split("\n")) <= set(a.split("\n")) for a, b in zip(got, dear, strict=True))
    assert weights["div"] < weights["p"] < 0 < weights["word"] and weights["link"] < weights["word"]


LONG = "A sentence with a good many words that the reader of this page came for. " * 3


@pytest.mark.parametrize(("page", "text"), [
    (f'<div><a title="a > b" href="/x">Link</a></div><div><p>{LONG}</p></div>', LONG.strip()),
    (f"<article><p>{LONG}</p><div class='x' hidden>Not seen by anyone.</div><p>End.</p></article>", LONG.strip() + "\nEnd."),
    (f"<article><p>{LONG}</p><p>As <math><mi>x</mi></math> says <object>fallback</object>.</p></article>", LONG.strip() + "\nAs x says fallback."),
    (f"<article><p>{LONG}</p><table><tr><td>1</td><td>2</td></tr></table><ul><li>a</li><li><a href='/'>b</a></li></ul></article>", LONG.strip() + "\n1\n2\na\nb"),
    (f"<div><div><a href='/a'>One</a> <a href='/b'>Two</a></div><div><h2>Head</h2><p>{LONG}</p><p>{LONG}</p></div><div><a href='/c'>Three</a></div></div>", f"Head\n{LONG.strip()}\n{LONG.strip()}"),
    (f"<article><p>Short teaser.</p></article><article><h1>Real</h1><p>{LONG}</p></article>", f"Real\n{LONG.strip()}"),
    ("<p>a &lt; b &amp;&#233;</p>", "a < b &é"),
    (f"<p data-x=it's>{LONG}</p><p>it's more of the same here.</p>", f"{LONG.strip()}\nit's more of the same here."),
])
def test_pages(page, text):
    assert html_text.main_text(page, html_text.DEFAULT) == text


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "<p>word " * 2000, "<b>" * 20_000 + "<p>x</b>" * 20_000, "<a title=" * 50_000, "<div " + "x='" * 50_000, "<" * 200_000, "<p>word and word" * 40_000, "<ul>" * 5000 + "<li>x" * 20_000])
def test_linear(page):
    began = time.process_time()
    html_text.main_text(page, html_text.DEFAULT)
    assert time.process_time() - began < 5


def test_odd_rows(spark):
    long = f"<article>{'<p>' + LONG + '</p>' * 3000}</article>"
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, long, None), (3, long, None), (4, "<p>one two</p>", "c")], "page_id bigint, html string, text string")
    got = html_text.extract(df, html_text.DEFAULT).collect()
    assert sorted((r.page_id, len(r.text)) for r in got) == [(1, 0), (2, 0), (3, len(LONG) - 1), (3, len(LONG) - 1), (4, 7)]
    assert html_text.extract(df.where("false"), html_text.DEFAULT).count() == 0


def test_default_weights_find_plain_articles(pages):
    whole = [p for p in (r.html for r in pages.select("html").collect()) if "</article>" in p]
    assert sum(html_text.main_text(bare(p), html_text.DEFAULT) == article(p) for p in whole) >= 0.95 * len(whole)


def test_scaled_weights_change_what_is_found(pages, weights):
    whole = [bare(p) for p in (r.html for r in pages.select("html").limit(60).collect()) if "</article>" in p]
    got = [html_text.main_text(p, weights) for p in whole]
    for share, least in ((0.1, 20), (30, 5)):
        other = [html_text.main_text(p, {k: share * v if v < 0 else v for k, v in weights.items()}) for p in whole]
        assert sum(a != b for a, b in zip(got, other, strict=True)) >= least


def phrases(n, word="phrase"):
    return [f"{word} number {i} of this text" for i in range(n)]


@pytest.mark.parametrize("named", ['id="related-work"', 'class="social-policy"', 'class="ad-hoc"', 'id="side-effects"', 'class="skip-list"', 'class="notice-board"', 'id="menu-recipes"', 'class="text commentary"', 'class="share-price"', 'id="article-header"'])
def test_class_words_take_no_text_away(named):
    page = f"<article><h1>Title</h1><p>{LONG}</p><section {named}>{''.join(f'<p>{x}.</p>' for x in phrases(40))}</section></article>"
    assert html_text.main_text(page, html_text.DEFAULT) == "\n".join(["Title", LONG.strip(), *(f"{x}." for x in phrases(40))])


@pytest.mark.parametrize("named", ['class="ad"', 'class="x notice"', 'id="comments"', 'class="comment-list"', 'class="site-footer"', 'class="cookie-banner"', 'class="share-buttons"', 'role="navigation"', 'ID="Sidebar"', "hidden"])
def test_what_a_whole_class_names_stands_beside(named):
    page = f"<article><p>{LONG}</p><div {named}><p>Not of the text.</p></div><p>End.</p></article>"
    assert html_text.main_text(page, html_text.DEFAULT) == f"{LONG.strip()}\nEnd."


def test_articles_within_articles():
    outer, inner = phrases(60, "outer"), phrases(10, "inner")
    paragraphs = lambda xs: "".join(f"<p>{x}</p>" for x in xs)
    for quote in ("<blockquote><article>{}</article></blockquote>", "<section><article>{}</article></section>", "<article><article>{}</article></article>"):
        page = f"<div><a href='/'>Home</a></div><article>{paragraphs(outer[:30])}{quote.format(paragraphs(inner))}{paragraphs(outer[30:])}</article><div><a href='/x'>Next</a></div>"
        assert html_text.main_text(page, html_text.DEFAULT) == "\n".join([*outer[:30], *inner, *outer[30:]])
    page = f"<main><p>One short teaser.</p><article>{paragraphs(outer)}</article></main>"
    assert html_text.main_text(page, html_text.DEFAULT) == "\n".join(outer)
    page = f"<main>{paragraphs(outer[:30])}<article>{paragraphs(inner)}</article>{paragraphs(outer[30:])}</main>"
    assert html_text.main_text(page, html_text.DEFAULT) == "\n".join([*outer[:30], *inner, *outer[30:]])


@pytest.mark.parametrize("letter", ["I", "\u0130", "\u1e9e", "\ufb03"])
@pytest.mark.parametrize("raw", ["<script>if (a < b) x();</SCRIPT >", "<STYLE>p{}</style>", "<textarea>x</TextArea>"])
def test_letters_that_grow_in_lower_case(letter, raw):
    page = f"<article><p>{letter * 200}</p>{raw}{''.join(f'<p>{x}</p>' for x in phrases(20))}</article>"
    assert html_text.main_text(page, html_text.DEFAULT) == "\n".join([letter * 200, *phrases(20)])


def test_a_page_of_which_all_is_named():
    page = f'<body><div id="menu"><h2>Soups</h2><p>{LONG}</p></div></body>'
    assert html_text.main_text(page, html_text.DEFAULT) == f"Soups\n{LONG.strip()}"
