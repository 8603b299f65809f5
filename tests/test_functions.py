import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfspark.functions import text as X
from shelfspark.operators.segment import split_sentences, spanned, unspanned


def values(spark, rows, kind, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_stamp(spark):
    assert values(spark, [0, 1_000_000_000, 1709164800, 951782400], "bigint", X.stamp) == ["1970-01-01 00:00", "2001-09-09 01:46", "2024-02-29 00:00", "2000-02-29 00:00"]


def test_human_size(spark):
    assert values(spark, [0, 1023, 1024, 1280, 1 << 20, 5 << 40, None], "bigint", X.human_size) == ["0 B", "1023 B", "1.0 KiB", "1.2 KiB", "1.0 MiB", "5120.0 GiB", None]


def test_titles_of_paths(spark):
    assert values(spark, ["/books/Some Paper.pdf", "/x/archive.tar.gz", "/x/.pdf", "a\\b.epub", "/x/dot. ", "/plain"], "string", X.title_of_path) == ["Some Paper", "archive.tar", "Untitled", "b", "dot", "plain"]


def test_formats(spark):
    assert values(spark, ["a.EPUB", "a.pdf", "a.cbz.txt", "epub", "x.CbZ"], "string", X.format_of) == ["epub", "pdf", None, None, "cbz"]


def test_components(spark):
    long = "é" * 100
    got = values(spark, ['a/b:c?"', "  ..x.. ", "", "XTCache", long, "a\tb", None], "string", lambda x: X.component(x, "none"))
    assert got == ["a_b_c__", "x", "none", "none", "é" * 60, "a_b", None]


def test_output_names(spark):
    (got,) = values(spark, ["Was? / wo"], "string", lambda x: X.output_name(x, F.lit("id"), F.lit("epub")))
    assert got.startswith("Was_ _ wo [") and got.endswith("].epub") and len(got) == len("Was_ _ wo [].epub") + 12


def test_series_order(spark):
    df = spark.createDataFrame([("a", "S", 10.0), ("b", "s", 2.0), ("c", "S", 2.5), ("d", None, None), ("e", "S", None)], "id string, s string, i double")
    assert [r.id for r in df.orderBy(X.series_key(F.col("s"), F.col("i"))).collect()] == ["e", "b", "c", "a", "d"]


def test_integer_prefix(spark):
    assert values(spark, ["6", "6abc", " 7", "x", "", None], "string", X.integer_prefix) == [6, 6, 7, 0, 0, None]


def test_words_and_leaders(spark):
    assert values(spark, ["(Well-known),", "'é'", "--"], "string", X.bare_word) == ["well-known", "é", "--"]
    assert values(spark, ["One ..... 7", "a...b", "End......"], "string", X.leaders_collapsed) == ["One  …  7", "a...b", "End …"]


def test_percent_and_day(spark):
    assert values(spark, [0.225, -0.005, 1.0], "double", X.percent) == [23, -1, 100]
    assert values(spark, ["2025-09-02T07:43", ""], "string", X.day_of) == ["2025-09-02", ""]


def test_trimming_and_folding(spark):
    assert values(spark, ["  a  "], "string", X.trimmed) == ["a"]
    assert values(spark, ["AbÉ"], "string", X.fold_ascii) == ["abÉ"]
    assert values(spark, ["a\tb\x07c"], "string", X.printable) == ["a b c"]


def test_sentences_agree(spark):
    texts = ["One. Two!  Three?", "No end", "3.14 is. ", "", "...", "A.\nB. c", "é. è."]
    assert values(spark, texts, "string", X.sentences) == [split_sentences(t) for t in texts]
    assert all("".join(split_sentences(t)) == t for t in texts)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.!? \n<>/pé", max_size=60))
def test_spans_come_off_again(text):
    page = f"<html><body>{text}</body></html>"
    assert unspanned(spanned(page)) == page
    assert "".join(split_sentences(text)) == text


def test_spans_number_paragraphs():
    got = spanned("<html><head><title>No. No.</title></head><body><p>A. B.</p><script>x. y.</script><p>C</p></body></html>")
    assert 'id="kobo.1.1">A. </span>' in got and 'id="kobo.1.2">B.</span>' in got and 'id="kobo.2.1">C</span>' in got
    assert "<title>No. No.</title>" in got and "<script>x. y.</script>" in got


@pytest.mark.parametrize("page", ["no body at all", "<body", "<body>a <!-- b. ", "<BODY>a.<br/>b.</BODY>"])
def test_spans_leave_odd_markup(page):
    assert unspanned(spanned(page)) == page
