"""Sentences of prose, numbered the way a reading device counts its place in a book, and markup that carries the numbers."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions import text as X

# Elements whose text is no prose.
SKIPPED = ("script", "style", "pre")


def sentence_spans(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (1, 2, ... over the lines with words), segment (1, 2, ... in each), id and sentence."""
    runs = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line")).where(F.col("line").rlike(r"(?U)\S"))
    numbered = runs.withColumn("paragraph", F.row_number().over(Window.partitionBy("doc_id").orderBy("k")))
    parts = F.filter(X.sentences(F.col("line")), lambda s: s.rlike(r"(?U)\S"))
    rows = numbered.select("doc_id", "paragraph", F.posexplode(parts).alias("n", "sentence"))
    return rows.select("doc_id", "paragraph", (F.col("n") + 1).alias("segment"), F.concat(F.lit("kobo."), F.col("paragraph").cast("string"), F.lit("."), (F.col("n") + 1).cast("string")).alias("id"), "sentence")


_SENTENCE = re.compile(r"(?s).*?[.!?](?:[ \t\n\f\r]+|\Z)|.+\Z")
_MARKUP = re.compile(r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[^>]*>")
_NAME = re.compile(r"</?([A-Za-z0-9]*)")


def split_sentences(text: str) -> list[str]:
    """As X.sentences does; the parts together are the text."""
    return _SENTENCE.findall(text)


def _wrapped(text: str, paragraph: int) -> str:
    out, segment = [], 0
    for s in split_sentences(text):
        if s.strip():
            segment += 1
            s = f'<span class="koboSpan" id="kobo.{paragraph}.{segment}">{s}</span>'
        out.append(s)
    return "".join(out)


def _runs(body: str) -> Iterator[tuple[str, str]]:
    """Text and the markup behind it; markup that never ends is the last."""
    at = 0
    while (open_ := body.find("<", at)) >= 0:
        m = _MARKUP.match(body, open_)
        if m is None:
            yield body[at:open_], body[open_:]
            return
        yield body[at:open_], m[0]
        at = m.end()
    yield "\0" + body[at:], ""


def spanned(document: str) -> str:
    """An XHTML document with each sentence of its body in a numbered span; all other bytes stay as they are."""
    begin = re.search(r"<body[^>]*>|<BODY[^>]*>", document)
    if begin is None:
        return document
    out, inside, paragraph = [document[: begin.end()]], "", 1
    for text, tag in _runs(document[begin.end() :]):
        if text.startswith("\0"):  # behind the last markup
            out.append(text[1:])
            continue
        if inside or not text.strip():
            out.append(text)
        else:
            out.append(_wrapped(text, paragraph))
            paragraph += 1
        out.append(tag)
        name = _NAME.match(tag)[1].lower() if _NAME.match(tag) else ""
        if inside:
            inside = "" if tag.startswith("</") and name == inside else inside
        elif name in SKIPPED and not tag.endswith("/>") and not tag.startswith("</"):
            inside = name
    return "".join(out)


def unspanned(document: str) -> str:
    """The document without those spans."""
    return re.sub(r'<span class="koboSpan" id="kobo\.[0-9]+\.[0-9]+">(.*?)</span>', r"\1", document, flags=re.S)
