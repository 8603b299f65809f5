"""Catalogue feeds: Atom documents with offers, as rows."""

from __future__ import annotations

from urllib.parse import quote_plus, urljoin
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions import media as M
from shelfspark.functions import text as X
from shelfspark.shipping import in_batches, ship
from shelfspark.storage import discard, materialize

ATOM, OPDS, DCTERMS, SEARCH = "{http://www.w3.org/2005/Atom}", "{http://opds-spec.org/2010/catalog}", "{http://purl.org/dc/terms/}", "{http://a9.com/-/spec/opensearch/1.1/}"
AUTH = "http://opds-spec.org/auth/document"
MAX_FEED = 8 << 20


class BadFeed(ValueError):
    """Why a document is no feed."""


def _base(kind: str | None) -> str:
    return (kind or "").partition(";")[0].strip().rstrip("/")


def chain(link: ET.Element) -> dict:
    """Where following a link's declared chain leads: delivery, format, the reason of a refusal, and a token's inner format.

    Steps are visited in order, entry documents by what is below them. The first book ends the walk; without
    one the first licence token counts; without that, the first type at an end says why not.
    """
    token, leaf, inner = None, None, None
    stack = [(s, 0) for s in reversed(link.findall(f"{OPDS}indirectAcquisition"))]
    while stack:
        step, depth = stack.pop()
        kind = _base(step.get("type"))
        below = step.findall(f"{OPDS}indirectAcquisition")
        inner = inner or (M.FORMATS.get(kind) if depth == 0 else None)
        if kind in M.FORMATS:
            return {"delivery": "book", "format": M.FORMATS[kind], "reason": None, "inner": inner}
        if kind == M.ATOM:
            stack += [(s, depth + 1) for s in reversed(below)]
            continue
        leaf = leaf if leaf is not None else kind
        if kind == M.ADEPT and token is None:
            token = next((M.FORMATS[k] for s in below if (k := _base(s.get("type"))) in M.FORMATS), "epub")
    if token is not None:
        return {"delivery": "acsm", "format": token, "reason": None, "inner": inner}
    reason = None if leaf is None else M.REFUSALS.get(leaf, M.OTHER_REFUSAL)
    return {"delivery": "unsupported", "format": None, "reason": reason, "inner": inner}


def parse(text: str, base: str) -> dict:
    """title, next, search, authentication and entries of a feed whose address is base."""
    head = text.lstrip().lstrip("﻿").lstrip()[:200].lower()
    if head.startswith(("<!doctype html", "<html")):
        raise BadFeed(f"{base} is a web page, not a feed")
    try:
        root = ET.fromstring(text.lstrip("﻿ \t\r\n"))
    except ET.ParseError as e:
        raise BadFeed("not a feed that can be parsed") from e
    if root.tag != f"{ATOM}feed":
        raise BadFeed(f"not a feed but a {root.tag.rpartition('}')[2]}")
    said = lambda node, tag: ((node.findtext(tag) or "").strip() or None)
    links = {e.get("rel"): urljoin(base, e.get("href")) for e in root.findall(f"{ATOM}link") if e.get("rel") and e.get("href")}
    return {
        "title": said(root, f"{ATOM}title") or "",
        "next": links.get("next"),
        "search": links.get("search"),
        "authentication": links.get(AUTH),
        "entries": [_entry(e, base, said) for e in root.findall(f"{ATOM}entry")],
    }


def _entry(node: ET.Element, base: str, said) -> dict:
    offers, subsection, alternate = [], None, None
    for link in node.findall(f"{ATOM}link"):
        rel, href = link.get("rel"), link.get("href")
        if not rel or not href:
            continue
        suffix = rel.removeprefix(M.ACQUISITION) if rel.startswith(M.ACQUISITION) else None
        if suffix in M.KINDS:
            status = link.find(f"{OPDS}availability")
            length = link.get("length", "")
            offers.append({
                "ord": len(offers), "rel": rel, "href": urljoin(base, href), "media_type": link.get("type", ""), "title": link.get("title"),
                "length": int(length) if length.isdigit() else None, "availability": None if status is None else status.get("status"), "chain": chain(link),
            })
        elif "opds-catalog" in link.get("type", ""):
            if rel == "subsection":
                subsection = urljoin(base, href)
            elif rel == "alternate" and alternate is None:
                alternate = urljoin(base, href)
    authors = [n for a in node.findall(f"{ATOM}author") if (n := said(a, f"{ATOM}name"))]
    return {
        "id": said(node, f"{ATOM}id") or "", "title": said(node, f"{ATOM}title") or "Untitled", "authors": authors, "summary": said(node, f"{ATOM}summary"), "publisher": said(node, f"{DCTERMS}publisher"),
        "language": said(node, f"{DCTERMS}language"), "subsection": subsection or alternate, "offers": offers,
    }


def search_template(description: str, base: str) -> str:
    """The address with a place for terms that an OpenSearch description gives for feeds."""
    root = ET.fromstring(description)
    template = next((u.get("template") for u in root.iter(f"{SEARCH}Url") if "opds-catalog" in u.get("type", "") and u.get("template")), None)
    if template is None:
        raise BadFeed("no search that returns a feed")
    return urljoin(base, template)


def search_address(description: str, base: str, terms: str) -> str:
    """The address that asks a catalogue for terms."""
    return search_template(description, base).replace("{searchTerms}", quote_plus(terms, safe="*-._"))


def search_addresses(template: str, terms: Column) -> Column:
    """The same for a column of terms, from one catalogue's template."""
    return F.replace(F.lit(template), F.lit("{searchTerms}"), X.form_encoded(terms))


CHAIN = "struct<delivery:string,format:string,reason:string,inner:string>"
OFFER = f"struct<ord:int,rel:string,href:string,media_type:string,title:string,length:bigint,availability:string,chain:{CHAIN}>"
ENTRY = f"struct<id:string,title:string,authors:array<string>,summary:string,publisher:string,language:string,subsection:string,offers:array<{OFFER}>>"
FEED = f"address string, title string, next string, search string, authentication string, entries array<{ENTRY}>, error string"


def feeds(captured: DataFrame) -> DataFrame:
    """Feeds from captured documents (address, text); one that is none has an error and no entries."""
    ship(captured.sparkSession)

    def read(batches):
        for batch in batches:
            for address, text in zip(batch.column("address"), batch.column("text"), strict=True):
                address, text = address.as_py(), text.as_py() or ""
                row = {"address": address, "title": None, "next": None, "search": None, "authentication": None, "entries": [], "error": None}
                try:
                    if len(text.encode()) > MAX_FEED:
                        raise BadFeed("larger than a feed may be")
                    row |= parse(text, address)
                except BadFeed as e:
                    row["error"] = str(e)
                yield row, len(text)

    target = T._parse_datatype_string(FEED)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(target)
    return captured.select("address", "text").mapInArrow(lambda batches: in_batches(read(batches), schema), target)


def entries(made: DataFrame) -> DataFrame:
    return made.select("address", F.explode("entries").alias("e")).select("address", "e.*")


def offers(made: DataFrame) -> DataFrame:
    return entries(made).select(F.col("id").alias("entry_id"), F.explode("offers").alias("o")).select("entry_id", "o.ord", "o.rel", "o.href", "o.media_type", "o.title", "o.length", "o.availability", "o.chain")


def captured(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that were saved as files, one to a file."""
    return spark.read.option("wholetext", "true").text(folder).select(F.input_file_name().alias("address"), F.col("value").alias("text"))


def page_numbers(made: DataFrame, start: str, most: int | None = None) -> DataFrame:
    """(address, page): the feeds from start (page 0) on by their links to the next, as far as they are there, and before the first that comes again.

    By doubling: in each round, every page that is known says where the one 2, 4, 8, ... links behind it is, and every link grows as long. So a list
    takes as many rounds as its length has binary digits. Of several feeds with one address the smallest link counts.
    """
    spark = made.sparkSession
    links = materialize(made.where("address IS NOT NULL").groupBy("address").agg(F.min("next").alias("next")), "links")
    there = links.select(F.col("address").alias("next"))
    jumps = materialize(links.join(there, "next").select("address", F.col("next").alias("to")), "jumps")
    first = spark.createDataFrame([(start, 0)], "address string, page bigint")
    reached = materialize(first.join(links.select("address"), "address"), "pages")
    step = 1
    while most is None or step < most:
        ahead = reached.join(jumps, "address").groupBy(F.col("to").alias("address")).agg((F.min("page") + step).alias("page"))
        new = materialize(ahead.join(reached.select("address"), "address", "left_anti"), "pages")
        if new.isEmpty():
            break
        held, reached = reached, materialize(reached.unionByName(new), "pages")
        further = jumps.select(F.col("address").alias("to"), F.col("to").alias("beyond"))
        longer = materialize(jumps.join(further, "to").select("address", F.col("beyond").alias("to")), "jumps")
        discard(held, new, jumps)
        jumps, step = longer, 2 * step
    discard(links, jumps)
    return reached if most is None else reached.where(F.col("page") < most)


def pages(made: DataFrame, start: str, most: int) -> list[str]:
    """Addresses of the feeds from start on by their links to the next, at most max(most, 1)."""
    rows = page_numbers(made, start, max(most, 1)).orderBy("page").collect()  # as many as are asked for
    return [r.address for r in rows]
