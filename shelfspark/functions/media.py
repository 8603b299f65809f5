"""What media types and link relations of a catalogue mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACQUISITION = "http://opds-spec.org/acquisition"

# Kinds of offers by what follows the acquisition relation, with rank and label; formats and refusals by type.
KINDS = {"": ("direct", 0, "download"), "/open-access": ("open-access", 0, "free"), "/borrow": ("borrow", 1, "borrow"), "/sample": ("sample", 2, "sample"), "/buy": ("buy", 3, "buy"), "/subscribe": ("subscribe", 3, "subscribe")}
FORMATS = {"application/epub+zip": "epub", "application/pdf": "pdf", "application/vnd.comicbook+zip": "cbz", "application/x-cbz": "cbz"}
ADEPT, ATOM = "application/vnd.adobe.adept+xml", "application/atom+xml"
REFUSALS = {
    "application/vnd.readium.lcp.license.v1.0+json": "Readium LCP, which this program cannot open",
    "application/audiobook+lcp": "Readium LCP, which this program cannot open",
    "application/vnd.overdrive.circulation.api+json": "an audiobook",
    "application/audiobook+json": "an audiobook",
    "text/html": "a reader in a browser, not a file",
    "application/vnd.librarysimplified.bearer-token+json": "a bearer-token handover",
}
OTHER_REFUSAL = "a format this program does not read"


def _chosen(x: Column, table: dict, otherwise: Column | None = None) -> Column:
    """Looked up in a map of constants, so that x is worked out once."""
    found = F.try_element_at(F.create_map(*[F.lit(y) for pair in table.items() for y in pair]), x)
    return found if otherwise is None else F.coalesce(found, otherwise)


def base_type(media_type: Column) -> Column:
    """Without parameters and slashes at the end."""
    return F.regexp_replace(F.trim(F.substring_index(media_type, ";", 1)), "/+$", "")


def readable_format(base: Column) -> Column:
    """The format of a base type, if it is one that is read."""
    return _chosen(base, FORMATS)


def refusal(base: Column) -> Column:
    return _chosen(base, REFUSALS, F.lit(OTHER_REFUSAL))


def kind_of(rel: Column) -> Column:
    return _chosen(rel, {ACQUISITION + k: v[0] for k, v in KINDS.items()})


def kind_rank(kind: Column) -> Column:
    return _chosen(kind, {v[0]: v[1] for v in KINDS.values()})


def kind_label(kind: Column) -> Column:
    return _chosen(kind, {v[0]: v[2] for v in KINDS.values()})
