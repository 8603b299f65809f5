"""Scalar functions over strings and numbers, as column expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ILLEGAL = r'[\p{Cc}<>:"/\\|?*]'


def fold_ascii(x: Column) -> Column:
    """A-Z in lower case and nothing else, as a NOCASE collation compares."""
    return F.translate(x, UPPER, LOWER)


def same_ascii(a: Column, b: Column) -> Column:
    return fold_ascii(a) == fold_ascii(b)


def trimmed(x: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def printable(x: Column) -> Column:
    """Each control character as a space."""
    return F.regexp_replace(x, r"\p{Cc}", " ")


def integer_prefix(x: Column) -> Column:
    """The number a text begins with, 0 without one, as a lenient CAST gives it."""
    return F.coalesce(F.regexp_extract(x, r"^\s*([+-]?[0-9]{1,18})", 1).try_cast("bigint"), F.when(x.isNotNull(), F.lit(0).cast("bigint")))


def day_of(created: Column) -> Column:
    return F.trim(F.substring_index(created, "T", 1))


def percent(progress: Column) -> Column:
    """Whole per cent, halves away from zero."""
    return F.round(progress * 100).cast("bigint")


def stamp(epoch: Column) -> Column:
    """YYYY-MM-DD HH:MM in UTC, whatever the session's time zone."""
    days = F.floor(epoch / 86400).cast("int")
    minutes = F.floor(F.pmod(epoch, F.lit(86400)) / 60)
    clock = F.concat(F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"))
    return F.concat_ws(" ", F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string"), clock)


def human_size(n: Column) -> Column:
    """Bytes with one decimal in B, KiB, MiB or GiB; halves go to the even digit."""
    part = lambda unit, name: F.concat(F.bround((n / unit).cast("decimal(30,10)"), 1).cast("decimal(30,1)").cast("string"), F.lit(f" {name}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, part(1 << 10, "KiB")).when(n < 1 << 30, part(1 << 20, "MiB")).otherwise(part(1 << 30, "GiB"))


def counted(n: Column, noun: str = "book") -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def format_of(name: Column) -> Column:
    """epub, pdf or cbz from what stands after the last dot; else null."""
    extension = fold_ascii(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return F.when(extension.isin("epub", "pdf", "cbz"), extension)


def title_of_path(path: Column) -> Column:
    """The title of a file that has no other: its name without dots and white space at the end and without the extension."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?U)[.\s]+$", "")
    stem = trimmed(F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name))
    return F.when(stem == "", F.lit("Untitled")).otherwise(stem)


def cut_bytes(x: Column, most: int) -> Column:
    """As many whole characters as fit in so many bytes."""
    grown = F.aggregate(
        F.split(x, ""),
        F.struct(F.lit("").alias("t"), F.lit(True).alias("open")),
        lambda a, c: F.struct(
            F.when(a["open"] & (F.octet_length(a["t"]) + F.octet_length(c) <= most), F.concat(a["t"], c)).otherwise(a["t"]).alias("t"),
            (a["open"] & (F.octet_length(a["t"]) + F.octet_length(c) <= most)).alias("open"),
        ),
        lambda a: a["t"],
    )
    return F.when(F.octet_length(x) <= most, x).otherwise(grown)


def component(x: Column, fallback: str) -> Column:
    """One path component that a FAT file system takes: legal characters, at most 120 bytes, no dots or white space at the ends."""
    kept = F.regexp_replace(cut_bytes(F.regexp_replace(x, ILLEGAL, "_"), 120), r"(?U)^[.\s]+|[.\s]+$", "")
    return F.when((kept == "") | F.lower(kept).isin("system volume information", "xtcache"), F.lit(fallback)).otherwise(kept)


#: Characters that take two cells of a table, and none.
WIDE, NARROWEST = r"[\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{1F300}-\x{1FAFF}\x{20000}-\x{3FFFD}]", r"[\p{Mn}\p{Me}\x{200B}-\x{200F}]"


def cells(x: Column) -> Column:
    """How many cells of a table a text takes."""
    return F.length(x) + F.regexp_count(x, F.lit(WIDE)) - F.regexp_count(x, F.lit(NARROWEST))


def _beginning(characters: Column, most: int) -> Column:
    """The characters from the first on that fit in so many cells."""
    state = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"), F.lit(True).alias("open"))

    def step(a: Column, c: Column) -> Column:
        fits = a["open"] & (a["used"] + cells(c) <= most)
        return F.struct((a["used"] + cells(c)).alias("used"), F.when(fits, F.concat(a["kept"], F.array(c))).otherwise(a["kept"]).alias("kept"), fits.alias("open"))

    return F.aggregate(characters, state, step, lambda a: a["kept"])


def shortened(x: Column, limit: int) -> Column:
    """The beginning of a text that fits in so many cells, with an ellipsis if that is not all."""
    clean = printable(x)
    return F.when(cells(clean) <= limit, clean).otherwise(F.concat(F.array_join(_beginning(F.split(F.substring(clean, 1, limit), ""), limit - 1), ""), F.lit("…")))


def ending(x: Column, limit: int) -> Column:
    """The end of a path that fits, behind an ellipsis if that is not all: a file is known by its name."""
    clean = printable(x)
    last = F.reverse(F.split(F.substring(clean, -limit, limit), ""))
    return F.when(cells(clean) <= limit, clean).otherwise(F.concat(F.lit("…"), F.array_join(F.reverse(_beginning(last, limit - 1)), "")))


def wrapped(x: Column, limit: int) -> Column:
    """Lines of whole words that fit in so many cells, where a word by itself does."""
    words = F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")

    def step(lines: Column, w: Column) -> Column:
        last = F.element_at(lines, -1)
        joined = F.concat(last, F.lit(" "), w)
        return F.when(F.size(lines) == 0, F.array(w)).when(cells(F.try_element_at(lines, F.lit(-1))) + cells(w) + 1 > max(limit, 8), F.concat(lines, F.array(w))).otherwise(F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(joined)))

    step_ = lambda a, w: F.when(F.size(a) == 0, F.array(w)).otherwise(step(a, w))
    return F.aggregate(words, F.array().cast("array<string>"), step_)


def output_name(title: Column, identity: Column, extension: Column, fallback: str = "Book") -> Column:
    """`Title [hash].ext`: at most 80 characters and 180 bytes of the title, and 12 digits of the identity's SHA-256."""
    short = cut_bytes(F.substring(F.regexp_replace(title, ILLEGAL, "_"), 1, 80), 180)
    short = F.regexp_replace(short, r"^[ .]+|[ .]+$", "")
    return F.concat(F.when(short == "", F.lit(fallback)).otherwise(short), F.lit(" ["), F.substring(F.sha2(identity, 256), 1, 12), F.lit("]."), extension)


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), F.substring(F.sha2(path, 256), 1, 24))


def cache_key(*parts: Column) -> Column:
    return F.concat_ws("\u0001", *parts)


def fingerprint(length: Column, modified: Column) -> Column:
    """length.seconds.nanoseconds of a file; null without a modification time, which is never cached."""
    micros = F.unix_micros(modified)
    return F.when(modified.isNotNull(), F.concat(length.cast("string"), F.lit("."), F.floor(micros / 1_000_000).cast("string"), F.lit("."), F.lpad((F.pmod(micros, F.lit(1_000_000)) * 1000).cast("string"), 9, "0")))


def squashed(name: Column) -> Column:
    """ASCII letters and digits only, in lower case."""
    return fold_ascii(F.regexp_replace(name, "[^A-Za-z0-9]", ""))


def series_key(series: Column, index: Column) -> Column:
    """Sorts by series and number, 2 before 10, and what is in no series last."""
    padded = F.lpad(F.format_string("%.3f", F.coalesce(index.cast("double"), F.lit(0.0))), 9, "0")
    return F.when(series.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.lower(series), F.lit("\u0001"), padded))


def series_label(series: Column, index: Column) -> Column:
    """`Series 2` or `Series 2.5`; without a number, the series."""
    whole = index == F.floor(index)
    number = F.when(whole, F.floor(index).cast("string")).otherwise(index.cast("string"))
    return F.when(index.isNull(), series).otherwise(F.concat(series, F.lit(" "), number))


def digits_removed(x: Column) -> Column:
    """What a line says apart from its numbers, to find those that recur from page to page."""
    return F.lower(trimmed(F.regexp_replace(x, "[0-9]", "")))


def bare_word(x: Column) -> Column:
    """A word without punctuation around it (hyphens stay), in lower case."""
    return F.lower(F.regexp_replace(x, r"^[^\p{L}\p{N}-]+|[^\p{L}\p{N}-]+$", ""))


def leaders_collapsed(x: Column) -> Column:
    """The dots that lead to a page number, as one ellipsis; texts without four dots in a row stay as they are."""
    closed = F.regexp_replace(F.regexp_replace(x, r"\.{4,}$", " …"), r"\.{4,}", " … ")
    return F.when(F.instr(x, "....") > 0, trimmed(closed)).otherwise(x)


def xml_escaped(x: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def looks_like_web_page(x: Column) -> Column:
    head = F.lower(F.substring(F.regexp_replace(x, r"(?U)^[\s\x{FEFF}]+", ""), 1, 200))
    return head.startswith("<!doctype html") | head.startswith("<html")


def resolved_reference(base: Column, href: Column) -> Column:
    """A path in an archive from a reference in a document of folder base; null if it leads out of it or is no reference to a file."""
    raw = F.substring_index(href, "#", 1)
    path = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    refused = raw.rlike("%(?![0-9A-Fa-f]{2})") | path.rlike(r"^/|[\\:]") | (F.contains(path, F.lit("\ufffd")) & ~F.contains(raw, F.lit("\ufffd")) & ~F.contains(F.lower(raw), F.lit("%ef%bf%bd")))
    steps = F.filter(F.split(F.concat_ws("/", base, path), "/"), lambda s: ~s.isin("", "."))

    def step(at: Column, s: Column) -> Column:
        return F.when(s != "..", F.concat(at, F.array(s))).when(F.size(at) > 0, F.slice(at, 1, F.size(at) - 1))

    way = F.aggregate(steps, F.array().cast("array<string>"), step)
    return F.when(~refused & way.isNotNull(), F.when(F.size(way) == 0, F.lit(".")).otherwise(F.array_join(way, "/")))


def form_encoded(x: Column) -> Column:
    return F.url_encode(x)


def sentences(x: Column) -> Column:
    """Parts that end after . ! or ? and the white space behind it; together they are the whole text."""
    return F.regexp_extract_all(x, F.lit(r"[\s\S]*?[.!?](?:[ \t\n\f\r]+|\z)|[\s\S]+\z"), F.lit(0))
