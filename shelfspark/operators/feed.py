"""Catalogue feeds: which offers can be delivered, and which of an entry's offers to take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import media as M


def offers(rows: DataFrame) -> DataFrame:
    """Offers of known kinds with kind, delivery (book, acsm, unsupported), format and the label that is shown.

    rows: entry_id, ord, rel, media_type and, where a feed declares chains, `chain` (delivery and format of its best end or a refusal).
    """
    rows = rows.withColumn("base", M.base_type(F.col("media_type")))
    rows = rows.withColumns({"readable": M.readable_format(F.col("base")), "kind": M.kind_of(F.col("rel"))}).where(F.col("kind").isNotNull())
    format_, adept = F.col("readable"), F.col("base") == M.ADEPT
    chained = F.col("chain") if "chain" in rows.columns else F.lit(None).cast("struct<delivery:string,format:string,reason:string,inner:string>")
    delivery = F.when(format_.isNotNull(), "book").when(adept, "acsm").otherwise(F.coalesce(chained["delivery"], F.lit("unsupported")))
    out = rows.withColumns({
        "delivery": delivery,
        "format": F.coalesce(format_, F.when(adept, F.coalesce(chained["inner"], F.lit("epub"))).otherwise(chained["format"])),
    })
    name = F.upper("format")
    shown = F.when(F.col("delivery") == "book", name).when(F.col("delivery") == "acsm", F.concat(name, F.lit(" via Adobe DRM"))).otherwise(F.coalesce(chained["reason"], M.refusal(F.col("base"))))
    return out.withColumn("shown", shown).drop("base", "readable")


def rank():
    """What can be taken as it is before what needs a licence before what is refused; free before loans, samples and sales."""
    delivery = F.when(F.col("delivery") == "book", 0).when(F.col("delivery") == "acsm", 1).otherwise(2)
    return F.struct(delivery.alias("d"), M.kind_rank(F.col("kind")).alias("k"), F.col("ord"), F.col("media_type"))


def best_offers(made: DataFrame) -> DataFrame:
    """The offer to act on of each entry; the first of equals."""
    best = F.min_by(F.struct("ord", "kind", "delivery", "format", "shown"), rank())
    return made.groupBy("entry_id").agg(best.alias("best"), F.count("*").alias("n_offers")).select("entry_id", "best.*", "n_offers")


def feed_counts(best: DataFrame) -> DataFrame:
    """Entries that are shown and those hidden because nothing they offer can be delivered."""
    return best.agg(F.count("*").alias("entries"), F.sum((F.col("delivery") != "unsupported").cast("bigint")).alias("shown"), F.sum((F.col("delivery") == "unsupported").cast("bigint")).alias("hidden"))


def hidden(best: DataFrame) -> DataFrame:
    return best.where(F.col("delivery") == "unsupported")


def navigation(entries: DataFrame) -> DataFrame:
    """Entries that lead to another feed: they offer nothing themselves."""
    return entries.where((F.size("offers") == 0) & F.col("subsection").isNotNull())


def author_line(authors):
    """One author, the first and others, or nobody known."""
    return F.when(F.size(authors) == 0, "Unknown author").when(F.size(authors) == 1, F.get(authors, F.lit(0))).otherwise(F.concat(F.get(authors, F.lit(0)), F.lit(" and others")))


def media_counts(made: DataFrame) -> DataFrame:
    return made.groupBy(M.base_type(F.col("media_type")).alias("media"), "shown").agg(F.count("*").alias("n_offers"))
