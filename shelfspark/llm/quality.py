"""Operator 5: quality rules by how far a document's distributions are from its language's. DataFrame functions only.

Two histograms of each document, of character classes and of its language's most common words, are held
against those of all documents of the language by Jensen-Shannon distance (square root of the divergence in bits,
0 to 1). A document is kept unless a base rule or a distance is against it; a distance counts only for
documents long enough to be judged by it.

Repeated words are found without leaving the row: the hashes of the three-word windows are sorted together with
their places, neighbours of equal hash are compared word by word, and the places of those that agree are merged.

Defined results: a null or empty text has no words and fails the base rules. A null language is a language of its
own; one without a list of common words is judged by characters only. An empty table gives no rows. Very long texts are judged whole, by
arrays as long as the text's words. Rows repeat as they come, equal ones with equal verdicts, and other columns do not matter, whatever their
names: filtered() gives back those that df has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import GAP, documents, materialize, text_or_empty

# The most common words of each language.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in a is that for it was on are as with be by this have from".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par pas sur au plus".split(),
}
#: Classes of characters, taken away one after the other; what remains is a class too.
CLASSES = (r"[a-z]+", GAP, r"[A-Z]+", r"[#*$%&|<>]+", r"[0-9]+", r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+")
MIN_WORDS, MOST_REPEATED = 50, 50  # a document's words, and per cent of them in repeated windows
MIN_CHARS, FAR_CHARS = 200, 0.30
MIN_COMMON, FAR_WORDS = 120, 0.27  # words that a document needs before its common words count
MOST_LANGUAGES = 1000  # up to so many rows, the languages' histograms are broadcast


def features(df: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The base counts and both histograms of each row, with the columns of df named in carry."""
    carried = [F.col(c) for c in carry]
    kept = [*carry, "lang"]
    t = df.select(*carried, F.col("lang").alias("lang"), text_or_empty().alias("t"))
    trimmed = F.btrim("t", F.lit(" \t\n\x0b\x0c\r"))
    left, lefts = F.col("t"), []
    for i, pattern in enumerate(CLASSES):
        left = F.regexp_replace(F.col("t") if i == 0 else F.col(f"l{i - 1}"), pattern, "")
        t = t.withColumn(f"l{i}", left)
        lefts.append(F.length(f"l{i}"))
    sizes = [F.length("t"), *lefts]
    classes = [sizes[i] - sizes[i + 1] for i in range(len(CLASSES))] + [sizes[-1]]
    common = F.lit(None).cast("array<bigint>")
    found = F.array().cast("array<string>")
    lexicon = F.array().cast("array<string>")
    for lang, words in COMMON.items():
        pattern = rf"(?<![^\x20\x09-\x0D])(?:{'|'.join(sorted(words, key=len, reverse=True))})(?![^\x20\x09-\x0D])"
        found = F.when(F.col("lang") == lang, F.regexp_extract_all(F.lower("t"), F.lit(pattern), F.lit(0))).otherwise(found)
        lexicon = F.when(F.col("lang") == lang, F.array(*map(F.lit, words))).otherwise(lexicon)
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    t = t.select(
        *kept,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP)).alias("w"),
        (F.length("t") - classes[1]).cast("long").alias("word_chars"),
        classes[3].cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.array(*[c.cast("long") for c in classes]).alias("chars"),
        found.alias("found"),
        lexicon.alias("lexicon"),
    )
    kept += ["word_chars", "n_symbols", "chars"]
    t = t.select(
        *kept,
        "w",
        F.size("w").alias("n"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("lexicon", lambda x: F.size(F.filter("found", lambda y: y == x)).cast("long")).alias("common"),
    )
    kept += ["n_dup_lines", "common"]
    t = t.select(*kept, "w", "n", F.length(F.bin("n")).alias("b"))
    t = t.withColumn("s", F.expr("CASE WHEN n < 4 THEN CAST(array() AS array<bigint>) ELSE sort_array(transform(sequence(0, n - 3), i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), b) | CAST(i AS bigint))) END"))
    t = t.withColumn("m", F.size("s"))
    place = "CAST(s[{j}] & (shiftleft(1L, b) - 1) AS int)"
    same = "shiftrightunsigned(s[j], b) = shiftrightunsigned(s[{o}], b) AND array_join(slice(w, " + place.format(j="j") + " + 1, 3), ' ') = array_join(slice(w, " + place.format(j="{o}") + " + 1, 3), ' ')"
    again = f"(j > 0 AND {same.format(o='j - 1')}) OR (j < m - 1 AND {same.format(o='j + 1')})"
    t = t.withColumn("again", F.expr(f"CASE WHEN m = 0 THEN CAST(array() AS array<int>) ELSE sort_array(transform(filter(sequence(0, m - 1), j -> {again}), j -> {place.format(j='j')})) END"))
    covered = F.expr("aggregate(again, struct(0 AS c, -3 AS p), (a, x) -> struct(a.c + least(3, x - a.p) AS c, x AS p), a -> a.c)")
    return t.select(*kept, F.col("n").cast("long").alias("n_words"), covered.cast("long").alias("n_repeat_words"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; null if one is empty."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("double"), lambda a, v: a + v)
    part = lambda x: F.when(x.getField("a") > 0, x.getField("a") * F.log2(2 * x.getField("a") / (x.getField("a") + x.getField("b")))).otherwise(F.lit(0.0))
    share = lambda x: F.transform(x, lambda v: v / total(x))
    half = lambda x, y: F.aggregate(F.transform(F.zip_with(share(x), share(y), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), part), F.lit(0.0), lambda a, v: a + v)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(F.lit(0.0), (half(p, q) + half(q, p)) / 2)))


def judged(df: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The features with js_chars, js_words, base_failed and kept."""
    f = materialize(features(df, carry), "quality")
    others = F.array_append(F.col("common"), F.col("n_words") - F.aggregate("common", F.lit(0).cast("long"), lambda a, v: a + v))
    f = f.withColumn("common", F.when(F.size("common") > 0, others).otherwise(F.col("common")))
    n_common = 1 + max(map(len, COMMON.values()))
    sums = f.groupBy("lang").agg(*[F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 1)], *[F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(n_common)])
    refs = sums.select(
        F.col("lang").alias("ref_lang"),
        F.array(*[F.col(f"c{i}") for i in range(len(CLASSES) + 1)]).alias("ref_chars"),
        F.filter(F.array(*[F.col(f"w{i}") for i in range(n_common)]), lambda v: v.isNotNull()).alias("ref_common"),
    )
    refs = materialize(refs, "languages")
    if refs.count() <= MOST_LANGUAGES:
        both = f.join(F.broadcast(refs), F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    else:  # a hot language's rows are dealt over 64 copies of its histograms
        salts = 64
        salted = refs.withColumn("ref_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        both = f.withColumn("salt", F.pmod(F.xxhash64("chars", "n_words", "common"), F.lit(salts)).cast("int"))
        both = both.join(salted, F.col("lang").eqNullSafe(F.col("ref_lang")) & (F.col("salt") == F.col("ref_salt")), "left").drop("salt", "ref_salt")
    both = both.withColumns({"js_chars": distance(F.col("chars"), F.col("ref_chars")), "js_words": distance(F.col("common"), F.col("ref_common"))})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    n_chars = F.aggregate("chars", F.lit(0).cast("long"), lambda a, v: a + v)
    far = ((n_chars >= MIN_CHARS) & (F.coalesce("js_chars", F.lit(0.0)) > FAR_CHARS)) | ((F.col("n_words") >= MIN_COMMON) & (F.coalesce("js_words", F.lit(0.0)) > FAR_WORDS))
    return both.withColumns({"base_failed": failed, "kept": ~failed & ~far}).drop("ref_lang", "ref_chars", "ref_common")


def filtered(df: DataFrame) -> DataFrame:
    """The rows of df that are kept, with its columns."""
    rows = df.select("lang", "text", F.struct(*df.columns).alias("row"))
    out = judged(rows, ("row",)).where("kept")
    return out.select(*[F.col(f"row.{c}").alias(c) for c in df.columns])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(documents(spark, sf_dir), ("doc_id",))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op5_quality": op5_quality}


def _sql() -> str:
    left = ["t"]
    for pattern in CLASSES:
        left.append(f"regexp_replace({left[-1]}, '{pattern}', '', 'g')")
    lefts = ", ".join(f"length({x}) AS l{i}" for i, x in enumerate(left))
    chars = ", ".join([f"l{i} - l{i + 1}" for i in range(len(CLASSES))] + [f"l{len(CLASSES)}"])
    lexicon = "CASE lang " + " ".join(f"WHEN '{lang}' THEN [{', '.join(map(repr, words))}]" for lang, words in COMMON.items()) + " ELSE CAST([] AS VARCHAR[]) END"
    half = lambda p, q: f"list_sum(list_transform(range(1, len({p}) + 1), lambda i : CASE WHEN {p}[i] > 0 THEN {p}[i] * log2(2 * {p}[i] / ({p}[i] + {q}[i])) ELSE 0 END))"
    js = lambda p, q: f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0, ({half(p, q)} + {half(q, p)}) / 2)) END"
    share = lambda x: f"list_transform({x}, lambda v : v / list_sum({x}))"
    total = lambda x: f"(SELECT lang, list(s ORDER BY i) AS {x}_ref FROM (SELECT lang, i, sum(v) AS s FROM (SELECT lang, unnest({x}) AS v, unnest(range(len({x}))) AS i FROM f) GROUP BY lang, i) GROUP BY lang)"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
    a AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
    r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM a) GROUP BY rid),
    l AS (SELECT *, {lefts}, list_filter(string_split(t, chr(10)), lambda x : regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, list_transform(w, lambda x : lower(x)) AS lw, {lexicon} AS lexicon FROM d),
    c AS (SELECT rid, doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, l3 - l4 AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, [{chars}] AS chars,
          list_transform(lexicon, lambda x : len(list_filter(lw, lambda y : y = x))) AS found FROM l),
    f AS (SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words, CASE WHEN len(found) > 0 THEN list_append(found, n_words - list_sum(found)) ELSE found END AS common FROM c LEFT JOIN r ON c.rid = r.rid),
    p AS (SELECT f.*, {share("chars")} AS cp, {share("chars_ref")} AS cq, {share("common")} AS wp, {share("common_ref")} AS wq, chars_ref, common_ref FROM f LEFT JOIN {total("chars")} x ON f.lang IS NOT DISTINCT FROM x.lang
          LEFT JOIN {total("common")} y ON f.lang IS NOT DISTINCT FROM y.lang),
    j AS (SELECT *, {js("cp", "cq")} AS js_chars, {js("wp", "wq")} AS js_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM p)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
    NOT base_failed AND NOT (list_sum(chars) >= {MIN_CHARS} AND coalesce(js_chars, 0) > {FAR_CHARS}) AND NOT (n_words >= {MIN_COMMON} AND coalesce(js_words, 0) > {FAR_WORDS}) AS kept FROM j"""


ORACLE = {"op5_quality": _sql()}
