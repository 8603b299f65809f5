"""Operator 12: sessions kept by batches of late events, and the log of all their versions. JVM only.

Events come in batches, some of them later than their time. After each batch a user's events so far form sessions: neighbours in
time at most `gap` seconds apart share one. A session that holds an event of the batch is a new version and retracts the standing
sessions that it contains.

Events of one user, batch and second are summed before the first shuffle, and neighbours within one batch and one step of time
(`width` seconds) become one piece. The pieces of a user and of `chunk` batches, sorted by batch and start, are collected as structs
and folded: open sessions are an array, of which a piece takes out those that it touches (filter), becomes one with them (aggregate) and
comes back; those that an earlier batch had made go to the log. Afterwards each version of the log looks up (transform, filter) which later one
has it among its parts, and the log is exploded.

A chunk is exact by itself, so that no user, however long, is one task's. An event comes at most so many batches after its time (and not before it): `late` is
that span, or it is measured. So all events before (first batch of a chunk - span) steps of time have come before the chunk begins, and later
ones touch only the last session among them. That one enters the chunk as one struct, from a running sum over one row for each user and chunk of time; the
standing events behind it are collected with the chunk's own. For what retracts its versions, a chunk folds as many
batches more as a session stays within reach of new events. A chunk so has at most (chunk + 2 * span + 2) batches, each of at most width * (span + 1)
seconds, however many events there are: it is bounded.

Defined results: events without user, time or batch belong to no session and are left out. Repeated events count each. A null value adds 0. Ties (equal times) are one second's
events. An empty table gives no rows. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import spread

GAP, WIDTH, CHUNK = 600, 900, 16
#: Sorts before every batch.
BEFORE = -(1 << 62)

_SESSION = "struct<start:bigint,end:bigint,n:bigint,h:bigint,batch:bigint,n_new:bigint,parts:array<struct<batch:bigint,start:bigint>>>"


def _floor(c: Column, by: int) -> Column:
    """Exact floor of a long by a positive number."""
    return ((c - F.pmod(c, F.lit(by))) / F.lit(by)).cast("bigint") if by & (by - 1) else F.shiftright(c, by.bit_length() - 1)


def lateness(events: DataFrame, width: int = WIDTH) -> tuple[int, int]:
    """By how many batches at least and at most events (seconds, batch) come after the batch of their time; (0, 0) without events."""
    span = events.select((F.col("batch") - _floor(F.col("seconds"), width)).alias("by")).agg(F.min("by"), F.max("by")).first()
    return (span[0], span[1]) if span[0] is not None else (0, 0)


def pieces(events: DataFrame, gap: int = GAP, width: int = WIDTH) -> DataFrame:
    """user, batch, step, start, end, n, h: neighbours of one batch in one step of time."""
    seconds = events.groupBy("user", "batch", "seconds").agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).alias("h"))
    order = Window.partitionBy("user", "batch").orderBy("seconds")  # at most width * (span + 1) rows
    step = _floor(F.col("seconds"), width)
    opens = F.lag("seconds").over(order).isNull() | (F.col("seconds") - F.lag("seconds").over(order) > gap) | (F.lag("step").over(order) != F.col("step"))
    marked = seconds.withColumn("step", step).withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(order))
    return marked.groupBy("user", "batch", "run").agg(F.first("step").alias("step"), F.min("seconds").alias("start"), F.max("seconds").alias("end"), F.sum("n").alias("n"), F.sum("h").alias("h")).drop("run")


def settled(found: DataFrame, gap: int, width: int, chunk: int, most: int) -> DataFrame:
    """user, chunk, start, end, n, h: the last session among all events before each chunk's reach, where the chunk can touch it."""
    found = found.withColumn("slice", _floor(F.col("step") + most, chunk))
    order = Window.partitionBy("user", "slice").orderBy("start", "end", "batch")  # at most chunk steps of time
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("opens", (reach.isNull() | (F.col("start") - reach > gap)).cast("int")).withColumn("island", F.sum("opens").over(order))
    islands = islands.groupBy("user", "slice", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.sum("h").alias("h"))
    last = islands.groupBy("user", "slice").agg(F.max(F.struct("start", "end", "n", "h")).alias("last"), F.count("*").alias("islands")).select("user", "slice", "islands", "last.*")
    before = Window.partitionBy("user").orderBy("slice")  # one row for each chunk of time
    goes_on = (F.col("islands") == 1) & (F.col("start") - F.lag("end").over(before) <= gap)
    chained = last.withColumn("chain", F.sum(F.coalesce(~goes_on, F.lit(True)).cast("int")).over(before))
    so_far = Window.partitionBy("user", "chain").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    chained = chained.select("user", (F.col("slice") + 1).alias("chunk"), F.min("start").over(so_far).alias("start"), "end", F.sum("n").over(so_far).alias("n"), F.sum("h").over(so_far).alias("h"))
    return chained.where(F.col("end") >= (F.col("chunk") * chunk - most) * width - gap)


def fold(sorted_pieces: Column, gap: int, first: Column) -> Column:
    """All versions that pieces (batch, start, end, n, h), sorted, make; of those before batch `first` only the ones that stand at the end."""

    def joined(m: Column, x: Column) -> Column:
        same = x["batch"] == m["batch"]
        return F.struct(
            F.least(m["start"], x["start"]).alias("start"), F.greatest(m["end"], x["end"]).alias("end"), (m["n"] + x["n"]).alias("n"), (m["h"] + x["h"]).alias("h"), m["batch"].alias("batch"),
            (m["n_new"] + F.when(same, x["n_new"]).otherwise(F.lit(0))).alias("n_new"),
            F.concat(m["parts"], F.when(same, x["parts"]).otherwise(F.array(F.struct(x["batch"].alias("batch"), x["start"].alias("start"))))).alias("parts"),
        ).cast(_SESSION)

    def take(acc: Column, r: Column) -> Column:
        touches = lambda x: (x["start"] <= r["end"] + gap) & (x["end"] >= r["start"] - gap)
        alone = F.struct(r["start"], r["end"], r["n"], r["h"], r["batch"], r["n"].alias("n_new"), F.array().alias("parts")).cast(_SESSION)
        whole = F.aggregate(F.filter(acc["open"], touches), alone, joined)
        over = F.filter(acc["open"], lambda x: touches(x) & (x["batch"] < r["batch"]) & (x["batch"] >= first))
        return F.struct(F.concat(F.filter(acc["open"], lambda x: ~touches(x)), F.array(whole)).alias("open"), F.concat(acc["log"], over).alias("log"))

    none = F.array().cast(f"array<{_SESSION}>")
    return F.aggregate(sorted_pieces, F.struct(none.alias("open"), none.alias("log")), take, lambda acc: F.concat(acc["log"], acc["open"]))


def versions(events: DataFrame, gap: int = GAP, width: int = WIDTH, late: tuple[int, int] | None = None, chunk: int = CHUNK) -> DataFrame:
    """Every version of every session, from events (user, seconds, batch, h).

    user, batch, start_s, end_s, n_events, n_new (of that batch), n_retracted, h_sum (of all its events), and retracted_batch and
    retracted_start_s of the version that retracts it, null if none does. late: by how many batches events come after that of their time, at
    least and at most; measured if it isn't given.
    """
    if chunk * width < gap:
        raise ValueError("a chunk must be as long as the gap")
    events = events.where("user IS NOT NULL AND seconds IS NOT NULL AND batch IS NOT NULL").select("user", F.col("seconds").cast("bigint").alias("seconds"), F.col("batch").cast("bigint").alias("batch"), F.col("h").cast("bigint").alias("h"))
    least, most = lateness(events, width) if late is None else late
    ahead = most - least + -(-gap // width)  # batches after its own in which a session can still be touched
    found = pieces(events, gap, width)
    piece = F.struct("batch", "start", "end", "n", "h")

    own = found.withColumn("chunk", F.explode(F.sequence(_floor(F.col("batch") - ahead, chunk), _floor(F.col("step") + most, chunk)))).select("user", "chunk", piece.alias("piece"))
    carried = settled(found, gap, width, chunk, most).withColumn("batch", F.lit(BEFORE)).select("user", "chunk", piece.alias("piece"))
    chunks = own.unionByName(carried).groupBy("user", "chunk").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    begins = F.col("chunk") * chunk
    log = chunks.where(F.exists("pieces", lambda p: p["batch"].between(begins, begins + chunk - 1))).select("user", begins.alias("begins"), fold(F.col("pieces"), gap, begins).alias("log"))

    def retracted(v: Column) -> Column:
        by = F.filter(F.col("log"), lambda w: F.exists(w["parts"], lambda p: (p["batch"] == v["batch"]) & (p["start"] == v["start"])))
        return F.struct(v.alias("v"), F.get(by, F.lit(0)).alias("by"))

    out = log.select("user", "begins", F.explode(F.transform(F.filter("log", lambda v: v["batch"].between(F.col("begins"), F.col("begins") + chunk - 1)), retracted)).alias("x"))
    v = F.col("x.v")
    return out.select(
        "user", v["batch"].alias("batch"), v["start"].alias("start_s"), v["end"].alias("end_s"), v["n"].alias("n_events"), v["n_new"].alias("n_new"), F.size(v["parts"]).cast("bigint").alias("n_retracted"),
        v["h"].alias("h_sum"), F.col("x.by.batch").alias("retracted_batch"), F.col("x.by.start").alias("retracted_start_s"),
    )


def conversation_events(turns: DataFrame) -> DataFrame:
    """user, seconds, batch and h of the turns (conv_id, turn) of conversations."""
    crc = lambda text: F.crc32(F.encode(text, "UTF-8"))
    conv = F.col("conv_id").cast("bigint")
    rows = turns.where(F.col("turn").isNotNull()).select(conv.alias("conv_id"), F.col("turn").cast("bigint").alias("turn"))
    rows = rows.withColumn("c", crc(F.col("conv_id").cast("string"))).withColumn("h", crc(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))))
    rows = rows.withColumn("seconds", F.shiftright("c", 1) % 7200 + 300 * F.col("turn") + F.col("h") % 600).withColumn("g", _floor(F.col("h"), 600))
    batch = _floor(F.col("seconds"), WIDTH) + F.when(F.col("g") % 5 == 0, F.col("g") % 4).otherwise(0)
    return rows.select((2 * F.shiftright("conv_id", 3) + F.col("c") % 2).alias("user"), "seconds", batch.alias("batch"), "h")


def op12_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(conversation_events(spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn"))), late=(0, 3))


QUERIES = {"op12_sessions": op12_sessions}
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda h : CAST('0x' || h AS BIGINT))), lambda c, x : xor(c // 256, tab[xor(c % 256, x) + 1])), 4294967295)"
#: CRC-32 goes byte by byte through the table of its polynomial, 0xEDB88320. A session after a batch is a run of the events so far.
ORACLE = {
    "op12_sessions": f"""
    WITH t AS (SELECT list_transform(range(256), lambda i : list_reduce(list_prepend(i, list_transform(range(8), lambda z : 0::BIGINT)), lambda a, z : CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS tab),
    r AS (SELECT conv_id, turn, {_CRC.format("CAST(conv_id AS VARCHAR)")} AS c, {_CRC.format("CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)")} AS h FROM conversations, t WHERE turn IS NOT NULL AND conv_id IS NOT NULL),
    s AS (SELECT 2 * CAST(floor(conv_id / 8) AS BIGINT) + c % 2 AS "user", (c // 2) % 7200 + 300 * turn + h % 600 AS seconds, h // 600 AS g, h FROM r),
    e AS (SELECT "user", seconds, CAST(floor(seconds / 900) AS BIGINT) + CASE WHEN g % 5 = 0 THEN g % 4 ELSE 0 END AS batch, h FROM s),
    b AS (SELECT DISTINCT "user", batch FROM e),
    x AS (SELECT e."user", b.batch, e.batch AS came, seconds, h, seconds - lag(seconds) OVER w AS since FROM e JOIN b ON e."user" = b."user" AND e.batch <= b.batch WINDOW w AS (PARTITION BY e."user", b.batch ORDER BY seconds)),
    y AS (SELECT *, sum(CASE WHEN since <= 600 THEN 0 ELSE 1 END) OVER (PARTITION BY "user", batch ORDER BY seconds ROWS UNBOUNDED PRECEDING) AS n FROM x),
    v AS (SELECT "user", batch, min(seconds) AS start_s, max(seconds) AS end_s, count(*) AS n_events, count(*) FILTER (came = batch) AS n_new, CAST(sum(h) AS BIGINT) AS h_sum FROM y GROUP BY "user", batch, n HAVING count(*) FILTER (came = batch) > 0),
    k AS (SELECT a."user", a.batch, a.start_s, min({{'batch': z.batch, 'start_s': z.start_s}}) AS "by" FROM v a JOIN v z ON a."user" = z."user" AND z.batch > a.batch AND z.start_s <= a.start_s AND z.end_s >= a.end_s GROUP BY ALL),
    d AS (SELECT "user", "by".batch AS batch, "by".start_s AS start_s, count(*) AS n_retracted FROM k GROUP BY ALL)
    SELECT v."user", v.batch, v.start_s, v.end_s, v.n_events, v.n_new, coalesce(n_retracted, 0) AS n_retracted, h_sum, k."by".batch AS retracted_batch, k."by".start_s AS retracted_start_s
    FROM v LEFT JOIN k ON v."user" = k."user" AND v.batch = k.batch AND v.start_s = k.start_s LEFT JOIN d ON v."user" = d."user" AND v.batch = d.batch AND v.start_s = d.start_s"""
}
