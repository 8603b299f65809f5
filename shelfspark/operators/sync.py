"""Planning a one-way synchronisation: what is present, what is a duplicate, what collides, what can be sent."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import text as X
from shelfspark.operators import resolve as R
from shelfspark.shipping import ship
from shelfspark.storage import discard, materialize

#: Rows of one range that a task folds.
FOLDED = 200_000


def target_path(author: Column, title: Column, extension: Column) -> Column:
    """Author/Title.ext in components that a FAT file system takes."""
    return F.concat(X.component(author, "Unknown author"), F.lit("/"), X.component(title, "Untitled"), F.lit("."), extension)


def targets(rows: DataFrame, folders: DataFrame, organised: bool = True) -> DataFrame:
    """rows (id, author, title, name, extension) with target: by author and title, in a folder (name) that is there in whatever case; or, flat, the name of the file."""
    if not organised:
        return rows.withColumn("target", F.col("name"))
    folder = X.component(F.col("author"), "Unknown author")
    known = folders.groupBy(F.lower("name").alias("folded")).agg(F.min("name").alias("there"))
    placed = rows.withColumn("folder", folder).join(known, F.lower("folder") == F.col("folded"), "left")
    path = F.concat(F.coalesce("there", "folder"), F.lit("/"), X.component(F.col("title"), "Untitled"), F.lit("."), F.col("extension"))
    return placed.select(*rows.columns, path.alias("target"))


def case_collisions(paths: DataFrame) -> DataFrame:
    """Paths that differ only in case or not at all, which abort an inventory."""
    return paths.groupBy(F.lower("path").alias("folded")).agg(F.count("*").alias("n_paths")).where("n_paths > 1")


def inventory_match(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, path): the first path in order of what exists with one of the identities of each wanted row.

    Both come with an array of identities; equal identities are found by an equi-join of the exploded arrays.
    """
    left = wanted.select("id", F.explode(F.array_distinct("identities")).alias("identity"))
    right = existing.select("path", F.explode(F.array_distinct("identities")).alias("identity")).groupBy("identity").agg(F.min("path").alias("path"))
    return left.join(right, "identity").groupBy("id").agg(F.min("path").alias("path"))


def excluded(wanted: DataFrame, ids: DataFrame) -> DataFrame:
    """wanted without ids; an id that is not wanted is an error."""
    unknown = ids.join(wanted, "id", "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"unknown exclusions: {[r.id for r in unknown]}")
    return wanted.join(ids, "id", "left_anti")


def plan(wanted: DataFrame, existing: DataFrame, wireless: bool = False) -> DataFrame:
    """id, status (present, duplicate, failed, repair, transfer) and detail of each wanted row.

    wanted: id, title, identities, target, length, head (a prefix test's value), error (why it can't be read, or null).
    existing: path, identities, length. Rows are taken in order of title and id. One that is neither there nor blocked is sent unless one
    that is sent before it has one of its identities or its target (first_come).
    """
    found = inventory_match(wanted, existing).withColumnRenamed("path", "present_at")
    there = existing if "prefix_of" in existing.columns else existing.withColumn("prefix_of", F.lit(None).cast("string"))
    at = there.groupBy(F.lower("path").alias("folded")).agg(F.min_by(F.struct("length", "prefix_of"), "path").alias("there"))
    rows = wanted.withColumn("folded", F.lower("target")).join(found, "id", "left").join(at, "folded", "left")
    repairable = F.lit(wireless) & F.coalesce(F.col("there.prefix_of") == F.col("id").cast("string"), F.lit(False)) & (F.col("there.length") < F.col("length"))
    occupied = F.when(F.col("there").isNull(), None).when(repairable, "repair").otherwise("failed")
    own = F.concat(F.transform("identities", lambda x: F.concat(F.lit("i:"), x)), F.array(F.concat(F.lit("t:"), "folded")))
    rows = materialize(rows.select("id", F.struct(F.lower("title").alias("title"), "id").alias("order"), "target", "error", "present_at", occupied.alias("occupied"), F.array_distinct(own).alias("keys")), "wanted")
    asked = rows.where("error IS NULL AND present_at IS NULL").select("id", "order", "occupied", F.explode("keys").alias("key"))
    sent = first_come(asked.where("occupied IS NULL OR occupied = 'repair'"))

    taken = asked.join(sent, "id", "left_semi").select("key", F.col("order").alias("earlier"))  # no two of them share a key
    blocked = asked.join(sent, "id", "left_anti").join(taken, "key").where(F.col("earlier") < F.col("order"))
    blocked = blocked.groupBy("id").agg(F.max((F.substring("key", 1, 2) == "i:").cast("int")).alias("twin"))
    rows = rows.join(blocked, "id", "left").join(sent.withColumn("sent", F.lit(True)), "id", "left")
    said = lambda status, detail: F.struct((status if isinstance(status, Column) else F.lit(status)).alias("status"), (F.col(detail) if detail in rows.columns else F.lit(detail)).alias("detail"))
    rule = F.when(F.col("error").isNotNull(), said("failed", "error")).when(F.col("present_at").isNotNull(), said("present", "present_at"))
    rule = rule.when(F.col("sent"), said(F.coalesce("occupied", F.lit("transfer")), "target")).when(F.col("twin") == 1, said("duplicate", "the same book is sent already"))
    rule = rule.when(F.col("twin") == 0, said("failed", "another book has this name")).otherwise(said("failed", "a different file is there"))
    return rows.select("id", rule.alias("rule")).select("id", "rule.status", "rule.detail")


def first_come(asked: DataFrame, rounds: int = 2, most: int = FOLDED) -> DataFrame:
    """(id) of the rows that are taken when rows (id, order, key) come in order, and one is taken unless one of its keys is.

    In each of some rounds, all rows that come first under all of their keys are taken, and those that share one with them go; that is all there is to do
    where many rows have one key. What is left, such as chains, is folded in order: rows that are connected by keys follow each other in ranges of about `most` rows, each range is a
    task, and only connected rows that go over the end of one wait for it, so that there are as many further rounds as one such component has ranges.
    """
    left = materialize(asked.select("id", "order", "key"), "asked")
    taken = None
    for _ in range(rounds):
        firsts = left.groupBy("key").agg(F.min("order").alias("first"))
        won = left.join(firsts, "key").groupBy("id").agg(F.min((F.col("order") == F.col("first")).cast("int")).alias("first")).where("first = 1").select("id")
        won = materialize(won, "taken")
        taken = won if taken is None else taken.unionByName(won)
        closed = left.join(won, "id", "left_semi").select("key").distinct()
        gone = left.join(closed, "key", "left_semi").select("id").distinct()
        rest = materialize(left.join(gone, "id", "left_anti"), "asked")
        discard(left)
        left = rest
        if left.isEmpty():
            return taken
    found = _folded(left, most)
    return found if taken is None else taken.unionByName(found)


def _folded(left: DataFrame, most: int) -> DataFrame:
    """(id) of those that are taken of rows that are still open, component by component."""
    ship(left.sparkSession)
    groups = R.components(left.select("id", "key"), "id")
    rows = left.groupBy("id", "order").agg(F.collect_list("key").alias("keys")).join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    rows = materialize(rows, "open")
    ranges = -(-rows.count() // most)
    placed = rows.repartitionByRange(ranges, "component", "order").withColumn("range", F.spark_partition_id())
    rows, unplaced = materialize(placed, "ranges"), rows
    discard(unplaced)
    begins = rows.groupBy("component").agg(F.min("range").alias("begins"))
    rows, plain = materialize(rows.join(begins, "component").withColumn("turn", F.col("range") - F.col("begins")), "turns"), rows
    discard(plain)
    out, closed = None, None
    for turn in range((rows.agg(F.max("turn")).first()[0] or 0) + 1):
        live = rows.where(F.col("turn") == turn)
        if closed is not None:
            gone = live.select("id", F.explode("keys").alias("key")).join(closed, "key", "left_semi").select("id").distinct()
            live = live.join(gone, "id", "left_anti")
        won = materialize(_in_order(live), "taken")
        out = won if out is None else out.unionByName(won)
        further = rows.where(F.col("turn") > turn).select("component").distinct()
        keys = rows.where(F.col("turn") == turn).join(won, "id", "left_semi").join(further, "component", "left_semi").select(F.explode("keys").alias("key"))
        closed = keys if closed is None else closed.unionByName(keys)
    return out


def _in_order(rows: DataFrame) -> DataFrame:
    """(id) of those of rows (id, order, keys, component, range) that are taken, each component of a range in its order."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        current, held = None, set()
        for batch in batches:
            won = []
            for i, (component, keys) in enumerate(zip(batch.column("component").to_pylist(), batch.column("keys").to_pylist(), strict=True)):
                if component != current:
                    current, held = component, set()
                if held.isdisjoint(keys):
                    held.update(keys)
                    won.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(won, pa.int64()))], names=["id"])

    dealt = rows.repartition("range").sortWithinPartitions("range", "component", "order")
    return dealt.select("id", "component", "keys").mapInArrow(run, f"id {kind}")


def report(planned: DataFrame) -> DataFrame:
    """One row: how many of each status."""
    return planned.agg(*[F.coalesce(F.sum((F.col("status") == s).cast("bigint")), F.lit(0)).alias(s) for s in ("present", "duplicate", "failed", "repair", "transfer")])


def applied(planned: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A plan after it ran: transfers are sent, repairs repaired, and what went wrong (id, error) failed."""
    done = F.when(F.col("error").isNotNull(), "failed").when(F.col("status") == "transfer", "sent").when(F.col("status") == "repair", "repaired").otherwise(F.col("status"))
    return planned.join(outcomes, "id", "left").select("id", done.alias("status"), F.coalesce("error", "detail").alias("detail"))


def copy_check(wanted: DataFrame, existing: DataFrame, free: int | None) -> DataFrame:
    """id, outcome and path of copying files to a card, where nothing is ever overwritten.

    wanted: id, folder, name, sha, size. existing: folder, name, sha, directory. A name that is there in any case is taken: by a folder, by another
    file, or by the same bytes, which is a success. free: bytes on the card, or None if they can't be measured, which fails.
    """
    there = existing.groupBy("folder", F.lower("name").alias("folded")).agg(F.min_by(F.struct("name", "sha", "directory"), "name").alias("there"))  # the first of several that differ in case
    rows = wanted.withColumn("folded", F.lower("name")).join(there, ["folder", "folded"], "left")
    fits = F.lit(False) if free is None else F.col("size") <= free
    path = lambda name: F.concat("folder", F.lit("/"), name)
    suitable = X.format_of(F.col("name")).isNotNull() & ~F.col("name").startswith(".") & ~F.col("name").rlike(X.ILLEGAL)
    outcome = F.when(~suitable, "not a suitable name").when(F.col("there.directory"), "the name is taken by a folder").when(F.col("there.sha") == F.col("sha"), "already there").when(F.col("there").isNotNull(), "a different file is there")
    outcome = outcome.when(~fits, "free space is unknown" if free is None else "not enough space").otherwise("copied")
    rows = rows.withColumn("outcome", outcome)
    return rows.select("id", "outcome", F.when(F.col("outcome") == "copied", path(F.col("name"))).when(F.col("outcome") == "already there", path(F.col("there.name"))).alias("path"))


def transfer_check(books: DataFrame, target: str) -> DataFrame:
    """book_id and why a book can't be transferred before any byte moves, or ready."""
    p = F.col("preferred")
    rule = F.when(p["sha"] == "", "unreadable").when(p["place"] == target, "source is the target").when(F.lit(target == "CrossPoint") & ~p["format"].isin("epub", "pdf"), "reader shows only EPUB").otherwise("ready")
    return books.select("book_id", rule.alias("check"))


def plan_table(planned: DataFrame, apply: bool = False) -> DataFrame:
    """id and the printed outcome: planned, a message or `failed: ...`."""
    return planned.select("id", F.when(F.col("status") == "failed", F.concat(F.lit("failed: "), "detail")).when(F.lit(not apply) & F.col("status").isin("transfer", "repair"), "planned").otherwise(F.col("status")).alias("outcome"))


def plan_summary(planned: DataFrame, place: str, apply: bool = False) -> DataFrame:
    """What stands below a plan's table: how many would be copied or were, how many failed, and that a dry run changes nothing."""
    n = planned.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("status") == "failed").cast("bigint")), F.lit(0)).alias("failed"))
    done = F.concat((F.col("n") - F.col("failed")).cast("string"), F.lit(f" book(s) {'copied' if apply else 'would be copied'} to {place}"), F.when(F.col("failed") > 0, F.concat(F.lit("; "), F.col("failed").cast("string"), F.lit(" failed"))).otherwise(""))
    said = done if apply else F.concat(done, F.lit("\nThis was a dry run. Add --apply to copy them."))
    return n.select(F.when(F.col("n") == 0, F.lit(f"Nothing to copy: every book is already at {place}.")).otherwise(said).alias("summary"))
