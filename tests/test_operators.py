import json

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import cache as C
from shelfspark.operators import copylog as L
from shelfspark.operators import layout as Y
from shelfspark.operators import sync as S
from shelfspark.plans import library as Q
from shelfspark.streaming import catalogue as G

WANTED = "id bigint, title string, identities array<string>, target string, length bigint, error string"
THERE = "path string, identities array<string>, length bigint, prefix_of string"


def plan(spark, wanted, there=(), **how):
    got = S.plan(spark.createDataFrame([(*w, None) if len(w) == 5 else w for w in wanted], WANTED), spark.createDataFrame(list(there), THERE), **how)
    return {r.id: r.status for r in got.collect()}


def test_sync_plan(spark):
    rows = [(1, "One", ["a"], "x/One.epub", 5), (2, "Two", ["a", "b"], "x/Two.epub", 5), (3, "Three", ["c"], "x/Three.epub", 5), (4, "Bad", [], "x/Bad.epub", 5, "unreadable")]
    assert plan(spark, rows) == {1: "transfer", 2: "duplicate", 3: "transfer", 4: "failed"}
    assert plan(spark, rows, [("x/old.epub", ["a"], 5, None)]) == {1: "present", 2: "present", 3: "transfer", 4: "failed"}


def test_sync_collisions_in_order(spark):
    rows = [(1, "Same", ["a"], "x/Same.epub", 5), (2, "same", ["b"], "X/SAME.epub", 5), (3, "Zed", ["b"], "x/Zed.epub", 5)]
    assert plan(spark, rows) == {1: "transfer", 2: "failed", 3: "transfer"}  # a failed row is not planned, so its twin is sent


def test_sync_occupied_and_repaired(spark):
    rows = [(1, "One", ["a"], "One.epub", 10), (2, "Two", ["b"], "Two.epub", 10)]
    there = [("one.epub", ["z"], 4, "1"), ("Two.epub", ["y"], 4, None)]
    assert plan(spark, rows, there, wireless=True) == {1: "repair", 2: "failed"} and plan(spark, rows, there) == {1: "failed", 2: "failed"}


def test_sync_report_and_outcomes(spark):
    p = S.plan(spark.createDataFrame([(1, "One", ["a"], "One.epub", 1, None), (2, "Two", ["b"], "Two.epub", 1, None)], WANTED), spark.createDataFrame([], THERE))
    assert S.report(p).first().transfer == 2 and S.report(p.where("false")).first().transfer == 0
    done = S.applied(p, spark.createDataFrame([(1, None), (2, "full")], "id bigint, error string"))
    assert {(r.id, r.status) for r in done.collect()} == {(1, "sent"), (2, "failed")}
    with pytest.raises(ValueError):
        S.excluded(p, spark.createDataFrame([(9,)], "id bigint"))


def test_sync_queries_plan_every_kobo_copy(spark, small):
    kobo = sorted(r.copy_id for r in Q.copies(spark, small).where("place = 'Kobo'").collect())
    assert any(i % 2 == 0 for i in kobo) and sorted(r.id for r in Q.sync_plan(spark, small).collect()) == kobo
    assert sum(Q.sync_report(spark, small).first()) == len(kobo)


def test_log_tail_takes_lines_before_it_parses(spark):
    good = lambda at, ok=True: json.dumps({"at": at, "title": f"t{at}", "from": "a", "to": "b", "bytes": 1, "ok": ok, "detail": f"d{at}"})
    text = "\n".join([good(1), "", good(2, False), "junk", good(3), ""])
    lines = L.lines_of(spark.createDataFrame([(text,)], "value string"))
    assert [r.at for r in L.tail(lines, 2).orderBy("line_no").collect()] == [3] and L.tail(lines, 3).count() == 2 and L.failed(lines, 5).count() == 1
    (s,) = L.summary(lines.where("NOT malformed")).collect()
    assert (s.copied, s.total, s.failures, s.messages) == (2, 3, 1, "d2")


def test_cache(spark, tmp_path):
    schema = "key string, seen bigint, title string"
    rows = spark.createDataFrame([("a", 10, "A"), ("b", 20, "B"), ("gone", 30, "G")], schema)
    listing = spark.createDataFrame([("Local", "a"), ("Local", "c"), ("Local", None)], "place string, key string")
    assert [r.title for r in C.known(listing, rows).collect()] == ["A"] and C.todo(listing, rows).count() == 2
    path = str(tmp_path / "cache")
    assert C.load(spark, path, schema).count() == 0
    C.save(rows, path, now=30)
    assert C.load(spark, path, schema).count() == 3
    assert [r.key for r in C.kept(rows, now=20 + C.TTL, most=1).collect()] == ["gone"]
    new = C.refreshed(rows, listing, spark.createDataFrame([("c", "C")], "key string, title string"), now=99)
    assert {(r.key, r.seen) for r in new.collect()} == {("a", 99), ("b", 20), ("gone", 30), ("c", 99)}


LINES = "doc_id bigint, page int, line int, y float, left_edge float, right_edge float, size float, text string"


def lines(spark, texts, right=300.0, size=11.0):
    return spark.createDataFrame([(1, 0, i, 700.0 - 14 * i, 50.0, right, t[1] if isinstance(t, tuple) else size, t[0] if isinstance(t, tuple) else t) for i, t in enumerate(texts)], LINES)


def test_hyphens_follow_the_document(spark):
    got = Y.paragraphs(lines(spark, ["It gives real-", "time responses and inconsis-", "tent with them. A real-time one", "and inconsistent others."])).orderBy("block").collect()
    assert [r.text for r in got] == ["It gives real-time responses and inconsistent with them. A real-time one and inconsistent others."]


def test_headings_and_chapters(spark):
    rows = lines(spark, [("Part", 20.0), ("One", 20.0), "prose here and", "more of it", ("Two", 20.0), "again prose of some length"])
    got = Y.chapters(Y.paragraphs(rows)).orderBy("block").collect()
    assert [(r.kind, r.text, r.chapter) for r in got] == [("heading", "Part", 0), ("heading", "One", 0), ("paragraph", "prose here and more of it", 0), ("heading", "Two", 1), ("paragraph", "again prose of some length", 1)]


def test_furniture_goes(spark):
    rows = [(1, p, i, 700.0 - 14 * i, 50.0, 300.0, 11.0, t) for p in range(4) for i, t in enumerate((f"My Book {p}", f"words of page {'abcd'[p]}", str(p)))]
    got = Y.flow(spark.createDataFrame(rows, LINES)).select("text").collect()
    assert {r.text for r in got} == {f"words of page {c}" for c in "abcd"}


def test_anchored_lines(spark):
    piece = lambda i, y, x, t: (1, 0, i, float(x), float(y), 10.0, 5.0 * len(t), t)
    rows = [piece(0, 100, 50, "a"), piece(1, 97, 80, "b"), piece(2, 94, 110, "c")]  # b is near a; c is near b but not a
    df = spark.createDataFrame(rows, "doc_id bigint, page int, ord int, x float, y float, size float, advance float, text string")
    assert [r.text for r in Y.lines(df).orderBy("line").collect()] == ["a b", "c"]


def test_verdicts(spark):
    rows = [(1, i, 500, i % 2 == 0, 0, 0) for i in range(10)] + [(2, i, 0, False, 1, 0) for i in range(3)] + [(3, i, 500, False, 0, 0) for i in range(3)] + [(4, 0, 0, False, 0, 0)]
    got = {r.doc_id: r for r in Y.verdicts(spark.createDataFrame(rows, "doc_id bigint, page int, n_bytes bigint, two_columns boolean, pictures int, dropped int")).collect()}
    assert (got[1].verdict, got[1].concerns) == ("poor", "mixed columns") and got[2].concerns == "no text" and got[3].verdict == "good" and got[4].concerns == "nothing found"


def test_worth_carrying(spark):
    df = spark.createDataFrame([("a", 100.0, 100.0), ("rule", 500.0, 1.0), ("page", 590.0, 840.0)], "name string, width double, height double")
    assert [r.name for r in Y.worth_carrying(df).collect()] == ["a"]


COPY = "copy_id bigint, place string, place_rank int, format string, path string, title string, author string, series string, series_index double, size bigint, sha string, resources string, variant_resources string, optimized boolean, locked boolean, seen bigint, gone boolean"


def test_stream_equals_batch(spark, tmp_path):
    def arrive(n, rows):
        spark.createDataFrame([(i, place, 0, "epub", f"/{i}", title, "A", None, None, 1, sha, None, None, False, False, n, gone) for i, place, title, sha, gone in rows], COPY).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        q = G.follow(spark, str(tmp_path / "in"), COPY, str(tmp_path / "table"), str(tmp_path / "check"))
        q.awaitTermination(120)

    arrive(1, [(1, "Local", "one", "a", False), (2, "Kobo", "one", "a", False)])
    run()
    assert G.books(spark, str(tmp_path / "table")).count() == 1
    arrive(2, [(2, "Kobo", "one", "a", True), (3, "Local", "two", "b", False), (1, "Local", "renamed", "a", False)])
    run()
    got = {r.book_id: (r.title, r.places) for r in G.books(spark, str(tmp_path / "table")).collect()}
    assert got == {1: ("renamed", "Local"), 3: ("two", "Local")}
    before = G.current(spark, str(tmp_path / "table"))
    G.upsert(spark.createDataFrame([], COPY), before[0], str(tmp_path / "table"))  # a repeated batch
    assert G.current(spark, str(tmp_path / "table")) == before


def test_windows_of_the_log(spark):
    rows = spark.createDataFrame([(0, True), (30, False), (700, True)], "at bigint, ok boolean")
    assert [(r.copies, r.failed) for r in G.counts_by_window(rows).orderBy("start").collect()] == [(2, 1), (1, 0)]


def test_excluded_and_space(spark):
    wanted = spark.createDataFrame([(1,), (2,)], "id bigint")
    assert S.excluded(wanted, spark.createDataFrame([(2,)], "id bigint")).collect()[0].id == 1
    assert F is not None
