import random

from pyspark.sql import functions as F

from shelfspark.operators import catalog as K
from shelfspark.operators import resolve as R

COPY = "copy_id bigint, place string, place_rank int, format string, path string, title string, author string, series string, series_index double, size bigint, sha string, resources string, variant_resources string, optimized boolean, locked boolean"


def copy(i, place, sha, resources=None, variant=None, optimized=False, title="T", path=None, format_="epub", locked=False):
    return (i, place, ("Local", "Kobo", "CrossPoint").index(place), format_, path or f"/{i}", title, "A", None, None, 10 * i, sha, resources, variant, optimized, locked)


def test_repacked_copies_are_one_book(spark):
    df = spark.createDataFrame([copy(1, "Local", "a", "r"), copy(2, "CrossPoint", "b", "r"), copy(3, "CrossPoint", "c", "other")], COPY)
    got = {r.book_id: r for r in R.books(R.resolved(df)).collect()}
    assert len(got) == 2 and got[1].places == "Local,CrossPoint" and got[1].preferred.place == "Local"


def test_device_copy_joins_its_original_and_is_not_preferred(spark):
    df = spark.createDataFrame([copy(1, "Local", "a", "x", optimized=True), copy(2, "Kobo", "b", "r", "x")], COPY)
    (b,) = R.books(R.resolved(df)).collect()
    assert b.n_copies == 2 and b.preferred.place == "Kobo"


def test_unreadable_stays_alone(spark):
    df = spark.createDataFrame([copy(1, "Local", "", "r"), copy(2, "Kobo", "", "r"), copy(3, "Kobo", "s", "r")], COPY)
    b = R.books(R.resolved(df))
    assert b.count() == 3 and K.unreadable(b).count() == 2


def test_components_over_chains_and_hot_keys(spark):
    random.seed(4)
    pairs = [(i, f"c{i // 2}") for i in range(1, 400)] + [(i, f"d{(i + 1) // 2}") for i in range(1, 400)]  # one long chain
    pairs += [(1000 + i, "hot") for i in range(2000)] + [(5000, "alone")]
    random.shuffle(pairs)
    got = {r.copy_id: r.component for r in R.components(spark.createDataFrame(pairs, "copy_id bigint, key string")).collect()}
    assert {got[i] for i in range(1, 400)} == {1} and {got[1000 + i] for i in range(2000)} == {1000} and 5000 not in got


def test_order_of_rows_does_not_matter(spark):
    rows = [copy(i, ("Local", "Kobo", "CrossPoint")[i % 3], f"s{i % 7}", f"r{i % 5}") for i in range(40)]
    one = R.books(R.resolved(spark.createDataFrame(rows, COPY))).orderBy("book_id").collect()
    two = R.books(R.resolved(spark.createDataFrame(rows[::-1], COPY).repartition(3))).orderBy("book_id").collect()
    assert one == two


def test_search_fields(spark):
    rows = [("Slow Horses", "Mick Herron", "Slough House"), ("Dead Lions", "Mick Herron", "Slough House"), ("Interlude", "Mick Herron", "Slough House"), ("Nobody Walks", "Mick Herron", None), ("Herron's Way", "Other", None)]
    df = spark.createDataFrame([(i, *r, None) for i, r in enumerate(rows)], "book_id bigint, title string, author string, series string, series_index double")
    n = lambda q: K.search(df, q).count()
    assert (n("series:slough"), n("author: Herron"), n("title:interlude"), n("title:mick"), n("slough"), n("herron"), n("a:b")) == (3, 4, 1, 0, 3, 5, 0)


def test_rules_of_destination_and_removal(spark):
    df = spark.createDataFrame([copy(1, "Local", "a", format_="cbz"), copy(2, "Local", "b", format_="pdf"), copy(3, "Local", "c"), copy(4, "CrossPoint", "c"), copy(5, "Kobo", "k", locked=True), copy(6, "Local", "k")], COPY)
    r = R.resolved(df)
    b = R.books(r)
    why = lambda rows: {x.book_id: (x.decision, x.why) for x in rows.collect()}
    got = why(K.destination(b, "CrossPoint", F.when(F.col("book_id") == 2, "poor")))
    assert got == {1: ("blocked", "reader shows only EPUB"), 2: ("ask", "converts poorly"), 3: ("blocked", "already here"), 5: ("ready", "copy, optimized")}
    assert set(why(K.destination(b, "Kobo", busy=True)).values()) == {("blocked", "busy")}
    assert why(K.destination(b, "Kobo", ready=False))[1] == ("blocked", "unavailable") and why(K.destination(b, "Local", ready=False))[5] == ("blocked", "already here")
    removal = {x.copy_id: x.removal for x in K.removal(r).collect()}
    assert removal == {1: "only copy", 2: "only copy", 3: "add only", 4: "ready", 5: "Kobo library", 6: "add only"}
    assert {x.copy_id: x.removal for x in K.removal(r, card=False).collect()}[4] == "needs the card"


def test_toggling_marks(spark):
    shown, marks = spark.createDataFrame([(1,), (2,)], "book_id int"), spark.createDataFrame([(2,), (9,)], "book_id int")
    some = K.toggled(shown, marks)
    assert {r.book_id for r in some.collect()} == {1, 2, 9} and {r.book_id for r in K.toggled(shown, some).collect()} == {9}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], COPY)
    assert R.books(R.resolved(empty)).count() == 0 and K.presence(R.resolved(empty)).count() == 0


def test_scrolling_keeps_two_rows_around_what_is_selected():
    from shelfspark.operators.catalog import scroll

    assert scroll(0, 0, 100, 0) == 0 and scroll(5, 3, 4, 10) == 0  # nothing to see, or all of it
    for current in range(0, 90, 7):
        for selected in range(100):
            for visible in (1, 2, 3, 5, 20):
                at, margin = scroll(current, selected, 100, visible), min((visible - 1) // 2, 2)
                assert 0 <= at <= 100 - visible and at <= selected < at + visible
                assert selected - at >= margin or at == 0
                assert at + visible - 1 - selected >= margin or at == 100 - visible
                if margin <= selected - min(current, 100 - visible) <= visible - 1 - margin:
                    assert at == min(current, 100 - visible)
