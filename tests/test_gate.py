"""The gate, reasons and forms of names on small rows."""

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import text as T
from ledgerlark.operators import gate, reasons

DELTA = "id long, kind string, source string, source_item_id string, subject string, book_id long, match_reason string, title string, subtitle string, pages int"


def gated(spark, budget):
    rows = [
        (1, "first_seen", "a", "1", "isbn:1", 1, "genre_category", "T", None, 300),  # reader: 1 star
        (2, "first_seen", "a", "2", "isbn:2", 2, "genre_category", "T", None, 300),  # portrait: 5
        (3, "first_seen", "a", "3", "isbn:3", 3, "genre_category", "T", None, None),  # described: 2
        (4, "first_seen", "b", "3", "isbn:3", 3, "genre_category", "T", None, None),  # the same book elsewhere
        (5, "first_seen", "a", "5", "isbn:5", 5, "genre_category", "T", None, None),  # short, as described
        (6, "first_seen", "a", "6", "isbn:6", 6, "genre_category", "T", None, None),  # over the budget of two
        (7, "price_drop", "a", "7", "isbn:7", 7, "genre_category", "T", None, 300),  # no verdict: stays
        (8, "first_seen", "a", "8", "isbn:1", 1, "watchlist", "T", None, 10),  # the reader's own choice
    ]
    deltas = spark.createDataFrame(rows, DELTA)
    portraits = spark.createDataFrame([("isbn:2", 5)], "subject string, stars int")
    described = spark.createDataFrame([("isbn:3", 2, 300), ("isbn:5", 4, 20), ("isbn:6", 4, 300)], "subject string, stars int, pages int")
    reader = spark.createDataFrame([(1, 1)], "book_id long, stars int")
    out = gate.apply(deltas, portraits, described, reader, 3, budget)
    return {r["id"]: (r["outcome"], r["counted"]) for r in out.collect()}, gate.report(out).first().asDict()


def test_gate_within_budget(spark):
    found, report = gated(spark, 2)
    assert found == {1: ("held_back", "reused"), 2: ("kept", "reused"), 3: ("held_back", None), 4: ("held_back", None), 5: ("short_stories", "short_stories"), 6: ("kept", "over_budget"), 7: ("kept", None), 8: ("kept", None)}
    assert report == {"held_back": 2, "short_stories": 1, "unrated": 0, "over_budget": 1, "reused": 2}


def test_gate_without_describing_shows_what_has_no_verdict(spark):
    found, report = gated(spark, None)
    assert {i for i, (outcome, counted) in found.items() if counted == "unrated"} == {3, 4, 5, 6}
    assert report["unrated"] == 3 and report["short_stories"] == 0


def test_gate_on_no_rows(spark):
    none = spark.createDataFrame([], DELTA)
    stars = spark.createDataFrame([], "subject string, stars int")
    out = gate.apply(none, stars, stars.withColumn("pages", F.lit(1)), spark.createDataFrame([], "book_id long, stars int"), 3, 5)
    assert out.count() == 0


@pytest.mark.parametrize("scope, genre", [("all", "x"), (None, "x"), ("genre", None), ("genre", "")])
def test_scopes_that_cannot_hold_are_errors(spark, scope, genre):
    answers = spark.createDataFrame([(1, 1, "f", scope, genre)], "position int, book int, family string, scope string, genre string")
    with pytest.raises(Exception, match="scope|genre"):
        reasons.scoped_counterweights(answers).collect()


def test_genre_is_a_whole_word(spark):
    rows = spark.createDataFrame([("Roman", "Kriminalroman"), ("High Fantasy", "high fantasy / Heroische Fantasy"), (None, "x"), ("FIC", "y"), ("C++", "Über C++ und mehr")], "genre string, told string")
    met = [r[0] for r in rows.select(reasons.genre_met(F.col("genre"), F.array(F.lit("FIC")), F.col("told"))).collect()]
    assert met == [False, True, True, True, True]


def test_series_from_title(spark):
    cases = {
        ("Otherland. Band 2", None): ("Otherland", "2"),
        ("The Heritage Universe - Band 3: Der kalte Tod", None): ("The Heritage Universe", "3"),
        ("X", "Bobby Dollar 3"): ("Bobby Dollar", "3"),
        ("X", "Thriller: Natalie Price ermittelt 4 | Krimi"): ("Natalie Price ermittelt", "4"),
        ("X", "Mysterien der Heide - Band 2"): ("Mysterien der Heide", "2"),
        ("Otherland. Band 2 und 3", "Bobby Dollar 3"): None,
        ("Die Hexenholzkrone 1", None): None,
        ("X", "Folge 26"): None,
        ("X", "Nr. 3"): None,
        ("X", "Band 2 und 3"): None,
        (None, None): None,
    }
    rows = spark.createDataFrame(list(cases), "title string, subtitle string")
    found = [r[0] and tuple(r[0]) for r in rows.select(T.series_from_title(F.col("title"), F.col("subtitle"))).collect()]
    assert found == list(cases.values())


def test_display_author(spark):
    cases = {"Crouch, Blake": "Blake Crouch", "Michael Crichton, Norbert Wölfl": "Michael Crichton", "Martin, George R. R.": "George R. R. Martin", "Le Guin, Ursula K.": "Ursula K. Le Guin", "A B; C D": "A B", "": None, None: None}
    rows = spark.createDataFrame([(a,) for a in cases], "a string")
    assert [r[0] for r in rows.select(T.display_author(F.col("a"))).collect()] == list(cases.values())


def test_split_free_text(spark):
    cases = {"Der Schwarm - Frank Schätzing (Grund: langsam)": ("Der Schwarm", "Frank Schätzing", "Grund: langsam"), "Cry  Baby": ("Cry Baby", None, None), "A - Teil 2": ("A - Teil 2", None, None), "A ()": ("A", None, None)}
    rows = spark.createDataFrame([(a,) for a in cases], "a string")
    assert [tuple(r[0]) for r in rows.select(T.split_free_text(F.col("a"))).collect()] == list(cases.values())
