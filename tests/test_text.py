import unicodedata

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import text as T


def one(spark, column, *values):
    row = spark.range(1).select(column(*(F.lit(v).cast("string") for v in values)).alias("x")).first()
    return row.x


@pytest.mark.parametrize(
    "title, normal",
    [
        ("Der Schwarm", "schwarm"), ("The House of the Sea", "house of the sea"), ("Blau - Ein Roman", "blau"), ("R - Ein Roman", "r ein roman"), ("Die 1,000 Inseln", "1000 inseln"),
        ("Stille (Roman) (Band 2)", "stille"), ("Meer [Hörbuch]", "meer"), ("Straße ebook", "strasse"), ("", ""),
    ],
)
def test_normalize_title(spark, title, normal):
    assert one(spark, T.normalize_title, title) == normal


@pytest.mark.parametrize("title, volume", [("Der Schwarm - Band 2", 2), ("Insel 3", 3), ("Zimmer 1408", None), ("1984", None), ("Passagier 23", None), ("Nacht Teil 12: Ende", 12), (None, None)])
def test_volume_of(spark, title, volume):
    assert one(spark, T.volume_of, title) == volume


@pytest.mark.parametrize("left, right, conflict", [("A", "A 2", True), ("A", "A 1", False), ("A 2", "A", False), ("A 2", "A Band 3", True)])
def test_volumes_conflict(spark, left, right, conflict):
    assert one(spark, T.volumes_conflict, left, right) is conflict


@pytest.mark.parametrize(
    "raw, people",
    [
        ("Anna Meier, Bernd Schulz", ["Anna Meier", "Bernd Schulz"]), ("Riley, Lucinda", ["Riley, Lucinda"]), ("Barnes, S. A.", ["Barnes, S. A."]), ("A B und C D", ["A B", "C D"]),
        ("Sand && Salz Verlag; X Y", ["Sand & Salz Verlag", "X Y"]), ("", []), (None, []),
    ],
)
def test_split_authors(spark, raw, people):
    assert one(spark, T.split_authors, raw) == people


@pytest.mark.parametrize("name, full", [("Tolkien, J. R. R.", "j r r tolkien"), ("Dr. Anna von Meier (Hg.)", "anna meier"), ("Blaue Wolke Verlag", "blaue wolke verlag"), ("Unbekannt", "")])
def test_author_key(spark, name, full):
    assert one(spark, T.author_key, name) == full


@pytest.mark.parametrize("name, key", [("Die Cormoran-Strike-Reihe", "cormoran strike"), ("Die Reihe", "reihe"), ("Flüsse (Peter)", "flüsse"), ("Ein Nacht-Thriller", "nacht")])
def test_series_key(spark, name, key):
    assert one(spark, T.series_key, name) == key


@pytest.mark.parametrize(
    "blurb, clean", [("Ein Buch ... Mehr navigate_next", "Ein Buch ..."), ("  ", None), (None, None), ("Text weniger anzeigen expand_less", "Text"), ("a expand_more b", "a b")]
)
def test_clean_blurb(spark, blurb, clean):
    assert one(spark, T.clean_blurb, blurb) == clean


def test_without_teaser(spark):
    assert one(spark, T.without_teaser, "Der Anfang ... alles anzeigen Der Anfang und das Ende.") == "Der Anfang und das Ende."
    kept = "Sie will alles anzeigen, was fehlt"
    assert one(spark, T.without_teaser, kept) == kept


@pytest.mark.parametrize("isbn, code", [("978-3-16-148410-0", "ger"), ("9780306406157", "eng"), ("9786061234567", "rum"), ("9789212345678", None), ("316148410", None), (None, None)])
def test_language_of_isbn(spark, isbn, code):
    assert one(spark, T.language_of_isbn, isbn) == code


@pytest.mark.parametrize("text, cents", [("9,99 €", 999), ("ab 1.234,56 €", 123456), ("gratis", None), (None, None)])
def test_parse_price(spark, text, cents):
    assert one(spark, T.parse_price, text) == cents


@pytest.mark.parametrize("title, bundle", [("A / B wie C", False), ("Erster Teil / Zweiter Teil", True), ("3in1 Bundle", True), ("2 Gruselkrimis: X", True), ("Gesamtausgabe", True), ("5 Cottages - Haus", False)])
def test_bundles(spark, title, bundle):
    assert one(spark, T.looks_like_bundle, title) is bundle


def test_fold_equals_decomposition(spark):
    text = "ÀÉÎÕÜñçŠžĀ ǅ Œuvre Straße Ærø Þór ﬁ"[:-2] + "é"
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.replace("ǅ", "x")) if not 0x300 <= ord(c) <= 0x36F)
    for letter, to in T.LETTER_FOLDS.items():
        plain = plain.replace(letter, to)
    assert one(spark, T.fold, text.replace("ǅ", "x")) == plain.casefold()
