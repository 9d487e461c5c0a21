import pytest
from pyspark.sql import functions as F

from ledgerlark.functions.fuzzy import indel_ratio, token_set_ratio, token_sort_ratio
from ledgerlark.operators import catalog, diff, eligibility, matching, state, taste
from ledgerlark.settings import Settings, Weights
from ledgerlark.sources import extract, fake_source
from ledgerlark.streaming import runs

BOOK = "id long, title string, author string, year int, identifier string"


def resolve(spark, query, candidates):
    q = spark.createDataFrame([(0, *query)], BOOK)
    c = spark.createDataFrame([(n, *x) for n, x in enumerate(candidates)], BOOK)
    row = matching.resolutions(q, c).first()
    return row.confidence, row.cid


CASES = [
    (("Der stille Fluss", "Anna Meier", None, None), [("Stille Fluss", "Meier, Anna", None, None)], ("auto_accept", 0)),
    (("Blaue Berge", "Anna Meier", None, None), [("Blaue Berge", "Kim Otto", None, None), ("Blaue Berge. Das Ende", "Anna Meier", None, None)], ("provisional", 1)),
    (("Blaue Berge", None, None, "1"), [("Ganz anders blaue", None, None, "1")], ("auto_accept", 0)),
    (("Nachtwind", "Anna Meier", None, None), [("Nachtwind 2", "Anna Meier", None, None)], ("provisional", 0)),
    (("Nachtwind", None, None, None), [("Nachtwind", None, None, None)], ("provisional", 0)),
    (("Roter Sand", None, None, None), [("Roter Sand", "X Y", None, None)], ("auto_accept", 0)),
    (("Roter Sand", None, None, None), [("Roter Sand", "X Y", None, None), ("Roter Sand", "Z W", None, None)], ("provisional", 0)),
    (("Roter Sand", "X Y", None, "1"), [("Roter Sand", "X Y", None, "2")], ("provisional", 0)),
    (("Roter Sand", "Anna Meier", None, None), [("Kalter Stein", "Anna Meier", None, None)], ("no_match", None)),
    (("Größe Äpfel", "Jörg Weiß", None, None), [("Grosse Apfel", "Jorg Weiss", None, None)], ("auto_accept", 0)),
]


@pytest.mark.parametrize("query, candidates, want", CASES)
def test_resolution(spark, query, candidates, want):
    assert resolve(spark, query, candidates) == want


def test_ratios():
    assert indel_ratio("abc", "abc") == 100 and indel_ratio("abc", "xyz") == 0
    assert token_set_ratio("a b", "a b c") == 100 and token_set_ratio("", "a") == 0
    assert token_sort_ratio("b a", "a b") == 100
    assert round(indel_ratio("kitten", "sitting"), 4) == round(200 * 4 / 13, 4)


OBS = "id long, source string, source_item_id string, match_reason string, title string, subtitle string, price_cents long, original_price_cents long, availability string, pages int"


def test_deltas(spark):
    rows = [
        (1, "s", "a", "watchlist", "T", None, 1200, None, None, None), (2, "s", "a", "watchlist", "T", None, 900, None, None, None), (3, "s", "a", "watchlist", "T", None, None, None, None, None),
        (4, "s", "b", "genre_category", "T Sammelband", None, 100, None, None, None), (5, "l", "c", "profile_author", "T", None, None, None, "unknown", None),
        (6, "l", "c", "profile_author", "T", None, None, None, "available", None), (7, "l", "c", "profile_author", "T", None, None, None, "unavailable", None),
    ]
    found = diff.deltas(diff.with_previous(spark.createDataFrame(rows, OBS)), Settings())
    assert {(r.id, r.kind) for r in found.collect()} == {(1, "first_seen"), (2, "price_drop"), (6, "became_available"), (7, "became_unavailable")}


def test_unknown_excludes_nothing(spark):
    row = spark.createDataFrame([(1, "s", "a", None, None, None, None, None, None, None)], OBS)
    got = row.select(diff.is_short_story().alias("short"), diff.is_strong_deal(Settings()).alias("deal"), diff.junk_reason().alias("junk")).first()
    assert (got.short, got.deal, got.junk) == (False, False, None)


def test_settings_are_checked():
    with pytest.raises(ValueError):
        Settings(strong_deal_max_cents=1000)
    with pytest.raises(ValueError):
        Settings(languages=("de",))


def test_overlap_steps_add_up(spark):
    w = Weights()
    terms = spark.createDataFrame([("x", "t1", 1.0), ("x", "t2", 0.4), ("x", "p1", 0.7), ("y", "t2", 1.0), ("y", "t3", 1.0)], "subject string, term string, w double")
    vocabulary = spark.createDataFrame([("t1", "f1", False), ("t2", "f2", False), ("t3", "f3", False), ("p1", "p", True)], "term string, family string, is_pattern boolean")
    form = spark.createDataFrame([("family", "f1", "f1", 1.0), ("family", "f2", "f2", -0.8), ("family", "p", "p", -0.5), ("term", "t1", "f1", 0.9)], "kind string, key string, family string, value double")
    facets = spark.createDataFrame([("a", "f1"), ("a", "f2")], "facet string, family string")
    rules = spark.createDataFrame([("x", "r", "f1")], "subject string, rule string, family string")
    scores = taste.overlap(terms, form, vocabulary, w, facets, spark.createDataFrame([("x",)], "subject string"), rules).collect()
    for s in scores:
        assert sum(x.delta for x in s.steps) == pytest.approx(s.share, abs=1e-9)
    by = {s.subject: s for s in scores}
    raw = (0.9 - 0.4 * 0.8 + 4 * 0.2) / (1.4 + 4)
    share = 1 - (1 - raw) * 0.75
    share = 1 - (1 - share) * 0.85
    pattern = (-0.5 + 0.2) / 2
    assert by["x"].share == pytest.approx(share * (1 + 0.5 * pattern) * 0.5)
    assert by["y"].share == pytest.approx(max(0, (-0.8 + 0.8) / 5))


def test_same_disappointment_twice_rejects_once(spark):
    vocabulary = spark.createDataFrame([("t1", "f1", False), ("t2", "f2", False)], "term string, family string, is_pattern boolean")
    terms = spark.createDataFrame([(1, "t1", 1.0), (2, "t2", 1.0), (3, "t2", 1.0)], "book long, term string, w double")

    def value(rated):
        form = taste.learn(spark.createDataFrame(rated, "book long, sign int"), terms, vocabulary, Weights())
        return form.where("kind = 'family' and key = 'f2'").first().value

    assert value([(1, 1), (2, -1)]) == pytest.approx(value([(1, 1), (2, -1), (3, -1)]))


def test_facets(spark):
    carriers = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "3"), ("b", "1"), ("b", "2"), ("c", "3")], "family string, book string")
    assert [(r.books, r.families) for r in taste.derive_facets(carriers).collect()] == [(["1", "2"], ["a", "b"])]


def test_connected(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7)], "a long, b long")
    assert {(r.node, r.component) for r in catalog.connected(edges).collect()} == {(5, 2), (4, 2), (3, 2), (2, 2), (9, 8), (8, 8)}


def test_state_log(spark):
    log = spark.createDataFrame([("k", True, "x", 1), ("k", False, None, 2), ("m", True, None, 3)], "key string, active boolean, details string, seq long")
    assert [r.key for r in state.active(log, "key").collect()] == ["m"]
    assert {(r.key, r.active, r.details) for r in state.kept_details(log, "key").collect()} == {("k", False, "x"), ("m", True, None)}
    new = spark.createDataFrame([("k", 1), ("z", 2), ("z", 3)], "key string, v int")
    assert [(r.key, r.v) for r in state.insert_missing(new, log, "key").collect()] == [("z", 2)]


def test_catalogue_json(spark):
    payload = """{"items":[{"id":"1","title":"<b>Wald</b>","firstCreatorName":"A B","type":{"id":"ebook"},"languages":[{"id":"de"}],"ownedCopies":2,"availableCopies":0,"luckyDayAvailableCopies":1,"formats":[{"id":"x"},{"id":"y","isbn":"978"}]},
    {"id":"2","title":"Kind","type":{"id":"ebook"},"languages":[{"id":"de"}],"bisacCodes":["JUV001"]},{"id":"3","title":"Ton","type":{"id":"audiobook"},"languages":[{"id":"de"}]},{"id":"4","title":"Leer","type":{"id":"ebook"},"languages":[{"id":"de"}],"ownedCopies":0}]}"""
    rows = {r.source_item_id: r for r in extract.catalogue_items(spark.createDataFrame([(payload,)], "json string")).collect()}
    assert set(rows) == {"1", "4"} and rows["1"].title == "Wald" and rows["1"].availability == "available" and rows["1"].isbn == "978" and rows["4"].availability == "unknown"


def test_marc(spark):
    xml = """<r><datafield tag="245"><subfield code="a">Meer</subfield><subfield code="b">ein Roman</subfield></datafield><datafield tag="100"><subfield code="a">Meier, Anna</subfield></datafield>
    <datafield tag="041"><subfield code="a">ger</subfield></datafield><datafield tag="300"><subfield code="a">321 Seiten</subfield></datafield><datafield tag="653"><subfield code="a">See</subfield></datafield><datafield tag="653"><subfield code="a">See</subfield></datafield></r>"""
    row = extract.marc_records(spark.createDataFrame([(1, xml), (2, "<r/>")], "id long, xml string")).where("id = 1").first()
    assert (row.title, row.subtitle, row.author, row.language, row.pages, row.keywords) == ("Meer", "ein Roman", "Meier, Anna", "ger", 321, ["See"])


def test_sparql(spark):
    payload = '{"results":{"bindings":[{"item":{"value":"Q1"},"authorLabel":{"value":"Anna Meier"},"series":{"value":"S"},"seriesLabel":{"value":"Wald"},"ord":{"value":"2"}},{"item":{"value":"Q2"},"authorLabel":{"value":"Kim Otto"}}]}}'
    row = extract.sparql_memberships(spark.createDataFrame([(1, payload, "Meier, Anna")], "id long, json string, author string"), F.col("author")).first()
    assert (row.item, row.series, row.volume) == ("Q1", "S", "2")


def test_tiles(spark):
    tile = '<article class="t" data-order="{0}"><a href="/b/1?c=9" title="{1}">x</a><address>Anna</address><p>9,99 €</p></article>'
    page = tile.format("n1", "Wald") + tile.format("n1", "Wald") + tile.format("n2", "See")
    rows = extract.tiles(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()
    assert {(r.order_number, r.title, r.price_cents, r.url) for r in rows} == {("n1", "Wald", 999, "/b/1"), ("n2", "See", 999, "/b/1")}


def test_fake_source(spark, tmp_path):
    file = tmp_path / "list.yaml"
    file.write_text("- {id: a, title: Der Wald, price_cents: 499}\n- {id: b, title: See, match_reason: genre_category}\n", encoding="utf-8")
    watchlist = spark.createDataFrame([("der wald", 7)], "title string, book_id long")
    rows = {r.source_item_id: r for r in fake_source.observations(spark, str(file), "shop", watchlist).collect()}
    assert (rows["a"].book_id, rows["a"].match_reason, rows["b"].book_id, rows["b"].match_reason) == (7, "watchlist", None, "genre_category")


def test_change_stream_equals_batch(spark, tmp_path):
    schema = "id long, source string, source_item_id string, price_cents long, availability string"
    parts = [[(1, "s", "a", 900, None), (2, "l", "b", None, "unknown")], [(3, "s", "a", 700, None), (4, "l", "b", None, "available"), (5, "s", "a", 800, None)]]
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p={n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p=*"))
    q = runs.change_stream(stream).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = {(r.id, r.kind) for r in spark.sql("select id, kind from changes").collect()}
    assert found == {(1, "first_seen"), (2, "first_seen"), (3, "price_drop"), (4, "became_available"), (5, "price_rise")}


def test_journal_batches(spark, tmp_path):
    rows = [(1, "s", "a", "watchlist", "T", None, 900, None, None, None), (2, "s", "a", "watchlist", "T", None, 500, None, None, None)]
    for n, row in enumerate(rows):
        spark.createDataFrame([row], OBS).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={n}"))
    for _ in range(2):
        stream = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p=*"))
        runs.journal_batches(stream, str(tmp_path / "journal"), str(tmp_path / "deltas"), str(tmp_path / "c"), Settings()).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "journal")).count() == 2
    assert {(r.id, r.kind) for r in spark.read.parquet(str(tmp_path / "deltas")).collect()} == {(1, "first_seen"), (2, "price_drop")}


def test_budget(spark):
    finds = spark.createDataFrame([("a", 3), ("b", 1), ("a", 2), ("c", 9)], "subject string, id long")
    assert [r.subject for r in eligibility.budgeted(finds, 2).collect()] == ["b", "a"]


def test_similar_titles_against_all_pairs(spark):
    """No pair of titles that are similar or contained is lost, whether they share a token or not."""
    import random

    from ledgerlark.functions import fuzzy

    rng = random.Random(2)
    words = "river rivers stone stones garden night nights the silver tower of towers winter song a".split()
    titles = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(60)})
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(titles)], "id long, title string, author string, year int, identifier string")
    q, c = matching.prepared(rows, "q"), matching.prepared(rows, "c")
    found = {(r.qtitle, r.ctitle): (r.title_score, r.title_contained) for r in matching.similar_titles(q, c).collect()}
    forms = {r.qtitle: (r.qnorm, r.qtokens) for r in q.collect()}
    want = {}
    for a, (x, xs) in forms.items():
        for b, (y, ys) in forms.items():
            score = round(min(fuzzy.token_set_ratio(x, y), fuzzy.token_sort_ratio(x, y)))
            contained = len(xs) > 0 and len(ys) > len(xs) and not set(xs) - set(ys)
            if x and y and (score >= matching.NO_MATCH_BELOW or contained):
                want[a, b] = (score, contained)
    assert found == want and len(want) > len(titles)


def test_orders_that_share_parts(spark):
    """Components over all of lineitem against union by hand."""
    from pathlib import Path

    import duckdb

    from ledgerlark.plans.catalog_queries import QUERIES

    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        return
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    first = {}
    for order, part in duckdb.sql(f"SELECT DISTINCT l_orderkey, l_partkey FROM '{sf}/lineitem.parquet'").fetchall():
        a, b = sorted((root(order), root(first.setdefault(part, order))))
        parent[b] = a
    assert {r.node: r.component for r in QUERIES["join_graph_merge"](spark, sf).collect()} == {x: root(x) for x in list(parent)}
