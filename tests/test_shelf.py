"""The shelf and watching on small rows."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import text as T
from ledgerlark.operators import shelf, watching

NOW = "timestamp_ntz'2024-01-20 00:00:00'"


def test_find_or_create(spark):
    books = spark.createDataFrame([(1, None, "Cold Sea", "Lee, Ann", None), (2, "x", "Dust", None, "Old")], "id long, isbn string, title string, author string, series string")
    rows = [
        (1, "y", "Cold Sea", "Ann Lee", "S"), (2, "z", "Cold Sea", "Bo Ray", "T"), (3, "x", "Dust", "Cy", "New"),
        (4, "n", "Elm", "Di", None), (5, "n", "Elm again", None, None), (6, None, "Fog", "Eve", None), (7, " ", "fog", "EVE", None), (8, None, "Fog", None, None),
    ]
    rows = spark.createDataFrame(rows, "row long, isbn string, title string, author string, series string")
    found = shelf.by_isbn(rows, books).unionByName(spark.createDataFrame([(1, 1), (2, 1)], "row long, id long"))
    out = {r.id: tuple(r)[1:] for r in shelf.find_or_create(books, rows, found).collect()}
    assert out[1] == ("y", "Cold Sea", "Ann Lee", "S")  # the first row's ISBN and series, the better spelling
    assert out[2] == ("x", "Dust", "Cy", "Old")
    assert {i: out[i][:2] for i in out if i > 2} == {6: ("n", "Elm"), 8: (None, "Fog"), 10: (None, "Fog")}
    empty = shelf.find_or_create(books.limit(0), rows.limit(0), found.limit(0))
    assert empty.count() == 0


def test_learned_isbns_are_free_and_single(spark):
    books = spark.createDataFrame([(1, None), (2, ""), (3, "t"), (4, None)], "id long, isbn string")
    offered = spark.createDataFrame([(1, "t", 1), (1, "u", 2), (1, "v", 3), (2, "u", 4), (3, "w", 5), (4, "", 6), (9, "q", 7)], "book_id long, isbn string, seq long")
    assert {r.id: r.isbn for r in shelf.learn_isbns(books, offered).collect()} == {1: "u", 2: "", 3: "t", 4: None}


def test_renaming_drops_links_and_cover(spark):
    books = spark.createDataFrame([(i, "T", "A", "c") for i in range(5)], "id long, title string, author string, cover string")
    renames = spark.createDataFrame([(0, " N ", None, 1), (1, "T", None, 1), (2, "T", " ", 1), (3, " ", "B", 1), (4, "X", None, 1), (4, "T", "A", 2)], "book_id long, title string, author string, seq long")
    out = shelf.rename_books(books, renames)
    assert sorted(map(tuple, out.collect())) == [(0, "N", "A", None, True), (1, "T", "A", "c", False), (2, "T", None, None, True), (3, "T", "A", "c", False), (4, "T", "A", None, True)]
    links = spark.createDataFrame([(i, "s") for i in range(5)], "book_id long, source string")
    assert {r.book_id for r in shelf.links_after_renaming(links, out).collect()} == {1, 3}  # 4 was renamed away and back


def test_unknown_outcome_is_an_error(spark):
    links = spark.createDataFrame([(1, "s", "linked")], "book_id long, source string, outcome string")
    with pytest.raises(Exception, match="unknown link outcome"):
        shelf.put_links(links, spark.createDataFrame([(1, "s", "likned", 1)], "book_id long, source string, outcome string, seq long")).collect()


def test_rejecting_and_restoring(spark):
    links = spark.createDataFrame([(1, "s", ["a"]), (2, "s", None), (3, "s", ["k"])], "book_id long, source string, rejected array<string>")
    rejections = [(1, "s", ["b", "a", "", None], False, 1), (2, "s", ["x"], False, 1), (2, "s", None, True, 2), (2, "s", ["y"], False, 3), (9, "s", ["z"], False, 1)]
    out = shelf.reject_candidates(links, spark.createDataFrame(rejections, "book_id long, source string, urls array<string>, restore boolean, seq long"))
    assert {r.book_id: r.rejected for r in out.collect()} == {1: ["a", "b"], 2: ["y"], 3: ["k"]}


def test_watch_state_keeps_the_time_of_the_change(spark):
    log = spark.createDataFrame([(1, True, 10, 1), (1, True, 20, 2), (2, True, 10, 1), (2, False, 20, 2), (2, False, 30, 3), (2, True, 40, 4), (2, True, 50, 5)], "series long, active boolean, at int, seq int")
    assert {tuple(r) for r in shelf.watch_state(log, "series").collect()} == {(1, True, 10), (2, True, 40)}


def test_watched_takes_pinned_remembered_and_found(spark):
    entries = spark.createDataFrame([(1, "s", "p"), (2, "s", None), (3, "s", None), (4, "s", ""), (5, "s", None)], "book_id long, source string, pinned string")
    links = spark.sql("select * from values (1L, 's', 'old', timestamp_ntz'2024-01-19'), (2L, 's', 'r', timestamp_ntz'2023-01-01'), (3L, 's', null, timestamp_ntz'2024-01-14'), (4L, 's', null, timestamp_ntz'2024-01-13') as t(book_id, source, url, resolved_at)")
    steps = {r.book_id: (r.step, r.url) for r in watching.linked_entries(entries, links, F.expr(NOW)).collect()}
    assert steps == {1: ("pinned", "p"), 2: ("remembered", "r"), 3: ("wait", None), 4: ("resolve", None), 5: ("resolve", None)}
    resolutions = spark.createDataFrame([(3, "s", "auto_accept", "n"), (4, "s", "auto_accept", "n"), (5, "s", "provisional", "m")], "book_id long, source string, confidence string, url string")
    checks = spark.createDataFrame([("s", u, c) for c, u in enumerate("prnm")], "source string, url string, price_cents int")
    assert {(r.book_id, r.url) for r in watching.watched(entries, links, resolutions, checks, F.expr(NOW)).collect()} == {(1, "p"), (2, "r"), (4, "n")}


def test_series_volumes_respect_what_was_said(spark):
    volumes = spark.createDataFrame([("s", i) for i in range(1, 7)], "series_id string, book_id long")
    said = [(1, "owned", True, None, None), (2, "watching", False, "s", True), (3, "watching", False, "s", False), (4, "watching", False, "other", True), (5, "liked", False, None, None)]
    relations = spark.createDataFrame(said, "book_id long, kind string, active boolean, series string, ended boolean")
    ids = [{r.book_id for r in watching.volumes_to_add(volumes, relations, revive).collect()} for revive in (False, True)]
    assert ids == [{5, 6}, {2, 5, 6}]


def test_swept_volumes(spark):
    found = spark.createDataFrame([("s", "1", "Roman", None, 300), ("s", "2", "Eine Kurzgeschichte", None, 300), ("s", None, "Roman", None, 300), ("t", "3", "Roman", None, 300), ("s", "4", "Roman", None, 20)], "series_id string, isbn string, title string, subtitle string, pages int")
    assert {r.isbn for r in watching.swept_volumes(found, spark.createDataFrame([("s",)], "series_id string")).collect()} == {"1"}


def test_maybe_volumes(spark):
    interests = spark.createDataFrame([("Lee, Ann", True, 1, 1), ("Ann Lee", True, 2, 2), ("Bo", False, 1, 3), ("Cy", True, None, 4), ("Di", True, 9, 5)], "value string, active boolean, series long, seq long")
    out = watching.maybe_volumes(interests, spark.createDataFrame([(1, "One"), (2, "Two")], "series_id long, name string"))
    assert [tuple(r) for r in out.collect()] == [("ann lee", 2, "Two")]


def test_best_source_of_a_kind(spark):
    states = [(1, "a", "library", "linked", 1), (1, "b", "library", "not_found", 2), (1, "c", "shop", "not_found", 3), (1, "d", "shop", "linked", 4), (2, "a", "library", "not_found", 1), (2, "c", "shop", "linked", 3), (2, "d", "shop", "not_found", 4)]
    states = spark.createDataFrame(states, "book_id long, source string, category string, outcome string, position int")
    latest = spark.createDataFrame([(1, "b", "available", None), (2, "c", None, None), (2, "d", None, 300)], "book_id long, source string, availability string, price_cents int")
    assert {(r.book_id, r.category): r.source for r in watching.best_sources(states, latest).collect()} == {(1, "library"): "b", (1, "shop"): "d", (2, "library"): None, (2, "shop"): "d"}


def _badness(name):
    return "," in name, -sum(c in T.ACCENTED for c in name), -len(name), name


def _spelled(kept, seen):
    if not (seen or "").strip():
        return kept
    if not (kept or "").strip():
        return seen.strip()
    return seen.strip() if PERSONS[kept] == PERSONS[seen] and _badness(seen.strip()) < _badness(kept) else kept


PERSONS = {"Lee, Ann": 1, "Ann Lee": 1, "Bo Ray": 2, "Ray, Bo": 2, "José Paz": 3, "Jose Paz": 3, " ": 0}


@pytest.mark.parametrize("seed", range(4))
def test_a_batch_is_its_rows_one_by_one(spark, seed):
    rng = random.Random(seed)
    author = lambda: rng.choice([None, *PERSONS])
    series = lambda: rng.choice([None, None, "S", "T"])
    books = [(k, rng.choice([None, f"i{k}"]), f"B{k}", author(), series()) for k in range(1, 8)]
    rows = [(k, f"i{rng.randint(1, 14)}", f"R{k}", author(), series()) for k in range(1, 50)]
    state = {b[0]: list(b[1:]) for b in books}
    for row, isbn, title, who, what in rows:
        at = next((i for i, b in state.items() if b[0] == isbn), None)
        if at is None:
            state[7 + row] = [isbn, title, who, what]
            continue
        state[at][2], state[at][3] = _spelled(state[at][2], who), what if state[at][3] is None else state[at][3]
    frames = [spark.createDataFrame(x, f"{key} long, isbn string, title string, author string, series string") for x, key in ((books, "id"), (rows, "row"))]
    out = shelf.find_or_create(*frames, shelf.by_isbn(frames[1], frames[0])).collect()
    assert {r.id: list(r)[1:] for r in out} == state and len(out) == len(state)


@pytest.mark.parametrize("seed", range(3))
def test_offered_isbns_one_by_one(spark, seed):
    rng = random.Random(seed)
    books = {k: rng.choice([None, None, "", f"i{k}"]) for k in range(30)}
    offers = [(rng.randrange(33), rng.choice(["", *(f"i{k}" for k in range(25))]), k) for k in range(150)]
    got = shelf.learn_isbns(spark.createDataFrame(list(books.items()), "id long, isbn string"), spark.createDataFrame(offers, "book_id long, isbn string, seq long"))
    state = dict(books)
    for book, isbn, _ in offers:
        if book in state and not state[book] and isbn and isbn not in state.values():
            state[book] = isbn
    assert {r.id: r.isbn for r in got.collect()} == state


def test_a_refused_offer_leaves_room_for_the_next(spark):
    books = spark.createDataFrame([(1, None), (2, None)], "id long, isbn string")
    offered = spark.createDataFrame([(1, "X", 1), (2, "X", 2), (2, "Y", 3)], "book_id long, isbn string, seq long")
    assert {r.id: r.isbn for r in shelf.learn_isbns(books, offered).collect()} == {1: "X", 2: "Y"}
    assert shelf.learn_isbns(books, offered.limit(0)).count() == 2


@pytest.mark.parametrize("seed", range(4))
def test_renames_one_by_one(spark, seed):
    rng = random.Random(seed)
    books = [(k, rng.choice("AB"), rng.choice([None, "P", "Q"]), "c") for k in range(25)]
    renames = [(rng.randrange(27), rng.choice(["A", " A", "B", " ", None]), rng.choice([None, None, "P", " ", "Q "]), k) for k in range(60)]
    state = {b[0]: [*b[1:], False] for b in books}
    for book, title, author, _ in renames:
        new = (title or "").strip()
        if not new or book not in state:
            continue
        b = state[book]
        if b[0] == new and (author is None or b[1] == author):
            continue
        state[book] = [new, b[1] if author is None else author.strip() or None, None, True]
    frames = spark.createDataFrame(books, "id long, title string, author string, cover string"), spark.createDataFrame(renames, "book_id long, title string, author string, seq long")
    assert {r.id: list(r)[1:] for r in shelf.rename_books(*frames).collect()} == state
