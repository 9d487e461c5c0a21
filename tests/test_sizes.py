"""What must not grow with the square of its input: rows and bytes that the steps of a plan make, and results against brute force."""

import itertools
import random
import re

from pyspark.sql import functions as F

from ledgerlark.functions import bags
from ledgerlark.operators import catalog, eligibility, matching, taste, watching
from ledgerlark.plans import catalog_queries, gate_queries

SF = "/root/testdata/sf0.001"
BOOK = "id long, title string, author string, year int, identifier string"


def made(df):
    """The rows of df, and the most rows and the most shuffled bytes that a step of its plan made."""
    found, rows, size, todo = df.collect(), 0, 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        for metric in ("numOutputRows", "dataSize"):
            value = node.metrics().get(metric)
            if value.isDefined() and metric == "dataSize" and name == "ShuffleExchangeExec":
                size = max(size, value.get().value())
            elif value.isDefined() and metric == "numOutputRows":
                rows = max(rows, value.get().value())
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return found, rows, size


def test_owned_editions_of_a_large_work(spark):
    works = spark.range(2000).select(F.format_string("%05d", "id").alias("isbn"), F.when(F.col("id") < 1900, "one").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"))
    works = works.union(spark.createDataFrame([("01901", "one"), (None, "one"), ("x", None)], "isbn string, key string"))
    owned = works.where("try_cast(isbn as int) % 3 <> 1 or isbn = 'x'").select("isbn")
    found, rows, _ = made(catalog.owned_as(works, owned))
    all_rows, have = works.collect(), {r.isbn for r in owned.collect()}
    want = {}
    for key in {r.key for r in all_rows} - {None}:
        isbns = {r.isbn for r in all_rows if r.key == key} - {None}
        for isbn in isbns:
            others = isbns & have - {isbn}
            if others:
                want[isbn] = min([min(others), *([want[isbn]] if isbn in want else [])])
    assert {r.isbn: r.owned_isbn for r in found} == want and len(found) == len(want)
    assert rows <= 2 * 2003


def test_facets_of_many_books(spark):
    """Whole lists of books are no key that rows are dealt by."""
    rng, threshold = random.Random(3), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    for n, most in ((6, 4), (40, 3), (3000, 4)):
        carriers = sorted({(f"f{rng.randrange(6)}", b) for b in range(n) for _ in range(rng.randrange(1, most + 1))} | {(f, b) for f in ("f7", "f8") for b in (0, 3)})
        found, _, size = made(taste.derive_facets(spark.createDataFrame([*carriers, carriers[0]], "family string, book long")))
        books = {f: frozenset(b for g, b in carriers if g == f) for f, _ in carriers}
        sets = {s for s in [*books.values(), *(x & y for x, y in itertools.combinations(books.values(), 2))] if len(s) >= 2}
        whole = {s: frozenset(f for f, b in books.items() if s <= b) for s in sets}
        valid = {(s, f) for s, f in whole.items() if len(f) >= 2}
        want = {(s, f) for s, f in valid if not any(s <= t and f <= g and (s, f) != (t, g) for t, g in valid)}
        assert {(frozenset(r.books), frozenset(r.families)) for r in found} == want and len(found) == len(want)
        assert all(r.books == sorted(r.books) and r.families == sorted(r.families) for r in found)
    spark.conf.set(threshold, before)
    assert size < 2_000_000


def test_titles_that_many_bear(spark):
    rng = random.Random(4)
    titles, authors = ["The Same"] * 9 + ["Other", " the same ", None], ["Ann", "ann ", "Bo", "", None]
    books, finds = ([(i, f"isbn:{k}{i}", rng.choice(titles), rng.choice(authors)) for i in range(400)] for k in "bf")
    entries = [(i, f"intake:{i}", rng.choice(titles), rng.choice(authors)) for i in range(600)]
    ratings = [(f"book:{i}", i % 5 + 1) for i in range(0, 400, 90)]
    portraits = [(s, rng.choice([None, 2, 4])) for s in {*(f"book:{i}" for i in range(0, 400, 37)), *(f"isbn:f{i}" for i in range(0, 400, 41)), *(f"intake:{i}" for i in range(0, 600, 7))}]
    frames = [spark.createDataFrame(rows, schema) for rows, schema in (
        (entries, "entry long, subject string, title string, author string"), (books, "id long, subject string, title string, author string"), (finds, "id long, subject string, title string, author string"),
        (ratings, "subject string, stars int"), (portraits, "subject string, stars int"))]
    found, rows, _ = made(watching.judged_titles(*frames))
    plain = lambda x: x.strip(" ").lower() if x is not None else None
    stars, shown, want = dict(ratings), dict(portraits), {}
    for entry, subject, title, author in entries:
        same = lambda r: title is not None and plain(r[2]) == plain(title) and (author is None or plain(author) == (plain(r[3]) or ""))  # noqa: E731, B023
        keys = [subject, *(f"book:{r[0]}" for r in books if same(r)), *(r[1] for r in finds if same(r))]
        own = next((stars[k] for k in keys[1:] if k in stars), None)
        first = next((k for k in keys if k in shown), None)
        said = shown.get(first)
        source = "present" if own is not None or said is not None else "unknown" if first else "missing"
        want[entry] = (source, None if own is not None else first, own if own is not None else said)
    assert {r.entry: (r.source, r.subject, r.stars) for r in found} == want
    assert {"present", "unknown", "missing"} == {v[0] for v in want.values()}
    assert rows <= 4 * 800


def test_exact_titles_that_many_bear(spark):
    rng = random.Random(5)
    some = ["Roter Bolzen", "Der rote Bolzen", "roter bolzen (Roman)", "Roter Bolzer", "Blau", "", None]
    q, c = ([(i, rng.choice(some), None, None, None) for i in range(n)] for n in (300, 400))
    asked, books = (spark.createDataFrame(rows, BOOK) for rows in (q, c))
    found, rows, _ = made(matching.exact_titles(asked, books))
    norms = [{r[0]: r[1] for r in matching.prepared(df, p).select(f"{p}id", f"{p}norm").collect()} for df, p in ((asked, "q"), (books, "c"))]
    want = {i: n for i, a in norms[0].items() if a and (n := sum(a == b for b in norms[1].values()))}
    assert {r.qid: r.exact for r in found} == want and len(found) == len(want)
    assert rows <= 1000


def test_matches_of_equal_rows(spark):
    """Texts with years and first ids give what all pairs of rows give, also ties."""
    rng = random.Random(6)
    titles = ["Night Song", "Night Songs", "Night Sing", "Nights Song", "Night Song Tower", "The Tower", "Night Song Band 2", "Night Songen", None, ""]
    people = ["Ann Lee", "Lee, Ann", "Ann Leed", "Bo Tan", "Ann Lea", None, ""]
    for years, marks, n in (([None, 1, 2], ["7", "8", "", None], 150), ([None, 1, 2], [None], 150), ([5], [None], 400)):
        q, c = ([(i, rng.choice(titles), rng.choice(people), rng.choice(years), rng.choice(marks)) for i in rng.sample(range(10 * n), n)] for _ in "qc")
        asked, books = (spark.createDataFrame(rows, BOOK) for rows in (q, c))
        want = matching.decided(asked, matching.scored(asked, books))
        found, rows, _ = made(matching.resolutions(asked, books))
        assert {r.qid: r for r in found} == {r.qid: r for r in want.collect()}
        assert len(found) == n and {r.confidence for r in found} >= {"no_match", "provisional"}
    assert rows <= 4 * n


def test_forms_are_made_once_for_each_title_author_and_name(spark, monkeypatch):
    """Many rows of few titles, authors and names: each distinct text is normalised once, and every row has its forms."""
    made_of = {name: spark.sparkContext.accumulator(0) for name in ("normalize_title", "split_authors")}
    plain = {name: getattr(matching.T, name) for name in made_of}

    def counted(name):
        def seen(text):
            made_of[name].add(1)
            return text

        return lambda text: plain[name](F.udf(seen, "string")(text))

    titles, people = ["Roter Bolzen", "Das Meer Band 2", "", None, "roter bolzen"], ["Ann Lee", "Tan, Bo; Ann Lee", "", None]
    rows = [(i, titles[i % 5], people[i % 4], 2000, None) for i in range(1000)]
    books = spark.createDataFrame(rows, BOOK)
    forms = matching.T.normalize_title(F.col("title")), matching.T.volume_of(F.col("title")), matching.T.title_tokens(F.col("title")), matching.T.looks_like_bundle(F.col("title"))
    want = {r[0]: r[1:] for r in books.select("id", *forms).collect()}
    recorded = spark.createDataFrame([(str(i % 300), i, ("Red Bolt – Roter Bolzen", "The Sea: A Novel", None)[i % 3]) for i in range(900)], "identifier string, ordinal int, name string")
    for name in made_of:
        monkeypatch.setattr(matching.T, name, counted(name))
    found = matching.prepared(books, "q").collect()
    assert {r.qid: (r.qnorm, r.qvolume, r.qtokens, r.qbundle) for r in found} == want and len(found) == 1000
    assert all([a["full"] for a in r.qpeople or []] == [[], ["ann lee"], ["bo tan", "ann lee"], [], []][(("Ann Lee", "Tan, Bo; Ann Lee", "", None).index(r.qauthor) + 1) % 5] for r in found)
    assert 0 < made_of["normalize_title"].value <= 4 * 5 and 0 < made_of["split_authors"].value <= 4 * 4
    asked = matching.written(matching.prepared(spark.createDataFrame([(0, "Red Bolt", "Ann Lee", None, None)], BOOK), "q"))
    editions = spark.createDataFrame([(i, "Ausgabe", "Ann Lee", None, str(i)) for i in range(300)], BOOK)
    editions = matching.written(matching.prepared(editions, "c"))
    before = made_of["normalize_title"].value
    hits = matching.named_alike(asked, editions, recorded).collect()
    assert sorted((r.cid, r.original) for r in hits) == [(i, "Red Bolt – Roter Bolzen") for i in range(0, 300, 3)]
    assert made_of["normalize_title"].value - before <= 4 * 6


def test_answers_are_dealt_by_row_not_by_term(spark):
    """Several answers of one subject are judged apart, equal ones each keep a row, and few terms make no large task."""
    trait = '{"id":"%s","satz":"s","beleg":"text","gewicht":"deutlich"}'
    answer = lambda *ids: '{"bekannt":true,"pitch":"p","form":"roman","merkmale":[' + ",".join(trait % i for i in ids) + '],"erzaehlmuster":[{"id":"p1","satz":"s","beleg":"wissen"}]}'
    good, short = answer("t1", "t2", "t3", "t4"), answer("t1", "t1", "t2")
    vocabulary = spark.createDataFrame([(f"t{i}", f"d{i % 3}", False) for i in range(1, 7)] + [("p1", "m", True)], "term string, dimension string, is_pattern boolean")
    rows = spark.createDataFrame([(1, good), (1, short), (2, good), (2, good), (3, None), (4, "{broken")], "subject long, answer string")
    found, _, _ = made(bags.answers(rows, vocabulary))
    few = ["2 traits, four to eight are asked for", "fewer than three dimensions", "twice: t1"]
    assert sorted((r.subject, r.known, r.violations) for r in found) == [(1, True, []), (1, True, few), (2, True, []), (2, True, []), (3, False, []), (4, False, [])]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_rows_are_dealt_by_number(spark):
    """Partitions follow the table's rows, and terms, families and forms, of which there are few, deal nothing."""
    assert eligibility.dealt(spark.range(1000), "id", each=100).rdd.getNumPartitions() == 10
    assert "hashpartitioning(term#" not in plan(catalog_queries.alg_overlap(spark, SF))
    assert "hashpartitioning(term#" not in plan(catalog_queries.win_waterfall(spark, SF))


def test_few_families_deal_nothing(spark):
    assert not re.search(r"hashpartitioning\(family#\d+, \d+\)", plan(gate_queries.alg_reasons(spark, SF)))


def test_pairs_of_a_nation_are_dealt_over_slots(spark):
    dealt = [line for line in plan(gate_queries.str_names_match(spark, SF)).splitlines() if "hashpartitioning(c_nationkey#" in line]
    assert dealt and all("slot#" in line for line in dealt)


def test_components_of_paths_and_stars(spark):
    """Long paths too: rounds grow with the logarithm of the nodes, not with the path."""
    rng = random.Random(8)
    order = rng.sample(range(1000), 60)
    edges = [*zip(order, order[1:]), *((i, i + 1) for i in range(2000, 2050)), *((3000, 3000 + i) for i in range(50)), (7, 7), (5001, 5000), (5000, 5001)]
    found = {r.node: r.component for r in catalog.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**dict.fromkeys(order, min(order)), **dict.fromkeys(range(2000, 2051), 2000), **dict.fromkeys(range(3000, 3050), 3000), 5000: 5000, 5001: 5000}
    assert found == want
    assert catalog.connected(spark.createDataFrame([(1, 1)], "a long, b long")).isEmpty()
