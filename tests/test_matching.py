"""Titles and names that meet by rare pieces, and editions found by their original titles, against all pairs."""

import random
import string
import time

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import fuzzy
from ledgerlark.operators import matching, similar

BOOK = "id long, title string, author string, year int, identifier string"


def ratio(a, b):
    return min(fuzzy.token_set_ratio(a, b), fuzzy.token_sort_ratio(a, b))


def spoiled(rng, text, most):
    out = list(text)
    for _ in range(rng.randrange(most + 1)):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randrange(2)] = rng.choice(["", "e", "s", " ", "ä", "𝔊"])
    return " ".join("".join(out).split())


def some_titles(rng, n):
    words = ["".join(rng.choice("aeiourstnlm") for _ in range(rng.randrange(1, 9))) for _ in range(40)] + ["band", "band", "x", "aaaa", "aaaaaa"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) for _ in range(n // 3)]
    base += [" ".join(rng.choice(words) for _ in range(rng.randrange(10, 30))) for _ in range(n // 20)]
    return sorted({*base, *(spoiled(rng, rng.choice(base), 5) for _ in range(n)), "a", "b", "ab", "aa", "ab ba", "ba ab"} - {""})


@pytest.mark.parametrize("seed", range(2))
def test_no_pair_is_lost(spark, seed):
    """All pairs of texts short, long and very alike: none that reaches the bound is missing."""
    texts = some_titles(random.Random(seed), 150)
    forms = sorted({" ".join(sorted(t.split())) for t in texts})
    rows = spark.createDataFrame([(t,) for t in forms], "text string")
    ratios = {(a, b): fuzzy.indel_ratio(a, b) for a in forms for b in forms}
    for least in (80, 84.5):
        found = {(r.l, r.r) for r in similar.candidate_pairs(rows, rows, least).collect()}
        want = {pair for pair, r in ratios.items() if r >= least}
        assert want <= found and len(want) > len(forms)
        assert len(found) <= 4 * len(want)


def test_odd_texts(spark):
    rows = spark.createDataFrame([("",), (None,), ("ab",), ("ab",), ("z" * 400,), ("z" * 399 + "y",)], "text string")
    found = sorted((r.l[:2], r.r[:2]) for r in similar.candidate_pairs(rows, rows, 90).collect())
    assert found == [("ab", "ab"), *[("zz", "zz")] * 4]
    assert similar.candidate_pairs(rows.limit(0), rows, 90).isEmpty()
    with pytest.raises(ValueError):
        similar.candidate_pairs(rows, rows, 70)


def test_similar_titles_without_a_common_token(spark):
    """Every pair of titles that is similar or contained is found, with no condition on tokens."""
    rng = random.Random(7)
    titles = [t for t in some_titles(rng, 120)] + ["Schattenlicht", "Schattenlichts", "", "Der"]
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(titles)], BOOK)
    q, c = matching.prepared(rows, "q"), matching.prepared(rows, "c")
    found = [(r.qtitle, r.ctitle, r.title_score, r.title_contained) for r in matching.similar_titles(q, c).collect()]
    forms = {r.qtitle: (r.qnorm, r.qtokens) for r in q.collect()}
    want = set()
    for a, (x, xs) in forms.items():
        for b, (y, ys) in forms.items():
            score, contained = round(ratio(x, y)), len(xs) > 0 and len(ys) > len(xs) and not set(xs) - set(ys)
            if x and y and (score >= matching.NO_MATCH_BELOW or contained):
                want.add((a, b, score, contained))
    assert len(found) == len(set(found)) and set(found) == want
    assert ("Schattenlicht", "Schattenlichts", 96, False) in want


def test_many_distinct_titles(spark):
    """20,000 distinct titles, half of them a slip away from another: candidates are few, common words make no block."""
    rng = random.Random(11)
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randrange(4, 10))) for _ in range(4000)]
    base = sorted({"book " + " ".join(rng.choice(words) for _ in range(2)) for _ in range(10_000)})
    texts = sorted({" ".join(sorted(t.split())) for t in [*base, *(spoiled(rng, t, 2) for t in base)]})
    rows = similar.written(spark.createDataFrame([(t,) for t in texts], "text string"))
    start = time.time()
    candidates = similar.written(similar.candidate_pairs(rows, rows, matching.LEAST_RATIO))
    found = candidates.where(fuzzy.title_similarity("l", "r") >= 85).count()
    assert len(texts) > 15_000 and found > len(texts)
    assert candidates.count() <= 10 * found
    print(len(texts), candidates.count(), found, time.time() - start)


ASKED = [
    (0, "Scythe", "Shusterman, Neal", None, None), (1, "Scythe", None, None, None), (2, "Scythe", "Anna Meier", None, None), (3, "Dark Matter", "Blake Crouch", None, None),
    (4, "Die Hüter des Todes", "Neal Shusterman", None, None), (5, "Thunderheed", "Neal Shusterman", None, None), (6, "Toll", "Neal Shusterman", None, "9"),
    (7, "", "Neal Shusterman", None, None), (8, None, None, None, None), (9, "Winter Night", "Kim Otto", None, None), (10, "Scythe 2", "Neal Shusterman", None, None),
]
EDITIONS = [
    (0, "Die Hüter des Todes", "Neal Shusterman", 2017, "1"), (1, "Der Zorn der Gerechten", "Neal Shusterman", 2018, "2"), (2, "Das Vermächtnis der Ältesten", "Neal Shusterman", 2019, "3"),
    (3, "Die Hüter des Todes", "Neal Shusterman", None, "1"), (4, "Der Zeitenläufer", "Blake Crouch", None, "4"), (5, "Schwarze Materie", "Blake Crouch", None, "5"),
    (6, "Hüter 2", "Neal Shusterman", None, "6"), (7, "Eisnacht", "Otto, Kim", None, None), (8, "Frostnacht", "Kim M. Otto", None, "8"), (9, "Ohne Person", None, None, "1"),
]
NAMES = [
    ("1", 0, "Arc of a Scythe"), ("1", 1, "Scythe – Die Hüter des Todes"), ("2", 0, "Thunderhead"), ("3", 0, "The Toll: Ende"), ("4", 0, "Dark Matter"), ("5", 0, "Dark Matter: Roman"),
    ("6", 0, "Scythe"), ("8", 0, "Winter Night"), ("8", 1, None), ("", 0, "Scythe"), (None, 0, "Scythe"), ("77", 0, "Scythe"), ("1", 2, "Scythe Band 2"),
]


def replayed(spark, asked, editions, names, found):
    """Each open query against each edition and each of its names, one by one."""
    import re

    q = {r.qid: r for r in matching.prepared(spark.createDataFrame(asked, BOOK), "q").collect()}
    c = {r.cid: r for r in matching.prepared(spark.createDataFrame(editions, BOOK), "c").collect()}
    parts = [(i, p.strip()) for i, o, n in sorted((x for x in names if x[0] and x[2]), key=lambda x: (x[0], x[1])) for p in (n, *re.split(matching.NAME_PARTS, n))]
    forms = spark.createDataFrame([(k, p, None, None, i) for k, (i, p) in enumerate(parts)], BOOK)
    named = sorted(matching.prepared(forms, "n").collect(), key=lambda r: r.nid)
    other = lambda a, b: a != b if a is not None and b is not None else b is not None and b > 1
    hits = {}
    for row in found:
        ours = q[row.qid]
        if row.confidence == "auto_accept" or (row.title_score or 0) >= 85 or not ours.qauthor or not ours.qnorm:
            continue
        for theirs in c.values():
            if not theirs.cidentifier or other(ours.qvolume, theirs.cvolume) or not any(ratio(a["full"], b["full"]) >= 90 for a in ours.qpeople for b in theirs.cpeople):
                continue
            best = (0, None)
            for n in named:
                if n.nidentifier == theirs.cidentifier and not other(ours.qvolume, n.nvolume):
                    score = round(ratio(ours.qnorm, n.nnorm))
                    best = (score, n.ntitle) if score > best[0] else best
            if best[0] >= 85:
                hits[row.qid, theirs.cid] = (best[1], best[0])
    return hits


def test_original_titles(spark):
    asked, editions, names = spark.createDataFrame(ASKED, BOOK), spark.createDataFrame(EDITIONS, BOOK), spark.createDataFrame(NAMES, "identifier string, ordinal int, name string")
    before = matching.written(matching.resolutions(asked, editions))
    after = {r.qid: r for r in matching.by_original_title(asked, editions, names, before).collect()}
    assert sorted(after) == list(range(11))
    level = {k: (r.confidence, r.cid, r.original) for k, r in after.items()}
    assert level[0][0] == "auto_accept" and level[0][1] in (0, 3) and level[0][2] == "Scythe – Die Hüter des Todes"
    assert level[1][0] == level[2][0] == level[7][0] == level[8][0] == "no_match" and level[1][2] is None
    assert level[3][0] == "provisional" and after[3].original_books == 2
    assert level[4][2] is None
    assert level[5] == ("provisional", 1, "Thunderhead")
    assert level[6][0] == "provisional" and after[6].original_score == 100 and after[6].id_conflict
    assert level[9][2] is None
    empty = matching.by_original_title(asked, editions, names.limit(0), before)
    assert sorted((r.qid, r.confidence) for r in empty.collect()) == sorted((r.qid, r.confidence) for r in before.collect())


def test_original_titles_against_all_pairs(spark):
    rng = random.Random(5)
    people = [f"{a} {b}" for a in ("Anna", "Kim", "Jo") for b in ("Meier", "Maier", "Otto", "Sand")] + [None, "Meier, Anna; Otto, Kim"]
    titles = [t for t in some_titles(rng, 60)]
    asked = ASKED + [(20 + i, rng.choice(titles), rng.choice(people), None, rng.choice([None, "3"])) for i in range(60)]
    editions = EDITIONS + [(20 + i, f"Ausgabe {i}x", rng.choice(people), rng.choice([None, 2000]), rng.choice([None, "", *map(str, range(10, 40))])) for i in range(80)]
    names = NAMES + [(str(rng.randrange(10, 40)), 10 + i, " – ".join(spoiled(rng, rng.choice(titles), 2) or "x" for _ in range(rng.randrange(1, 3)))) for i in range(80)]
    q, c, n = spark.createDataFrame(asked, BOOK), spark.createDataFrame(editions, BOOK), spark.createDataFrame(names, "identifier string, ordinal int, name string")
    found = matching.written(matching.resolutions(q, c))
    want = replayed(spark, asked, editions, names, found.collect())
    still = found.where("confidence <> 'auto_accept' and coalesce(title_score, 0) < 85").select("qid")
    hits = matching.named_alike(matching.prepared(q, "q").join(still, "qid", "left_semi"), matching.prepared(c, "c"), n).collect()
    assert {(r.qid, r.cid): (r.original, r.original_score) for r in hits} == want and len(want) > 20
    after = {r.qid: r for r in matching.by_original_title(q, c, n, found).collect()}
    identifiers = {e[0]: e[4] for e in editions}
    for qid, row in after.items():
        books = {identifiers[cid] for k, cid in want if k == qid}
        assert (row.original_books or 0) == len(books)
        if books:
            sure = len(books) == 1 and row.original_score >= 95 and not row.id_conflict
            assert row.confidence == ("auto_accept" if sure else "provisional") and want[qid, row.cid] == (row.original, row.original_score)
