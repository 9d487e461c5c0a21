"""Each operator against a plain version, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlark.llm import (
    byte_bpe, chat_format, components, embedding_dedup, line_dedup, ngram_jaccard, packing, quality_rules, substring_dedup, text_arrays, token_counts, url_filters,
)
from ledgerlark.llm.queries import URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def docs(spark, texts, **more):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOC)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=3):
    rng = random.Random(seed)
    texts = [None, "", "  \n\t ", "one two", "one two", "One  TWO", "a b c d e", "é ü\x0bß", "x" * 5000, prose(rng, 3000)]
    for _ in range(25):
        base = prose(rng, rng.randrange(6, 120), 10**6)
        texts.append(base)
        for _ in range(rng.randrange(4)):
            words = base.split()
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = f"n{rng.random()}"
            texts.append(" ".join(words))
    passage = prose(rng, 60, 10**6)
    texts += [f"{prose(rng, 20, 10**6)} {passage} {prose(rng, 15, 10**6)}" for _ in range(12)]
    return texts


# --- components ---


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(1000, 1040)] + [(1, 1), (None, 2)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in found} == {x: root(x) for x in list(parent)} and len(found) == len(parent)


# --- op 10 ---


def shingles(text, width=5):
    words = WORD.findall(lower(text))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def jaccard_components(rows, percent=80):
    sets, parent = [(i, shingles(t)) for i, t in rows if i is not None], {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(sets):
        root(a)
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted(((i, len(shingles(t)), root(i) if i is not None else None) for i, t in rows), key=repr)


def test_jaccard(spark):
    rows = [*enumerate(corpus()), (None, "one two"), (3, "a b c d e"), (7, corpus()[12])]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in rows], "doc_id long, text string, sig int, rep int, id int, hub int, n int")
    found = ngram_jaccard.ngram_jaccard_components(df)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == jaccard_components(rows)
    assert ngram_jaccard.ngram_jaccard_components(df.limit(0)).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(0)
    bands = ngram_jaccard.Bands(80)
    for _ in range(400):
        size = int(rng.integers(1, 90))
        a = rng.choice(2**62, size, replace=False).astype(np.uint64)
        change = int(size * 0.11)
        b = np.concatenate([a[change:], rng.choice(2**62, change, replace=False).astype(np.uint64)]) if rng.random() < 0.5 else a[: max(1, -(-size * 4 // 5))]
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common) and set(a) != set(b):
            x, y = (set(np.concatenate(ngram_jaccard.signatures(np.sort(s), bands)).tolist()) for s in (a, b))
            assert x & y


# --- op 9 ---


def plain_links(rows, threshold=0.95):
    unit = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            unit[k] = x / np.linalg.norm(x)
    links = defaultdict(set)
    for a in unit:
        for b in unit:
            if a < b and len(unit[a]) == len(unit[b]) and rows[a][0] is not None and rows[b][0] is not None and unit[a] @ unit[b] >= threshold - 1e-15:
                links[a].add(b)
                links[b].add(a)
    label = {i: i for i, _ in rows if i is not None}
    while True:
        before = dict(label)
        for a in links:
            for b in links[a]:
                m = min(label[rows[a][0]], label[rows[b][0]])
                label[rows[a][0]] = label[rows[b][0]] = m
        if before == label:
            break
    return sorted(((i, len(links[k]), label.get(i), i is not None and label[i] == i) for k, (i, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("block_rows", [8192, 20])
def test_embeddings(spark, block_rows):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(12):
        centre = rng.normal(size=16)
        rows += [(centre + rng.normal(size=16) * s).astype(np.float32).tolist() for s in rng.uniform(0, 0.35, rng.integers(1, 9))]
    rows += [rows[0], rows[0], [2 * x for x in rows[1]], None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] * 16, [1.0, 0.0], [1.0, 0.01]]
    rows = [*enumerate(rows), (None, rows[0]), (4, rows[2])]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, rep int, k1 int")
    found = embedding_dedup.embedding_near_duplicates(df, block_rows=block_rows, tile=7)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_links(rows)
    assert embedding_dedup.embedding_near_duplicates(df.limit(0)).count() == 0


def test_quantised_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, scale, length, error = embedding_dedup.quantise(x)
    near = (codes.astype(float) @ codes.T.astype(float)) * np.outer(scale, scale)
    bound = np.outer(length, error) + np.outer(error, length) + np.outer(error, error)
    assert (np.abs(near - x @ x.T) <= bound).all()


# --- op 5 ---


def plain_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_quality_statistics(spark):
    texts = [*corpus(), "a b c a b c\n\na b c\na b c", "# $ %\n# $ %\r\n# $ %", "\n\n", "ü*ö\n ü*ö\nü*ö"]
    df = docs(spark, texts).withColumn("x", F.lit(1)).withColumn("stratum", F.lit(2))
    found = {r.doc_id: r for r in quality_rules.quality_verdicts(df).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        r, want = found[i], plain_statistics(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    assert quality_rules.quality_verdicts(df.limit(0)).count() == 0


def test_quality_outliers(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randrange(60, 400)) for _ in range(150)]
    junk = ["### " + " | ".join(f"w{rng.randrange(300)}" for _ in range(120)) for _ in range(6)]
    rows = [(i, t, None if i % 2 else "de", None, 0) for i, t in enumerate(texts + junk)]
    kept = {r.doc_id: r.kept for r in quality_rules.quality_verdicts(spark.createDataFrame(rows, DOC)).collect()}
    assert all(kept[i] for i in range(150)) and not any(kept[i] for i in range(150, 156))


def plain_determinants(x, part=0.75):
    """For every start of a stratum, the log determinants step by step, and the centre and inverse of the best in the end."""
    floors, p = np.square(quality_rules.FLOORS), x.shape[1]
    low = lambda v, q: np.sort(v)[max(int(np.ceil(q * len(v))), 1) - 1]
    middle = np.array([low(x[:, i], 0.5) for i in range(p)])
    spread = np.array([1.4826 * low(np.abs(x[:, i] - middle[i]), 0.5) + quality_rules.FLOORS[i] / 4 for i in range(p)])
    unit = (x - middle) / spread
    length = np.linalg.norm(unit, axis=1, keepdims=True)
    unit = np.divide(unit, length, out=np.zeros_like(unit), where=length > 0)
    covariance = lambda v: (v - v.mean(axis=0)).T @ (v - v.mean(axis=0)) / len(v)
    starts = {"middle": (middle, np.diag(spread**2)), "all": (x.mean(axis=0), covariance(x)), "signs": (middle, p * unit.T @ unit / len(x) * np.outer(spread, spread))}
    paths, ends = {}, {}
    for name, (centre, cov) in starts.items():
        path = []
        for _ in range(10):
            gap = x - centre
            d2 = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov + np.diag(floors)), gap)
            inside = x[d2 <= low(d2, part)]
            centre, cov = inside.mean(axis=0), covariance(inside)
            path.append(np.linalg.slogdet(cov + np.diag(floors))[1])
        paths[name], ends[name] = path, (centre, np.linalg.inv(cov + np.diag(floors)))
    best = min(paths, key=lambda s: (paths[s][1], s))
    return paths, ends[best], paths[best][-1]


def test_least_determinants(spark):
    """Strata of one, few and many rows, ties and a share of outliers, against a plain version."""
    rng = np.random.default_rng(4)
    strata = {
        "one": rng.normal(size=(1, 5)), "four": rng.normal(size=(4, 5)), "alike": np.tile(rng.normal(size=5), (30, 1)),
        "far": np.concatenate([rng.normal(size=(180, 5)) * 0.4, rng.normal(6, 1, size=(30, 5))]), "two": np.concatenate([rng.normal(size=(60, 5)), rng.normal(3, 0.1, size=(50, 5))]),
    }
    rows = spark.createDataFrame([(k, r.tolist(), i) for k, v in strata.items() for i, r in enumerate(v)], "stratum string, x array<double>, i long")
    found = {r.stratum: r for r in quality_rules.least_determinants(rows, part=0.75, steps=8).collect()}
    assert found.keys() == strata.keys()
    for name, x in strata.items():
        paths, (centre, inverse), least = plain_determinants(x)
        assert all(b <= a + 1e-9 for path in paths.values() for a, b in zip(path, path[1:]))  # a step never raises the determinant
        assert np.allclose(found[name].logdet, least, atol=1e-6) and np.allclose(found[name].centre, centre, atol=1e-6) and np.allclose(np.reshape(found[name].inverse, (5, 5)), inverse, atol=1e-4)
    far = {r.i: r.d2 for r in quality_rules.robust_distances(rows.where("stratum = 'far'"), part=0.75, steps=8).collect()}
    assert max(far[i] for i in range(180)) < min(far[i] for i in range(180, 210))


# --- op 6 and op 8 ---


def lined_corpus(seed=9):
    rng = random.Random(seed)
    shared = ["\n".join(prose(rng, rng.randrange(3, 60), 10**6) for _ in range(rng.randrange(2, 9))) for _ in range(4)]
    texts = [None, "", "\n", "\n\n\n", "one line", "One LINE here and there", "one  line here and there", shared[0], shared[0]]
    for _ in range(40):
        parts = [prose(rng, rng.randrange(1, 30), 10**6) for _ in range(rng.randrange(6))] + rng.sample(shared, rng.randrange(3))
        rng.shuffle(parts)
        texts.append(rng.choice(["\n", "\n\n"]).join(parts) + rng.choice(["", "\n"]))
    return texts + ["x\n" * 500, texts[-1]]


def plain_units(rows, spans_of, key_of):
    seen, out = set(), []
    for i, text in rows:
        if text is None or i is None:
            out.append((i, text))
            continue
        kept = ""
        for a, b in spans_of(text):
            key = key_of(text[a:b])
            if key is not None and key in seen:
                continue
            seen.add(key)
            kept += text[a:b]
        out.append((i, kept))
    return sorted(out, key=repr)


def plain_passages(rows, least=50):
    """Without the words of each run of ``least`` words that begins earlier too; words go with the white space after them."""
    seen, out = set(), []
    for i, text in rows:
        if text is None or i is None:
            out.append((i, text))
            continue
        parts = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
        words, gone = WORD.findall(lower(text)), set()
        for k in range(len(words) - least + 1):
            run = tuple(words[k : k + least])
            if run in seen:
                gone.update(range(k, k + least))
            seen.add(run)
        head = text[: len(text) - sum(map(len, parts))]
        out.append((i, head + "".join(p for k, p in enumerate(parts) if k not in gone)))
    return sorted(out, key=repr)


def passage_corpus(seed=4):
    """Passages of 20 to 120 words inside other lines, wrapped anew, in capitals, edited, repeated inside a text and word by word."""
    rng = random.Random(seed)
    passages = [prose(rng, n, 10**6) for n in (20, 49, 50, 51, 60, 75, 90, 120)]
    texts = [None, "", "\n \n", "a b c", "spam " * 300, "Spam\n" * 70, "x y z " * 60, passages[3]]
    for k in range(60):
        parts = [prose(rng, rng.randrange(40), 10**6)]
        for p in rng.sample(passages, rng.randrange(1, 4)):
            words = p.split()
            if k % 5 == 0:
                words[rng.randrange(len(words))] = "edited"
            p = "".join(w + rng.choice([" ", " ", "\n", "\t \r\n"]) for w in words) if k % 3 else " ".join(words)
            parts += [p.upper() if k % 4 == 0 else p, prose(rng, rng.randrange(40), 10**6)]
        texts.append(rng.choice([" ", "\n"]).join(parts))
    whole = prose(rng, 400, 10**6)
    return [*texts, whole, whole, " ".join(["n", *whole.split()[7:130], "m", *whole.split()[90:320]]), f"{passages[7]} {passages[7]} {passages[7]}", prose(rng, 30_000, 10**6) + " " + passages[6]]


def test_substring_dedup(spark):
    rows = [*enumerate(passage_corpus()), (None, passage_corpus()[-2]), (10**6, "äöü " * 49 + "äöü")]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, id int, part int, gone int").repartition(5)
    found = substring_dedup.substring_dedup(df).collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=repr) == plain_passages(rows)
    originals = dict(rows)
    for r in found:  # the spans and what is left make up the original
        assert (r.id, r.part, r.gone) == (1, 2, 3)
        if r.text is not None:
            left, at = "", 0
            for s in r.removed_spans:
                left, at = left + originals[r.doc_id][at : s.start], s.end
            assert left + originals[r.doc_id][at:] == r.text
    assert substring_dedup.substring_dedup(df.limit(0)).count() == 0


def test_shorter_passages(spark):
    rows = [*enumerate(passage_corpus(8))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.substring_dedup(df, least_words=20, line_words=5).collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=repr) == plain_passages(rows, 20)


def test_many_copies_are_dealt(spark, monkeypatch):
    """Hot digests take the other join, and their copies are compared in several slots."""
    from ledgerlark.llm import units

    monkeypatch.setattr(units, "SLOT_ROWS", 100)
    rng = random.Random(6)
    passage = prose(rng, 60, 10**6)
    rows = [(i, f"{prose(rng, 5, 10**6)} {passage} {i}") for i in range(700)]
    found = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=repr) == plain_passages(rows)
    lined = [(i, t.replace(" ", "\n")) for i, t in rows]
    found = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(lined, "doc_id long, text string")).collect()}
    assert all(len(found[i].split()) < 25 for i in range(1, 700)) and found[0] == lined[0][1]


@pytest.mark.parametrize("dedup", [substring_dedup.substring_dedup, line_dedup.line_dedup])
def test_rows_that_share_an_id(spark, dedup):
    """One row's parts don't go from the others of its id, and of rows equal in id and text one stays."""
    rng = random.Random(12)
    a, b, c = ("\n".join(prose(rng, 30, 10**6) for _ in range(2)) + "\n" for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (2, None), (2, ""), (3, c), (3, c), (3, c), (None, a), (None, a)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, id int").repartition(3)
    found = [(r.doc_id, r.text) for r in dedup(df).collect()]
    assert sorted(found, key=repr) == sorted([(1, a), (2, ""), (2, b), (2, None), (2, ""), (3, c), (3, ""), (3, ""), (None, a), (None, a)], key=repr)


def test_line_dedup(spark):
    rows = [*enumerate(lined_corpus()), (None, "a\nb\nc\nd")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, d1 int, slot int")
    found = line_dedup.line_dedup(df).collect()

    def key(chunk):
        chunk = chunk.removesuffix("\n")
        return chunk if "\n" in chunk else None

    assert sorted(((r.doc_id, r.text) for r in found), key=repr) == plain_units(rows, lambda t: line_dedup.chunk_spans(t, (2, 2)), key)
    seen = []
    for r in sorted((r for r in found if r.doc_id is not None), key=lambda r: r.doc_id):  # whatever the chunks are: what goes are whole lines that stand before
        text = dict(rows)[r.doc_id]
        for s in r.removed_spans:
            chunk = "\n" + text[s.start : s.end].removesuffix("\n") + "\n"
            assert chunk.count("\n") > 2 and (s.start == 0 or text[s.start - 1] == "\n")
            assert any(chunk in "\n" + t + "\n" for t in seen) or chunk in "\n" + text[: s.start]
        seen.append(text or "")
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_chunk_bounds_shift_with_the_lines():
    rng = np.random.default_rng(3)
    lines = rng.integers(0, 2**63, 200).astype(np.uint64)
    more = np.concatenate([rng.integers(0, 2**63, 3).astype(np.uint64), lines])

    def chunks(hashes):
        bounds = line_dedup.chunk_bounds(hashes, (2, 2)).tolist()
        return {tuple(hashes[a:b]) for a, b in zip(bounds, [*bounds[1:], len(hashes)])}

    base, moved = chunks(lines), chunks(more)
    assert len(base & moved) >= len(base) - 2


def test_no_chunk_of_a_single_line():
    rng = np.random.default_rng(4)
    for n in (*range(2, 80), 129, 193, 500):
        for hashes in (rng.integers(0, 2**63, n).astype(np.uint64), np.full(n, rng.integers(2**63), np.uint64)):
            for shape in ((2, 2), (1, 2), (3, 4)):
                assert np.diff([*line_dedup.chunk_bounds(hashes, shape), n]).min() >= 2


def test_shared_runs_of_lines_go(spark):
    """Of passages of ten lines inside different texts most lines go; a long run of lines needs no boundary in it."""
    rng = random.Random(13)
    passage = [prose(rng, 5, 10**6) for _ in range(10)]
    texts = ["\n".join([*(prose(rng, 5, 10**6) for _ in range(rng.randrange(1, 9))), *passage, *(prose(rng, 5, 10**6) for _ in range(rng.randrange(1, 9)))]) for _ in range(40)]
    found = line_dedup.line_dedup(docs(spark, [*texts, "x\n" * 3000, "x\n" * 3000])).collect()
    left = [sum(line in r.text.split("\n") for line in passage) for r in found if 0 < r.doc_id < 40]
    assert sum(left) < 0.5 * 10 * 39
    assert {r.doc_id: r.text for r in found}[41] == ""


def test_copies_go_wholly(spark):
    """Every copy of a text of two lines and more goes, wherever its chunks end."""
    rng = random.Random(11)
    texts = ["\n".join(prose(rng, 5, 10**6) for _ in range(n)) for n in range(2, 22)]
    found = line_dedup.line_dedup(docs(spark, [*texts, *texts])).collect()
    assert {r.doc_id: r.text for r in found} == dict(enumerate([*texts, *[""] * len(texts)]))


# --- tokenizers: op 1, op 2, op 4 ---

ODD = [
    None, "", " ", "\n\n  x", "it's we'll 'tis ''s don't've", "<|endoftext|>a <|startoftext|> b<|endoftext|>", "Ⅷ½ ٣ 中文字", "ΑΣ ΟΔΟΣ İ", "e\u0301 u\u0308", "a" * 3000, "=" * 500,
    "tab\there  \r\n end \u00a0\u2003", "🙂🙃" * 50, "".join(random.Random(1).choice("abcdef") for _ in range(900)),
]


def test_token_counts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ODD + corpus()
    df = docs(spark, texts).withColumn("n_tokens", F.lit("x"))
    found = {r.doc_id: r for r in token_counts.token_counts(df, path).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (found[i].n_bytes, found[i].n_tokens, found[i].over_limit) == (len((t or "").encode()), n, n > 2048), t
    assert token_counts.token_counts(df.limit(0), path).count() == 0


def test_merged_length_counts_merges():
    ranks = {("a", "b"): 0, ("ab", "a"): 1, ("b", "a"): 2}
    assert token_counts.merged_length(list("ababa"), ranks) == 2  # ab aba
    assert token_counts.merged_length([], ranks) == 0 and token_counts.merged_length(["a"], ranks) == 1


def test_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ODD + corpus()
    df = docs(spark, texts).withColumn("ids", F.lit(1))
    for r in byte_bpe.round_trip(df, path).collect():
        ids, data = library.encode_ordinary(texts[r.doc_id] or ""), (texts[r.doc_id] or "").encode()
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(data).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(df.drop("ids"), path), path).collect()
    assert all(bytes(r.bytes) == (texts[r.doc_id] or "").encode() for r in back) and len(back) == len(texts)
    assert byte_bpe.round_trip(df.limit(0), path).count() == 0


def test_long_words():
    """Words that take many places at once, against the library's merges of one piece."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    words = ["a" * 100_000, "aab" * 10_000, "ab" * 700, "=" * 777, "-" * 131, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10_000)), "".join(rng.choice("éüßaeth") for _ in range(2_000))]
    for _ in range(60):
        letters = rng.choice(["ab", "abc", "aeiou", "etaoinsh", "=-", "ACGT", "the"])
        words.append("".join(rng.choice(letters) * rng.choice([1, 1, 1, 2, 3, 7]) for _ in range(rng.randrange(60, 300))))
    counts, flat = byte_bpe.Codec(path).encode([w.encode() for w in words])
    for w, ids in zip(words, np.split(flat, np.cumsum(counts)[:-1])):
        assert ids.tolist() == library.encode_ordinary(w), w[:80]


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ODD + corpus()
    df = docs(spark, texts).withColumn("pack", F.lit(1)).withColumn("id", F.lit(2))
    found = packing.best_fit_packing(df, path, group_rows=30).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids, at = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and (r.piece == 0 or r.length == 1024)
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.best_fit_packing(df.limit(0), path).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    tokens = np.random.default_rng(0).integers(1, 300, 500)
    where, offset = packing.best_fit(tokens, (1024, 6, 200_000), (1.0, 0.2, 0.5), rule)
    for s in np.unique(where):
        own = tokens[where == s]
        assert own.sum() <= 1024 and len(own) <= 6 and np.square(own).sum() <= 200_000
        assert sorted(offset[where == s]) == [0, *np.cumsum(own[np.argsort(offset[where == s])])[:-1]]
    loose, _ = packing.best_fit(tokens, (1024, 1024, 1024**2), (1.0, 1e-3, 1e-3), "norm")
    assert len(np.unique(loose)) <= -(-tokens.sum() // 1024) + 1


def test_packing_deals_rows_without_id_over_groups(spark):
    rows = [(None, 0, 5)] * 300 + [(7, 0, 5)] * 300
    packed = packing.pack_pieces(spark.createDataFrame(rows, "id long, piece int, length long"), tokens=64, group_rows=60).collect()
    groups = Counter(r.sequence_id >> 32 for r in packed)
    assert len(packed) == 600 and len(groups) == 10 and max(groups.values()) < 120
    assert max(Counter(r.sequence_id for r in packed).values()) == 12


def test_packed_sequences(spark):
    pieces = packing.token_pieces(docs(spark, ["one two", "three", None]), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)
    row = packing.packed_sequences(packing.pack_pieces(pieces, tokens=64)).first()
    assert sorted(row.document_ids) == [0, 1, 2] and row.ids.count(2) == 3 and sum(row.lengths) == len(row.ids)


# --- op 7 ---


def test_url_parts_and_rules(spark):
    urls = [
        (1, "http://A.Example.ORG/es/x?y#z"), (2, "https://m.example.org/en/12"), (3, "http://other.org/p"), (4, "http://x.com/fr/1"), (5, "http://com/de/"), (6, "http://notcom/de/"), (7, None), (8, "nothing"),
        (9, "http://x.org"), (10, "a://b://c/d"), (11, "http://x.org?/"), (11, "http://x.org?/"),
    ]
    df = spark.createDataFrame([(i, u, 1, 2) for i, u in urls], "page_id long, url string, host int, grams int")
    found = {r.page_id: r for r in url_filters.url_verdicts(df, URL_RULES).collect()}
    assert [(found[i].host, found[i].path, found[i].rule) for i in (1, 2, 3, 4, 5)] == [
        ("a.example.org", "/es/x", "example.org/es/"), ("m.example.org", "/en/12", "example.org/en/1"), ("other.org", "/p", "org/"), ("x.com", "/fr/1", "com/fr/"), ("com", "/de/", "com/de/"),
    ]
    assert [found[i].verdict for i in (1, 2, 3, 4, 5)] == ["block", "block", "allow", "allow", "block"]
    assert [(found[i].host, found[i].path, found[i].rule) for i in (6, 7, 8, 9, 10, 11)] == [("notcom", "/de/", None), ("", "", None), ("", "", None), ("x.org", "", None), ("b:", "//c/d", None), ("x.org", "", None)]
    assert url_filters.url_verdicts(df.limit(0), URL_RULES).count() == 0


def test_url_model_on_held_out_names(spark):
    """A quarter of the names is held out of training."""
    labelled = url_filters.labelled_urls(spark)
    held = F.pmod(F.xxhash64("name"), F.lit(4)) == 0
    rows = labelled.where(held)
    scored = url_filters.url_verdicts(rows.select(F.col("url").alias("page_id"), "url"), (), labelled.where(~held)).join(rows.select(F.col("url").alias("page_id"), "label"), "page_id")
    right = scored.agg(F.avg((F.col("verdict") == F.when(F.col("label") == 1, "block").otherwise("allow")).cast("double"))).first()[0]
    assert right >= 0.75


def test_labelled_table_is_not_made_of_the_test_hosts(spark):
    """No word of a junk host of the test pages, none of their prefixes, domains and paths; and a column to hold out words by."""
    rows = url_filters.labelled_urls(spark).collect()
    parts = {p for r in rows for p in re.split(r"[^a-z0-9]+", r.url)}
    assert not parts & set("casino win ads track free bets spam farm cheap pills adult x example www m blog en de fr es".split())
    assert all(r.word in r.name.split("-") for r in rows)


# --- op 3 ---


def test_tool_calls(spark):
    calls = [
        (1, "a", "add", '{"y":2,"x":1}', None), (1, "b", "add", '{"x":"1","y":2}', "a"), (1, "c", "add", '{"x":1}', "b"), (1, "d", "add", '{"x":1,"y":2.5,"z":0}', "c"), (1, "e", "none", "{}", "zz"),
        (1, "f", "add", "[1]", None), (1, "g", "add", None, None), (2, "p", "add", '{"x":1,"y":2}', "q"), (2, "q", "add", '{"x":1,"y":2}', "p"), (2, "a", "add", '{"x":1,"y":2}', None), (2, "a", "add", '{"x":1,"y":2}', None),
        (None, "a", "add", "{}", None), (3, None, "add", "{}", None),
    ]
    results = [(1, "a", "three"), (1, "b", None), (2, "a", 'quote " \n'), (9, "x", "lost"), (1, "c", "r"), (1, "c", "r"), (None, "a", "r")]
    schemas = [("add", "x", "integer", True), ("add", "y", "number", True)]
    frames = (
        spark.createDataFrame(calls, "conv_id long, call_id string, name string, arguments string, after string"), spark.createDataFrame(results, "conv_id long, call_id string, content string"),
        spark.createDataFrame(schemas, "name string, param string, type string, required boolean"),
    )
    found = {(r.conv_id, r.call_id): r for r in chat_format.link_tool_calls(*frames).collect()}
    status = {k: v.status for k, v in found.items()}
    assert status == {
        (1, "a"): "ok", (1, "b"): "type: x", (1, "c"): "missing: y", (1, "d"): "unknown: z", (1, "e"): "no schema", (1, "f"): "not an object", (1, "g"): "not an object",
        (2, "p"): "cycle", (2, "q"): "cycle", (2, "a"): "ok", (9, "x"): "no call",
    }
    assert [found[1, c].depth for c in "abcd"] == [0, 1, 2, 3] and found[1, "e"].depth == 0
    for r in found.values():
        parsed = json.loads(r.record)
        assert list(parsed) == sorted(parsed) and json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.record
    assert json.loads(found[1, "a"].record) == {"after": None, "arguments": {"x": 1, "y": 2}, "id": "a", "name": "add", "result": "three"}
    assert chat_format.link_tool_calls(*(f.limit(0) for f in frames)).count() == 0


def test_long_chains_and_conversations(spark):
    chain = spark.createDataFrame([(1, f"c{i}", "n", "{}", f"c{i - 1}" if i else None) for i in range(300)], "conv_id long, call_id string, name string, arguments string, after string")
    assert {r.call_id: r.depth for r in chat_format.call_depths(chain).collect()} == {f"c{i}": i for i in range(300)}
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", None), (2, 0, "user", "x"), (2, 1, "assistant", None)]
    found = {(r.conv_id, r.call_id): r.status for r in chat_format.link_tool_calls(*chat_format.conversation_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert found == {(1, "t0"): "no schema", (1, "t1"): "ok", (1, "t3"): "no result", (2, "t0"): "ok"}


# --- text arrays ---


def thue_morse(n, a="a", b="b"):
    """Sequences on which polynomials modulo 2**64 meet whatever their odd base."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


def test_hashes_of_structured_words(spark):
    for n in (16, 64, 256, 512, 1024, 4096):
        one, other = thue_morse(n)
        data = np.frombuffer((one + other).encode(), np.uint8)
        assert len(set(text_arrays.span_hashes(data, np.array([0, n]), np.array([n, 2 * n])).tolist())) == 2
    words = [f"{'x' * k}" for k in range(1, 600)] + [f"{'y' * k}z" for k in range(1, 600)]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    assert len(set(text_arrays.span_hashes(data, ends - [len(w) for w in words], ends).tolist())) == len(words)


def test_structured_texts(spark):
    """Words and lines in the order of Thue and Morse are told apart by every operator that hashes them."""
    word = thue_morse(1024)
    lines = [t.replace("a", "first line\n").replace("b", "second one\n") for t in thue_morse(256)]
    texts = [*word, *lines]
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs(spark, texts), path).collect()} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in packing.best_fit_packing(docs(spark, texts), path, length=4096).collect():
        assert r.ids_crc32 == zlib.crc32(np.array([*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted(((r.doc_id, r.text) for r in substring_dedup.substring_dedup(docs(spark, texts)).collect()), key=repr) == plain_passages(list(enumerate(texts)))
    rows = list(enumerate(texts))
    assert sorted(tuple(r) for r in ngram_jaccard.ngram_jaccard_components(docs(spark, texts)).collect()) == jaccard_components(rows)


def test_pieces_that_share_a_hash(monkeypatch):
    """The second hash tells them apart."""
    from ledgerlark.llm import pieces

    monkeypatch.setattr(pieces, "span_hashes", lambda data, a, b, seed=0: (b - a).astype(np.uint64) if not seed else text_arrays.span_hashes(data, a, b, seed))
    table = pieces.PieceTable(lambda ps: (np.array([len(set(p)) for p in ps], np.int32), np.array([x for p in ps for x in sorted(set(p))], np.int32)))
    for _ in range(2):
        data = np.frombuffer(b"aabbabcaab", np.uint8)
        a, b = np.array([0, 2, 4, 7]), np.array([2, 4, 7, 10])
        counts, at = table.look_up(data, a, b)
        assert counts.tolist() == [1, 1, 3, 2] and bytes(table.gather(counts, at).astype(np.uint8).tolist()) == b"ababcab"


def test_words_over_chunks():
    import pyarrow as pa

    texts = [t or "" for t in corpus()]
    found = [[] for _ in texts]
    for low, data, offsets in text_arrays.text_chunks(pa.array(texts), 64):
        raw = data.tobytes()
        for a, b, r in zip(*text_arrays.words(data, offsets)):
            found[low + r].append(raw[a:b].decode())
    assert found == [WORD.findall(t) for t in texts]
