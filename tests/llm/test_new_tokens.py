"""Backtracking encoder, alignment of two tokenizers and fill-in-the-middle, each against a brute-force version."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerlark.llm import alignment, backtracking_bpe, fill_in_middle
from ledgerlark.llm.offset_table import OffsetTable, decimals

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, id string, row long, pair int"
rng = random.Random(7)
ODD = [
    None, "", " ", "\n\n  \t", "a", "Don't they'll I'M 'sx", "naïve Straße ﬁ ①½", "x<|endoftext|>y <|endoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext", "<s> </s> <unk> <0x41>",
    "▁a b", " 　x ", "👩‍👩‍👧 日本語テキスト العربية", "a" * 3000, "ab" * 2000, "\x00\x01", "<P>a", "<", "<P", "tail <", "same text twice", "same text twice", "word " * 4000,
    *("".join(rng.choices("abcdeéßA 1'\n<|>PSM.,▁", k=rng.randint(1, 200))) for _ in range(150)), *("".join(map(chr, rng.choices(range(32, 0x2FFF), k=50))) for _ in range(50)), "".join(rng.choices("etaoinshr", k=20000)),
]


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if k == 5 else k - k % 7 // 6, t, "x", 1, 2) for k, t in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def texts_of(docs) -> list[tuple]:
    return [(r[0], r[1] or "") for r in docs.collect()]


def test_backtracking_round_trip(docs):
    t = Tokenizer.from_file(BYTES)
    t.no_truncation()
    t.no_padding()
    expected = Counter()
    for i, text in texts_of(docs):
        ids = t.encode(text, add_special_tokens=False).ids
        expected[i, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, backtracking_bpe.backtracking_round_trip(docs, BYTES).collect())) == expected
    back = backtracking_bpe.decode(backtracking_bpe.encode(docs, BYTES), BYTES)
    assert Counter(map(tuple, back.collect())) == Counter(texts_of(docs))


def test_decode_of_odd_ids(spark):
    t = Tokenizer.from_file(BYTES)
    lists = [None, [], [50256, 15496], [10**6, -1, 64], [None, 64], [140, 222, 64], [222]]
    rows = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<long>")
    expected = {k: t.decode([x for x in ids or [] if x is not None and 0 <= x <= 50256], skip_special_tokens=False) for k, ids in enumerate(lists)}
    assert {r[0]: r[1] for r in backtracking_bpe.decode(rows, BYTES).collect()} == expected


def test_backtracking_is_merging():
    """Every pair of neighbours in a token row is compatible, and joined tokens split again as they were made."""
    v, _ = backtracking_bpe.vocabulary(BYTES)
    t = Tokenizer.from_file(BYTES)
    words = ["".join(rng.choices("aeinst", k=n)) for n in (1, 2, 3, 5, 8, 13, 50, 400) for _ in range(40)]
    counts, flat = v.encode([w.encode() for w in words])
    at = 0
    for w, n in zip(words, counts.tolist()):
        assert flat[at : at + n].tolist() == t.encode(w, add_special_tokens=False).ids
        at += n


def test_offset_table():
    table = OffsetTable([b"ab", b"", b"c"])
    data, bounds = table.gather(np.array([2, 0, 1, 0]))
    assert data.tobytes() == b"cabab" and bounds.tolist() == [0, 1, 3, 3, 5]
    assert decimals(12).gather(np.array([11, 0]))[0].tobytes() == b"11,0,"


def test_bits():
    places = np.array(sorted(rng.sample(range(1000), 300)))
    bits = alignment.Bits.of(places, 1000)
    assert bits.select().tolist() == places.tolist()
    assert bits.rank(np.arange(1001)).tolist() == np.searchsorted(places, np.arange(1001)).tolist()


def byte_entries(t: Tokenizer) -> dict[int, bytes]:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(hidden)}}
    return {i: bytes(byte[c] for c in s) for s, i in t.get_vocab(with_added_tokens=False).items() if all(c in byte for c in s)}


def brute_alignment(rows: list[tuple]) -> list[tuple]:
    t, m = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    t.encode_special_tokens = True
    of_a = byte_entries(t)
    of_b = {k: bytes([int(s[3:-1], 16)]) if re.fullmatch("<0x..>", s) else s.replace("▁", " ").encode() for k in range(m.vocab_size()) for s in [m.id_to_piece(k)]}
    found, counts = [], Counter()
    for i, text in rows:
        a, b = t.encode(" " + text, add_special_tokens=False).ids, m.encode(text)
        whole = (" " + text).encode()
        if not text or b"".join(of_a[x] for x in a) != whole or b"".join(of_b[x] for x in b) != whole:
            found.append((i, [], [], "", []))
            continue
        spans = []
        for ids, entries in ((a, of_a), (b, of_b)):
            ends = np.cumsum([len(entries[x]) for x in ids]).tolist()
            spans.append(list(zip([0, *ends], ends)))
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [[[x for x, (_, e) in zip(ids, own) if low < e <= high] for ids, own in zip((a, b), spans)] for low, high in zip([0, *cuts], cuts)]
        links, j = [], 0
        for x, (low, high) in zip(a, spans[0]):
            while spans[1][j][1] <= low:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < high:
                links.append((x, b[k]))
                k += 1
        counts.update(links)
        found.append((i, a, b, ";".join("|".join(",".join(map(str, g)) for g in two) for two in groups), links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (i, len(a), len(b), g.count(";") + bool(g), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha(g) if g else "")
        for i, a, b, g, links in found
    ]


@pytest.mark.parametrize("share", [alignment.FREQUENT_SHARE, 200, 1])
def test_alignment(docs, share):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = alignment.token_alignment(docs, BYTES, PIECES, frequent_share=share).select(columns)
    assert Counter(map(tuple, got.collect())) == Counter(brute_alignment(texts_of(docs)))


def test_aligned_tokens(docs):
    for r in alignment.aligned_tokens(docs, BYTES, PIECES).collect():
        assert sum(r.group_a_sizes) == len(r.a_ids) and sum(r.group_b_sizes) == len(r.b_ids)
        assert len(r.link_a) == len(r.link_b) == len(set(zip(r.link_a, r.link_b)))
        assert set(r.link_a) == set(range(len(r.a_ids))) and set(r.link_b) == set(range(len(r.b_ids)))


def test_alignment_of_nothing(docs):
    assert alignment.token_alignment(docs.limit(0), BYTES, PIECES).count() == 0
    assert alignment.aligned_tokens(docs.limit(0), BYTES, PIECES).count() == 0
    empty = docs.where("coalesce(text, '') = ''")
    assert {tuple(r)[1:] for r in alignment.token_alignment(empty, BYTES, PIECES).collect()} == {(0, 0, 0, 0, "", 0, 0)}


def brute_middle(i, text: str) -> tuple:
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = sha(f"1:{'' if i is None else i}")
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, sha(text), sha(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return i, n, form, len(p), len(m), sha(out), sha(text)


def test_fill_in_middle(docs):
    got = Counter(map(tuple, fill_in_middle.fill_in_middle_digests(docs).collect()))
    assert got == Counter(brute_middle(*r) for r in texts_of(docs))
    assert {form for _, _, form, *_ in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle_digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["<", "<P", "P>", "<<", "S><", "<M<P"])
def test_marks_beside_cuts(text):
    for k in range(300):
        _, form, _, _, out = (x := fill_in_middle.transform(text * 3, f"1:{k}"))
        assert fill_in_middle.restore(out, form) == text * 3, x
