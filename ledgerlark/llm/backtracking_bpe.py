"""Byte-level BPE by backtracking, in time linear in the text, and decoding through an offset table.

An Aho-Corasick automaton of the reversed tokens, run over reversed text, finds the longest token that begins
at each byte. From the left the encoder takes the longest, then ever shorter tokens, until one is compatible
with the token before it; where none is, that place is dead and the token before gives way to a
shorter one. Two tokens are compatible if merging their joined bytes gives these two again. A sequence
of which all neighbours are compatible is what merging gives, and there is only one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache, partial

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.offset_table import OffsetTable, decimals
from ledgerlark.llm.pieces import PieceTable, piece_spans
from ledgerlark.llm.storage import bounded_batches
from ledgerlark.llm.text_arrays import text_chunks, tidily
from ledgerlark.llm.token_counts import byte_chars

#: No token has this character: it parts pieces in one text for the automaton.
BETWEEN = "Ā"
#: Pairs of tokens whose compatibility a worker remembers; then it begins anew.
MOST_PAIRS = 500_000
#: Distinct pieces whose tokens a worker remembers.
MOST_PIECES = 600_000


class Vocabulary:
    """The merges of a tokenizers file of model BPE on bytes.

    Tokens are numbered here in the order in which merging makes them: the 256 bytes, then the merge of rank k as 256 + k. This
    needs each part of a merge to come before it, each token to be made by one merge only, and no further settings of the
    model; a file that isn't so is refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("not a plain byte-level BPE")
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
            raise ValueError("the model has settings that change merging")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("an added token takes more than its own characters")
        chars = byte_chars()
        number = {c: b for b, c in enumerate(chars)}
        self.left, self.right = list(range(256)), list(range(256))
        self.joined: dict[tuple[int, int], int] = {}
        names = list(chars)
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            if a not in number or b not in number or a + b in number:
                raise ValueError("merges are not in the order of their making")
            number[a + b] = self.joined[number[a], number[b]] = len(names)
            self.left.append(number[a])
            self.right.append(number[b])
            names.append(a + b)
        byte = {c: b for b, c in enumerate(chars)}
        self.bytes = [bytes(byte[c] for c in name) for name in names]
        self.ids = np.array([model["vocab"][name] for name in names], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        entries = [b""] * (max(max(self.special.values(), default=0), int(self.ids.max())) + 1)
        for t, own in zip(self.ids.tolist(), self.bytes):
            entries[t] = own
        for text, t in self.special.items():
            entries[t] = text.encode()
        self.offsets = OffsetTable(entries)
        self.decimals = decimals(len(entries))
        self.special_pattern = regex.compile(b"|".join(regex.escape(s.encode()) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        # a token whose own bytes merge to something else is never a result
        made = [True] * len(names)
        for t in range(256, len(names)):
            made[t] = made[self.left[t]] and made[self.right[t]] and self.holds(self.left[t], self.right[t], t)
        text = [b.decode("latin-1") for b in self.bytes]
        known = {s: t for t, s in enumerate(text) if made[t]}
        self.sizes = [len(s) for s in text]
        #: The longest token that a token begins with, other than itself; -1 if none.
        self.shorter = [next((known[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in known), -1) for s in text]
        self.automaton = ahocorasick.Automaton()
        for s, t in known.items():
            self.automaton.add_word(s[::-1], t)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}

    def holds(self, a: int, b: int, limit: int) -> bool:
        """Whether of merges numbered below ``limit`` none crosses the border between tokens a and b.

        The two are taken apart again at the border, the one that was made later first, of equals the right one, as equal pairs merge from
        the left. What then stands at the border has stood there until that merge: a merge of it that comes
        before (of the same number: more to the left) would have been taken.
        """
        while True:
            across = self.joined.get((a, b))
            if across is not None and across < limit:
                return False
            if max(a, b) < 256:
                return True
            if a > b:
                limit, a = a, self.right[a]
            else:
                limit, b = b + 1, self.left[b]

    def compatible(self, a: int, b: int) -> bool:
        """Entry (a, b) of the pair-compatibility table, worked out when it is first asked for."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self.holds(a, b, len(self.bytes))
        return found

    def longest(self, text: str) -> list[int]:
        """For each place the longest token that begins there; -1 where none does."""
        found, n, done = [-1] * len(text), len(text) - 1, -1
        for end, token in self.automaton.iter(text[::-1]):
            if end != done:  # of the matches that end at a place the longest comes first
                found[n - end] = token
                done = end
        return found

    def backtrack(self, longest: list[int], at: int, end: int) -> list[int]:
        """The tokens of the bytes from ``at`` to ``end``, by their numbers here."""
        out: list[int] = []
        dead: set[int] = set()
        sizes, shorter, compatible = self.sizes, self.shorter, self.compatible
        token = longest[at]
        while at < end:
            after = at + sizes[token]
            if after not in dead and (not out or compatible(out[-1], token)):
                out.append(token)
                at = after
                if at < end:
                    token = longest[at]
                continue
            token = shorter[token]
            while token < 0:
                dead.add(at)
                token = out.pop()
                at -= sizes[token]
                token = shorter[token]
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and all ids in order."""
        text = BETWEEN.join(p.decode("latin-1") for p in pieces)
        longest, counts, flat, at = self.longest(text), [], [], 0
        for p in pieces:
            own = self.backtrack(longest, at, at + len(p))
            counts.append(len(own))
            flat += own
            at += len(p) + 1
        return np.array(counts, np.int32), self.ids[np.array(flat, np.int64)]

    def table(self) -> PieceTable:
        return PieceTable(self.encode, most=MOST_PIECES)

    def tokens(self, table: PieceTable, data: np.ndarray, offsets: np.ndarray, *, special: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk of rows, and where each row's begin, with the end of the last. With ``special`` the strings of special
        tokens stand for these, wherever they are; else they are text."""
        rows, named = offsets, []
        if special and self.special_pattern is not None:
            raw = data.tobytes()
            if self.special_pattern.search(raw):
                for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
                    named += [(m.start(), m.end(), self.special[m[0].decode()]) for m in self.special_pattern.finditer(raw, a, b)]
                rows = np.unique(np.concatenate([offsets, [x for a, b, _ in named for x in (a, b)]]).astype(np.int64))
        starts, ends, _ = piece_spans(data, rows, "spaced")
        counts, at = table.look_up(data, starts, ends)
        if named:  # the first piece of a special token's string becomes its one token
            counts = counts.copy()
            firsts = np.searchsorted(starts, [a for a, _, _ in named])
            for first, last in zip(firsts, np.searchsorted(starts, [b for _, b, _ in named])):
                counts[first:last] = 0
                counts[first] = 1
        ids = table.gather(counts, at)
        sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        if named:
            ids[sums[firsts]] = [t for _, _, t in named]
        return ids, sums[np.searchsorted(starts, offsets)]


@lru_cache(2)
def vocabulary(path: str) -> tuple[Vocabulary, PieceTable]:
    """A worker's vocabulary and the pieces that it has seen."""
    v = Vocabulary(path)
    return v, v.table()


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    v, table = vocabulary(path)
    for batch in tidily(batches):
        for low, data, offsets in text_chunks(batch.column(1), 1 << 20):
            ids, bounds = v.tokens(table, data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(lists)), lists], ["id", "ids"])


def _known(ids: np.ndarray, v: Vocabulary) -> np.ndarray:
    return (ids >= 0) & (ids < len(v.offsets.sizes))


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    v, _ = vocabulary(path)
    for batch in tidily(batches):
        texts = []
        for ids in batch.column(1):
            own = np.array([x for x in ids.as_py() or () if x is not None], np.int64)
            texts.append(v.offsets.gather(own[_known(own, v)])[0].tobytes().decode(errors="replace"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    v, table = vocabulary(path)
    for batch in tidily(batches):
        for low, data, offsets in text_chunks(batch.column(1), 1 << 20):
            ids, bounds = v.tokens(table, data, offsets)
            digests = []
            for entries, cut in ((v.decimals, 1), (v.offsets, 0)):
                flat, places = entries.gather(ids)
                flat = memoryview(flat)
                ends = places[bounds].tolist()
                digests.append([hashlib.sha256(flat[a : max(a, b - cut)]).hexdigest() for a, b in zip(ends, ends[1:])])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(bounds) - 1), pa.array(np.diff(bounds)), *map(pa.array, digests)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _two(df: DataFrame, id_col: str, col: str, kind: str) -> tuple[DataFrame, str]:
    bounded_batches(df.sparkSession)
    two = df.select(F.col(id_col).alias("id"), F.col(col).cast(kind).alias("value"))
    return two, two.schema["id"].dataType.simpleString()


def encode(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids: array of long) of whole texts. Null and empty texts have no ids; special tokens' strings stand for these."""
    docs, kind = _two(documents, id_col, text_col, "string")
    return docs.mapInArrow(partial(_encode, path=tokenizer_path), f"id {kind}, ids array<long>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of lists of ids. A null or empty list gives an empty text; null and unknown ids are left out; bytes that
    are not UTF-8 become U+FFFD."""
    rows, kind = _two(tokens, id_col, ids_col, "array<long>")
    return rows.mapInArrow(partial(_decode, path=tokenizer_path), f"id {kind}, text string").withColumnRenamed("id", id_col)


def backtracking_round_trip(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its id, n_tokens, ids_sha256 and decoded_sha256, the digests of its ids, in decimal and joined by
    commas, and of the text that they decode to.

    Null and empty texts have no ids; each row is coded for itself, with any id or none; an empty table gives an empty
    result; further columns are left out. Texts are coded in chunks of 1 MB, a longer one by itself. There is no shuffle.
    """
    docs, kind = _two(documents, id_col, text_col, "string")
    fields = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.mapInArrow(partial(_digests, path=tokenizer_path), fields).withColumnRenamed("id", id_col)
