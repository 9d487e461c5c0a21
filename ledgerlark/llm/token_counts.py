"""Token counts by byte-pair merging over a heap and a linked list; no token ids are made.

The vocabulary is read from a tokenizers file of model BPE with word ends, whose normaliser composes
(NFC), makes white space one space and lower-cases, and whose pieces are letters, single numbers or other signs.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.pieces import PieceTable, piece_spans
from ledgerlark.llm.storage import bounded_batches
from ledgerlark.llm.text_arrays import text_chunks, tidily


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself where Latin-1
    prints it, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Number of symbols left when the adjacent pair of lowest rank, the leftmost of equals, has been
    merged again and again: the initial ones minus the merges."""
    n = len(symbols)
    if n < 2:
        return n
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = following[i]
        if j >= n or symbols[i] != left or symbols[j] != right:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = left + right, ""
        following[i] = k = following[j]
        merges += 1
        if k < n:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
    return n - merges


@lru_cache(2)
def _vocabulary(path: str) -> tuple[regex.Pattern | None, PieceTable]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    end = spec["model"]["end_of_word_suffix"] or ""
    ranks = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(spec["model"]["merges"])}
    chars = byte_chars()

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        counts = []
        for piece in pieces:
            symbols = [chars[b] for b in piece]
            symbols[-1] += end
            counts.append(merged_length(symbols, ranks))
        return np.array(counts, np.int32), np.zeros(sum(counts), np.int32)

    special = [t["content"] for t in spec["added_tokens"]]
    return (regex.compile("|".join(map(regex.escape, special))) if special else None), CountTable(encode)


class CountTable(PieceTable):
    """A PieceTable that keeps numbers of tokens only."""

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = super().look_up(data, starts, ends)
        self.flat = self.flat[:0]
        return out


def normalised(text: str) -> str:
    """NFC, then lower case character by character: a final sigma is lower-cased as any other."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _counts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    special, table = _vocabulary(path)
    for batch in tidily(batches):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        n_bytes = np.array([len(t.encode()) for t in texts], np.int64)
        n_tokens = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for r, text in enumerate(texts):
            pieces = special.split(text) if special is not None and "<" in text else [text]
            n_tokens[r] = len(pieces) - 1  # a special token stands between two parts
            parts += map(normalised, pieces)
            owner += [r] * len(pieces)
        owner = np.array(owner, np.int64)
        for low, data, offsets in text_chunks(pa.array(parts, pa.large_string()), 1 << 20):
            starts, ends, rows = piece_spans(data, offsets, "bare")
            counts, _ = table.look_up(data, starts, ends)
            n_tokens += np.bincount(owner[low + rows], counts, len(texts)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens)], ["id", "n_bytes", "n_tokens"])


def token_counts(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, limit: int = 2048) -> DataFrame:
    """One row for each document: its id, n_bytes (long, UTF-8), n_tokens (long) and over_limit (boolean:
    n_tokens > limit). Null and empty texts have no byte and no token. Each row is counted for itself, with any id; an empty table
    gives an empty result; further columns are left out. Special tokens inside a text count one each.

    Distinct pieces of a task are merged once; a worker keeps up to a bounded number of them between batches.
    """
    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fields = f"id {docs.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    counts = docs.mapInArrow(partial(_counts, path=tokenizer_path), fields)
    return counts.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
