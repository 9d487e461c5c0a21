"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last lines decides where a chunk ends, so that lines put in
before a passage shift its chunks but don't change them. Chunks of two lines and more that occur again, anywhere, go
after their bytes have been compared with the first occurrence's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.storage import bounded_batches, stored
from ledgerlark.llm.text_arrays import U64, span_hashes, text_chunks, tidily, window_hashes
from ledgerlark.llm.units import PARTS, SPANS, beside_ids, is_later, line_spans, repeated, row_keys, slot, without_spans

Shape = tuple[int, int]


def chunk_bounds(hashes: np.ndarray, shape: Shape) -> np.ndarray:
    """First lines of a text's chunks. shape: lines of the rolling window, least lines between boundaries (two at least).
    A chunk ends where the rolling hash is less than at the places around it that are nearer than the least distance; of equal ones the
    first counts. So each boundary depends on a few lines alone. No boundary is one line off the text's beginning or end."""
    window, apart = shape
    rolling = window_hashes(hashes, window)
    if not len(rolling):
        return np.zeros(min(len(hashes), 1), np.int64)
    around = np.pad(rolling, apart - 1, constant_values=np.iinfo(np.uint64).max)
    ends = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(around, 2 * apart - 1).argmin(axis=1) == apart - 1) + window
    return np.append(0, ends[(ends >= 2) & (ends <= len(hashes) - 2)])


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (without the newline) of all lines of a chunk, and each row's first line. What
    follows a row's last newline is no line if it is empty."""
    breaks = np.flatnonzero(data == 10)
    rows = np.searchsorted(offsets, breaks, "right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((starts, np.concatenate([np.arange(len(offsets) - 1), rows])))
    counts = 1 + np.bincount(rows, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(counts)])
    starts = starts[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = first[1:] - 1
    ends[last] = offsets[1:]
    empty = starts[last] == ends[last]
    kept = np.ones(len(starts), bool)
    kept[last[empty]] = False
    return starts[kept], ends[kept], np.concatenate([[0], np.cumsum(counts - empty)])


def _digests(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    for batch in tidily(batches):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for low, data, offsets in text_chunks(batch.column(1)):
            starts, ends, first = _lines(data, offsets)
            hashes = span_hashes(data, starts, ends)
            begins, row, number = [], [], []
            for r in range(len(offsets) - 1):
                own = chunk_bounds(hashes[first[r] : first[r + 1]], shape)
                begins.append(own + first[r])
                row.append(np.full(len(own), r))
                number.append(np.arange(len(own)))
            a, row, number = (np.concatenate(x) for x in (begins, row, number))
            b = np.append(a[1:], len(hashes))
            keep = b - a > 1
            a, b, row, number = a[keep], b[keep], row[keep], number[keep]
            digests = span_hashes(data, starts[a], ends[b - 1])
            yield pa.RecordBatch.from_arrays([pa.array(ids[low + row].astype(np.int64)), pa.array(number), pa.array(digests.view(np.int64))], ["id", "part", "d"])


def chunk_spans(text: str, shape: Shape) -> list[tuple[int, int]]:
    """Character spans of a text's chunks, each with the newline that ends it."""
    lines = line_spans(text)
    data = text.encode()
    starts, ends, _ = _lines(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    bounds = chunk_bounds(span_hashes(np.frombuffer(data, np.uint8), starts, ends), shape)
    return [(lines[a][0], lines[b - 1][1]) for a, b in zip(bounds, [*bounds[1:], len(starts)])]


def _chunk_texts(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    """(id, text, parts: array of part, first_id, first_part, slot) -> the characters of each chunk, and its bytes beside what they must equal."""
    for batch in tidily(batches):
        rows = []
        for i, text, parts in zip(*(batch.column(k).to_pylist() for k in range(3))):
            spans = chunk_spans(text, shape)
            for p in parts:
                a, b = spans[p["part"]]
                rows.append((p["first_id"], p["first_part"], p["slot"], int((i, p["part"]) != (p["first_id"], p["first_part"])), i, a, b, text[a:b].removesuffix("\n").encode()))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [c.split()[0] for c in CHUNKS.split(", ")])


CHUNKS = "first_id long, first_part long, slot int, later int, id long, start long, end long, bytes binary"


def _equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted with the first occurrence before the later ones of a slot: the later ones equal to it, byte by byte."""
    key, own = None, None
    for batch in tidily(batches):
        found = []
        for a, b, slot, later, i, start, end, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not later:
                key, own = (a, b, slot), text
            elif (a, b, slot) == key and text == own:
                found.append((i, start, end))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["id", "start", "end"])


def line_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 2, apart: int = 2) -> DataFrame:
    """documents with text_col rewritten and a column removed_spans added (array of start, end: characters
    of the original text, in order): of equal multi-line chunks the first by id, then place, stays.

    Lines end at \\n and are compared as they are. A chunk ends where the rolling hash of the last ``window`` lines is the least
    of those less than ``apart`` lines away, so every 2 * apart - 1 lines on average, but not one line off the text's beginning or end; a text of a single line
    stays always. Chunks have no greatest length: lines that are all alike may be one. Null text stays null, an empty one empty; a row whose id is
    null keeps its text. Rows with one id are rows of their own, in the order of a hash of their texts.
    Other columns stay as they are; an empty table gives an empty result. Digests of 64 bits are shuffled, then the bytes of
    chunks that occur again; many copies of one chunk are dealt over several tasks, each with the first beside it.
    """
    bounded_batches(documents.sparkSession)
    shape = (window, max(apart, 2))
    name = {c: f"c{i}" for i, c in enumerate(documents.columns)}
    docs = documents.withColumnsRenamed(name)
    docs = row_keys(docs.withColumns({"id": F.col(name[id_col]).cast("long"), "text": F.col(name[text_col]).cast("string")}).drop(name[text_col]))
    plain = docs.where("id is not null and text is not null").select("id", "text")
    parts = stored(plain.mapInArrow(partial(_digests, shape=shape), PARTS))
    later = stored(repeated(parts).where(is_later()).withColumn("slot", slot("id", "part")).drop("n"))
    first = later.select(F.col("first_id").alias("id"), F.col("first_part").alias("part"), "first_id", "first_part", "slot").distinct()
    wanted = later.select("id", "part", "first_id", "first_part", "slot").unionByName(first)
    wanted = stored(wanted.groupBy("id").agg(F.collect_list(F.struct("part", "first_id", "first_part", "slot")).alias("parts")))
    texts = beside_ids(plain, wanted, "parts", 56).mapInArrow(partial(_chunk_texts, shape=shape), CHUNKS)
    gone = texts.repartition("first_id", "first_part", "slot").sortWithinPartitions("first_id", "first_part", "slot", "later").mapInArrow(_equal, "id long, start long, end long")
    out = without_spans(docs, gone)
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col(name[c]).alias(c) for c in documents.columns), F.coalesce("gone", F.array().cast(SPANS)).alias("removed_spans"))
