"""Substring dedup by line hashing.

Units are lines of a layout that depends on the words alone. White space counts as one space and A-Z as
a-z; then, of every so many places in a row, the first one whose next words have the least hash begins a line of
``line_words`` words. A passage falls into the same lines in every text, whatever stands around it and however its
own lines were broken, and each run of ``least_words`` words holds one whole line at least.

Digests of lines are grouped over all texts, and words around a later line are compared with those around the
first: where ``least_words`` or more are equal, they go from the later text. A line may stand first in a text that has less
in common than another. So where a line stands in three texts or more, the digests of all runs of
``least_words`` words around its later places that haven't gone are grouped and compared in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.storage import bounded_batches, stored
from ledgerlark.llm.text_arrays import LOWER, span_hashes, text_chunks, tidily, window_hashes, words
from ledgerlark.llm.units import PARTS, SPANS, Spans, is_later, repeated, row_keys, slot, without_spans

WORD = regex.compile(r"[^\x20\x09-\x0D]+")
#: What is asked of a text: its words from a to b, as a member (later text) or the hub (first one) of a comparison.
ASKED = "struct<a:long,b:long,hub:long,slot:int,member:int,shift:long>"
#: A line or run by its first word's number; ``before`` is where it stands the last time before in its own text.
PLACES = PARTS + ", before long"


def line_starts(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places whose hash is the least, and the first such, of some ``window`` consecutive ones (Schleimer, Wilkerson, Aiken, 2003)."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(view.argmin(axis=1) + np.arange(len(view)))


def _before(place: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The place before with the same hash in the same text; -1 for none."""
    before = np.full(len(place), -1)
    if len(np.unique(hashes)) < len(hashes):
        order = np.lexsort((place, hashes))
        again = np.flatnonzero(hashes[order][1:] == hashes[order][:-1])
        before[order[again + 1]] = place[order[again]]
    return before


def _places(texts: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """PLACES of texts: id, places and their hashes."""
    if texts:
        ids, place, hashes = zip(*texts)
        before = np.concatenate([_before(p, h) for p, h in zip(place, hashes)])
        columns = [pa.array(np.repeat(ids, [len(p) for p in place])), pa.array(np.concatenate(place)), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(before, mask=before < 0)]
        yield pa.RecordBatch.from_arrays(columns, ["id", "part", "d", "before"])


def _hashed_words(column: pa.Array) -> Iterator[np.ndarray]:
    """The hashes of each text's words, in order."""
    for _, data, offsets in text_chunks(column):
        data = LOWER[data]
        starts, ends, rows = words(data, offsets)
        hashes = span_hashes(data, starts, ends)
        bounds = np.searchsorted(rows, np.arange(len(offsets)))
        yield from (hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:]))


def _lines(batches: Iterator[pa.RecordBatch], line_words: int, least_words: int) -> Iterator[pa.RecordBatch]:
    """(id, text) -> PLACES of the lines."""
    for batch in tidily(batches):
        out = []
        for i, own in zip(batch.column(0).to_pylist(), _hashed_words(batch.column(1))):
            if len(own) >= least_words:
                lines = window_hashes(own, line_words)
                at = line_starts(lines, least_words - line_words + 1)
                out.append((i, at, lines[at]))
        yield from _places(out)


def _runs(batches: Iterator[pa.RecordBatch], line_words: int, least_words: int) -> Iterator[pa.RecordBatch]:
    """(id, text, lines: array of line starts, gone: array of runs) -> PLACES of the runs that hold one of the lines and haven't gone."""
    for batch in tidily(batches):
        out = []
        for i, own, lines, gone in zip(batch.column(0).to_pylist(), _hashed_words(batch.column(1)), *(batch.column(k).to_pylist() for k in (2, 3))):
            runs = window_hashes(own, least_words)
            ends = np.zeros(len(runs) + 1, np.int64)
            at = np.array(lines)
            np.add.at(ends, np.maximum(at - (least_words - line_words), 0), 1)
            np.add.at(ends, np.minimum(at + 1, len(runs)), -1)
            open_ = np.cumsum(ends)[:-1] > 0
            for s in gone or ():
                open_[s["start"] : s["end"] - least_words + 1] = False
            place = np.flatnonzero(open_)
            if len(place):
                out.append((i, place, runs[place]))
        yield from _places(out)


def _asked_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, asked: array of ASKED) -> WANTED: a row for each, the words asked for with one space between two."""
    for batch in tidily(batches):
        rows = []
        for i, text, asked in zip(*(batch.column(k).to_pylist() for k in range(3))):
            own = text.encode().lower().split()
            rows += [(x["hub"], x["slot"], x["member"], i, max(x["a"], 0), x["shift"], b" ".join(own[max(x["a"], 0) : x["b"]])) for x in asked]
            if len(rows) >= 1_000:
                yield _wanted_batch(rows)
                rows = []
        if rows:
            yield _wanted_batch(rows)


WANTED = "hub long, slot int, member int, id long, a long, shift long, words binary"


def _wanted_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [c.split()[0] for c in WANTED.split(", ")])


def equal_runs(one: list[bytes], other: list[bytes], least: int) -> list[tuple[int, int]]:
    """Where two lists of words, side by side, are equal for ``least`` words and more."""
    n = min(len(one), len(other))
    if one[:n] == other[:n]:
        return [(0, n)] if n >= least else []
    stops = [-1, *(k for k in range(n) if one[k] != other[k]), n]
    return [(a + 1, b) for a, b in zip(stops, stops[1:]) if b - a - 1 >= least]


def _compared(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hub and slot with the hub's words before the members': runs (id, a, b) of members' words that the hub has."""
    key, base, own = None, 0, []
    for batch in tidily(batches):
        found = []
        for hub, slot, member, i, a, shift, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not member:
                key, base, own = (hub, slot), a, text.split(b" ")
            elif (hub, slot) == key:
                at = a - shift - base  # where the member's first word stands among the hub's
                theirs, a, at = text.split(b" ")[max(0, -at) :], a + max(0, -at), max(0, at)
                found += [(i, a + x, a + y) for x, y in equal_runs(theirs, own[at : at + len(theirs)], least_words)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["id", "start", "end"])


def word_spans(text: str, runs: Spans) -> Spans:
    """Runs of words, by number, as spans of characters: each up to the next word or the text's end."""
    at = [m.start() for m in WORD.finditer(text)] + [len(text)]
    return [(at[a], at[b]) for a, b in runs]


def _equal_words(plain: DataFrame, places: DataFrame, size: int, least_words: int) -> tuple[DataFrame, DataFrame]:
    """Of PLACES of ``size`` words: those that another place's digest equals, and the runs (id, start, end) of ``least_words`` words
    and more that stand at or around a place and also around the first such place, or the last one before in its own text."""
    same = stored(repeated(places, F.max(F.col("before").isNotNull()).alias("within")))
    own = F.col("before").isNotNull()
    later = same.where(own | is_later()).select("id", "part", F.when(own, F.col("id")).otherwise(F.col("first_id")).alias("hub"), (F.col("part") - F.coalesce("before", "first_part")).alias("shift"), F.when(own, 1).otherwise(F.col("n")).alias("n"))
    around = least_words - size
    later = later.groupBy("id", "hub", "shift").agg((F.min("part") - around).alias("a"), (F.max("part") + size + around).alias("b"), F.max("n").alias("n"))
    later = stored(later.withColumn("slot", slot("id")).drop("n"))
    hubs = later.groupBy("hub", "slot").agg(F.min(F.col("a") - F.col("shift")).alias("a"), F.max(F.col("b") - F.col("shift")).alias("b"))
    asked = later.select("id", F.struct("a", "b", "hub", "slot", F.lit(1).alias("member"), "shift").cast(ASKED).alias("x"))
    asked = asked.unionByName(hubs.select(F.col("hub").alias("id"), F.struct("a", "b", "hub", "slot", F.lit(0).alias("member"), F.lit(0).alias("shift")).cast(ASKED).alias("x")))
    asked = stored(asked.groupBy("id").agg(F.collect_list("x").alias("asked")))
    found = plain.join(asked.hint("merge"), "id").mapInArrow(_asked_words, WANTED)
    found = found.repartition("hub", "slot").sortWithinPartitions("hub", "slot", "member").mapInArrow(partial(_compared, least_words=least_words), "id long, start long, end long")
    return same, stored(found)


def substring_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_words: int = 50, line_words: int = 16) -> DataFrame:
    """documents with text_col rewritten and a column removed_spans added (array of start, end: characters
    of the original text, in order): of a run of ``least_words`` words or more that stands in several places the
    earliest by id, then place, stays, and the rest go, with the white space after them.

    Words are equal with A-Z as a-z and any white space between. A word goes if it is in a run of ``least_words`` words that
    begins earlier as well, in an earlier text or before in its own; so a text that repeats one word keeps the first. Texts of fewer
    words stay as they are. Null text stays null, an empty one empty; a row whose id is null keeps its text. Rows with one
    id are rows of their own, in the order of a hash of their texts. Other columns stay as they are; an empty table gives an
    empty result. A digest for some 18 words is shuffled, then the words around lines that occur again, then digests where
    that doesn't decide; many copies are dealt over several tasks, each with the first beside it.
    """
    if not 1 <= line_words <= least_words:
        raise ValueError("a line must not be longer than the least run")
    bounded_batches(documents.sparkSession)
    name = {c: f"c{i}" for i, c in enumerate(documents.columns)}
    docs = documents.withColumnsRenamed(name)
    docs = row_keys(docs.withColumns({"id": F.col(name[id_col]).cast("long"), "text": F.col(name[text_col]).cast("string")}).drop(name[text_col]))
    plain = docs.where("id is not null and text is not null").select("id", "text")
    sizes = {"line_words": line_words, "least_words": least_words}
    lines = stored(plain.mapInArrow(partial(_lines, **sizes), PLACES))
    same, gone = _equal_words(plain, lines, line_words, least_words)
    open_ = same.where(F.col("within") | (is_later() & (F.col("n") > 2))).groupBy("id").agg(F.collect_list("part").alias("lines"))
    open_ = stored(open_.join(gone.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("gone")), "id", "left"))
    runs = plain.join(open_.hint("merge"), "id").mapInArrow(partial(_runs, **sizes), PLACES)
    gone = gone.unionByName(_equal_words(plain, stored(runs), least_words, least_words)[1])
    out = without_spans(docs, gone, word_spans, send=False)
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col(name[c]).alias(c) for c in documents.columns), F.coalesce("gone", F.array().cast(SPANS)).alias("removed_spans"))
