"""Parts of texts that other texts have as well: which stay, and the texts without the rest. A part is
named by its row's key, see ``row_keys``, and its number."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.storage import sent_if_small, stored
from ledgerlark.llm.text_arrays import tidily

#: A part's digest only finds candidates: what goes is compared byte by byte.
PARTS = "id long, part long, d long"
#: Most digests that are dealt with as hot, whatever the number of rows.
HOT_DIGESTS = 50_000
#: Occurrences of a part that one task compares with the first.
SLOT_ROWS = 500
SPANS = "array<struct<start:long,end:long>>"
Spans = list[tuple[int, int]]
#: From a text and spans in some unit to spans of characters.
Cut = Callable[[str, Spans], Spans]


def row_keys(docs: DataFrame, column: str = "id", *, nulls: bool = False) -> DataFrame:
    """docs whose ``column`` (long) names one row: as it is where no value but null repeats, else a number of the row
    in the order of its value, then of its text. Null stays null, or with ``nulls`` gets a number as well.

    Rows are numbered by a sort over ranges of the whole table, texts too, written once; equal rows are told apart by
    a random number, so no group of them is one task's."""
    key = F.col(column)
    again = (F.col("count") > 1) & key.isNotNull() | (key.isNull() if nulls else F.lit(False))
    if not docs.groupBy(column).count().where(again).take(1):
        return docs
    rows = docs.withColumns({"_hash": F.xxhash64("text"), "_random": F.rand(0)}).orderBy(column, "_hash", "_random").drop("_hash", "_random")
    return stored(rows.withColumn(column, F.when(key.isNotNull() | F.lit(nulls), F.monotonically_increasing_id())))


def repeated(parts: DataFrame, *more: Column) -> DataFrame:
    """The parts whose digest another part has, with the earliest such part (first_id, first_part) by id, then part, their
    number n, and further aggregates of them.

    The earliest is found by partial minima, so a digest that very many parts share costs a row from each task. Such hot
    digests, at most HOT_DIGESTS by their definition, are then sent to all tasks; the others meet their parts by a
    shuffle, and none of them has many rows."""
    first = parts.groupBy("d").agg(F.min(F.struct("id", "part")).alias("first"), F.count("*").alias("n"), *more).where("n > 1")
    first = stored(first.withColumns({"first_id": F.col("first.id"), "first_part": F.col("first.part")}).drop("first"))
    total = first.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(500, total // HOT_DIGESTS)
    return parts.join(F.broadcast(first.where(hot)), "d").unionByName(parts.join(first.where(~hot), "d")).drop("d")


def is_later() -> Column:
    """Whether a repeated part isn't the earliest of its digest."""
    return F.struct("id", "part") > F.struct(F.col("first_id").alias("id"), F.col("first_part").alias("part"))


def slot(*of: str) -> Column:
    """Among how many tasks the n parts of a digest are dealt, and which of them is a part's own."""
    return F.pmod(F.xxhash64(*of), (1 + F.col("n") / SLOT_ROWS).cast("int")).cast("int")


def beside_ids(docs: DataFrame, lists: DataFrame, of: str, width: int, how: str = "inner") -> DataFrame:
    """docs joined by id to lists (id, ``of``: an array of elements of ``width`` bytes), which are sent to every executor while they are
    small; that saves the shuffle of whole texts. Beyond that both sides are shuffled by id."""
    return docs.join(sent_if_small(lists, F.size(of) * width), "id", how)


def as_they_are(text: str, spans: Spans) -> Spans:
    return spans


def _without(batches: Iterator[pa.RecordBatch], cut: Cut) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in tidily(batches):
        names = batch.schema.names
        texts, gone = batch.column(names.index("text")), batch.column(names.index("gone"))
        changed = pc.fill_null(pc.greater(pc.list_value_length(gone), 0), False)
        left, spans = [], []
        for text, own in zip(texts.filter(changed).to_pylist(), gone.filter(changed).to_pylist()):
            merged: Spans = []
            for a, b in sorted(cut(text, [(s["start"], s["end"]) for s in own])):
                if merged and a <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                else:
                    merged.append((a, b))
            stops = [0, *(x for span in merged for x in span), len(text)]
            left.append("".join(text[a:b] for a, b in zip(stops[::2], stops[1::2])))
            spans.append([{"start": a, "end": b} for a, b in merged])
        which = pc.if_else(changed, pc.cumulative_sum(changed.cast(pa.int64())), 0)
        texts = pc.replace_with_mask(texts, changed, pa.array(left, texts.type))
        spans = pa.array([None, *spans], kind).take(which)
        yield pa.RecordBatch.from_arrays([texts if n == "text" else spans if n == "gone" else batch.column(k) for k, n in enumerate(names)], names)


def without_spans(docs: DataFrame, gone: DataFrame, cut: Cut = as_they_are, *, send: bool = True) -> DataFrame:
    """docs (id, text, further columns) without the spans in gone (id, start, end: characters of the text, or what
    ``cut`` makes them of). Spans that meet or overlap are one. With ``send`` the spans go to all executors while they are small, see beside_ids; else both sides are shuffled at every size. Column gone then holds the removed spans, in order."""
    lists = stored(gone.groupBy("id").agg(F.collect_set(F.struct("start", "end")).alias("gone")))
    joined = beside_ids(docs, lists, "gone", 32, "left") if send else docs.join(lists.hint("merge"), "id", "left")
    fields = ", ".join(f"`{f.name}` {SPANS if f.name == 'gone' else f.dataType.simpleString()}" for f in joined.schema)
    return joined.mapInArrow(partial(_without, cut=cut), fields)


def line_spans(text: str) -> list[tuple[int, int]]:
    """Lines by \\n, each with the newline that ends it."""
    spans, at = [], 0
    for line in text.split("\n"):
        spans.append((at, min(len(text), at + len(line) + 1)))
        at += len(line) + 1
    return spans
