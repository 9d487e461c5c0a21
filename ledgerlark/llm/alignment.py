"""Alignment of two tokenizers' tokens of the same texts, by packed bitsets over bytes.

For a run of texts one bit for each byte says whether a token of A ends there, another whether one of B does. Where both are set, both
token rows can be cut; the set bits up to a cut (popcounts, summed once) tell how many tokens of each lie before it. Where either is
set, a stretch ends that one token of A and one of B cover: each stretch is a link, and each link one stretch.

How often an id pair is linked is counted over all texts. Pairs that make up much of all rows are few, by the size of
the share alone, so their counts go to every task; all others meet theirs by a shuffle in which no key is frequent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.backtracking_bpe import vocabulary
from ledgerlark.llm.offset_table import OffsetTable, decimals
from ledgerlark.llm.storage import bounded_batches, stored
from ledgerlark.llm.text_arrays import text_chunks, tidily

#: A pair with more than one in this many of all rows (document, pair) is frequent: at most so many pairs are, 16 bytes each.
FREQUENT_SHARE = 400_000
#: Links of an id pair, A's id in the upper half: the key of counts.
LOW = 0xFFFFFFFF


class Bits:
    """A packed bitset over bytes with the number of set bits before each of its own bytes."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros(size, bool)
        flags[places] = True
        return cls(np.packbits(flags, bitorder="little"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.packed & other.packed)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.packed | other.packed)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Set bits before each place; a place may be the size."""
        at, within = places >> 3, places & 7
        padded = np.append(self.packed, np.uint8(0))
        return self.before[at] + np.bitwise_count(padded[at] & ((1 << within) - 1).astype(np.uint8))

    def select(self) -> np.ndarray:
        """The places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.packed, bitorder="little"))


class Pieces:
    """A SentencePiece model and the bytes of its pieces."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.vocab_size())]
        entries = [bytes([int(name[1:-1], 16)]) if self.model.is_byte(k) else name.replace("▁", " ").encode() for k, name in enumerate(names)]
        self.offsets, self.decimals = OffsetTable(entries), decimals(len(entries))


pieces = lru_cache(2)(Pieces)


class Aligned:
    """The tokens of a run of texts, their groups and links. Bounds of rows are places in the token, group or link lists."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, path_a: str, path_b: str):
        self.n = len(offsets) - 1
        sizes = np.diff(offsets)
        full = sizes > 0
        # a space before each text that isn't empty
        spaced = np.insert(data, offsets[:-1][full], 0x20)
        bounds = np.concatenate([[0], np.cumsum(sizes + full)])
        (v, table), p = vocabulary(path_a), pieces(path_b)
        raw = data.tobytes()
        texts = [raw[x:y].decode() for x, y in zip(offsets[:-1][full].tolist(), offsets[1:][full].tolist())]
        found = iter(p.model.encode(texts, num_threads=1) if texts else [])
        rows = [next(found) if f else [] for f in full.tolist()]
        b = np.fromiter((t for row in rows for t in row), np.int64)
        b_rows = np.concatenate([[0], np.cumsum([len(row) for row in rows], dtype=np.int64)])
        a, a_rows = v.tokens(table, spaced, bounds, special=False)
        a_bytes, a_bounds = v.offsets.gather(a)
        b_bytes, b_bounds = p.offsets.gather(b)
        # a text whose tokens don't give its bytes back has none
        kept = full.copy()
        for bytes_, own in ((a_bytes, a_bounds[a_rows]), (b_bytes, b_bounds[b_rows])):
            for k in np.flatnonzero(kept).tolist():
                kept[k] = np.array_equal(bytes_[own[k] : own[k + 1]], spaced[bounds[k] : bounds[k + 1]])
        a, a_rows, a_sizes = _kept(a, a_rows, kept, v.offsets.sizes)
        b, b_rows, b_sizes = _kept(b, b_rows, kept, p.offsets.sizes)
        self.a, self.b, self.a_rows, self.b_rows = a, b, a_rows, b_rows
        self.ends = np.concatenate([[0], np.cumsum(np.where(kept, sizes + full, 0))])
        size = int(self.ends[-1])
        ends_a, ends_b = Bits.of(np.cumsum(a_sizes) - 1, size), Bits.of(np.cumsum(b_sizes) - 1, size)
        shared, either = ends_a & ends_b, ends_a | ends_b
        cuts = shared.select() + 1
        #: Tokens of A and of B up to the end of each group.
        self.group_a, self.group_b = ends_a.rank(cuts), ends_b.rank(cuts)
        self.groups = shared.rank(self.ends)
        starts = np.concatenate([[0], either.select() + 1])[:-1]
        #: Places in a and b of the two tokens of each link.
        self.link_a, self.link_b = ends_a.rank(starts), ends_b.rank(starts)
        self.links = either.rank(self.ends)
        self.decimals_a, self.decimals_b = v.decimals, p.decimals

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of each row, how often each is linked, and the rows' bounds in these."""
        key = (self.a.astype(np.int64)[self.link_a] << 32) | self.b[self.link_b]
        row = np.repeat(np.arange(self.n), np.diff(self.links))
        order = np.lexsort((key, row))
        key, row = key[order], row[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(key)))
        return key[first], counts, np.searchsorted(row[first], np.arange(self.n + 1))

    def written_groups(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for each row: the ids of each group."""
        of_a = np.searchsorted(self.group_a, np.arange(len(self.a)), "right")
        of_b = np.searchsorted(self.group_b, np.arange(len(self.b)), "right")
        at_a = np.arange(len(self.a)) + np.concatenate([[0], self.group_b])[of_a]
        at_b = np.arange(len(self.b)) + self.group_a[of_b]
        na = len(self.decimals_a.sizes)
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        ids[at_a], ids[at_b] = self.a, self.b + na
        both = _both(self.decimals_a, self.decimals_b)
        flat, places = both.gather(ids)
        last_a, last_b = at_a[self.group_a - 1], at_b[self.group_b - 1]
        flat[places[last_a + 1] - 1], flat[places[last_b + 1] - 1] = ord("|"), ord(";")
        bounds = places[self.a_rows + self.b_rows].tolist()
        view = memoryview(flat)
        return [bytes(view[x : max(x, y - 1)]) for x, y in zip(bounds, bounds[1:])]


@lru_cache(2)
def _both(one: OffsetTable, other: OffsetTable) -> OffsetTable:
    joined = OffsetTable([])
    joined.data = np.concatenate([one.data, other.data])
    joined.sizes = np.concatenate([one.sizes, other.sizes])
    joined.starts = np.concatenate([one.starts, other.starts + len(one.data)])
    return joined


def _kept(ids: np.ndarray, rows: np.ndarray, kept: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = np.diff(rows)
    own = ids[np.repeat(kept, counts)].astype(np.int64)
    return own, np.concatenate([[0], np.cumsum(np.where(kept, counts, 0))]), sizes[own]


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _chunks(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[tuple[pa.Array, Aligned]]:
    for batch in tidily(batches):
        for low, data, offsets in text_chunks(batch.column(1), 1 << 19):
            yield batch.column(0).slice(low, len(offsets) - 1), Aligned(data, offsets, path_a, path_b)


def _groups(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    for ids, own in _chunks(batches, path_a, path_b):
        sizes = [np.diff(np.concatenate([[0], g])) for g in (own.group_a, own.group_b)]
        columns = [_lists(own.a, own.a_rows, pa.int64()), _lists(own.b, own.b_rows, pa.int64()), *(_lists(s, own.groups, pa.int32()) for s in sizes)]
        for side, rows in ((own.link_a, own.a_rows), (own.link_b, own.b_rows)):
            columns.append(_lists(side - np.repeat(rows[:-1], np.diff(own.links)), own.links, pa.int32()))
        yield pa.RecordBatch.from_arrays([ids, *columns], ["id", "a_ids", "b_ids", "group_a_sizes", "group_b_sizes", "link_a", "link_b"])


def _summaries(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    for ids, own in _chunks(batches, path_a, path_b):
        key, counts, bounds = own.pairs()
        digests = [hashlib.sha256(g).hexdigest() if g else "" for g in own.written_groups()]
        numbers = [pa.array(np.diff(x), pa.int64()) for x in (own.a_rows, own.b_rows, own.groups, own.links)]
        columns = [ids, *numbers, pa.array(digests, pa.string()), _lists(key, bounds, pa.int64()), _lists(counts, bounds, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def _two(documents: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return docs, docs.schema["id"].dataType.simpleString()


def aligned_tokens(documents: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a_ids, b_ids, group_a_sizes, group_b_sizes, link_a, link_b) of every row: both token rows, how many tokens of each are in
    each group, and for each link the places of its two tokens in a_ids and b_ids.

    A null or empty text, and one whose tokens don't join to a space and the text again, has no tokens and empty lists. Rows with
    the same id are rows of their own; an empty table gives an empty result; further columns are left out. No shuffle.
    """
    docs, kind = _two(documents, id_col, text_col)
    fields = f"id {kind}, a_ids array<long>, b_ids array<long>, group_a_sizes array<int>, group_b_sizes array<int>, link_a array<int>, link_b array<int>"
    return docs.mapInArrow(partial(_groups, path_a=path_a, path_b=path_b), fields).withColumnRenamed("id", id_col)


def _row_pairs(rows: DataFrame, *more: str) -> DataFrame:
    zipped = F.explode(F.arrays_zip("pairs", "times"))
    return rows.select(*more, zipped.alias("p")).select(*more, F.col("p.pairs").alias("pair"), F.col("p.times").cast("long").alias("times"))


def _pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, links, n_rows, best): links of each id pair, rows that have it, and whether no pair of its B id has more."""
    counts = _row_pairs(rows).groupBy("pair").agg(F.sum("times").alias("links"), F.count("*").alias("n_rows"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(LOW)))  # holds a row for each id of A at most
    return counts.withColumn("best", F.col("links") == F.max("links").over(of_b))


def _sums(links: Column, best: Column) -> list[Column]:
    return [F.sum(F.when(best, F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * links).alias("count_sum")]


def token_alignment(documents: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", *, frequent_share: int = FREQUENT_SHARE) -> DataFrame:
    """One row for each document: its id, n_a and n_b tokens, n_groups, n_links, n_best (links whose id pair is
    linked as often, over all documents, as any of its B id), count_sum (over links, how often their pair is linked), groups_sha256.

    A null or empty text, and one whose tokens don't join to a space and the text again, has zeros and an empty digest. Rows with the
    same id, or none, are rows of their own; an empty table gives an empty result; further columns are left out. Each row's
    distinct pairs are written once; sums by row come together in the task that reads the row, but for rare pairs.
    """
    docs, kind = _two(documents, id_col, text_col)
    fields = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    rows = stored(docs.mapInArrow(partial(_summaries, path_a=path_a, path_b=path_b), fields).withColumn("row", F.monotonically_increasing_id()))
    counts = stored(_pair_counts(rows))
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    often = F.col("n_rows") > total // frequent_share
    frequent = F.broadcast(counts.where(often).select("pair", "links", "best"))
    rare = counts.where(~often).select("pair", "links", "best")
    met = _row_pairs(rows, "row").join(frequent, "pair").groupBy("row").agg(*_sums(F.col("links"), F.col("best")))
    others = _row_pairs(rows, "row").join(frequent, "pair", "left_anti").join(rare.hint("shuffle_hash"), "pair").groupBy("row").agg(*_sums(F.col("links"), F.col("best")))
    plain = rows.select("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    none = [F.lit(0).cast("long").alias(c) for c in ("n_best", "count_sum")]
    empty = [F.lit(None).cast(plain.schema[c].dataType).alias(c) for c in plain.columns if c != "row"]
    parts = plain.select("*", *none).unionByName(met.unionByName(others).select("row", *empty, "n_best", "count_sum"))
    firsts = [F.max(c).alias(c) for c in plain.columns if c not in ("row", "id")]
    joined = parts.groupBy("row").agg(F.max_by("id", F.col("n_a")).alias("id"), *firsts, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return joined.drop("row").withColumnRenamed("id", id_col)
