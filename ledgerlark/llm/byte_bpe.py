"""Byte-level BPE in DuckDB, one connection for each Python worker.

Encoding: rows of (word, position, token) join the merge table with the token after them; in each
step of a recursive query every word contracts its leftmost pair of least rank, until no pair has
one. A long word does so in many places at once: a pair that comes first, by rank and then place, among all
within the reach of one token can't be touched by a merge before its own, wherever that happens.
Decoding: rows of (text, position, token) join the vocabulary and are aggregated in order.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.pieces import PieceTable, piece_spans
from ledgerlark.llm.storage import bounded_batches
from ledgerlark.llm.text_arrays import text_chunks, tidily

#: Steps of one recursive query; what isn't done then goes into another, so that its rows stay few.
STEPS = 24
#: Words of more bytes contract in several places in a step; as they have many rows, a query has few steps.
LONG, LONG_STEPS = 96, 3

ONE_PAIR = f"""
WITH RECURSIVE t AS (
  SELECT word, pos, tok, 0 AS step FROM start
  UNION ALL (
    WITH p AS MATERIALIZED (
      SELECT a.*, m.rank, (m.rank::BIGINT << 32) + a.pos AS key
      FROM (SELECT *, lead(tok) OVER w AS next, lead(pos) OVER w AS next_pos FROM t WINDOW w AS (ORDER BY word, pos)) a
      LEFT JOIN merges m ON m.l = a.tok AND m.r = a.next AND a.next_pos > a.pos),
    b AS MATERIALIZED (SELECT word, min(key) AS best, arg_min(next_pos, key) AS gone FROM p WHERE key IS NOT NULL GROUP BY word)
    SELECT p.word, p.pos, CASE WHEN p.key = b.best THEN p.rank ELSE p.tok END, p.step + 1
    FROM p JOIN b ON p.word = b.word WHERE p.pos <> b.gone AND p.step < {STEPS}))
SELECT word, pos, tok, step FROM t QUALIFY step = max(step) OVER (PARTITION BY word)
"""

# A pair goes if no pair within ``reach`` tokens has a lower rank. No token is longer, so what could take one of its parts
# before its turn begins with a merge there. Of equal pairs there the leftmost goes, unless their token, with
# its neighbours or itself beside it, has no merge of lower rank: then all go, and of those that overlap every second one from the
# left, if all that overlap may go.
MANY_PAIRS = f"""
WITH RECURSIVE t AS (
  SELECT word, pos, tok, reach, 0 AS step FROM start
  UNION ALL (
    WITH p AS (SELECT *, row_number() OVER w AS i, lead(tok) OVER w AS next, lead(tok, 2) OVER w AS after, lag(tok) OVER w AS prev FROM t WINDOW w AS (PARTITION BY word ORDER BY pos)),
    q AS (SELECT p.*, m.rank, x.rank IS NULL AND y.rank IS NULL AND z.rank IS NULL AS plain FROM p LEFT JOIN merges m ON m.l = p.tok AND m.r = p.next
      LEFT JOIN sooner x ON x.l = m.rank AND x.r = p.after LEFT JOIN sooner y ON y.r = m.rank AND y.l = p.prev LEFT JOIN sooner z ON z.l = m.rank AND z.r = m.rank),
    l AS (SELECT *, min(rank) OVER (PARTITION BY word) AS least,
      min(rank) OVER (PARTITION BY word ORDER BY i RANGE BETWEEN reach PRECEDING AND reach FOLLOWING) AS near,
      bool_and(plain OR rank IS NULL) OVER (PARTITION BY word ORDER BY i RANGE BETWEEN reach PRECEDING AND reach FOLLOWING) AS plains,
      min((rank::BIGINT << 32) + i) OVER (PARTITION BY word ORDER BY i RANGE BETWEEN reach PRECEDING AND reach FOLLOWING) AS first FROM q),
    h AS (SELECT *, rank IS NOT NULL AND rank = near AS hit,
      lag(rank) OVER (PARTITION BY word ORDER BY i) IS NOT DISTINCT FROM rank AND lag(tok) OVER (PARTITION BY word ORDER BY i) = tok AND tok = next AS follows FROM l WHERE least IS NOT NULL),
    g AS (SELECT *, max(CASE WHEN follows THEN NULL ELSE i END) OVER (PARTITION BY word ORDER BY i) AS head FROM h),
    c AS (SELECT *, hit AND CASE WHEN plains THEN (i - head) % 2 = 0 AND bool_and(hit) OVER (PARTITION BY word, head) ELSE first = (rank::BIGINT << 32) + i END AS taken FROM g),
    o AS (SELECT *, lag(taken, 1, false) OVER (PARTITION BY word ORDER BY i) AS gone FROM c)
    SELECT word, pos, CASE WHEN taken THEN rank ELSE tok END, reach, step + 1 FROM o WHERE NOT gone AND step < {LONG_STEPS}))
SELECT word, pos, tok, step, reach FROM t QUALIFY step = max(step) OVER (PARTITION BY word)
"""

DECODE = "SELECT t.doc, string_agg(v.hex, '' ORDER BY t.pos) AS hex FROM tokens t JOIN vocabulary v ON v.id = t.tok GROUP BY t.doc"


class Codec:
    """A rank file's vocabulary in DuckDB."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self.db.execute("SET enable_progress_bar = false")
        vocabulary = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "hex": [t.hex() for t in self.ranks]})
        found = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        merges = pa.table([pa.array(x, pa.int32()) for x in zip(*found)] if found else [pa.array([], pa.int32())] * 3, ["l", "r", "rank"])
        self.db.register("v", vocabulary).execute("CREATE TABLE vocabulary AS FROM v")
        self.db.register("m", merges).execute("CREATE TABLE merges AS FROM m")
        self.db.execute("CREATE TABLE sooner AS FROM m WHERE rank < l OR rank < r")
        self.symbol = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        #: Lengths of tokens by the bytes in them, longest first.
        longest: dict[int, int] = {}
        for token in self.ranks:
            bits = sum(1 << b for b in set(token))
            longest[bits] = max(len(token), longest.get(bits, 0))
        self.byte_sets = sorted(longest.items(), key=lambda x: -x[1])
        self.table = PieceTable(self.encode)

    def _contract(self, words: np.ndarray, pos: np.ndarray, tok: np.ndarray, reach: np.ndarray | None = None) -> list[tuple[np.ndarray, ...]]:
        """Contract words until none of their pairs has a rank; with ``reach``, in several places at once."""
        done, query, steps = [], ONE_PAIR if reach is None else MANY_PAIRS, STEPS if reach is None else LONG_STEPS
        while len(words):
            start = {"word": words, "pos": pos, "tok": tok}
            self.db.register("start", pa.table(start if reach is None else {**start, "reach": reach}))
            out = [c.to_numpy() for c in self.db.sql(query).to_arrow_table().columns]
            over = out[3] < steps
            done.append(tuple(c[over] for c in out[:3]))
            words, pos, tok, _, *more = (c[~over] for c in out)
            reach = more[0] if more else None
        return done

    def _reach(self, piece: bytes) -> int:
        """The length of the longest token made of bytes that stand in a piece."""
        own = sum(1 << b for b in set(piece))
        return next((n for bits, n in self.byte_sets if not bits & ~own), 1)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and all ids in order. A piece that is a token is that token."""
        whole = [self.ranks.get(p) for p in pieces]
        rest = [k for k, r in enumerate(whole) if r is None]
        sizes = np.array([len(pieces[k]) for k in rest], np.int64)
        data = np.frombuffer(b"".join(pieces[k] for k in rest), np.uint8)
        word = np.repeat(np.array(rest, np.int32), sizes)
        pos = (np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        long = np.repeat(sizes > LONG, sizes)
        reach = np.repeat([self._reach(pieces[k]) if n > LONG else 0 for k, n in zip(rest, sizes.tolist())], sizes).astype(np.int32)
        known = [(np.array([k for k, r in enumerate(whole) if r is not None], np.int32), np.zeros(len(whole) - len(rest), np.int32), np.array([r for r in whole if r is not None], np.int32))]
        known += self._contract(word[~long], pos[~long], self.symbol[data[~long]])
        known += self._contract(word[long], pos[long], self.symbol[data[long]], reach[long])
        word, pos, tok = (np.concatenate(x) for x in zip(*known))
        order = np.lexsort((pos, word))
        return np.bincount(word, minlength=len(pieces)).astype(np.int32), tok[order]

    def decode(self, docs: np.ndarray, tokens: np.ndarray, n: int) -> list[bytes]:
        """The bytes of each of n texts; docs names the text of each token, in order."""
        self.db.register("tokens", pa.table({"doc": docs, "pos": np.arange(len(docs)), "tok": tokens}))
        texts = [b""] * n
        out = self.db.sql(DECODE).to_arrow_table()
        for doc, text in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            texts[doc] = bytes.fromhex(text)
        return texts

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk of rows, and where each row's begin."""
        starts, ends, rows = piece_spans(data, offsets, "spaced")
        counts, at = self.table.look_up(data, starts, ends)
        bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[np.searchsorted(rows, np.arange(len(offsets)))]
        return self.table.gather(counts, at), bounds


codec = lru_cache(2)(Codec)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in tidily(batches):
        for low, data, offsets in text_chunks(batch.column(1), 1 << 20):
            ids, bounds = codec(path).tokens(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(lists)), lists], ["id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in tidily(batches):
        lists = batch.column(1)
        sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
        docs = np.repeat(np.arange(len(lists), dtype=np.int32), sizes)
        texts = codec(path).decode(docs, lists.flatten().to_numpy().astype(np.int32), len(lists))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["id", "bytes"])


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in tidily(batches):
        for low, data, offsets in text_chunks(batch.column(1), 1 << 20):
            ids, bounds = codec(path).tokens(data, offsets)
            n = len(offsets) - 1
            texts = codec(path).decode(np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds)), ids, n)
            raw = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, n), pa.array(np.diff(bounds)), pa.array([hashlib.sha256(raw[a:b].tobytes()).hexdigest() for a, b in zip(bounds, bounds[1:])]), pa.array([hashlib.sha256(t).hexdigest() for t in texts])],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def _two(df: DataFrame, id_col: str, col: str, kind: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("id"), F.col(col).cast(kind).alias("value"))


def encode(documents: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids: array of long) of whole texts; null counts as empty, which has no ids. Special tokens are text."""
    docs = _two(documents, id_col, text_col, "string")
    return docs.mapInArrow(partial(_encode, path=ranks_path), f"id {docs.schema['id'].dataType.simpleString()}, ids array<long>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes: binary) of lists of ids; a null or empty list gives no bytes."""
    rows = _two(tokens, id_col, ids_col, "array<long>")
    return rows.mapInArrow(partial(_decode, path=ranks_path), f"id {rows.schema['id'].dataType.simpleString()}, bytes binary").withColumnRenamed("id", id_col)


def round_trip(documents: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its id, n_tokens, ids_sha256 and decoded_sha256, the digests of its ids (as
    little-endian 32-bit integers) and of the bytes that these decode to.

    Null counts as empty; rows are coded each for itself, with any id; an empty table gives an empty
    result; further columns are left out. There is no shuffle.
    """
    docs = _two(documents, id_col, text_col, "string")
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(partial(_digests, path=ranks_path), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
