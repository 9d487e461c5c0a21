"""Best-fit packing of tokenised documents under several capacities at once.

A piece demands tokens, one place among a sequence's documents, and the square of its tokens as
attention cost. Pieces are placed by falling demand; each goes to the open sequence that can hold it under
every capacity and scores best: least norm of what would be left ("norm"), or largest weighted dot
product of demand and what is left ("dot").
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.pieces import PieceTable, piece_spans
from ledgerlark.llm.storage import bounded_batches, stored
from ledgerlark.llm.text_arrays import text_chunks, tidily

#: A special token that the tokenizer finds inside texts before it splits them.
SPECIAL = b"<|endoftext|>"


def best_fit(tokens: np.ndarray, capacities: tuple[float, float, float], weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each piece, and its offset there in tokens."""
    caps = np.array(capacities, float)
    demand = np.stack([tokens, np.ones(len(tokens)), np.square(tokens, dtype=float)], axis=1) / caps
    if len(demand) and demand.max() > 1:
        raise ValueError("a piece is larger than a capacity")
    w = np.array(weights)
    order = np.argsort(-(demand @ w), kind="stable")
    least = demand.min(axis=0) if len(demand) else np.zeros(3)
    left, names, filled = np.zeros((64, 3)), np.zeros(64, np.int64), np.zeros(64, np.int64)
    n_open = n_all = 0
    where, offset = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
    for k in order:
        d = demand[k]
        room = left[:n_open]
        fits = np.flatnonzero((room >= d - 1e-12).all(axis=1))
        if len(fits):
            score = -(np.square(room[fits] - d) @ w) if rule == "norm" else room[fits] @ (w * d)
            b = int(fits[np.argmax(score)])
        else:
            if n_open == len(left):
                left, names, filled = np.concatenate([left, left]), np.concatenate([names, names]), np.concatenate([filled, filled])
            b, n_open, n_all = n_open, n_open + 1, n_all + 1
            left[b], names[b], filled[b] = 1.0, n_all - 1, 0
        where[k], offset[k] = names[b], filled[b]
        left[b] -= d
        filled[b] += tokens[k]
        if (left[b] < least - 1e-12).any():  # nothing fits any more
            n_open -= 1
            left[b], names[b], filled[b] = left[n_open], names[n_open], filled[n_open]
    return where, offset


@lru_cache(2)
def _tokenizer(path: str) -> tuple:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = []
        for k in range(0, len(pieces), 5_000):  # the library's encodings are large beside their ids
            ids += [e.ids for e in tokenizer.encode_batch_fast([p.decode() for p in pieces[k : k + 5_000]], add_special_tokens=False)]
        return np.array([len(x) for x in ids], np.int32), np.array([i for x in ids for i in x], np.int32)

    return tokenizer, PieceTable(encode, most=400_000)


def _token_pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, length: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """(id, text) -> id, piece, start, length, ids_crc32, perhaps ids."""
    tokenizer, table = _tokenizer(path)
    for batch in tidily(batches):
        doc_ids = batch.column(0)
        for low, data, offsets in text_chunks(batch.column(1), 1 << 20):
            starts, ends, rows = piece_spans(data, offsets, "spaced")
            counts, at = table.look_up(data, starts, ends)
            tokens = table.gather(counts, at)
            bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[np.searchsorted(rows, np.arange(len(offsets)))]
            raw = data.tobytes()
            special = SPECIAL in raw
            docs, piece, start, size, crc, kept = [], [], [], [], [], []
            for r in range(len(offsets) - 1):
                ids = tokens[bounds[r] : bounds[r + 1]]
                if special and SPECIAL in raw[offsets[r] : offsets[r + 1]]:
                    ids = tokenizer.encode(raw[offsets[r] : offsets[r + 1]].decode(), add_special_tokens=False).ids
                ids = np.append(ids, end_id).astype("<u4")
                cuts = [0, *range(len(ids) % length or length, len(ids) + 1, length)] if len(ids) > length else [0, len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    docs.append(low + r)
                    piece.append(k)
                    start.append(a)
                    size.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        kept.append(ids[a:b].astype(np.int64))
            columns = [doc_ids.take(pa.array(docs, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.list_(pa.int64()))] if with_ids else [])], [*names, *(["ids"] if with_ids else [])])


def token_pieces(documents: DataFrame, id_col: str, text_col: str, tokenizer_path: str, *, end_id: int = 2, length: int = 1024, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, perhaps ids): each document's token ids and end_id, cut into
    pieces of ``length`` if there are more, the first of them the shorter one. Null text counts as empty."""
    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    fields = "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.mapInArrow(partial(_token_pieces, path=tokenizer_path, end_id=end_id, length=length, with_ids=with_ids), fields)


def _pack(pdf: pd.DataFrame, capacities: tuple, weights: tuple, rule: str) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "id", "piece"], ascending=[False, True, True], ignore_index=True)
    where, offset = best_fit(pdf["length"].to_numpy(), capacities, weights, rule)
    return pdf.assign(sequence_id=pdf["pack"].astype(np.int64) * (1 << 32) + where, offset=offset).drop(columns="pack")


def pack_pieces(pieces: DataFrame, *, tokens: int = 1024, documents: int | None = None, attention: int | None = None, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm", group_rows: int = 20_000) -> DataFrame:
    """pieces (id, piece, length, further columns) with sequence_id and offset, none over a capacity.

    Without ``documents`` and ``attention`` these capacities are what ``tokens`` pieces of one token, and one piece of
    ``tokens``, demand: they then bind never. Pieces are dealt by hash to groups of about ``group_rows``, each with the same mix of
    lengths, and packed group by group: what this costs is less than one sequence a group. The hash takes in each row's place in
    the written table, so rows that share an id, or have none, don't meet in one group. sequence_id names the group and
    the sequence. An empty table gives an empty result; equal rows are packed each.
    """
    pieces = stored(pieces)
    groups = max(1, round(pieces.count() / group_rows))
    capacities = (float(tokens), float(documents or tokens), float(attention or tokens**2))
    dealt = pieces.withColumn("pack", F.pmod(F.xxhash64("id", "piece", F.monotonically_increasing_id()), F.lit(groups)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return _pack(pdf, capacities, weights, rule)

    return dealt.groupBy("pack").applyInPandas(pack, fields)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, document_ids, lengths): sequences written out, from pieces packed with their ids."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "id", "length"))).alias("rows"))
    return rows.select("sequence_id", F.flatten("rows.ids").alias("ids"), F.col("rows.id").alias("document_ids"), F.col("rows.length").alias("lengths"))


def best_fit_packing(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 2, length: int = 1024, **packing) -> DataFrame:
    """Pack whole documents into sequences of at most ``length`` tokens: one row for each piece with its
    id, piece, start, length, ids_crc32, sequence_id and offset (see token_pieces and pack_pieces).

    Every row gives pieces, equal rows and null ids too; a null or empty text is one piece, the end id alone.
    """
    pieces = token_pieces(documents, id_col, text_col, tokenizer_path, end_id=end_id, length=length)
    return pack_pieces(pieces, tokens=length, **packing).withColumnRenamed("id", id_col)
