"""Embedding near-dedup by int8 quantised tile products with rigorous error bounds.

Each unit vector x is written as s*q + e: q int8, s its own scale, |e| its measured error. Then
x.y lies within |s q|_x |e|_y + |e|_x |s q|_y + |e|_x |e|_y of s_x s_y (q_x . q_y). Tiles of q are
multiplied as float32, where these sums of integers are exact; only pairs whose interval holds the
threshold are computed again in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.components import connected_components
from ledgerlark.llm.storage import stored

#: For rounding in double precision, far above what it amounts to.
SLACK = 1e-9
#: Dimensions whose int8 products float32 adds without error: 127 * 127 * 1040 < 2**24.
EXACT_DIMS = 1040


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, lengths of the quantised vectors, and lengths of the errors, of unit vectors."""
    scale = np.abs(vectors).max(axis=1) / 127
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.linalg.norm(back, axis=1), np.linalg.norm(vectors - back, axis=1) + SLACK


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow in the squares
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


ENCODED = "rep long, n long, k1 long, k2 long, dims int, unit binary, codes binary, scale double, length double, error double"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, n, k1, k2, embedding -> ENCODED; unit is the unit vector as float64 bytes."""
    for batch in batches:
        lists = batch.column(4)
        sizes = np.asarray(lists.value_lengths(), np.int64)
        flat, ends = np.asarray(lists.flatten(), np.float64), np.cumsum(sizes)
        for dims in np.unique(sizes):
            rows = np.flatnonzero(sizes == dims)
            unit = _unit(flat[(ends[rows] - dims)[:, None] + np.arange(dims)])
            codes, *numbers = quantise(unit)
            kept = [batch.column(k).take(pa.array(rows)) for k in range(4)]
            columns = [*kept, pa.array(np.full(len(rows), dims, np.int32)), *(pa.array([v.tobytes() for v in x], pa.binary()) for x in (unit, codes)), *map(pa.array, numbers)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ENCODED.split(", ")])


class _Side:
    """One block of a cell, by rising scale so that a tile's scales differ little."""

    def __init__(self, rows: pd.DataFrame, base: int):
        order = np.argsort(rows["scale"].to_numpy(), kind="stable")
        rows = rows.iloc[order]
        self.at = base + order
        self.scale, self.length, self.error, self.weight = (rows[c].to_numpy() for c in ("scale", "length", "error", "n"))
        dims = int(rows["dims"].iloc[0]) if len(rows) else 1
        self.codes = np.frombuffer(b"".join(rows["codes"]), np.int8).reshape(-1, dims).astype(np.float32)
        self.unit = np.frombuffer(b"".join(rows["unit"]), np.float64).reshape(-1, dims)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[1] <= EXACT_DIMS:
        return a @ b.T
    return sum((a[:, k : k + EXACT_DIMS] @ b[:, k : k + EXACT_DIMS].T).astype(np.float64) for k in range(0, a.shape[1], EXACT_DIMS))


def _tile_links(x: _Side, y: _Side, r: slice, c: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns (within the sides) of the tile's pairs whose cosine is at least the threshold."""
    found = _products(x.codes[r], y.codes[c])
    n, e = y.length[c].max(), y.error[c].max()
    most = x.length[r] * e + x.error[r] * n + x.error[r] * e
    need = (threshold - most) / (x.scale[r] * y.scale[c].max())
    need = np.where(threshold > most, need, -np.inf)
    i, j = np.nonzero(found >= np.nextafter(need.astype(np.float32), np.float32(-np.inf))[:, None])
    if not len(i):
        return i, j
    near, i, j = found[i, j].astype(np.float64), i + r.start, j + c.start
    near *= x.scale[i] * y.scale[j]
    bound = x.length[i] * y.error[j] + x.error[i] * y.length[j] + x.error[i] * y.error[j] + SLACK
    sure = near - bound >= threshold
    for k in np.array_split(np.flatnonzero(~sure & (near + bound >= threshold)), max(1, len(i) // 100_000)):
        sure[k] = np.einsum("ij,ij->i", x.unit[i[k]], y.unit[j[k]]) >= threshold
    return i[sure], j[sure]


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the ends of links; label[k] is the least index of k's component."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, label[label]):
            label = label[label]
    return label


def _cell(pdf: pd.DataFrame, threshold: float, tile: int) -> pd.DataFrame:
    """Links of a cell's two blocks (or within its one): linked weight and local component by class."""
    pdf = pdf.sort_values(["side", "rep"], ignore_index=True)
    cut = int((pdf["side"] == 0).sum())
    alone = pdf["low"].iloc[0] == pdf["high"].iloc[0]
    x = _Side(pdf.iloc[:cut], 0)
    y = x if alone else _Side(pdf.iloc[cut:], cut)
    linked, label = np.zeros(len(pdf)), np.arange(len(pdf))
    for r in range(0, len(x.at), tile):
        for c in range(r if alone else 0, len(y.at), tile):
            i, j = _tile_links(x, y, slice(r, min(r + tile, len(x.at))), slice(c, min(c + tile, len(y.at))), threshold)
            if alone and c == r:
                i, j = i[i < j], j[i < j]
            linked += np.bincount(x.at[i], y.weight[j], len(pdf)) + np.bincount(y.at[j], x.weight[i], len(pdf))
            label = _merge(label, x.at[i], y.at[j])
    hit = np.flatnonzero(linked)
    rep = pdf["rep"].to_numpy()
    least = pd.Series(rep).groupby(label).min()
    return pd.DataFrame({"k1": pdf["k1"].to_numpy()[hit], "k2": pdf["k2"].to_numpy()[hit], "rep": rep[hit], "root": least.loc[label[hit]].to_numpy(), "linked": linked[hit].astype(np.int64)})


def embedding_near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, threshold: float = 0.95, block_rows: int = 8192, tile: int = 1024) -> DataFrame:
    """One row for each vector: its id, n_links (long: other rows linked directly), component_id (the
    smallest id that links reach) and kept (boolean: id = component_id).

    Two vectors link when their cosine in double precision is at least ``threshold``. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. Equal vectors are compared once and counted by their number. A repeated id is
    one node for component_id, and each of its rows counts in n_links. A row whose id is null has no
    link, a null component and isn't kept. An empty table gives an empty result; further columns are left out.

    Vectors are dealt by hash to blocks of about ``block_rows``; a cell compares two blocks and gives
    a row for each linked vector, never a row for each pair. A group of very many copies therefore
    costs no more rows than others.
    """
    e, i = F.col("embedding"), F.col("id")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"))
    fit = F.coalesce(i.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False))
    keyed = stored(rows.select("id", fit.alias("fit"), F.when(fit, e).alias("embedding"), F.xxhash64(e).alias("k1"), F.xxhash64(F.lit(1), e).alias("k2")))
    classes = keyed.where("fit").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    classes = stored(classes)
    blocks = max(1, -(-classes.count() // block_rows))
    encoded = classes.select("rep", "n", "k1", "k2", "embedding").mapInArrow(_encode, ENCODED)
    encoded = encoded.withColumn("block", F.pmod(F.xxhash64("k1", "k2"), F.lit(blocks)).cast("int"))
    cells = encoded.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    cells = cells.withColumn("side", F.when(F.col("block") == F.col("low"), 0).otherwise(1))
    found = stored(
        cells.groupBy("dims", "low", "high").applyInPandas(lambda pdf: _cell(pdf, threshold, tile), "k1 long, k2 long, rep long, root long, linked long")
    )
    totals = found.groupBy("k1", "k2").agg(F.sum("linked").alias("linked"))
    by_id = keyed.where("fit").join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).select("id", "rep").where("id <> rep").distinct()
    component = connected_components(found.select("rep", F.col("root").alias("hub")).unionByName(by_id.select("rep", F.col("id").alias("hub"))), "rep", "hub")
    out = keyed.join(classes.select("k1", "k2", "n").join(totals, ["k1", "k2"], "left"), ["k1", "k2"], "left")
    out = out.join(component.withColumnRenamed("node", "id"), "id", "left")
    links = F.when(F.col("fit"), F.col("n") - 1 + F.coalesce("linked", F.lit(0))).otherwise(0)
    root = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), links.cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(i == root, F.lit(False)).alias("kept"))

