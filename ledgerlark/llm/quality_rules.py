"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates.

Every document is a vector of transformed text statistics. For each stratum, a language and source, estimates start
from three deterministic guesses (as in Hubert and others 2012) and improve by concentration steps over all documents:
take the part of them that is nearest by Mahalanobis distance, and estimate again from these. After two
steps the guess with the least determinant goes on until its determinant falls no more (Rousseeuw and Van Driessen 1999). To each covariance
a fixed diagonal is added, as in Boudt and others 2020, so that small or uniform strata have an estimate too; a step doesn't
raise the determinant of that sum either. Steps are grouped quantiles and sums over narrow rows, so no stratum is
ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.storage import bounded_batches, sent_if_small, stored
from ledgerlark.llm.text_arrays import SEPARATOR, U64, mix, span_hashes, text_chunks, tidily, window_hashes, words

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
FEATURES = ("size", "word_length", "symbols", "dup_lines", "repeats")
#: Least standard deviation of each feature: a stratum whose bulk is all alike must not reject
#: what differs from it by little. In the units of ``_features``.
FLOORS = (1.0, 0.15, 0.05, 0.15, 0.2)
#: Median of the chi-square distribution with five degrees of freedom.
CHI2_5_MEDIAN = 4.35146


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def text_statistics(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """STATISTICS of whole texts, a list of arrays for each chunk of rows."""
    for _, data, offsets in text_chunks(column):
        n = len(offsets) - 1
        starts, ends, rows = words(data, offsets)
        hashes = span_hashes(data, starts, ends)
        chars = _per_row(~SEPARATOR[data] & ((data & 0xC0) != 0x80), offsets)
        breaks = np.flatnonzero(data == 10)
        # lines with a word, by row: a line ends at a newline or at the row's end
        line_starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
        line_starts = line_starts[line_starts < len(data)]
        line_ends = np.append(line_starts[1:], len(data))
        line_ends = line_ends - (data[line_ends - 1] == 10) if len(data) else line_ends
        has = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        line_starts, line_ends = line_starts[has], line_ends[has]
        line_rows = np.searchsorted(offsets, line_starts, "right") - 1
        distinct = np.unique(np.stack([line_rows.astype(U64), span_hashes(data, line_starts, line_ends)]), axis=1)[0].astype(np.int64)
        n_lines = np.bincount(line_rows, minlength=n)
        triples = window_hashes(hashes, 3)
        whole = np.flatnonzero(rows[: len(triples)] == rows[len(rows) - len(triples) :])
        in_row = mix(triples[whole] + mix(rows[whole].astype(U64)))
        _, which, count = np.unique(in_row, return_inverse=True, return_counts=True)
        first = whole[count[which] > 1]
        repeated = np.zeros(len(starts), bool)
        for k in range(3):
            repeated[first + k] = True
        yield [np.bincount(rows, minlength=n), chars, _per_row(SYMBOL[data], offsets), n_lines - np.bincount(distinct, minlength=n), np.bincount(rows[repeated], minlength=n), n_lines]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tidily(batches):
        parts = [np.concatenate(x) for x in zip(*text_statistics(batch.column(0)))] or [np.zeros(0, np.int64)] * len(STATISTICS)
        yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in parts), *batch.columns[1:]], [*STATISTICS, *batch.schema.names[1:]])


def _features() -> list[Column]:
    words_, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return [
        F.log1p("n_words"),
        F.log(F.greatest("word_chars", F.lit(1)) / words_),
        F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / lines),
        F.sqrt(F.col("n_repeat_words") / words_),
    ]


def _estimate(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Numbers, sums and sums of products by stratum and start -> ESTIMATE."""
    p = len(FEATURES)
    for pdf in pdfs:
        rows = []
        for row in pdf.itertuples(index=False):
            centre, squares = np.array(row.sums) / row.n, np.zeros((p, p))
            squares[np.triu_indices(p)] = row.squares
            cov = (squares + np.triu(squares, 1).T) / row.n
            if row.spread is None:
                cov -= np.outer(centre, centre)
            elif row.start == "signs":  # sums of signs about the median, in units of the deviations
                centre, cov = np.array(row.centre), p * cov * np.outer(row.spread, row.spread)
            else:
                centre, cov = np.array(row.centre), np.diag(np.square(row.spread))
            cov[np.diag_indices(p)] = np.maximum(np.diag(cov), 0) + np.square(FLOORS)
            rows.append((row.stratum, row.start, centre.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
        yield pd.DataFrame(rows, columns=["stratum", "start", "centre", "inverse", "logdet"])


ESTIMATE = "stratum string, start string, centre array<double>, inverse array<double>, logdet double"
STARTS = ("middle", "all", "signs")
_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]


def _distance() -> Column:
    """Squared Mahalanobis distance of a row's x from its stratum's estimate."""
    p = len(FEATURES)
    gap = [F.col("x")[i] - F.col("centre")[i] for i in range(p)]
    return sum((gap[i] * gap[j] * F.col("inverse")[i * p + j] * (1 if i == j else 2) for i, j in _PAIRS), F.lit(0.0))


def _beside(rows: DataFrame, by_stratum: DataFrame, on: str | list[str] = "stratum") -> DataFrame:
    """Join estimates to rows: sent to all executors while they are small, else by a join that AQE may split."""
    return rows.join(sent_if_small(by_stratum, F.lit(400)), on)


def _sums(rows: DataFrame, by: list[str], x: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.array(*(F.sum(x[i]) for i in range(len(FEATURES)))).alias("sums"), F.array(*(F.sum(x[i] * x[j]) for i, j in _PAIRS)).alias("squares"))


def first_estimates(rows: DataFrame) -> DataFrame:
    """ESTIMATE of rows (stratum, x) by start: "middle", medians and absolute deviations; "all", the mean and covariance
    of all rows; "signs", the covariance of the directions from the medians (spatial signs)."""
    p = len(FEATURES)
    centre = stored(rows.groupBy("stratum").agg(F.array(*(F.percentile_approx(F.col("x")[i], 0.5) for i in range(p))).alias("centre")))
    gaps = _beside(rows, centre).withColumn("gap", F.transform(F.arrays_zip("x", "centre"), lambda z: z["x"] - z["centre"]))
    spread = gaps.groupBy("stratum", "centre").agg(F.array(*(1.4826 * F.percentile_approx(F.abs(F.col("gap")[i]), 0.5) + FLOORS[i] / 4 for i in range(p))).alias("spread"))
    spread = stored(spread)
    units = _beside(rows, spread).withColumn("unit", F.transform(F.arrays_zip("x", "centre", "spread"), lambda z: (z["x"] - z["centre"]) / z["spread"]))
    length = F.sqrt(F.aggregate("unit", F.lit(0.0), lambda s, v: s + v * v))
    signs = units.withColumn("sign", F.transform("unit", lambda v: F.when(length > 0, v / length).otherwise(0.0)))
    none = F.lit(None).cast("array<double>")
    plain = _sums(rows, ["stratum"], F.col("x")).select("stratum", F.lit("all").alias("start"), "n", "sums", "squares", none.alias("centre"), none.alias("spread"))
    signs = _sums(signs, ["stratum", "centre", "spread"], F.col("sign")).select("stratum", F.lit("signs").alias("start"), "n", "sums", "squares", "centre", "spread")
    return stored(plain.unionByName(signs).unionByName(signs.withColumn("start", F.lit("middle"))).mapInPandas(_estimate, ESTIMATE))


def concentrated(rows: DataFrame, estimate: DataFrame, part: float) -> DataFrame:
    """One concentration step: ESTIMATE from the ``part`` of each stratum's rows that are nearest to the estimate given, by start.
    The part is exact for up to 10,000 rows of a stratum and true to one in 10,000 above; rows as far as the last one belong to it."""
    near = _beside(rows, estimate.drop("logdet")).select("stratum", "start", "x", _distance().alias("d2"))
    cut = stored(near.groupBy("stratum", "start").agg(F.percentile_approx("d2", part, 10_000).alias("cut")))
    none = F.lit(None).cast("array<double>")
    inside = _beside(near, cut, ["stratum", "start"]).where("d2 <= cut")
    return stored(_sums(inside, ["stratum", "start"], F.col("x")).withColumns({"centre": none, "spread": none}).mapInPandas(_estimate, ESTIMATE))


def least_determinants(rows: DataFrame, *, part: float, steps: int) -> DataFrame:
    """ESTIMATE with the least determinant that the starts lead to, one row a stratum."""
    estimate = first_estimates(rows)
    for _ in range(2):
        estimate = concentrated(rows, estimate, part)
    best = stored(estimate.groupBy("stratum").agg(F.min_by(F.struct("start", "centre", "inverse", "logdet"), F.struct("logdet", "start")).alias("e")).select("stratum", "e.*"))
    for _ in range(steps):
        after = concentrated(rows, best, part)
        both = best.select("stratum", F.col("logdet").alias("was")).join(after.select("stratum", "logdet"), "stratum")
        fall = both.agg(F.max(F.col("was") - F.col("logdet"))).first()[0] or 0.0
        best = after
        if fall < 1e-6:
            break
    return best


def robust_distances(rows: DataFrame, *, part: float, steps: int) -> DataFrame:
    """rows (stratum, x: array of features, further columns) with d2, their squared robust distance,
    scaled in each stratum so that its median is that of a normal distribution."""
    best = least_determinants(rows, part=part, steps=steps).select("stratum", "centre", "inverse")
    far = _beside(rows, best).withColumn("d2", _distance()).drop("centre", "inverse")
    scale = stored(far.groupBy("stratum").agg(F.percentile_approx("d2", 0.5).alias("middle")))
    return _beside(far, scale).withColumn("d2", F.col("d2") * CHI2_5_MEDIAN / F.greatest("middle", F.lit(CHI2_5_MEDIAN / 4))).drop("middle")


def quality_verdicts(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", *, keep: tuple[str, ...] = ("doc_id",), part: float = 0.75, steps: int = 8, cut: float = 100.0) -> DataFrame:
    """One row for each document: the columns ``keep``, n_words, word_chars, n_symbols, n_dup_lines and
    n_repeat_words (long), base_failed, d2 (double, null if not judged) and kept (boolean).

    base_failed: fewer than 50 words, or over half the words in repeated three-word windows. Otherwise
    kept is false when the squared robust distance exceeds ``cut`` (at 100 a document lies ten robust
    deviations off). All documents with a word make the estimates, of each language and source its own, however few they
    are; ``steps`` is the most concentration steps after the first two. Null text counts as empty; null language or source is a value of its own; equal rows are judged
    alike, each for itself. An empty table gives an empty result.
    """
    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"), F.col(source_col).cast("string").alias("_source"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)))
    kept = docs.drop("_text").schema
    fields = ", ".join([*(f"{s} long" for s in STATISTICS), *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)])
    stats = stored(docs.mapInArrow(_statistics, fields))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stats.withColumn("base_failed", base)

    stratum = F.when(F.col("n_words") > 0, F.to_json(F.struct("_lang", "_source")))
    rows = stored(stats.withColumns({"stratum": stratum, "x": F.array(*_features())}))
    far = robust_distances(rows.where("stratum is not null"), part=part, steps=steps)
    out = far.unionByName(rows.where("stratum is null").withColumn("d2", F.lit(None).cast("double")))
    verdict = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cut)
    return out.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), *STATISTICS[:5], "base_failed", "d2", verdict.alias("kept"))
