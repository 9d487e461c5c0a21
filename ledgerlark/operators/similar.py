"""Texts alike by spelling, without blocks: a prefix filter over rare pairs of two-character pieces.

A text of sorted tokens is cut into its two-character pieces, ends marked. If two texts of lengths a and b have a common subsequence of
length c, at least 3c - a - b + 1 pieces are in both, as each of the a + b - 2c characters that differ breaks one of the c + 1 bonds at most.
So with pieces ordered by how many texts hold them, rarest first, the first few of either text share two, and texts meet on these two.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators.catalog import written

#: Texts above this length meet on one shared piece instead of two, as pairs of pieces grow with the square of the length.
LONG = 64


def sorted_form(text: Column) -> Column:
    """The tokens of a text in order: all that the set and sort ratios see of it."""
    return F.array_join(F.array_sort(F.filter(F.split(text, " "), lambda t: t != "")), " ")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once for a row, not once for each element that a lambda inside ``use`` sees."""
    return F.transform(F.array(value), use)[0]


def pieces(text: Column) -> Column:
    """Two-character pieces with marked ends, in order, equal ones numbered, so that sets of them count as bags."""

    def numbered(found: Column) -> Column:
        return F.transform(found, lambda piece, i: F.concat(piece, (i + 1 - F.array_position(found, piece)).cast("string")))

    def cut(marked: Column) -> Column:
        return F.sort_array(F.transform(F.sequence(F.lit(1), F.length(marked) - 1), lambda i: F.substring(marked, i, F.lit(2))))

    return _once(_once(F.concat(F.lit("\x01"), text, F.lit("\x02")), cut), numbered)


def _rarest_first(texts: DataFrame) -> DataFrame:
    """(text, pieces, length) of distinct texts, pieces ordered by the number of texts that hold them."""
    cut = written(texts.select("text", F.explode(pieces(F.col("text"))).alias("piece")))
    counts = cut.groupBy("piece").agg(F.count("*").alias("n"))
    order = F.sort_array(F.collect_list(F.struct("n", "piece")))
    ordered = cut.join(counts, "piece").groupBy("text").agg(F.transform(order, lambda x: x["piece"]).alias("pieces"))
    return written(ordered.withColumns({"length": F.length("text"), **{f"bits{half}": _bits(half) for half in (0, 1)}}))


def _bits(half: int) -> Column:
    """One half of 128 bits, set where a piece's hash falls: a bit that one text has and another lacks stands for a piece that it lacks, at least."""
    place = lambda piece: F.pmod(F.xxhash64(piece), F.lit(128))
    ours = F.filter("pieces", lambda piece: F.floor(place(piece) / 64) == half)
    one = lambda piece: F.call_function("shiftleft", F.lit(1).cast("long"), (place(piece) % 64).cast("int"))
    return F.aggregate(ours, F.lit(0).cast("long"), lambda bits, piece: bits.bitwiseOR(one(piece)))


def _keys(rows: DataFrame, share: float, shared: int) -> DataFrame:
    """(text, length, bits, key): hashes of each ``shared`` (one or two) of the pieces that come first."""
    broken = (2 - 3 * share) + (1 - 3 * share) * share / (1 - share)
    first = F.slice("pieces", 1, F.floor(F.col("length") * broken + 1e-9).cast("int") + shared)

    def paired(first: Column) -> Column:
        return F.flatten(F.transform(first, lambda a, i: F.transform(F.slice(first, i + 2, F.size(first)), lambda b: F.xxhash64(a, b))))

    keys = F.transform(first, lambda a: F.xxhash64(a)) if shared == 1 else _once(first, paired)
    return rows.select("text", "length", "bits0", "bits1", F.explode(keys).alias("key"))


def candidate_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Distinct (l, r) of left (text) and right (text), all whose ratio 200c / (a + b) reaches ``least`` (80 or more) and few others: each
    shares the rare pieces and as many pieces in all as the ratio needs. Null and empty texts meet none; equal texts meet."""
    if least < 80:
        raise ValueError("two shared pieces are certain from 80 on")
    share = least / 200
    left, right = (side.where("text <> ''").select("text").distinct() for side in (left, right))
    ordered = _rarest_first(left.union(right).distinct())
    ours, theirs = ordered.join(left, "text", "left_semi"), ordered.join(right, "text", "left_semi")
    nearest = share / (1 - share)

    def needed(total: Column) -> Column:
        return 3 * F.ceil(total * share - 1e-9) - total + 1

    def lacking(ours: str, theirs: str) -> Column:
        return sum(F.bit_count(F.col(f"{ours}{half}").bitwiseAND(F.bitwise_not(F.col(f"{theirs}{half}")))) for half in (0, 1))

    def met(ours: DataFrame, theirs: DataFrame, shared: int, fits: Column) -> DataFrame:
        a, b = _keys(ours, share, shared).toDF("l", "a", "x0", "x1", "key"), _keys(theirs, share, shared).toDF("r", "b", "y0", "y1", "key")
        alike = F.least("a", "b") >= F.greatest("a", "b") * nearest - 1e-9
        least_shared = needed(F.col("a") + F.col("b"))
        enough = (lacking("x", "y") <= F.col("a") + 1 - least_shared) & (lacking("y", "x") <= F.col("b") + 1 - least_shared)
        return a.join(b, (a["key"] == b["key"]) & alike & enough & fits).select("l", "r")

    short, long = F.col("length") <= LONG, F.col("length") >= LONG * nearest - 1
    pairs = met(ours.where(short), theirs.where(short), 2, F.lit(True)).union(met(ours.where(long), theirs.where(long), 1, F.greatest("a", "b") > LONG))
    both = F.size(F.array_intersect(pieces(F.col("l")), pieces(F.col("r"))))
    # Written, as Catalyst would move this filter below the distinct and work out the pieces for every row of the join.
    return written(pairs.distinct()).where(both >= needed(F.length("l") + F.length("r")))


def similar(left: DataFrame, right: DataFrame, score: Callable[[str, str], Column], least: float, bound: float) -> DataFrame:
    """(l, r, score) of texts whose score is ``least`` or more; scores of that size have a sort ratio of ``bound`` or more."""
    return candidate_pairs(left, right, bound).withColumn("score", score("l", "r")).where(F.col("score") >= least)
