"""Orders, top rows, pages and batches. Every order is total: the id breaks ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows with their place n: each task keeps its own first rows, one sorts what is left."""
    first = df.orderBy(*order).limit(limit)
    return first.withColumn("n", F.row_number().over(Window.orderBy(*order)))


def top_per(df: DataFrame, by: list[str], order: list[Column], limit: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)


def top_with_ties(df: DataFrame, by: list[str], value: str, limit: int) -> DataFrame:
    """The first ``limit`` of each group by value, largest first, and all that equal the last of them."""
    return df.withColumn("place", F.rank().over(Window.partitionBy(*by).orderBy(F.desc(value)))).where(F.col("place") <= limit)


def page(df: DataFrame, shown: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    """The next ``size`` rows that weren't shown, with their place n and rest, the number behind them."""
    left = df.join(shown.select(*keys).distinct(), keys, "left_anti")
    rest = left.agg(F.greatest(F.count("*") - size, F.lit(0)).alias("rest"))
    return top(left, order, size).crossJoin(F.broadcast(rest))


def chunks(df: DataFrame, by: list[str], order: list[Column], size: int) -> DataFrame:
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size))


SUGGESTIONS = {
    "stars": [F.desc_nulls_last, "percent"],
    "free": [F.asc, "free_rank"],
    "price": [F.asc_nulls_last, "price_cents"],
    "new": [F.desc_nulls_last, "observed_at"],
}
LEGACY_SORTS = {"best": "stars", "rating": "stars", "cheap": "price"}


def sort_order(slug: str | None, default: str = "stars") -> list[Column]:
    """The order that a name stands for; old names are known, others mean the default."""
    slug = LEGACY_SORTS.get(slug or "", slug)
    function, column = SUGGESTIONS.get(slug or "", SUGGESTIONS[default])
    return [function(column), F.desc("id")]
