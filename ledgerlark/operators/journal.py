"""Latest state, history, prices and streaks over an append-only journal. "Latest" is the largest id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM = ("source", "source_item_id")
DISCOVERY_REASONS = ("profile_author", "genre_category")


def latest_per(obs: DataFrame, keys: tuple[str, ...] = ITEM, order: str = "id") -> DataFrame:
    """The latest row of each key. Partial maxima are taken before the one shuffle, so the cost after it follows keys, not history."""
    rest = [c for c in obs.columns if c not in keys]
    return obs.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*").select(*obs.columns)


def latest_discoveries(obs: DataFrame, limit: int | None = None) -> DataFrame:
    """Latest row of each found item, newest first; the reason is asked of the latest row."""
    found = latest_per(obs).where(F.col("match_reason").isin(*DISCOVERY_REASONS))
    return found.orderBy(F.desc("id")).limit(limit) if limit else found


def sightings_by_isbn(obs: DataFrame) -> DataFrame:
    """(isbn, sightings): ids of the latest row of each item that carries the ISBN, in order."""
    return latest_per(obs.where("isbn is not null")).groupBy("isbn").agg(F.sort_array(F.collect_list("id")).alias("sightings"))


def least_prices(obs: DataFrame, by: str, source: str) -> DataFrame:
    """(by, price_cents): least positive price among the latest priced rows of one source."""
    priced = latest_per(obs.where((F.col("source") == source) & F.col("price_cents").isNotNull()))
    return priced.where((F.col("price_cents") > 0) & F.col(by).isNotNull()).groupBy(by).agg(F.min("price_cents").alias("price_cents"))


def price_points(obs: DataFrame) -> DataFrame:
    """Rows at which an item's price changed; unknown prices are skipped, the first known one is a point."""
    w = Window.partitionBy(*ITEM).orderBy("id")
    before = F.lag("price_cents").over(w)
    return obs.where("price_cents is not null").withColumn("_before", before).where(~F.col("price_cents").eqNullSafe(F.col("_before"))).drop("_before")


def streaks(probes: DataFrame, key: str, order: str, ok: Column) -> DataFrame:
    """probes with streak: failures in a row up to and with this row, 0 when it went well."""
    w = Window.partitionBy(key).orderBy(order)
    marked = probes.withColumn("_ok", ok).withColumn("_island", F.sum(F.col("_ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("streak", F.sum((~F.col("_ok")).cast("int")).over(inside)).drop("_ok", "_island")


def failing_twice(runs: DataFrame, key: str, order: str, failed: Column) -> DataFrame:
    """Rows that failed, as did the row before of the same key that ran at all."""
    w = Window.partitionBy(key).orderBy(order)
    return runs.withColumn("_failed", failed).withColumn("_before", F.lag("_failed").over(w)).where(F.col("_failed") & F.coalesce("_before", F.lit(False))).drop("_failed", "_before")


def best_availability(latest: DataFrame, by: str) -> DataFrame:
    """(by, availability): available before unavailable before unknown; null if no source spoke."""
    rank = F.when(F.col("availability") == "available", 0).when(F.col("availability") == "unavailable", 1).when(F.col("availability") == "unknown", 2)
    return latest.groupBy(by).agg(F.min_by("availability", rank).alias("availability"))


def newest_known_price(obs: DataFrame, by: str) -> DataFrame:
    """(by, price_cents) of the newest row that has a price."""
    priced = F.when(F.col("price_cents").isNotNull(), F.col("id"))
    return obs.groupBy(by).agg(F.max_by("price_cents", priced).alias("price_cents"))


def last_finished_run(runs: DataFrame) -> DataFrame:
    """runs with previous_run: the last run before it of the same profile that finished and was no entry run."""
    w = Window.partitionBy("profile").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    counts = F.col("finished_at").isNotNull() & (F.col("trigger") != "entry")
    return runs.withColumn("previous_run", F.last(F.when(counts, F.col("id")), ignorenulls=True).over(w))


def history(obs: DataFrame, limit: int = 200) -> DataFrame:
    """The newest ``limit`` rows of each item, with their place n from 1."""
    w = Window.partitionBy(*ITEM).orderBy(F.desc("id"))
    return obs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)


def fresh(latest: DataFrame, library_sources: tuple[str, ...], now: Column, days: int = 3) -> DataFrame:
    """A library's "available" that is older than ``days`` becomes "unknown"."""
    old = (F.col("availability") == "available") & F.col("source").isin(*library_sources) & (now - F.col("observed_at") > F.expr(f"interval {days} days"))
    return latest.withColumn("availability", F.when(F.coalesce(old, F.lit(False)), "unknown").otherwise(F.col("availability")))


def count_categories(obs: DataFrame) -> DataFrame:
    """(source, category, n, example): how often a source used a category, and the newest title under it."""
    titled = F.when(F.col("title").isNotNull(), F.col("id"))
    return obs.where("category is not null").groupBy("source", "category").agg(F.count("*").alias("n"), F.max_by("title", titled).alias("example"))
