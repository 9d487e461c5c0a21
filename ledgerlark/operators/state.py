"""Mutable state as logs: changes are appended with a growing seq, a view takes the last one of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append(changes: DataFrame, path: str) -> None:
    changes.write.mode("append").parquet(path)


def current(log: DataFrame, *keys: str, seq: str = "seq") -> DataFrame:
    """The last change of each key."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_row")).select(*keys, "_row.*").select(*log.columns)


def active(log: DataFrame, *keys: str) -> DataFrame:
    """Current rows that are not switched off."""
    return current(log, *keys).where("active")


def kept_details(log: DataFrame, *keys: str) -> DataFrame:
    """Current rows with the last details that were given: a change without details leaves them."""
    given = F.when(F.col("details").isNotNull(), F.col("seq"))
    return log.groupBy(*keys).agg(F.max_by("active", "seq").alias("active"), F.max_by("details", given).alias("details"), F.max("seq").alias("seq"))


def compact(log: DataFrame, path: str, *keys: str) -> None:
    """Write the current rows as a new log."""
    current(log, *keys).write.mode("overwrite").parquet(path)


def insert_missing(new: DataFrame, existing: DataFrame, *keys: str) -> DataFrame:
    """Rows of new whose keys are not there yet, one for each key."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*") if rest else new.distinct()
    return one.join(existing.select(*keys), list(keys), "left_anti").select(*new.columns)


def overlay(saved: Column, from_file: Column, default: Column) -> Column:
    return F.coalesce(saved, from_file, default)


def effective_rating(ratings: DataFrame, works: DataFrame) -> DataFrame:
    """(subject, origin, stars, own): a rating of an edition holds for its siblings that have none of their own."""
    mine = current(ratings, "subject", "origin").select("subject", "origin", "stars", "seq")
    isbn = F.expr("substring(subject, 6)")
    lead = mine.where("subject like 'isbn:%'").join(works.select("isbn", "key"), isbn == F.col("isbn")).groupBy("key", "origin").agg(F.max_by("stars", "seq").alias("stars"))
    lent = works.join(lead, "key").select(F.concat(F.lit("isbn:"), "isbn").alias("subject"), "origin", "stars").join(mine, ["subject", "origin"], "left_anti")
    return mine.select("subject", "origin", "stars", F.lit(True).alias("own")).unionByName(lent.withColumn("own", F.lit(False)))


def retry_due(links: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Links to try again: no address, and the last try is ``days`` old or unknown."""
    stale = F.col("resolved_at").isNull() | (now - F.col("resolved_at") > F.expr(f"interval {days} days"))
    return links.where(F.col("url").isNull() & stale)


def open_candidates(candidates: Column, rejected: Column) -> Column:
    """Candidates (array of struct with url) that were not rejected."""
    return F.filter(candidates, lambda c: ~F.coalesce(F.array_contains(rejected, c["url"]), F.lit(False)))


def current_terms(terms: Column, aliases: dict[str, str]) -> Column:
    """Terms by their present names, each once, in order."""
    if not aliases:
        return F.array_distinct(terms)
    names = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.array_distinct(F.transform(terms, lambda t: F.coalesce(F.try_element_at(names, t), t)))


def best_portrait(portraits: DataFrame) -> DataFrame:
    """The best portrait of each subject: with text, then known, then fewest violations, then newest."""
    order = F.struct(F.col("with_text").cast("int"), F.col("known").cast("int"), -F.size(F.coalesce("violations", F.array().cast("array<string>"))), "id")
    rest = [c for c in portraits.columns if c != "subject"]
    return portraits.groupBy("subject").agg(F.max_by(F.struct(*rest), order).alias("_row")).select("subject", "_row.*").select(*portraits.columns)


def run_is_due(runs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """(profile, due): no run is live and the last one that wasn't abandoned began ``hours`` ago or never."""
    counted = F.col("status").isin("finished", "running")
    return runs.groupBy("profile").agg(F.max(F.when(counted, F.col("started_at"))).alias("_last"), F.count_if(F.col("status") == "running").alias("_live")).select("profile", ((F.col("_live") == 0) & F.coalesce(now - F.col("_last") >= F.expr(f"interval {hours} hours"), F.lit(True))).alias("due"))
