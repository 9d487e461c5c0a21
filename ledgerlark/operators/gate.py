"""The gate: which changes pass the reader's threshold, who is described within a budget, and what is reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators.diff import is_short_story
from ledgerlark.operators.eligibility import budgeted

KEY = ["source", "source_item_id"]
#: Fewer pages are a short story.
SHORT_STORY_PAGES = 80


def is_discovery() -> Column:
    return F.col("kind").isin("first_seen", "became_available") & (F.col("match_reason") != "watchlist")


def _any(df: DataFrame, rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.join(rows.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def wanted(deltas: DataFrame, portraits: DataFrame, reader: DataFrame) -> DataFrame:
    """Discoveries that need a portrait: no stars of the reader's (book_id) and no portrait (subject) yet."""
    return deltas.where(is_discovery()).join(reader.where("stars is not null"), "book_id", "left_anti").join(portraits, "subject", "left_anti")


def apply(deltas: DataFrame, portraits: DataFrame, described: DataFrame, reader: DataFrame, threshold: int, budget: int | None) -> DataFrame:
    """deltas with outcome (kept, held_back, short_stories) and counted (the report's name for it, or null).

    deltas (id, kind, source, source_item_id, subject, book_id, match_reason, title, subtitle, pages); portraits (subject, stars): stars
    null if the book is unknown; described (subject, stars, pages): what describing gives or would give for a subject; reader
    (book_id, stars). budget counts distinct subjects in order of id; None: nobody describes.
    """
    waiting = wanted(deltas, portraits, reader)
    asked = budgeted(waiting, budget).select("subject") if budget is not None else waiting.select("subject").limit(0)
    tried = waiting.select(*KEY, "subject").distinct().join(asked, "subject")
    answers = asked.join(described, "subject")
    short = F.coalesce(F.col("pages") < SHORT_STORY_PAGES, F.lit(False))
    told = answers.where(~short).select("subject", "stars")
    out = _any(deltas, tried.join(answers.where(short), "subject", "left_semi"), KEY, "_short")
    out = _any(out, tried, KEY, "_tried")
    out = _any(out, tried.join(told, "subject", "left_semi"), KEY, "_created")
    known = portraits.select("subject", "stars").unionByName(told).withColumnRenamed("stars", "_stars").withColumn("_portrayed", F.lit(True))
    out = out.join(known, "subject", "left").join(reader.select("book_id", F.col("stars").alias("_own")), "book_id", "left")
    stars, watched = F.coalesce("_own", "_stars"), F.col("match_reason") == "watchlist"
    hidden = F.col("_short") | (~watched & F.coalesce(is_short_story(least_pages=SHORT_STORY_PAGES), F.lit(False)))
    outcome = F.when(hidden, "short_stories").when(~watched & (stars < threshold), "held_back").otherwise("kept")
    unrated = F.when(is_discovery(), F.when(F.coalesce("_portrayed", F.lit(False)) | F.col("_tried") | F.lit(budget is None), "unrated").otherwise("over_budget"))
    counted = F.when(hidden, "short_stories").when(watched, None).when(stars.isNull(), unrated).when(~F.col("_created"), "reused")
    return out.select(*deltas.columns, outcome.alias("outcome"), counted.alias("counted"))


def report(gated: DataFrame) -> DataFrame:
    """One row of counts by distinct subject: held_back, short_stories, unrated, over_budget, reused."""

    def books(name: str, condition: Column) -> Column:
        return F.count_distinct(F.when(condition, F.col("subject"))).alias(name)

    names = ("short_stories", "unrated", "over_budget", "reused")
    return gated.agg(books("held_back", F.col("outcome") == "held_back"), *(books(n, F.col("counted") == n) for n in names))


def gate_text(threshold: int) -> Column:
    """A report's row as one sentence; parts that count nothing are left out. The words are fixed values."""
    held, over, unrated, short = (F.col(c) for c in ("held_back", "over_budget", "unrated", "short_stories"))
    parts = [
        F.when(held > 0, F.concat(held.cast("string"), F.when(held == 1, " Vorschlag").otherwise(" Vorschläge"), F.lit(f" unter {threshold} Sternen zurückgehalten"))),
        F.when(over > 0, F.concat(over.cast("string"), F.lit(" heute nicht bewertet (Budget erschöpft) und deshalb ungeprüft gezeigt"))),
        F.when(unrated > 0, F.concat(unrated.cast("string"), F.lit(" konnten nicht bewertet werden und werden ungeprüft gezeigt"))),
        F.when(short > 0, F.concat(short.cast("string"), F.when(short == 1, " Kurzgeschichte").otherwise(" Kurzgeschichten"), F.lit(f" (unter {SHORT_STORY_PAGES} Seiten) nicht gezeigt"))),
    ]
    return F.concat(F.lit("Bewertungstor: "), F.concat_ws(", ", *parts))


def worth_asking_again(text_now: Column, sample_now: Column) -> Column:
    """An unknown book may be asked about again: with a text if it had none, once more with a sample if it had no sample."""
    with_text, with_sample = (F.coalesce(c, F.lit(False)) for c in ("with_text", "with_sample"))
    return ~F.col("known") & F.when(~with_text, text_now).otherwise(~with_sample & sample_now)


def asked_with_text(log: DataFrame, works: DataFrame) -> DataFrame:
    """(subject, n): portraits with a text of all subjects (subject, key) of the same work; counted by subject, then summed by work."""
    counts = log.where("with_text").groupBy("subject").agg(F.count("*").alias("n")).join(works, "subject")
    return works.join(counts.groupBy("key").agg(F.sum("n").alias("n")), "key").select("subject", "n")


def backlog(finds: DataFrame, portraits: DataFrame, budget: int) -> DataFrame:
    """Finds without a portrait, newest first; cut only after those that have one are out."""
    return finds.join(portraits, "subject", "left_anti").orderBy(F.desc("id")).limit(budget)


def to_rework(portraits: DataFrame, tries: DataFrame, budget: int, first: str = "Dimensionen", most_tries: int = 2) -> DataFrame:
    """Known portraits (id, subject, known, with_text, violations) with a text that break rules, asked fewer times than most_tries; those
    with a violation that names ``first`` come first, then newest."""
    flawed = portraits.where("known and with_text").where(F.size("violations") > 0).join(tries, "subject", "left").where(F.coalesce("n", F.lit(0)) < most_tries)
    return flawed.orderBy(F.exists("violations", lambda v: v.contains(first)).desc(), F.desc("id")).limit(budget)


def first_portrayed(subjects: DataFrame, portraits: DataFrame) -> DataFrame:
    """(book, subject): of a book's keys (book, position, subject) the first that has a portrait (subject)."""
    return subjects.join(portraits, "subject", "left_semi").groupBy("book").agg(F.min_by("subject", "position").alias("subject"))
