"""Read models: watchlist, shelves, editions, open questions, series, digest and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions import text as T
from ledgerlark.operators import catalog, journal
from ledgerlark.operators.diff import known
from ledgerlark.operators.state import open_candidates

OUTCOMES = ("linked", "unsure", "not_found")


def watchlist(entries: DataFrame, links: DataFrame, latest: DataFrame, include_paused: bool = True) -> DataFrame:
    """Entries (book_id, title, active) with what their sources say: best availability, newest known price, sources, and whether they need a choice,
    are missing everywhere or were never looked at. links: (book_id, source, outcome, candidates, rejected); latest: one row for each (book_id, source)."""
    opened = open_candidates(F.col("candidates"), F.coalesce("rejected", F.array().cast("array<string>")))
    asks = (F.col("outcome") == "unsure") & (F.size(opened) > 0)
    by_book = links.withColumn("_asks", known(asks)).groupBy("book_id").agg(
        F.count("*").alias("n_sources"), F.bool_or("_asks").alias("_any"), F.bool_and(F.col("outcome") == "not_found").alias("_none"), F.bool_or(F.col("outcome") == "unsure").alias("needs_attention"),
        F.min(F.when(F.col("_asks"), F.col("source"))).alias("choice_source"),
    )
    seen = journal.best_availability(latest, "book_id").join(journal.newest_known_price(latest, "book_id"), "book_id", "full")
    rows = entries if include_paused else entries.where("active")
    out = rows.join(by_book, "book_id", "left").join(seen, "book_id", "left")
    n = F.coalesce("n_sources", F.lit(0))
    return out.select(
        "book_id", "title", "active", "availability", "price_cents", n.alias("n_sources"), known(F.col("needs_attention")).alias("needs_attention"), (F.col("active") & known(F.col("_any"))).alias("needs_choice"),
        F.when(F.col("active"), F.col("choice_source")).alias("choice_source"), (F.col("active") & (n > 0) & known(F.col("_none"))).alias("missing"), (n == 0).alias("unresolved"),
    )


def open_questions(links: DataFrame) -> DataFrame:
    """One row for each open candidate of an unsure link."""
    rows = links.where("outcome = 'unsure'").withColumn("_c", open_candidates(F.col("candidates"), F.coalesce("rejected", F.array().cast("array<string>"))))
    return rows.select("book_id", "source", F.posexplode("_c").alias("position", "c")).select("book_id", "source", "position", "c.*")


def owned_shelf(owned: DataFrame, scores: DataFrame, ratings: DataFrame) -> DataFrame:
    """Owned books with the reader's stars, else the judged ones, and the percentage."""
    return owned.join(scores, "subject", "left").join(ratings.select("subject", F.col("stars").alias("_own")), "subject", "left").select(*owned.columns, F.coalesce("_own", "stars").alias("stars"), "percent")


def editions(works: DataFrame, latest: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """One row for each ISBN of a work with more than one: its sightings, least price, language and place; other languages stand behind "more"."""
    seen = latest.where("isbn is not null").groupBy("isbn").agg(F.count("*").alias("sightings"), F.min("price_cents").alias("price_cents"), F.min("title").alias("title"))
    rows = catalog.siblings(works).where("n > 1").join(seen, "isbn", "left").withColumn("language", T.language_of_isbn(F.col("isbn")))
    listed = F.array(*map(F.lit, languages))
    place = F.when(F.array_contains(listed, F.col("language")), F.array_position(listed, F.col("language"))).otherwise(len(languages) + 1)
    w = Window.partitionBy("work").orderBy(F.col("title").isNull(), place, F.asc_nulls_last("title"), "isbn")
    return rows.select("work", "isbn", "title", "sightings", "price_cents", T.is_other_language(F.col("language"), languages).alias("more"), F.row_number().over(w).alias("position"))


def series_volumes(entries: DataFrame, obs: DataFrame, records: DataFrame, books: DataFrame) -> DataFrame:
    """(series_id, isbn, title, author, cover_url): named by the latest sighting, else the library's record, else the book; the cover is the last known one of a sighting."""
    covered = F.when(F.col("cover_url").isNotNull(), F.col("id"))
    seen = obs.where("isbn is not null").groupBy("isbn").agg(F.max_by(F.struct("title", "author"), "id").alias("s"), F.max_by("cover_url", covered).alias("cover_url"))
    told = records.where("title is not null").select("isbn", F.struct("title", "author").alias("r"))
    own = books.where("isbn is not null").select("isbn", F.struct("title", "author").alias("b"))
    rows = entries.select("series_id", "isbn").distinct().join(seen, "isbn", "left").join(told, "isbn", "left").join(own, "isbn", "left")
    return rows.withColumn("n", F.coalesce("s", "r", "b")).where("n is not null").select("series_id", "isbn", "n.title", "n.author", "cover_url")


def liked_series(entries: DataFrame, liked: DataFrame, disliked: DataFrame, watched: DataFrame) -> DataFrame:
    """(isbn, note, favourite): "sequel" or "same series" of the earliest liked volume, or "watched"; a disliked volume spoils its series.
    entries (isbn, series_id, volume); liked (isbn, title); disliked (isbn); watched (series_id)."""
    number = F.coalesce(F.expr("try_cast(volume as double)"), F.lit(float("inf")))
    rows = entries.withColumn("_n", number)
    favourite = rows.join(liked, "isbn").groupBy("series_id").agg(F.min(F.struct("_n", "title")).alias("f"))
    spoiled = rows.join(disliked, "isbn", "left_semi").select("series_id").distinct()
    series = favourite.join(watched.select("series_id").distinct(), "series_id", "full").join(spoiled, "series_id", "left_anti")
    notes = rows.join(series, "series_id").join(liked, "isbn", "left_anti")
    note = F.when(F.col("f").isNull(), "watched").when(F.col("_n") > F.col("f._n"), "sequel").otherwise("same series")
    return notes.select("isbn", note.alias("note"), F.col("f.title").alias("favourite"))


def swept(searches: list[DataFrame], dismissed: DataFrame) -> DataFrame:
    """Finds of searches in their order: of one item the first stays; dismissed ones go. Each has the ordinal of its search."""
    out = None
    for n, rows in enumerate(searches):
        rows = rows.withColumn("ordinal", F.lit(n))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in journal.ITEM]
    first = out.groupBy(*journal.ITEM).agg(F.min_by(F.struct(*rest), F.struct("ordinal", "id")).alias("_r")).select(*journal.ITEM, "_r.*")
    return first.join(dismissed, list(journal.ITEM), "left_anti")


def enriched(obs: DataFrame, details: DataFrame) -> DataFrame:
    """obs with what detail pages say, and changed: whether blurb, cover, pages or series are new. Null in a detail keeps the old value."""
    fields = ("blurb", "cover_url", "pages", "series")
    new = details.select(*journal.ITEM, *(F.col(c).alias(f"_{c}") for c in fields))
    out = obs.join(new, list(journal.ITEM), "left")
    changed = F.lit(False)
    for c in fields:
        changed = changed | ~F.coalesce(f"_{c}", c).eqNullSafe(F.col(c))
    merged = {c: F.coalesce(f"_{c}", c) for c in fields}
    return out.withColumn("changed", changed).withColumns(merged).drop(*(f"_{c}" for c in fields))


def genre_addresses(codes: DataFrame, closure: DataFrame, addresses: DataFrame) -> DataFrame:
    """(code, source, address): a source's address for a genre, or for the nearest one above it."""
    known_ = addresses.select("source", F.col("code").alias("ancestor"), "address")
    return codes.join(closure, "code").join(known_, "ancestor").groupBy("code", "source").agg(F.min_by("address", "depth").alias("address"))


def digest_lines(found: DataFrame, section: Column) -> DataFrame:
    """(section, text): the lines of each section of a digest in order of id. A digest is what one run has to tell."""
    line = F.concat_ws(" – ", "title", "author", F.when(F.col("price_cents").isNotNull(), T.format_price(F.col("price_cents"))), "kind")
    return found.groupBy(section.alias("section")).agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda r: r["line"])).alias("text"))


def export(interests: DataFrame) -> DataFrame:
    """(profile, body): a profile's interests as one JSON text, for a file."""
    rows = F.array_sort(F.collect_list(F.struct("key", "value")))
    return interests.groupBy("profile").agg(F.to_json(F.struct(rows.alias("interests"))).alias("body"))


def mismatched(title: Column, matched: Column) -> Column:
    """Both titles have words of more than three letters and share none."""
    words = lambda c: F.filter(F.split(T.normalize_title(c), " "), lambda w: F.length(w) > 3)
    a, b = words(title), words(matched)
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)
