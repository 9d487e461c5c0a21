"""The reader's books and what is filed about them: found or created, corrected, linked to sources, put into series and codes.

Tables are rebuilt, not changed in place: each function takes the present rows and a batch of changes and returns the new rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions import text as T
from ledgerlark.operators.catalog import written

OUTCOMES = ("linked", "confirmed", "unsure", "not_found")


def given(text: Column) -> Column:
    """text without outer blanks, null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def badness(name: Column) -> Column:
    """Of spellings of the same person the least is best: without comma, then with more accents, then the longer, then the first by alphabet."""
    accents = F.length(name) - F.length(F.translate(name, T.ACCENTED, ""))
    return F.struct(name.contains(",").alias("comma"), (-accents).alias("accents"), (-F.length(name)).alias("length"), name.alias("name"))


def by_isbn(rows: DataFrame, books: DataFrame) -> DataFrame:
    """(row, id): the least book that carries a row's ISBN."""
    keyed = books.where("isbn <> ''").groupBy("isbn").agg(F.min("id").alias("id"))
    return rows.join(keyed, "isbn").select("row", "id")


def best_authors(books: DataFrame, rows: DataFrame) -> DataFrame:
    """books (_key, author, further columns) with the author after rows (_key, row, author), as if each came in its turn: a book without an author
    takes the first, and then the best spelling of the same person; other persons change nothing."""
    said = rows.select("_key", "row", given(F.col("author")).alias("_name")).where("_name is not null").withColumn("_person", T.author_key(F.col("_name")))
    people = said.groupBy("_key", "_person").agg(F.min(badness(F.col("_name"))).alias("_best"), F.min("row").alias("_at"))
    first = people.groupBy("_key").agg(F.min_by("_person", "_at").alias("_first"))
    own = given(F.col("author"))
    joined = books.join(first, "_key", "left").withColumn("_person", F.when(own.isNull(), F.col("_first")).otherwise(T.author_key(own))).join(people, ["_key", "_person"], "left")
    better = F.col("_best").isNotNull() & (own.isNull() | (F.col("_best") < badness(F.col("author"))))
    return joined.withColumn("author", F.when(better, F.col("_best.name")).otherwise(F.col("author"))).select(*books.columns)


def find_or_create(books: DataFrame, rows: DataFrame, found: DataFrame) -> DataFrame:
    """books (id, isbn, title, author, series) after a batch rows (row, isbn, title, author, series), of which found (row, id) names those
    that are there already, by ISBN or by a match. The result is that of taking the rows one by one, by their number.

    What a book lacks is filled in from the first row that has it, nothing is overwritten; its author may take a better spelling of
    the same name. Rows that aren't there become books, one for each ISBN, or for each title and author without one: the first row makes the book
    and later ones fill it. Ids go on from the greatest by the number of the first row, so they don't depend on how the data is split.
    """
    named = found.groupBy("row").agg(F.min("id").alias("id"))
    name = F.concat_ws("|", F.lit("name"), T.normalize_title(F.col("title")), F.coalesce(T.author_key(F.col("author")), F.lit("")))
    key = F.coalesce(F.concat(F.lit("id:"), F.col("id").cast("string")), F.concat(F.lit("isbn:"), given(F.col("isbn"))), name)
    placed = rows.join(named, "row", "left").withColumn("_key", key)

    def first(column: str) -> Column:
        return F.min_by(column, F.when(given(F.col(column)).isNotNull(), F.col("row"))).alias(f"_{column}")

    told = placed.groupBy("_key").agg(first("isbn"), first("series"), F.min(F.when(F.col("id").isNull(), F.struct("row", given(F.col("isbn")).alias("isbn"), "title", "author", "series"))).alias("b"))
    known = books.withColumn("_key", F.concat(F.lit("id:"), F.col("id").cast("string"))).join(told.drop("b"), "_key", "left")
    last = books.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    made = told.where("b is not null").crossJoin(F.broadcast(last)).select("_key", (F.col("_last") + F.col("b.row")).alias("id"), "b.isbn", "b.title", "b.author", "b.series", "_isbn", "_series")
    filled = known.unionByName(made).withColumns({c: F.coalesce(c, f"_{c}") for c in ("isbn", "series")})
    return best_authors(filled, placed).select("id", "isbn", "title", "author", "series")


def learn_isbns(books: DataFrame, offered: DataFrame) -> DataFrame:
    """books with ISBNs from offered (book_id, isbn, seq) where they have none, as if each offer came in its turn: it holds if the book has none
    yet and no other book carries it, since two rows for one book are for a person to join.

    An offer that is the first left both of its book and of its ISBN holds for certain; with it all others of the two go. Rounds go on
    until none is left, each written to the shared folder. Of equal seq the lesser book, then the lesser ISBN comes first.
    """
    free = offered.where("isbn <> ''").join(books.where("isbn <> ''").select("isbn"), "isbn", "left_anti")
    open_books = books.where("coalesce(isbn, '') = ''").select(F.col("id").alias("book_id"))
    left = written(free.join(open_books, "book_id", "left_semi").groupBy("book_id", "isbn").agg(F.min("seq").alias("seq")))
    taken = None
    while not left.isEmpty():
        turn = F.struct("seq", "book_id", "isbn")
        held = written(left.groupBy("book_id").agg(F.min(turn).alias("o")).join(left.groupBy("isbn").agg(F.min(turn).alias("o")), "o").select("o.book_id", "o.isbn"))
        taken = held if taken is None else taken.unionByName(held)
        left = written(left.join(held.select("book_id"), "book_id", "left_anti").join(held.select("isbn"), "isbn", "left_anti"))
    if taken is None:
        return books
    one = taken.select(F.col("book_id").alias("id"), F.col("isbn").alias("_isbn"))
    return books.join(one, "id", "left").withColumn("isbn", F.coalesce("_isbn", "isbn")).select(*books.columns)


def rename_books(books: DataFrame, renames: DataFrame) -> DataFrame:
    """books with renamed after renames (book_id, title, author, seq), as if each came in its turn. One with a blank title, or that changes nothing, isn't
    any. No author given leaves the one there, a blank one removes it. A book that was renamed loses its cover, even if its name is in
    the end what it was."""
    own = books.select(F.col("id").alias("book_id"), F.col("title").alias("_title"), F.col("author").alias("_author"))
    turn = Window.partitionBy("book_id").orderBy("seq")
    steps = (
        renames.select("book_id", "seq", given(F.col("title")).alias("title"), "author").where("title is not null").join(own, "book_id")
        .withColumn("set", F.when(F.col("author").isNotNull(), F.struct(given(F.col("author")).alias("to"))))
        .withColumns({"before": F.coalesce(F.lag("title").over(turn), "_title"), "set_before": F.last("set", True).over(turn.rowsBetween(Window.unboundedPreceding, -1))})
    )
    author_before = F.when(F.col("set_before").isNull(), F.col("_author")).otherwise(F.col("set_before.to"))
    same = F.col("title").eqNullSafe(F.col("before")) & (F.col("author").isNull() | F.col("author").eqNullSafe(author_before))
    after = steps.groupBy(F.col("book_id").alias("id")).agg(
        F.max_by("title", "seq").alias("_title"), F.max_by("set", F.when(F.col("set").isNotNull(), F.col("seq"))).alias("_set"), F.bool_or(~same).alias("_renamed")
    )
    joined = books.join(after, "id", "left").withColumn("renamed", F.coalesce("_renamed", F.lit(False)))
    changed = {
        "author": F.when(F.col("renamed") & F.col("_set").isNotNull(), F.col("_set.to")).otherwise(F.col("author")),
        "title": F.when(F.col("renamed"), F.col("_title")).otherwise(F.col("title")),
        "cover": F.when(~F.col("renamed"), F.col("cover")),
    }
    return joined.withColumns(changed).select(*books.columns, "renamed")


def links_after_renaming(links: DataFrame, renamed: DataFrame) -> DataFrame:
    """Links of books that kept their name: the others spoke of another title and are looked for again."""
    gone = renamed.where("renamed").select(F.col("id").alias("book_id"))
    return links.join(gone, "book_id", "left_anti").select(*links.columns)


def checked_outcome(outcome: Column) -> Column:
    """outcome, or an error for one that is unknown."""
    return F.when(outcome.isin(*OUTCOMES), outcome).otherwise(F.raise_error(F.concat(F.lit("unknown link outcome "), F.coalesce(outcome, F.lit("null")))))


def put_links(links: DataFrame, changes: DataFrame) -> DataFrame:
    """links after changes of the same columns and seq: the last change of a book at a source replaces its row whole."""
    last = changes.groupBy("book_id", "source").agg(F.max_by(F.struct(*[c for c in links.columns if c not in ("book_id", "source")]), "seq").alias("_c"))
    new = last.select("book_id", "source", "_c.*").withColumn("outcome", checked_outcome(F.col("outcome")))
    return links.join(new, ["book_id", "source"], "left_anti").unionByName(new)


def reject_candidates(links: DataFrame, rejections: DataFrame) -> DataFrame:
    """links with the addresses of rejections (book_id, source, urls, restore, seq) added to rejected, each once; restore empties the list
    before. When was looked last stays as it is."""
    last = F.max(F.when(F.col("restore"), F.col("seq"))).over(Window.partitionBy("book_id", "source"))
    after = rejections.withColumn("_from", last).where("_from is null or seq >= _from")
    urls = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("urls", F.array().cast("array<string>")).alias("urls")))), lambda r: r["urls"]))
    more = after.groupBy("book_id", "source").agg(urls.alias("_urls"), F.bool_or("restore").alias("_restore"))
    before = F.when(F.coalesce("_restore", F.lit(False)) | F.col("rejected").isNull(), F.array().cast("array<string>")).otherwise(F.col("rejected"))
    new = F.array_distinct(F.concat(before, F.filter("_urls", lambda u: u != "")))
    joined = links.join(more, ["book_id", "source"], "left")
    return joined.withColumn("rejected", F.when(F.col("_urls").isNull(), F.col("rejected")).otherwise(new)).select(*links.columns)


def watch_state(log: DataFrame, *keys: str) -> DataFrame:
    """(keys, active, since) of a log (keys, active, at, seq): as last set, since the change that made it so; setting it again alike moves nothing."""
    w = Window.partitionBy(*keys).orderBy("seq")
    flips = log.withColumn("_flip", ~F.col("active").eqNullSafe(F.lag("active").over(w)))
    return flips.groupBy(*keys).agg(F.max_by("active", "seq").alias("active"), F.max_by("at", F.when(F.col("_flip"), F.col("seq"))).alias("since"))


def assign_series(entries: DataFrame, assigned: DataFrame) -> DataFrame:
    """entries (isbn, origin, name, volume) after assigned (isbn, name, volume, seq) by the reader: the last holds, a blank name takes it back.
    What sources say stays beside it."""
    last = assigned.groupBy("isbn").agg(F.max_by(F.struct("name", "volume"), "seq").alias("a"))
    mine = last.select("isbn", F.lit("reader").alias("origin"), given(F.col("a.name")).alias("name"), given(F.col("a.volume")).alias("volume"))
    kept = entries.join(mine.select("isbn", "origin"), ["isbn", "origin"], "left_anti")
    return kept.unionByName(mine.where("name is not null"))


def replace_codes(entries: DataFrame, answers: DataFrame) -> DataFrame:
    """entries (isbn, origin, code, rank) after answers (isbn, origin, codes): an answer holds whole, also an empty one; codes keep their
    first place and count once."""
    kept = entries.join(answers.select("isbn", "origin"), ["isbn", "origin"], "left_anti")
    new = answers.select("isbn", "origin", F.posexplode(F.array_distinct("codes")).alias("rank", "code"))
    return kept.unionByName(new.select(*entries.columns))


def fill_series(books: DataFrame, records: DataFrame) -> DataFrame:
    """books with series and volume of the library's record by ISBN where they have no series."""
    told = records.where("found and series is not null").select("isbn", F.struct("series", "series_index").alias("_r"))
    joined = books.join(told, "isbn", "left").withColumn("filled", F.col("series").isNull() & F.col("_r").isNotNull())
    both = {c: F.when(F.col("filled"), F.col(f"_r.{c}")).otherwise(F.col(c)) for c in ("series", "series_index")}
    return joined.withColumns(both).select(*books.columns, "filled")


def same_world(records: DataFrame, series: DataFrame) -> DataFrame:
    """(isbn, series_item): works of the given series (series_item) that have no volume: the same world, no sequel."""
    return records.where("volume is null and series_item is not null").join(series.select("series_item").distinct(), "series_item", "left_semi").select("isbn", "series_item")


def to_ask(wanted: DataFrame, log: DataFrame, reading: int) -> DataFrame:
    """wanted (isbn) that a library has to be asked for: never asked, or found when an older form of the answer was read. A no stays a no."""
    last = log.groupBy("isbn").agg(F.max_by(F.struct("found", "reading"), "seq").alias("r"))
    return wanted.join(last.where(~F.col("r.found") | (F.col("r.reading") >= reading)), "isbn", "left_anti")


def foreign_ratings(obs: DataFrame) -> DataFrame:
    """(subject, stars, votes, reason): the last average of other readers for each subject; without votes an average says nothing."""
    told = obs.where("rating is not null and rating_votes > 0").groupBy("subject").agg(F.max_by(F.struct("rating", "rating_votes"), "id").alias("r"))
    votes = F.col("r.rating_votes")
    return told.select("subject", F.col("r.rating").alias("stars"), votes.alias("votes"), F.concat(F.lit("Durchschnitt der Leser:innen aus "), votes.cast("string"), F.lit(" Stimmen")).alias("reason"))
