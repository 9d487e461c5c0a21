"""Who may be suggested: exclusion rules in order, and the pile that is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions import text as T
from ledgerlark.operators import catalog, journal
from ledgerlark.operators.diff import is_short_story, junk_reason, known, worth_announcing
from ledgerlark.settings import BROADCAST_ROWS, ROWS_A_TASK, Settings


def subject() -> Column:
    """The key that judgements hang on: the ISBN, else source and item."""
    return F.when(F.col("isbn").isNotNull(), F.concat(F.lit("isbn:"), "isbn")).otherwise(F.concat_ws(":", F.lit("item"), "source", "source_item_id"))


def _flag(df: DataFrame, rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with name: whether rows has its keys."""
    return df.join(rows.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def is_foreign(settings: Settings, told: str = "language") -> Column:
    """By the library's language; else the shop's shelf; else the ISBN's group. Unknown is not foreign."""
    shelf = F.col("url").contains("/fremdsprachige-")
    code = F.coalesce(F.col(told), T.language_of_isbn(F.col("isbn")))
    judged = F.when(F.col(told).isNull() & known(shelf), True).when(F.col("isbn").isNull(), False).otherwise(known(~code.isin(*T.NOT_A_LANGUAGE, *settings.languages)))
    return (F.col("match_reason") != "watchlist") & judged


def ai_authors(obs: DataFrame) -> DataFrame:
    """Authors of whom any blurb says that a machine wrote it."""
    return obs.where("author is not null").where(T.declares_ai(F.col("blurb"))).select("author").distinct()


def with_ai(obs: DataFrame, authors: DataFrame) -> DataFrame:
    """obs with ai: its author is one of these, or its own blurb says so; without an author never."""
    out = _flag(obs, authors, ["author"], "_ai")
    return out.withColumn("ai", known((F.col("match_reason") != "watchlist") & (F.col("author") != "") & (F.col("_ai") | T.declares_ai(F.col("blurb"))))).drop("_ai")


def with_mid_series(obs: DataFrame, known_series: DataFrame, names: DataFrame, followed_authors: DataFrame, followed_series: DataFrame) -> DataFrame:
    """obs with mid_series: a later volume of a series that is not followed, by an author who isn't.

    known_series (isbn, series_id, volume); names (series_key, author_key, series_id); followed_authors (name); followed_series (series_id)."""
    by_isbn = known_series.select("isbn", F.col("series_id").alias("_sid"), F.col("volume").alias("_vol"))
    by_name = names.select("series_key", "author_key", F.col("series_id").alias("_named"))
    out = obs.join(by_isbn, "isbn", "left").withColumns({"series_key": T.series_key(F.col("series")), "author_key": T.author_key(F.coalesce("author", F.lit("")))})
    out = out.join(by_name, ["series_key", "author_key"], "left").withColumn("_sid", F.coalesce("_sid", "_named"))
    out = out.withColumn("_name", T.squeeze(F.lower("author")))
    out = _flag(out, followed_authors.select(T.squeeze(F.lower("name")).alias("_name")), ["_name"], "_known_author")
    out = _flag(out, followed_series.select(F.col("series_id").alias("_sid")), ["_sid"], "_known_series")
    volume = F.coalesce(catalog.volume_number(F.col("_vol")), catalog.volume_number(F.col("series_index")), T.named_volume(F.col("title")), T.volume_of(F.col("subtitle")))
    mid = known((F.col("match_reason") != "watchlist") & (volume > 1) & ~F.col("_known_author") & ~F.col("_known_series"))
    return out.withColumn("mid_series", mid).select(*obs.columns, "mid_series")


def with_disliked(obs: DataFrame, authors: DataFrame, codes: DataFrame | None = None, closure: DataFrame | None = None, genres: DataFrame | None = None) -> DataFrame:
    """obs with disliked: one of its people, or a genre above one of its codes, is disliked.

    authors (author_key); codes (subject, code); closure as genre_closure gives it; genres (code)."""
    people = F.array_union(F.array(T.author_key(F.col("author"))), F.transform(T.split_authors(F.col("author")), T.author_key))
    listed = obs.select("source", "source_item_id", F.explode(people).alias("author_key")).join(authors.distinct(), "author_key", "left_semi")
    out = _flag(obs, listed, ["source", "source_item_id"], "_by_author").withColumn("_subject", subject())
    if codes is not None and closure is not None and genres is not None:
        out = _flag(out, catalog.covered(codes, closure, genres).select(F.col("subject").alias("_subject")), ["_subject"], "_by_genre")
    else:
        out = out.withColumn("_by_genre", F.lit(False))
    return out.withColumn("disliked", (F.col("match_reason") != "watchlist") & (F.col("_by_author") | F.col("_by_genre"))).drop("_by_author", "_by_genre", "_subject")


def undecided(obs: DataFrame, items: DataFrame, isbns: DataFrame) -> DataFrame:
    """obs without items (source, source_item_id) and ISBNs that something was said about."""
    return obs.join(items, ["source", "source_item_id"], "left_anti").join(isbns.select("isbn"), "isbn", "left_anti").select(*obs.columns)


def exclusion(settings: Settings) -> Column:
    """The first reason that hides a find, or null. Expects language, ai, disliked, mid_series, advantage and withheld."""
    return (
        F.when(junk_reason().isNotNull(), "junk")
        .when(is_short_story(), "short")
        .when(is_foreign(settings), "language")
        .when(F.col("ai"), "ai")
        .when(F.col("disliked"), "disliked")
        .when(F.col("mid_series"), "series")
        .when(~worth_announcing(settings, F.col("advantage")), "priced")
        .when(known(F.col("withheld")), "weak")
    )


def hidden_counts(judged: DataFrame) -> DataFrame:
    """(exclusion, n): distinct subjects hidden for each reason and shown nowhere."""
    shown = judged.where("exclusion is null").select("subject").distinct()
    return judged.where("exclusion is not null").select("exclusion", "subject").distinct().join(shown, "subject", "left_anti").groupBy("exclusion").agg(F.count("*").alias("n"))


def pile(judged: DataFrame, works: DataFrame, settings: Settings, skip: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Finds that nothing excludes, one for each work, best first: position from 1, and others (further editions).

    judged has exclusion, percent, language, price_cents, availability, id. The order is total: percent (unknown last), price, then newest."""
    items = judged.where("exclusion is null").withColumn("ordinal", -F.col("id"))
    languages = F.array(*map(F.lit, settings.languages))
    place = F.when(F.array_contains(languages, F.col("language")), F.array_position(languages, F.col("language"))).otherwise(len(settings.languages) + 1)
    cost = [place, F.when(F.col("availability") == "available", 0).otherwise(1), F.coalesce("price_cents", F.lit(10**9))]
    winners = catalog.collapse_works(items, works, cost).where("winner")
    if skip is not None:
        winners = winners.join(skip, ["source", "source_item_id"], "left_anti")
    order = [F.desc_nulls_last("percent"), F.asc_nulls_last("price_cents"), F.desc("id")]
    if limit:  # the top rows are taken by each task first; only these are numbered
        winners = winners.orderBy(*order).limit(limit)
    return winners.withColumn("position", F.row_number().over(Window.orderBy(*order))) if limit else winners


def budgeted(finds: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` distinct subjects in order of arrival (id)."""
    return finds.groupBy("subject").agg(F.min("id").alias("arrival")).orderBy("arrival").limit(budget)


def known_pages(obs: DataFrame, records: DataFrame) -> DataFrame:
    """obs with pages from its own item, else any of the same ISBN, else the library's record; zero counts as unknown."""
    own = F.nullif(F.col("pages"), F.lit(0))
    by_isbn = obs.where(own.isNotNull() & F.col("isbn").isNotNull()).groupBy("isbn").agg(F.max_by("pages", "id").alias("_same"))
    out = obs.join(by_isbn, "isbn", "left").join(records.select("isbn", F.col("pages").alias("_told")), "isbn", "left")
    return out.withColumn("pages", F.coalesce(own, F.nullif(F.col("_same"), F.lit(0)), F.nullif(F.col("_told"), F.lit(0)))).select(*obs.columns)


def small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if a count says that it is small; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def dealt(rows: DataFrame, *keys: str, each: int = ROWS_A_TASK) -> DataFrame:
    """rows dealt by keys over so many partitions that one holds about ``each`` of them, whatever the table's size; groups and joins by
    these keys need no further shuffle. The count is one more pass, over plain tables of their footers only."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // each)), *keys)


def latest_fresh(obs: DataFrame, libraries: tuple[str, ...], now: Column, settings: Settings) -> DataFrame:
    return journal.fresh(journal.latest_discoveries(obs), libraries, now, settings.fresh_days)
