"""Schemas of the model's tables. Money is integer cents; unknown is null; order is the id's."""

from __future__ import annotations

from pyspark.sql import DataFrame

OBSERVATION = (
    "id long, run_id long, profile string, source string, source_item_id string, match_reason string, book_id long, title string, subtitle string, "
    "author string, price_cents long, original_price_cents long, availability string, reservation_count int, available_from string, category string, "
    "url string, blurb string, isbn string, series string, series_index string, cover_url string, rating int, rating_votes int, pages int, observed_at timestamp_ntz"
)
RUN = "id long, profile string, trigger string, started_at timestamp_ntz, finished_at timestamp_ntz, status string"
BOOK = "id long, title string, author string, isbn string, cover_url string, blurb string"
RELATION = "profile string, book_id long, kind string, active boolean, details string, seq long"
SERIES_ENTRY = "isbn string, origin string, series_id long, volume string"
WORK_ENTRY = "isbn string, origin string, key string"
RATING = "subject string, origin string, stars double, reason string, seq long"
PORTRAIT = "id long, subject string, known boolean, with_text boolean, genre_code string, form string, traits array<struct<term:string,sentence:string,evidence:string,weight:string>>, violations array<string>"

AVAILABILITY = ("available", "unavailable", "unknown")
MATCH_REASONS = ("watchlist", "profile_author", "genre_category")
DELTA_KINDS = ("first_seen", "became_available", "became_unavailable", "price_drop", "price_rise")

#: Which origin counts first when several name a series, a work or codes.
SERIES_ORIGINS = ("reader", "dnb", "wikidata", "overdrive", "onleihe", "title", "bundle")
WORK_ORIGINS = ("dnb", "title")
BISAC_ORIGINS = ("dnb", "overdrive")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, or an error that names the missing columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
