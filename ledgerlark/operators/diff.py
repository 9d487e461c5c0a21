"""Change data capture over the journal, and what of it is worth telling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.text import BUNDLE_PATTERN, EPISODE_PATTERN, SHORT_PATTERN
from ledgerlark.operators.journal import DISCOVERY_REASONS, ITEM
from ledgerlark.settings import Settings

NOTIFIABLE = ("first_seen", "became_available", "price_drop")


def known(condition: Column) -> Column:
    """A condition that is false where it is unknown: what isn't known excludes nothing."""
    return F.coalesce(condition, F.lit(False))


def junk_reason(price: str = "price_cents", reason: str = "match_reason", title: str = "title") -> Column:
    """"gratis" at no price; a bundle's or an episode's form counts only on a genre shelf; else null."""
    shelf = F.col(reason) == "genre_category"
    return F.when(F.col(price) == 0, "gratis").when(shelf & F.col(title).rlike(BUNDLE_PATTERN), "Sammelband").when(shelf & F.col(title).rlike(EPISODE_PATTERN), "Fortsetzungsheft")


def is_short_story(form: Column | None = None, least_pages: int = 80) -> Column:
    named = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("subtitle", F.lit("")))
    by_form = F.col("pages").isNull() & (form == "kurzgeschichte") if form is not None else F.lit(False)
    return known((F.col("match_reason") != "watchlist") & (known(F.col("pages") < least_pages) | known(by_form) | named.rlike(SHORT_PATTERN) | named.rlike(EPISODE_PATTERN)))


def is_strong_deal(settings: Settings, price: str = "price_cents") -> Column:
    return known((F.col(price) > 0) & (F.col(price) < settings.strong_deal_max_cents))


def is_deal(settings: Settings, previous: str = "previous_price_cents") -> Column:
    price = F.col("price_cents")

    def discounted(reference: Column) -> Column:
        return known((reference > price) & ((reference - price) * 100.0 / F.nullif(reference, F.lit(0)) >= settings.min_discount_pct))

    band = known((price >= settings.strong_deal_max_cents) & (price < settings.deal_max_cents))
    return band & (discounted(F.col("original_price_cents")) | discounted(F.col(previous)))


def deal_flag(settings: Settings, previous: str = "previous_price_cents") -> Column:
    return F.when(is_strong_deal(settings), "Strong Deal").when(is_deal(settings, previous), "Deal")


def worth_announcing(settings: Settings, bundle_advantage: Column | None = None) -> Column:
    advantage = known(bundle_advantage) if bundle_advantage is not None else F.lit(False)
    return (
        F.when(F.col("match_reason") == "watchlist", True)
        .when(junk_reason().isNotNull(), False)
        .when(F.col("availability") == "available", True)
        .when(advantage, True)
        .otherwise(is_strong_deal(settings))
    )


def with_previous(obs: DataFrame) -> DataFrame:
    """obs beside price and availability of the row before it of the same item; previous_id is null for the first."""
    w = Window.partitionBy(*ITEM).orderBy("id")
    return obs.withColumns({"previous_id": F.lag("id").over(w), "previous_price_cents": F.lag("price_cents").over(w), "previous_availability": F.lag("availability").over(w)})


def against_state(current: DataFrame, state: DataFrame) -> DataFrame:
    """current beside the latest stored row of the same item (state has one row for each)."""
    stored = state.select(*ITEM, F.col("id").alias("previous_id"), F.col("price_cents").alias("previous_price_cents"), F.col("availability").alias("previous_availability"))
    return current.join(stored, list(ITEM), "left")


def deltas(compared: DataFrame, settings: Settings, bundle_advantage: Column | None = None) -> DataFrame:
    """One row for each change: compared with kind. A row may change in availability and in price."""
    now, before = F.col("availability"), F.col("previous_availability")
    price, was = F.col("price_cents"), F.col("previous_price_cents")
    worth, first = worth_announcing(settings, bundle_advantage), F.col("previous_id").isNull()
    changed = ~first & known(now != before)
    kinds = F.array(
        F.when(first & worth, "first_seen"),
        F.when(changed & (now == "available"), "became_available").when(changed & (before == "available"), "became_unavailable"),
        F.when(~first & known(price < was) & worth, "price_drop").when(~first & known(price > was), "price_rise"),
    )
    return compared.withColumn("kind", F.explode(F.array_compact(kinds)))


def suppress_unseeded(found: DataFrame, origin: DataFrame, seeded: DataFrame) -> DataFrame:
    """Deltas without first sightings whose interest is known but not yet seeded at that source.

    origin: (source, source_item_id, interest_id); seeded: (interest_id, source)."""
    marked = found.join(origin, list(ITEM), "left").join(seeded.withColumn("_seeded", F.lit(True)), ["interest_id", "source"], "left")
    silent = (F.col("kind") == "first_seen") & F.col("match_reason").isin(*DISCOVERY_REASONS) & F.col("interest_id").isNotNull() & F.col("_seeded").isNull()
    return marked.where(~known(silent)).select(*found.columns)


def is_discovery() -> Column:
    return F.col("kind").isin("first_seen", "became_available") & (F.col("match_reason") != "watchlist")


def digest_section(settings: Settings, library_sources: tuple[str, ...]) -> Column:
    """The section of a digest in which a delta stands."""
    return (
        F.when(F.col("kind") == "became_available", "available")
        .when(F.col("kind") == "price_drop", "price drops")
        .when((F.col("kind") == "first_seen") & F.col("source").isin(*library_sources), "library finds")
        .when(F.col("kind") == "first_seen", "finds")
        .otherwise("other changes")
    )
