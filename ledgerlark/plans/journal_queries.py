"""Queries over the journal, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators import diff, eligibility, journal, ranking, state
from ledgerlark.plans.adapters import table, view, with_views
from ledgerlark.settings import Settings
from ledgerlark.streaming import runs

SETTINGS = Settings()
LIBRARIES = ("lib_a", "lib_b")
LATEST = "latest AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY source, source_item_id ORDER BY id DESC) = 1)"
JUNK = "CASE WHEN price_cents = 0 THEN 'gratis' WHEN match_reason = 'genre_category' AND regexp_matches(title, 'Sammelband|Sammelausgabe|Gesamtausgabe|Gesamtwerk|[0-9]\\s*in\\s*1', 'i') THEN 'Sammelband' WHEN match_reason = 'genre_category' AND regexp_matches(title, '(^|[^a-z])(Episode|Folge)\\s*[0-9]+', 'i') THEN 'Fortsetzungsheft' END"
STRONG = "coalesce(price_cents > 0 AND price_cents < 500, false)"
WORTH = f"CASE WHEN match_reason = 'watchlist' THEN true WHEN ({JUNK}) IS NOT NULL THEN false WHEN availability = 'available' THEN true ELSE {STRONG} END"
COMPARED = "compared AS (SELECT *, lag(id) OVER w AS previous_id, lag(price_cents) OVER w AS previous_price_cents, lag(availability) OVER w AS previous_availability FROM obs WINDOW w AS (PARTITION BY source, source_item_id ORDER BY id))"
DELTAS = f"""{COMPARED}, deltas AS (
  SELECT *, 'first_seen' AS kind FROM compared WHERE previous_id IS NULL AND {WORTH}
  UNION ALL SELECT *, CASE WHEN availability = 'available' THEN 'became_available' ELSE 'became_unavailable' END FROM compared
    WHERE previous_id IS NOT NULL AND availability <> previous_availability AND (availability = 'available' OR previous_availability = 'available')
  UNION ALL SELECT *, CASE WHEN price_cents < previous_price_cents THEN 'price_drop' ELSE 'price_rise' END FROM compared
    WHERE previous_id IS NOT NULL AND price_cents <> previous_price_cents AND (price_cents > previous_price_cents OR {WORTH}))"""

QUERIES, SQL = {}, {}


def query(sql: str | None, *views: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


def _obs(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "obs")


@query(f"+{LATEST} SELECT source, source_item_id, id, price_cents, availability FROM latest", "obs")
def agg_latest_per_item(spark, sf):
    return journal.latest_per(_obs(spark, sf)).select("source", "source_item_id", "id", "price_cents", "availability")


@query("SELECT book_id, source, max(id) AS id FROM obs GROUP BY ALL", "obs")
def agg_latest_per_book_source(spark, sf):
    return journal.latest_per(_obs(spark, sf), ("book_id", "source")).select("book_id", "source", "id")


@query(f"+{LATEST} SELECT id, source, title FROM latest WHERE match_reason <> 'watchlist' ORDER BY id DESC LIMIT 50", "obs")
def agg_latest_discoveries(spark, sf):
    return journal.latest_discoveries(_obs(spark, sf), 50).select("id", "source", "title")


@query("+l AS (SELECT * FROM obs WHERE isbn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, source_item_id ORDER BY id DESC) = 1) SELECT isbn, string_agg(id::VARCHAR, ',' ORDER BY id) AS sightings FROM l GROUP BY isbn", "obs")
def agg_sightings_by_isbn(spark, sf):
    return journal.sightings_by_isbn(_obs(spark, sf)).select("isbn", F.concat_ws(",", F.transform("sightings", lambda x: x.cast("string"))).alias("sightings"))


_PRICED = "+p AS (SELECT * FROM obs WHERE source = 'shop_a' AND price_cents IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, source_item_id ORDER BY id DESC) = 1) SELECT {by}, min(price_cents) AS price_cents FROM p WHERE price_cents > 0 AND {by} IS NOT NULL GROUP BY 1"


@query(_PRICED.format(by="title"), "obs")
def agg_min_price_by_title(spark, sf):
    return journal.least_prices(_obs(spark, sf), "title", "shop_a")


@query(_PRICED.format(by="isbn"), "obs")
def agg_min_price_by_isbn(spark, sf):
    return journal.least_prices(_obs(spark, sf), "isbn", "shop_a")


@query("+p AS (SELECT *, lag(price_cents) OVER (PARTITION BY source, source_item_id ORDER BY id) AS b FROM obs WHERE price_cents IS NOT NULL) SELECT id, source, source_item_id, price_cents FROM p WHERE price_cents IS DISTINCT FROM b", "obs")
def win_price_points(spark, sf):
    return journal.price_points(_obs(spark, sf)).select("id", "source", "source_item_id", "price_cents")


@query("WITH m AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events) SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY event_id) AS BIGINT) AS streak FROM m")
def win_streak(spark, sf):
    return journal.streaks(table(spark, sf, "events"), "user_id", "event_id", F.col("event_type") != "error").select("event_id", "user_id", "streak")


@query("SELECT event_id, user_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE event_type = 'error' AND b = 'error'")
def win_failing_twice(spark, sf):
    return journal.failing_twice(table(spark, sf, "events"), "user_id", "event_id", F.col("event_type") == "error").select("event_id", "user_id")


@query(f"+{LATEST} SELECT book_id, CASE min(CASE availability WHEN 'available' THEN 0 WHEN 'unavailable' THEN 1 WHEN 'unknown' THEN 2 END) WHEN 0 THEN 'available' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'unknown' END AS availability FROM latest GROUP BY 1", "obs")
def avail_best(spark, sf):
    return journal.best_availability(journal.latest_per(_obs(spark, sf)), "book_id")


@query("SELECT book_id, max_by(price_cents, id) FILTER (price_cents IS NOT NULL) AS price_cents FROM obs GROUP BY 1", "obs")
def price_newest_known(spark, sf):
    return journal.newest_known_price(_obs(spark, sf), "book_id")


@query(f"+{DELTAS} SELECT id, kind, price_cents, previous_price_cents, availability, previous_availability FROM deltas", "obs")
def q_deltas(spark, sf):
    return diff.deltas(diff.with_previous(_obs(spark, sf)), SETTINGS).select("id", "kind", "price_cents", "previous_price_cents", "availability", "previous_availability")


@query(f"+{COMPARED} SELECT id, previous_id, previous_price_cents, previous_availability FROM compared", "obs")
def win_compare(spark, sf):
    return diff.with_previous(_obs(spark, sf)).select("id", "previous_id", "previous_price_cents", "previous_availability")


@query("+old AS (SELECT * FROM obs WHERE run_id < 20 QUALIFY row_number() OVER (PARTITION BY source, source_item_id ORDER BY id DESC) = 1), new AS (SELECT * FROM obs WHERE run_id >= 20 QUALIFY row_number() OVER (PARTITION BY source, source_item_id ORDER BY id DESC) = 1) SELECT n.id, o.id AS previous_id, o.price_cents AS previous_price_cents FROM new n LEFT JOIN old o USING (source, source_item_id)", "obs")
def join_prev_state(spark, sf):
    obs = _obs(spark, sf)
    now, before = (journal.latest_per(obs.where(c)) for c in ("run_id >= 20", "run_id < 20"))
    return diff.against_state(now, before).select("id", "previous_id", "previous_price_cents")


RUNS = "runs AS (SELECT run_id AS id, 'default' AS profile, CASE WHEN run_id % 5 = 0 THEN 'entry' ELSE 'timer' END AS trigger, min(observed_at) AS started_at, CASE WHEN run_id % 7 <> 0 THEN max(observed_at) END AS finished_at, CASE WHEN run_id % 7 = 0 THEN 'abandoned' ELSE 'finished' END AS status FROM obs GROUP BY run_id)"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    run = F.col("run_id")
    return _obs(spark, sf).groupBy("run_id").agg(F.min("observed_at").alias("started_at"), F.max("observed_at").alias("_end")).select(
        run.alias("id"), F.lit("default").alias("profile"), F.when(run % 5 == 0, "entry").otherwise("timer").alias("trigger"), "started_at",
        F.when(run % 7 != 0, F.col("_end")).alias("finished_at"), F.when(run % 7 == 0, "abandoned").otherwise("finished").alias("status"),
    )


@query(f"+{RUNS} SELECT id, (SELECT max(p.id) FROM runs p WHERE p.id < r.id AND p.finished_at IS NOT NULL AND p.trigger <> 'entry') AS previous_run FROM runs r", "obs")
def join_asof_run(spark, sf):
    return journal.last_finished_run(_runs(spark, sf)).select("id", "previous_run")


@query(f"+{RUNS} SELECT id, status FROM runs WHERE trigger <> 'entry' ORDER BY id DESC LIMIT 10", "obs")
def limit_recent_runs(spark, sf):
    return _runs(spark, sf).where("trigger <> 'entry'").orderBy(F.desc("id")).limit(10).select("id", "status")


@query(f"+{RUNS} SELECT profile, count(*) FILTER (status = 'running') = 0 AND max(started_at) FILTER (status IN ('finished', 'running')) <= TIMESTAMP '2030-01-01' - INTERVAL 24 HOURS AS due FROM runs GROUP BY 1", "obs")
def dt_run_is_due(spark, sf):
    return state.run_is_due(_runs(spark, sf), F.expr("timestamp_ntz'2030-01-01 00:00:00'"))


@query("SELECT id, source, source_item_id, CAST(row_number() OVER (PARTITION BY source, source_item_id ORDER BY id DESC) AS INT) AS n FROM obs QUALIFY n <= 5", "obs")
def limit_history(spark, sf):
    return journal.history(_obs(spark, sf), 5).select("id", "source", "source_item_id", "n")


@query("SELECT source, category, count(*) AS n, max_by(title, id) FILTER (title IS NOT NULL) AS example FROM obs WHERE category IS NOT NULL GROUP BY 1, 2", "obs")
def agg_upsert_counter(spark, sf):
    return journal.count_categories(_obs(spark, sf))


@query("SELECT max(id) AS observations, max(run_id) AS runs FROM obs", "obs")
def agg_high_water(spark, sf):
    return _obs(spark, sf).agg(F.max("id").alias("observations"), F.max("run_id").alias("runs"))


_NOW = "(SELECT max(ts) FROM events)"


@query(f"+{LATEST} SELECT id, CASE WHEN availability = 'available' AND source IN ('lib_a', 'lib_b') AND {_NOW} - observed_at > INTERVAL 3 DAYS THEN 'unknown' ELSE availability END AS availability FROM latest", "obs")
def pred_fresh(spark, sf):
    obs = _obs(spark, sf)
    now = obs.agg(F.max("observed_at").alias("now"))
    return journal.fresh(journal.latest_per(obs).crossJoin(F.broadcast(now)), LIBRARIES, F.col("now"), SETTINGS.fresh_days).select("id", "availability")


@query(f"+{COMPARED} SELECT id, {STRONG} AS strong, CASE WHEN {STRONG} THEN 'Strong Deal' WHEN price_cents >= 500 AND price_cents < 1000 AND ((original_price_cents > price_cents AND (original_price_cents - price_cents) * 100.0 / original_price_cents >= 25) OR (previous_price_cents > price_cents AND (previous_price_cents - price_cents) * 100.0 / previous_price_cents >= 25)) THEN 'Deal' END AS flag FROM compared", "obs")
def fn_deal_flags(spark, sf):
    return diff.with_previous(_obs(spark, sf)).select("id", diff.is_strong_deal(SETTINGS).alias("strong"), diff.deal_flag(SETTINGS).alias("flag"))


@query(f"SELECT id, {JUNK} AS junk, {WORTH} AS worth, match_reason <> 'watchlist' AND (coalesce(pages < 80, false) OR regexp_matches(concat(coalesce(title, ''), ' ', coalesce(subtitle, '')), 'Kurzgeschichte|Kurzkrimi|(^|[^a-z])(Episode|Folge)\\s*[0-9]+', 'i')) AS short FROM obs", "obs")
def pred_junk_short_worth(spark, sf):
    return _obs(spark, sf).select("id", diff.junk_reason().alias("junk"), diff.worth_announcing(SETTINGS).alias("worth"), diff.is_short_story().alias("short"))


_SEEDED = "origin AS (SELECT DISTINCT source, source_item_id, CAST(source_item_id AS BIGINT) % 6 AS interest_id FROM obs WHERE CAST(source_item_id AS BIGINT) % 4 <> 0), seeded AS (SELECT DISTINCT interest_id, source FROM origin WHERE interest_id < 3)"


@query(f"+{DELTAS}, {_SEEDED} SELECT d.id, d.kind FROM deltas d LEFT JOIN origin o USING (source, source_item_id) WHERE NOT (d.kind = 'first_seen' AND d.match_reason <> 'watchlist' AND o.interest_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM seeded s WHERE s.interest_id = o.interest_id AND s.source = d.source))", "obs")
def pred_suppress_unseeded(spark, sf):
    obs = _obs(spark, sf)
    number = F.col("source_item_id").cast("long")
    origin = obs.where(number % 4 != 0).select("source", "source_item_id", (number % 6).alias("interest_id")).distinct()
    seeded = origin.where("interest_id < 3").select("interest_id", "source").distinct()
    return diff.suppress_unseeded(diff.deltas(diff.with_previous(obs), SETTINGS), origin, seeded).select("id", "kind")


@query(f"+{DELTAS} SELECT CASE WHEN kind = 'became_available' THEN 'available' WHEN kind = 'price_drop' THEN 'price drops' WHEN kind = 'first_seen' AND source LIKE 'lib%' THEN 'library finds' WHEN kind = 'first_seen' THEN 'finds' ELSE 'other changes' END AS section, count(*) AS n, count(DISTINCT coalesce('isbn:' || isbn, 'item:' || source || ':' || source_item_id)) AS subjects FROM deltas GROUP BY 1", "obs")
def agg_digest_sections(spark, sf):
    found = diff.deltas(diff.with_previous(_obs(spark, sf)), SETTINGS).withColumn("subject", eligibility.subject())
    return found.groupBy(diff.digest_section(SETTINGS, LIBRARIES).alias("section")).agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"))


@query("+f AS (SELECT coalesce('isbn:' || isbn, 'item:' || source || ':' || source_item_id) AS subject, min(id) AS arrival FROM obs WHERE match_reason <> 'watchlist' GROUP BY 1) SELECT * FROM f ORDER BY arrival LIMIT 40", "obs")
def topk_budget(spark, sf):
    return eligibility.budgeted(_obs(spark, sf).where("match_reason <> 'watchlist'").withColumn("subject", eligibility.subject()), SETTINGS.gate_budget)


def _sorted(slug: str) -> list[Column]:
    return ranking.sort_order(slug)


@query(f"+{LATEST} SELECT id, CAST(row_number() OVER (ORDER BY price_cents ASC NULLS LAST, id DESC) AS INT) AS n FROM latest QUALIFY n <= 30", "obs")
def sort_by_price(spark, sf):
    return ranking.top(journal.latest_per(_obs(spark, sf)), _sorted("price"), 30).select("id", "n")


@query(f"+{LATEST} SELECT id, CAST(row_number() OVER (ORDER BY observed_at DESC NULLS LAST, id DESC) AS INT) AS n FROM latest QUALIFY n <= 30", "obs")
def sort_by_newest(spark, sf):
    return ranking.top(journal.latest_per(_obs(spark, sf)), _sorted("new"), 30).select("id", "n")


@query(f"+{LATEST}, h AS (SELECT *, {STRONG} AS deal FROM latest WHERE {STRONG} OR availability = 'available') SELECT id, CAST(row_number() OVER (ORDER BY NOT deal, CASE WHEN deal THEN price_cents END NULLS LAST, lower(title) NULLS LAST, id) AS INT) AS n FROM h QUALIFY n <= 5", "obs")
def topk_home_offers(spark, sf):
    offers = journal.latest_per(_obs(spark, sf)).withColumn("deal", diff.is_strong_deal(SETTINGS)).where(F.col("deal") | diff.known(F.col("availability") == "available"))
    order = [F.asc(~F.col("deal")), F.asc_nulls_last(F.when(F.col("deal"), F.col("price_cents"))), F.asc_nulls_last(F.lower("title")), F.asc("id")]
    return ranking.top(offers, order, 5).select("id", "n")


@query(f"+{LATEST}, s AS (SELECT * FROM latest ORDER BY price_cents NULLS LAST, id DESC LIMIT 10), u AS (SELECT * FROM latest WHERE id NOT IN (SELECT id FROM s)) SELECT id, CAST(row_number() OVER (ORDER BY price_cents NULLS LAST, id DESC) AS INT) AS n, greatest((SELECT count(*) FROM u) - 10, 0) AS rest FROM u QUALIFY n <= 10", "obs")
def win_page(spark, sf):
    latest, order = journal.latest_per(_obs(spark, sf)), _sorted("price")
    return ranking.page(latest, ranking.top(latest, order, 10), ["id"], order, 10).select("id", "n", "rest")


@query("SELECT source, id, price_cents, CAST(rank() OVER (PARTITION BY source ORDER BY price_cents DESC) AS INT) AS place FROM obs WHERE price_cents IS NOT NULL QUALIFY place <= 5", "obs")
def win_top_with_ties(spark, sf):
    return ranking.top_with_ties(_obs(spark, sf).where("price_cents is not null"), ["source"], "price_cents", 5).select("source", "id", "price_cents", "place")


@query("SELECT id, CAST((row_number() OVER (PARTITION BY run_id ORDER BY id) - 1) // 25 AS BIGINT) AS chunk FROM obs", "obs")
def win_chunk(spark, sf):
    return ranking.chunks(_obs(spark, sf), ["run_id"], [F.col("id")], 25).select("id", "chunk")


@query("SELECT isbn, CAST(count(*) AS BIGINT) AS n, row_number() OVER (ORDER BY bool_or(match_reason = 'watchlist') DESC, max(id) DESC)::INT AS place FROM obs WHERE isbn IS NOT NULL GROUP BY isbn QUALIFY place <= 20", "obs")
def topk_dnb_queue(spark, sf):
    isbns = _obs(spark, sf).where("isbn is not null").groupBy("isbn").agg(F.count("*").alias("n"), F.bool_or(F.col("match_reason") == "watchlist").alias("own"), F.max("id").alias("seen"))
    first = ranking.top(isbns.withColumnRenamed("n", "sightings"), [F.desc("own"), F.desc("seen")], 20)
    return first.select("isbn", F.col("sightings").alias("n"), F.col("n").alias("place"))


@query("SELECT id FROM obs WHERE book_id = 7 UNION SELECT o.id FROM obs o WHERE EXISTS (SELECT 1 FROM obs b WHERE b.book_id = 7 AND b.isbn = o.isbn)", "obs")
def join_disjunctive(spark, sf):
    obs = _obs(spark, sf)
    own = obs.where("book_id = 7")
    return own.select("id").unionByName(obs.join(own.select("isbn").distinct(), "isbn", "left_semi").select("id")).distinct()


@query("+c AS (SELECT user_id AS item, event_id AS seq, event_type <> 'error' AS active, CASE WHEN event_id % 3 = 0 THEN props END AS details FROM events) SELECT item, max_by(active, seq) AS active, max_by(details, seq) FILTER (details IS NOT NULL) AS details, max(seq) AS seq FROM c GROUP BY 1".replace("+c", "WITH c"))
def dml_upsert_details(spark, sf):
    log = table(spark, sf, "events").select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("active"), F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("details"))
    return state.kept_details(log, "item")


@query("WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) SELECT user_id, event_id, value FROM l WHERE event_type <> 'error'")
def dml_active_view(spark, sf):
    log = table(spark, sf, "events").withColumn("active", F.col("event_type") != "error")
    return state.active(log.withColumnRenamed("event_id", "seq"), "user_id").select("user_id", F.col("seq").alias("event_id"), "value")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st_tumbling(spark, sf):
    out = runs.tumbling(table(spark, sf, "events"), "1 hour", "event_type")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, count(*) AS n FROM s GROUP BY user_id, k")
def st_sessions(spark, sf):
    out = runs.sessions(table(spark, sf, "events"), "30 minutes", "user_id")
    return out.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")), "n")


_CHANGES = "+compared2 AS (SELECT id, source, source_item_id, price_cents, availability, lag(id) OVER w AS p, lag(price_cents) OVER w AS pp, lag(availability) OVER w AS pa FROM obs WINDOW w AS (PARTITION BY source, source_item_id ORDER BY id)) SELECT id, 'first_seen' AS kind FROM compared2 WHERE p IS NULL UNION ALL SELECT id, CASE WHEN availability = 'available' THEN 'became_available' ELSE 'became_unavailable' END FROM compared2 WHERE availability <> pa AND 'available' IN (availability, pa) UNION ALL SELECT id, CASE WHEN price_cents < pp THEN 'price_drop' ELSE 'price_rise' END FROM compared2 WHERE price_cents <> pp"


@query(_CHANGES, "obs")
def st_change_stream(spark, sf):
    """The stateful stream's rule over all rows as one batch of groups."""
    compared = diff.with_previous(_obs(spark, sf))
    price, was, now, before = (F.col(c) for c in ("price_cents", "previous_price_cents", "availability", "previous_availability"))
    kinds = F.array(
        F.when(F.col("previous_id").isNull(), "first_seen"),
        F.when((now != before) & (now == "available"), "became_available").when((now != before) & (before == "available"), "became_unavailable"),
        F.when(price < was, "price_drop").when(price > was, "price_rise"),
    )
    return compared.select("id", F.explode(F.array_compact(kinds)).alias("kind"))
