"""Queries of the shelf and of watching, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators import shelf, watching
from ledgerlark.plans.adapters import table, view, with_views

QUERIES, SQL = {}, {}


def query(sql: str | None = None, *views: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


def _rows(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return table(spark, sf, name).selectExpr(*columns)


# --- books: parts are the shelf, events bring titles, ISBNs and new names ---


@query("""WITH books AS (SELECT p_partkey AS id, 'i' || p_partkey AS isbn, p_name AS title, CASE WHEN p_size > 30 THEN 'Lee, Ann' WHEN p_size > 15 THEN 'Bo Ray' END AS author, CASE WHEN p_size > 20 THEN p_brand END AS series FROM part WHERE p_size > 10),
  r AS (SELECT event_id + 1 AS row, CASE WHEN event_type <> 'error' THEN 'i' || user_id END AS isbn, event_type AS title, CASE event_type WHEN 'view' THEN 'Ann Lee' WHEN 'click' THEN 'Lee, Ann' END AS author, CASE WHEN value > 50 THEN props END AS series FROM events),
  p AS (SELECT r.*, b.id FROM r LEFT JOIN books b ON b.isbn = r.isbn),
  k AS (SELECT *, coalesce('id' || id, isbn, title) AS key FROM p),
  told AS (SELECT key, min_by(series, row) FILTER (series IS NOT NULL) AS s, min_by(author, row) FILTER (author IS NOT NULL) AS a, bool_or(author = 'Ann Lee') AS better FROM k GROUP BY 1),
  new AS (SELECT key, min(row) AS row FROM k WHERE id IS NULL GROUP BY 1),
  n AS (SELECT 'id' || id AS key, b.* FROM books b UNION ALL SELECT key, row + (SELECT max(id) FROM books), r.isbn, r.title, r.author, r.series FROM new JOIN r USING (row)),
  o AS (SELECT n.*, s, coalesce(author, a) AS own, better FROM n LEFT JOIN told USING (key))
  SELECT id, isbn, title, CASE WHEN own = 'Lee, Ann' AND better THEN 'Ann Lee' ELSE own END AS author, coalesce(series, s) AS series FROM o""")
def dml_book(spark, sf):
    books = _rows(spark, sf, "part", "p_partkey id", "concat('i', p_partkey) isbn", "p_name title", "case when p_size > 30 then 'Lee, Ann' when p_size > 15 then 'Bo Ray' end author", "case when p_size > 20 then p_brand end series", "p_size").where("p_size > 10").drop("p_size")
    rows = _rows(spark, sf, "events", "event_id + 1 row", "case when event_type <> 'error' then concat('i', user_id) end isbn", "event_type title", "case event_type when 'view' then 'Ann Lee' when 'click' then 'Lee, Ann' end author", "case when value > 50 then props end series")
    return shelf.find_or_create(books, rows, shelf.by_isbn(rows, books))


@query("""WITH RECURSIVE b AS (SELECT c_custkey AS id, CASE WHEN c_acctbal > 5000 THEN 'i' || c_custkey END AS isbn FROM customer), o AS (SELECT o_custkey AS book, 'i' || o_orderkey % 1300 AS isbn, min(o_orderkey) AS seq FROM orders GROUP BY 1, 2),
  e AS (SELECT *, 0 AS step, false AS held FROM o WHERE isbn NOT IN (SELECT isbn FROM b WHERE isbn IS NOT NULL) AND book IN (SELECT id FROM b WHERE isbn IS NULL)
    UNION ALL (WITH f AS (SELECT *, seq = min(seq) OVER (PARTITION BY book) AND seq = min(seq) OVER (PARTITION BY isbn) AS wins FROM e WHERE NOT held)
      SELECT book, isbn, seq, step + 1, wins FROM f WHERE wins OR (book NOT IN (SELECT book FROM f WHERE wins) AND isbn NOT IN (SELECT isbn FROM f WHERE wins))))
  SELECT id, coalesce(b.isbn, e.isbn) AS isbn FROM b LEFT JOIN e ON e.book = id AND e.held""")
def dml_learn_isbn(spark, sf):
    books = _rows(spark, sf, "customer", "c_custkey id", "case when c_acctbal > 5000 then concat('i', c_custkey) end isbn")
    return shelf.learn_isbns(books, _rows(spark, sf, "orders", "o_custkey book_id", "concat('i', o_orderkey % 1300) isbn", "o_orderkey seq"))


_RENAMES = """b AS (SELECT p_partkey AS id, p_name AS title, p_brand AS author, 'c' || p_partkey AS cover FROM part),
  n AS (SELECT user_id AS id, CASE event_type WHEN 'click' THEN '  ' WHEN 'view' THEN ' New one ' ELSE p_name END AS title, CASE WHEN value > 50 THEN ' ' WHEN value > 20 THEN 'Bo ' END AS author, event_id AS seq FROM events JOIN part ON p_partkey = user_id),
  w AS (SELECT n.id, trim(n.title) AS t, n.author AS a, seq, b.title AS t0, b.author AS a0 FROM n JOIN b USING (id) WHERE trim(n.title) <> ''),
  x AS (SELECT *, coalesce(lag(t) OVER v, t0) AS t1, last_value(trim(a) IGNORE NULLS) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a1 FROM w WINDOW v AS (PARTITION BY id ORDER BY seq)),
  l AS (SELECT id, max_by(t, seq) AS t, max_by(a, seq) FILTER (a IS NOT NULL) AS a, bool_or(NOT (t = t1 AND (a IS NULL OR a IS NOT DISTINCT FROM CASE WHEN a1 IS NULL THEN a0 ELSE nullif(a1, '') END))) AS changed FROM x GROUP BY 1),
  j AS (SELECT b.*, t, a, coalesce(changed, false) AS renamed FROM b LEFT JOIN l USING (id))"""


def _renamed(spark: SparkSession, sf: str) -> DataFrame:
    books = _rows(spark, sf, "part", "p_partkey id", "p_name title", "p_brand author", "concat('c', p_partkey) cover")
    events = table(spark, sf, "events").join(books.selectExpr("id user_id", "title p_name"), "user_id")
    renames = events.selectExpr("user_id book_id", "case event_type when 'click' then '  ' when 'view' then ' New one ' else p_name end title", "case when value > 50 then ' ' when value > 20 then 'Bo ' end author", "event_id seq")
    return shelf.rename_books(books, renames)


@query(f"WITH {_RENAMES} SELECT id, CASE WHEN renamed THEN t ELSE title END AS title, CASE WHEN renamed AND a IS NOT NULL THEN nullif(trim(a), '') ELSE author END AS author, CASE WHEN NOT renamed THEN cover END AS cover, renamed FROM j")
def dml_rename_book(spark, sf):
    return _renamed(spark, sf)


@query(f"WITH {_RENAMES} SELECT DISTINCT book_id, source FROM (SELECT user_id AS book_id, event_type AS source FROM events UNION ALL SELECT p_partkey, p_brand FROM part) WHERE book_id NOT IN (SELECT id FROM j WHERE renamed)")
def dml_links_after_renaming(spark, sf):
    links = _rows(spark, sf, "events", "user_id book_id", "event_type source").unionByName(_rows(spark, sf, "part", "p_partkey book_id", "p_brand source")).distinct()
    return shelf.links_after_renaming(links, _renamed(spark, sf))


_OUTCOME = "CASE WHEN value > 60 THEN 'linked' WHEN value > 40 THEN 'confirmed' WHEN value > 20 THEN 'unsure' ELSE 'not_found' END"


@query(f"""WITH c AS (SELECT user_id AS book_id, event_type AS source, max_by({_OUTCOME}, event_id) AS outcome, arg_max_null(CASE WHEN value > 40 THEN 'u' || event_id END, event_id) AS url FROM events GROUP BY 1, 2)
  FROM c UNION ALL SELECT p_partkey, 'view', 'linked', 'old' FROM part WHERE p_partkey NOT IN (SELECT book_id FROM c WHERE source = 'view')""")
def dml_book_source(spark, sf):
    links = _rows(spark, sf, "part", "p_partkey book_id", "'view' source", "'linked' outcome", "'old' url")
    return shelf.put_links(links, _rows(spark, sf, "events", "user_id book_id", "event_type source", f"{_OUTCOME} outcome", "case when value > 40 then concat('u', event_id) end url", "event_id seq"))


@query("""WITH e AS (SELECT *, max(CASE WHEN value > 90 THEN event_id END) OVER (PARTITION BY user_id, event_type) AS reset FROM events), a AS (SELECT * FROM e WHERE reset IS NULL OR event_id >= reset),
  u AS (SELECT user_id, event_type, event_id AS seq, 1 AS i, 'u' || CAST(floor(value) AS INT) AS url FROM a UNION ALL SELECT user_id, event_type, event_id, 2, CASE WHEN value < 50 THEN 'low' ELSE '' END FROM a
    UNION ALL SELECT user_id, event_type, -1, 0, 'u5' FROM (SELECT user_id, event_type FROM e GROUP BY ALL HAVING max(reset) IS NULL)),
  f AS (SELECT user_id, event_type, url, min(row(seq, i)) AS first FROM u WHERE url <> '' GROUP BY 1, 2, 3)
  SELECT g.user_id AS book_id, g.event_type AS source, coalesce(string_agg(url, ',' ORDER BY first), '') AS rejected FROM (SELECT DISTINCT user_id, event_type FROM events) g LEFT JOIN f USING (user_id, event_type) GROUP BY 1, 2""")
def dml_reject_candidates(spark, sf):
    links = _rows(spark, sf, "events", "user_id book_id", "event_type source", "array('u5') rejected").distinct()
    urls = "array(concat('u', cast(floor(value) as int)), case when value < 50 then 'low' else '' end) urls"
    found = shelf.reject_candidates(links, _rows(spark, sf, "events", "user_id book_id", "event_type source", urls, "coalesce(value > 90, false) restore", "event_id seq"))
    return found.withColumn("rejected", F.array_join("rejected", ","))


@query("""WITH f AS (SELECT *, lag(a) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM a AS flip FROM (SELECT *, event_type IN ('view', 'click') AS a FROM events))
  SELECT user_id AS series_id, max_by(a, event_id) AS active, max_by(ts, event_id) FILTER (flip) AS since FROM f GROUP BY 1""")
def dml_series_watch(spark, sf):
    return shelf.watch_state(_rows(spark, sf, "events", "user_id series_id", "event_type in ('view', 'click') active", "ts at", "event_id seq"), "series_id")


@query("""WITH e AS (SELECT CAST(p_partkey AS VARCHAR) AS isbn, 'dnb' AS origin, p_brand AS name, CAST(p_size AS VARCHAR) AS volume FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'reader', p_type, NULL FROM part WHERE p_size > 25),
  a AS (SELECT CAST(user_id AS VARCHAR) AS isbn, max_by(CASE event_type WHEN 'click' THEN ' ' ELSE event_type || ' ' END, event_id) AS name, max_by(CASE WHEN value > 50 THEN ' 3' ELSE '' END, event_id) AS volume FROM events GROUP BY 1)
  SELECT * FROM e WHERE NOT (origin = 'reader' AND isbn IN (SELECT isbn FROM a)) UNION ALL SELECT isbn, 'reader', trim(name), nullif(trim(volume), '') FROM a WHERE trim(name) <> ''""")
def dml_series(spark, sf):
    part = _rows(spark, sf, "part", "cast(p_partkey as string) isbn", "p_brand", "p_type", "p_size")
    entries = part.selectExpr("isbn", "'dnb' origin", "p_brand name", "cast(p_size as string) volume").unionByName(part.where("p_size > 25").selectExpr("isbn", "'reader' origin", "p_type name", "cast(null as string) volume"))
    assigned = _rows(spark, sf, "events", "cast(user_id as string) isbn", "case event_type when 'click' then ' ' else concat(event_type, ' ') end name", "case when value > 50 then ' 3' else '' end volume", "event_id seq")
    return shelf.assign_series(entries, assigned)


@query("""WITH e AS (SELECT o_orderkey AS isbn, unnest(['dnb', 'overdrive']) AS origin, o_orderpriority AS code, 0 AS rank FROM orders), a AS (SELECT o_orderkey AS isbn, 'dnb' AS origin, CASE WHEN o_totalprice > 200000 THEN [o_orderstatus, 'x', o_orderstatus] ELSE [] END AS codes FROM orders WHERE o_orderstatus <> 'O')
  SELECT * FROM e WHERE NOT (origin = 'dnb' AND isbn IN (SELECT isbn FROM a)) UNION ALL SELECT isbn, origin, codes[1], 0 FROM a WHERE len(codes) > 0 UNION ALL SELECT isbn, origin, 'x', 1 FROM a WHERE len(codes) > 0""")
def dml_bisac(spark, sf):
    entries = _rows(spark, sf, "orders", "o_orderkey isbn", "explode(array('dnb', 'overdrive')) origin", "o_orderpriority code", "0 rank")
    answers = table(spark, sf, "orders").where("o_orderstatus <> 'O'").selectExpr("o_orderkey isbn", "'dnb' origin", "case when o_totalprice > 200000 then array(o_orderstatus, 'x', o_orderstatus) else array() end codes")
    return shelf.replace_codes(entries, answers)


@query("""SELECT c_custkey AS id, CAST(c_custkey AS VARCHAR) AS isbn, coalesce(own, CASE WHEN p_size > 10 THEN told END) AS series, CASE WHEN own IS NOT NULL THEN 1 WHEN p_size > 10 AND told IS NOT NULL THEN p_size END AS series_index, own IS NULL AND coalesce(p_size > 10, false) AND told IS NOT NULL AS filled
  FROM (SELECT *, CASE WHEN c_acctbal > 5000 THEN c_mktsegment END AS own FROM customer) LEFT JOIN (SELECT *, CASE WHEN p_retailprice > 930 THEN p_brand END AS told FROM part) ON p_partkey = c_custkey""")
def join_inner_fill(spark, sf):
    books = _rows(spark, sf, "customer", "c_custkey id", "cast(c_custkey as string) isbn", "case when c_acctbal > 5000 then c_mktsegment end series", "case when c_acctbal > 5000 then 1 end series_index")
    return shelf.fill_series(books, _rows(spark, sf, "part", "cast(p_partkey as string) isbn", "p_size > 10 found", "case when p_retailprice > 930 then p_brand end series", "p_size series_index"))


@query("SELECT p_partkey AS isbn, p_brand AS series_item FROM part WHERE p_size <= 25 AND p_brand IN (SELECT 'Brand#' || s_nationkey FROM supplier WHERE s_acctbal > 7000)")
def join_same_world(spark, sf):
    records = _rows(spark, sf, "part", "p_partkey isbn", "p_brand series_item", "case when p_size > 25 then p_size end volume")
    return shelf.same_world(records, table(spark, sf, "supplier").where("s_acctbal > 7000").selectExpr("concat('Brand#', s_nationkey) series_item"))


@query("""WITH l AS (SELECT user_id AS isbn, max_by(event_type <> 'error', event_id) AS found, max_by(CASE WHEN value > 30 THEN 2 ELSE 1 END, event_id) AS reading FROM events GROUP BY 1)
  SELECT p_partkey AS isbn FROM part WHERE p_partkey NOT IN (SELECT isbn FROM l WHERE NOT found OR reading >= 2)""")
def st_negative_cache(spark, sf):
    log = _rows(spark, sf, "events", "user_id isbn", "event_type <> 'error' found", "case when value > 30 then 2 else 1 end reading", "event_id seq")
    return shelf.to_ask(_rows(spark, sf, "part", "p_partkey isbn"), log, 2)


@query("""WITH r AS (SELECT 'item:' || user_id AS subject, value AS stars, length(props) AS votes, event_id AS id FROM events WHERE value IS NOT NULL AND event_type IN ('view', 'click'))
  SELECT subject, max_by(stars, id) AS stars, max_by(votes, id) AS votes, 'Durchschnitt der Leser:innen aus ' || max_by(votes, id) || ' Stimmen' AS reason FROM r GROUP BY 1""")
def q_foreign_ratings(spark, sf):
    return shelf.foreign_ratings(_rows(spark, sf, "events", "event_id id", "concat('item:', user_id) subject", "value rating", "case event_type when 'view' then length(props) when 'click' then length(props) when 'error' then 0 end rating_votes"))


# --- watching: events are what sources said ---

_NOW = "2024-01-20 00:00:00"


@query(f"""WITH l AS (SELECT user_id AS book_id, arg_max_null(CASE WHEN event_type = 'purchase' THEN 'u' || event_id END, event_id) AS u, max_by(ts, event_id) AS tried FROM events GROUP BY 1),
  s AS (SELECT p_partkey AS book_id, CASE WHEN p_size > 40 THEN 'p' || p_size END AS pin, l.* EXCLUDE (book_id), CASE WHEN p_size > 40 THEN 'pinned' WHEN u IS NOT NULL THEN 'remembered' WHEN TIMESTAMP '{_NOW}' - tried < INTERVAL 7 DAY THEN 'wait' ELSE 'resolve' END AS step FROM part LEFT JOIN l ON l.book_id = p_partkey)
  SELECT book_id, 'shop' AS source, CASE step WHEN 'pinned' THEN pin WHEN 'remembered' THEN u END AS url, step FROM s""")
def src_watch(spark, sf):
    last = _rows(spark, sf, "events", "user_id book_id", "struct(case when event_type = 'purchase' then concat('u', event_id) end url, cast(ts as timestamp_ntz) resolved_at) l", "event_id").groupBy("book_id").agg(F.max_by("l", "event_id").alias("l"))
    entries = _rows(spark, sf, "part", "p_partkey book_id", "'shop' source", "case when p_size > 40 then concat('p', p_size) end pinned")
    return watching.linked_entries(entries, last.selectExpr("book_id", "'shop' source", "l.*"), F.expr(f"timestamp_ntz'{_NOW}'"))


@query("""SELECT o_orderkey AS book_id, o_orderpriority AS source, CASE o_orderstatus WHEN 'O' THEN 'linked' WHEN 'F' THEN CASE WHEN o_totalprice > 150000 THEN 'unsure' ELSE 'not_found' END ELSE 'not_found' END AS outcome, CASE o_orderstatus WHEN 'O' THEN 'u' || o_orderkey END AS url,
  CASE WHEN o_orderstatus = 'P' THEN 'not in this catalogue' ELSE 'because' END AS reason, CASE WHEN o_orderstatus <> 'P' AND o_totalprice > 150000 THEN 2 END AS n_candidates, o_orderstatus = 'F' AND o_totalprice > 150000 AS attention FROM orders""")
def src_remember(spark, sf):
    orders = table(spark, sf, "orders")
    asked = orders.selectExpr("o_orderkey book_id", "o_orderpriority source")
    level = "case when o_orderstatus = 'O' then 'auto_accept' when o_totalprice > 150000 then 'provisional' else 'no_match' end confidence"
    told = orders.where("o_orderstatus <> 'P'").selectExpr("o_orderkey book_id", "o_orderpriority source", level, "concat('u', o_orderkey) url", "'because' reason", "'t' matched_title", "'a' matched_author", "case when o_totalprice > 150000 then array('x', 'y') else array() end candidates")
    kept = watching.remembered(asked, told, F.expr(f"timestamp_ntz'{_NOW}'"))
    return kept.select("book_id", "source", "outcome", "url", "reason", F.when(F.col("candidates").isNotNull(), F.size("candidates")).alias("n_candidates"), "attention")


_RELATIONS = "r AS (SELECT o_custkey AS book_id, CASE o_orderstatus WHEN 'O' THEN 'owned' ELSE 'watching' END AS kind, o_totalprice > 420000 AS active, 'Brand#' || (o_custkey % 5) AS series, o_orderpriority > '2' AS ended, o_orderpriority > '3' AS removed FROM orders WHERE o_totalprice > 330000)"


def _relations(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").where("o_totalprice > 330000")
    return rows.selectExpr("o_custkey book_id", "case o_orderstatus when 'O' then 'owned' else 'watching' end kind", "o_totalprice > 420000 active", "concat('Brand#', o_custkey % 5) series", "o_orderpriority > '2' ended", "o_orderpriority > '3' removed")


@query(f"""WITH {_RELATIONS} SELECT p_brand AS series_id, p_partkey AS book_id FROM part WHERE p_partkey NOT IN (SELECT book_id FROM r WHERE active)
  AND (p_partkey NOT IN (SELECT book_id FROM r WHERE kind = 'watching') OR EXISTS (SELECT 1 FROM r WHERE r.book_id = p_partkey AND kind = 'watching' AND ended AND series = p_brand))""")
def q_series_watch(spark, sf):
    return watching.volumes_to_add(_rows(spark, sf, "part", "p_brand series_id", "p_partkey book_id"), _relations(spark, sf), revive=True)


@query(f"WITH {_RELATIONS}, h AS (SELECT *, series IN ('Brand#1', 'Brand#3') AND kind = 'watching' AND (active OR NOT removed) AS hit FROM r) SELECT book_id, kind, active AND NOT hit AS active, series, ended OR hit AS ended, removed OR hit AS removed FROM h")
def q_series_unwatch(spark, sf):
    return watching.unwatched(_relations(spark, sf), spark.createDataFrame([("Brand#1",), ("Brand#3",)], "series string"))


@query("""SELECT 'Brand#' || s_suppkey AS series_id, s_name AS name, (SELECT count(*) FROM part WHERE p_brand = 'Brand#' || s_suppkey) AS known, (SELECT count(*) FROM part WHERE p_brand = 'Brand#' || s_suppkey AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)) AS owned FROM supplier""")
def agg_followed(spark, sf):
    series = _rows(spark, sf, "supplier", "concat('Brand#', s_suppkey) series_id", "s_name name")
    return watching.followed(series, _rows(spark, sf, "part", "p_brand series_id", "p_partkey isbn"), table(spark, sf, "lineitem").where("l_quantity > 45").selectExpr("l_partkey isbn"))


@query("""WITH l AS (SELECT p_brand AS series_id, p_name || ' ' || p_size AS title, p_partkey AS position FROM part), v AS (SELECT p_brand AS series_id, p_name || ' ' || (p_size + 1) AS title, p_partkey AS isbn, CASE WHEN p_size > 25 THEN p_type END AS author FROM part WHERE p_brand <> 'Brand#4')
  SELECT l.series_id, min(position) AS position, l.title, (SELECT min_by(author, isbn) FROM v WHERE author IS NOT NULL AND v.series_id = l.series_id) AS author FROM l WHERE l.series_id <> 'Brand#4' AND NOT EXISTS (SELECT 1 FROM v WHERE v.series_id = l.series_id AND v.title = l.title) GROUP BY l.series_id, l.title""")
def q_series_listed(spark, sf):
    listed = _rows(spark, sf, "part", "p_brand series_id", "concat(p_name, ' ', p_size) title", "p_partkey position")
    volumes = _rows(spark, sf, "part", "p_brand series_id", "concat(p_name, ' ', p_size + 1) title", "p_partkey isbn", "case when p_size > 25 then p_type end author").where("series_id <> 'Brand#4'")
    return watching.listed_volumes(listed, volumes)


_STATES = f"""s AS (SELECT user_id AS book_id, event_type AS source, CASE WHEN event_type IN ('view', 'signup') THEN 'library' ELSE 'shop' END AS category, max_by({_OUTCOME}, event_id) AS outcome, arg_max_null(CASE WHEN value > 50 THEN 'u' || event_id END, event_id) AS url,
  max_by(CASE WHEN value > 45 THEN 'available' ELSE 'unavailable' END, event_id) AS availability, arg_max_null(CASE WHEN value > 30 THEN CAST(floor(value) AS BIGINT) END, event_id) AS price_cents, ascii(event_type) * 256 + length(event_type) AS position FROM events GROUP BY 1, 2)"""


def _states(spark: SparkSession, sf: str) -> DataFrame:
    said = f"struct({_OUTCOME} outcome, case when value > 50 then concat('u', event_id) end url, case when value > 45 then 'available' else 'unavailable' end availability, case when value > 30 then floor(value) end price_cents) s"
    rows = _rows(spark, sf, "events", "user_id book_id", "event_type source", said, "event_id").groupBy("book_id", "source").agg(F.max_by("s", "event_id").alias("s"))
    return rows.selectExpr("book_id", "source", "case when source in ('view', 'signup') then 'library' else 'shop' end category", "s.*", "ascii(source) * 256 + length(source) position")


@query(f"""WITH {_STATES}, h AS (SELECT *, outcome IN ('linked', 'confirmed') AS has FROM s) SELECT book_id, category, CAST(CASE category WHEN 'library' THEN 0 ELSE 1 END AS INT) AS place, count(*) AS count, bool_or(has) AS found,
  min_by(url, position) FILTER (has AND url IS NOT NULL) AS url, string_agg(source, ',' ORDER BY NOT has, position) AS sources FROM h GROUP BY book_id, category""")
def sort_source_groups(spark, sf):
    return watching.source_groups(_states(spark, sf)).withColumn("sources", F.array_join("sources", ","))


@query(f"""WITH {_STATES}, k AS (SELECT *, CASE WHEN category = 'library' AND availability = 'available' OR category = 'shop' AND price_cents IS NOT NULL THEN 0 WHEN outcome IN ('linked', 'confirmed') THEN 1 ELSE 2 END AS level FROM s),
  b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY book_id, category ORDER BY level, CASE WHEN category = 'shop' AND level = 0 THEN price_cents ELSE 0 END, position) = 1) SELECT book_id, category, CASE WHEN level < 2 THEN source END AS source FROM b""")
def sort_categories(spark, sf):
    states = _states(spark, sf)
    return watching.best_sources(states, states)


@query("""+f AS (SELECT * FROM obs WHERE match_reason <> 'watchlist' QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY id DESC) = 1),
  r AS (SELECT o_custkey AS book_id, o_orderpriority > '3' AS own, CASE o_orderstatus WHEN 'P' THEN 'reader' WHEN 'O' THEN 'others' ELSE 'model' END AS origin, o_totalprice AS stars, o_orderdate AS rated_at FROM orders),
  j AS (SELECT book_id, origin, max(row(rated_at, CASE WHEN own THEN 'book:' ELSE 'isbn:' END || book_id, stars)) AS m FROM r WHERE origin <> 'model' AND (own OR origin = 'others') GROUP BY 1, 2)
  SELECT c_custkey AS book_id, f.id AS found_by, f.match_reason AS why, a.m[3] AS reader_stars, b.m[3] AS others_stars FROM customer LEFT JOIN f ON f.book_id = c_custkey LEFT JOIN j a ON a.book_id = c_custkey AND a.origin = 'reader' LEFT JOIN j b ON b.book_id = c_custkey AND b.origin = 'others'""", "obs")
def q_book_page(spark, sf):
    books = _rows(spark, sf, "customer", "c_custkey book_id")
    subjects = books.selectExpr("book_id", "concat('book:', book_id) subject", "true own").unionByName(books.selectExpr("book_id", "concat('isbn:', book_id) subject", "false own"))
    ratings = _rows(spark, sf, "orders", "concat(case when o_orderpriority > '3' then 'book:' else 'isbn:' end, o_custkey) subject", "case o_orderstatus when 'P' then 'reader' when 'O' then 'others' else 'model' end origin", "o_totalprice stars", "cast(o_orderdate as timestamp_ntz) rated_at")
    said = watching.judgements(ratings, subjects, ("others",), ("reader", "others"))
    stars = said.groupBy("book_id").agg(*(F.max(F.when(F.col("origin") == o, F.col("stars"))).alias(f"{o}_stars") for o in ("reader", "others")))
    found = watching.origin_of_find(view(spark, sf, "obs")).select("book_id", F.col("id").alias("found_by"), F.col("match_reason").alias("why"))
    return books.join(found, "book_id", "left").join(stars, "book_id", "left")


@query("""WITH n AS (SELECT p_partkey, p_name || ' ' || p_size AS name, p_brand, p_size, p_retailprice FROM part),
  k AS (SELECT p_partkey AS entry, 0 AS rank, 0 AS place, 'intake:' || p_partkey AS subject FROM n UNION ALL SELECT a.p_partkey, r.r, b.p_partkey, CASE r.r WHEN 1 THEN 'book:' ELSE 'isbn:' END || b.p_partkey FROM n a JOIN n b USING (name), (VALUES (1), (2)) r(r) WHERE a.p_size <= 25 OR a.p_brand = b.p_brand),
  o AS (SELECT entry, min_by(c_nationkey % 5 + 1, place) AS own FROM k JOIN customer ON subject = 'book:' || c_custkey WHERE rank = 1 AND c_acctbal > 8000 GROUP BY 1),
  p AS (SELECT entry, min_by(struct_pack(s := subject, n := stars), row(rank, place)) AS p FROM k JOIN (SELECT CASE WHEN o_totalprice > 300000 THEN 'book:' WHEN o_totalprice > 200000 THEN 'isbn:' ELSE 'intake:' END || o_orderkey AS subject, CASE WHEN o_orderstatus <> 'P' THEN length(o_orderpriority) % 5 + 1 END AS stars FROM orders WHERE o_totalprice > 150000) USING (subject) GROUP BY 1)
  SELECT p_partkey AS entry, CASE WHEN own IS NOT NULL OR p.n IS NOT NULL THEN 'present' WHEN p IS NOT NULL THEN 'unknown' ELSE 'missing' END AS source, CASE WHEN own IS NULL THEN p.s END AS subject, CAST(coalesce(own, p.n) AS INT) AS stars FROM n LEFT JOIN o ON o.entry = p_partkey LEFT JOIN p ON p.entry = p_partkey""")
def q_judge_titles(spark, sf):
    name = "concat(p_name, ' ', p_size) title"
    entries = _rows(spark, sf, "part", "p_partkey entry", "concat('intake:', p_partkey) subject", name, "case when p_size > 25 then p_brand end author")
    books, finds = (_rows(spark, sf, "part", "p_partkey id", "concat('isbn:', p_partkey) subject", title, "lower(p_brand) author") for title in (name, f"concat(' ', upper({name[:-6]})) title"))
    ratings = table(spark, sf, "customer").where("c_acctbal > 8000").selectExpr("concat('book:', c_custkey) subject", "c_nationkey % 5 + 1 stars")
    portraits = table(spark, sf, "orders").where("o_totalprice > 150000").selectExpr("concat(case when o_totalprice > 300000 then 'book:' when o_totalprice > 200000 then 'isbn:' else 'intake:' end, o_orderkey) subject", "case when o_orderstatus <> 'P' then length(o_orderpriority) % 5 + 1 end stars")
    return watching.judged_titles(entries, books, finds, ratings, portraits)
