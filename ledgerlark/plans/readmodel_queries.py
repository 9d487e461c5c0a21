"""Queries of the read models, bags and genre texts, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import bags, genres
from ledgerlark.functions import text as T
from ledgerlark.operators import catalog, diff, journal, state
from ledgerlark.plans import readmodels
from ledgerlark.plans.adapters import table, view, with_views
from ledgerlark.plans.catalog_queries import _TREE, _tree
from ledgerlark.plans.journal_queries import DELTAS, LATEST, LIBRARIES, SETTINGS

QUERIES, SQL = {}, {}


def query(sql: str | None = None, *views: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


_ENTRIES = "entries AS (SELECT p_partkey AS book_id, p_name AS title, p_partkey % 5 <> 0 AS active FROM part)"
_LINKS = """links AS (SELECT DISTINCT book_id, source, CASE (book_id + length(source) + CASE WHEN source LIKE '%a' THEN 1 ELSE 0 END) % 4 WHEN 0 THEN 'linked' WHEN 1 THEN 'unsure' ELSE 'not_found' END AS outcome FROM obs WHERE book_id % 8 <> 3),
  cand AS (SELECT book_id, source, outcome, i AS position, 'u' || i AS url FROM links, range(3) r(i) WHERE NOT (book_id % 2 = 0 AND i = 0) AND NOT (book_id % 10 = 5))"""


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(key.alias("book_id"), F.col("p_name").alias("title"), (key % 5 != 0).alias("active"))


def _links(spark: SparkSession, sf: str) -> DataFrame:
    number = (F.col("book_id") + F.length("source") + F.when(F.col("source").endswith("a"), 1).otherwise(0)) % 4
    rows = view(spark, sf, "obs").where("book_id % 8 <> 3").select("book_id", "source").distinct()
    every = F.array(*(F.struct(F.lit(f"u{i}").alias("url")) for i in range(3)))
    return rows.select(
        "book_id", "source", F.when(number == 0, "linked").when(number == 1, "unsure").otherwise("not_found").alias("outcome"), F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
        F.when(F.col("book_id") % 10 == 5, F.slice(every, 1, 0)).otherwise(every).alias("candidates"), F.when(F.col("book_id") % 2 == 0, F.array(F.lit("u0"))).alias("rejected"), F.when(number == 0, "u").alias("url"),
    )


@query(f"""+{_ENTRIES}, {_LINKS}, bs AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY book_id, source ORDER BY id DESC) = 1),
  st AS (SELECT l.book_id, l.source, l.outcome, l.outcome = 'unsure' AND EXISTS (SELECT 1 FROM cand c WHERE c.book_id = l.book_id AND c.source = l.source) AS asks FROM links l),
  b AS (SELECT book_id, count(*) AS n_sources, bool_or(outcome = 'unsure') AS att, bool_or(asks) AS asks, bool_and(outcome = 'not_found') AS none, min(source) FILTER (asks) AS cs FROM st GROUP BY 1),
  v AS (SELECT book_id, min(CASE availability WHEN 'available' THEN 0 WHEN 'unavailable' THEN 1 WHEN 'unknown' THEN 2 END) AS a, max_by(price_cents, id) FILTER (price_cents IS NOT NULL) AS price_cents FROM bs GROUP BY 1)
  SELECT e.book_id, e.title, e.active, CASE a WHEN 0 THEN 'available' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'unknown' END AS availability, price_cents, coalesce(n_sources, 0) AS n_sources, coalesce(att, false) AS needs_attention,
    e.active AND coalesce(asks, false) AS needs_choice, CASE WHEN e.active THEN cs END AS choice_source, e.active AND coalesce(none, false) AS missing, n_sources IS NULL AS unresolved
  FROM entries e LEFT JOIN b USING (book_id) LEFT JOIN v USING (book_id)""", "obs")
def q_watchlist(spark, sf):
    latest = journal.latest_per(view(spark, sf, "obs"), ("book_id", "source"))
    return readmodels.watchlist(_entries(spark, sf), _links(spark, sf), latest)


@query(f"+{_LINKS} SELECT book_id, source, url FROM cand WHERE outcome = 'unsure'", "obs")
def q_assignments(spark, sf):
    return readmodels.open_questions(_links(spark, sf)).select("book_id", "source", "url")


@query(f"+{_LINKS} SELECT book_id, source FROM links WHERE outcome <> 'linked'", "obs")
def st_ttl_retry(spark, sf):
    return state.retry_due(_links(spark, sf), F.expr("timestamp_ntz'2030-01-01 00:00:00'")).select("book_id", "source")


@query("+l AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY source, source_item_id ORDER BY id DESC) = 1), s AS (SELECT isbn, count(*) AS sightings, min(price_cents) AS price_cents, min(title) AS title FROM l WHERE isbn IS NOT NULL GROUP BY 1), w AS (SELECT DISTINCT isbn, title AS key FROM obs WHERE isbn IS NOT NULL), n AS (SELECT isbn, min(isbn) OVER (PARTITION BY key) AS work, count(*) OVER (PARTITION BY key) AS n FROM w) SELECT work, isbn, title, sightings, price_cents, substr(isbn, 4, 1) = '0' AS more, CAST(row_number() OVER (PARTITION BY work ORDER BY title IS NULL, substr(isbn, 4, 1) = '0', title, isbn) AS INT) AS position FROM n JOIN s USING (isbn) WHERE n > 1", "obs")
def q_editions(spark, sf):
    obs = view(spark, sf, "obs")
    works = obs.where("isbn is not null").select("isbn", F.col("title").alias("key")).distinct()
    return readmodels.editions(works, journal.latest_per(obs), SETTINGS.languages)


@query("SELECT DISTINCT o.isbn, p.p_brand AS series_id, max_by(o.title, o.id) OVER (PARTITION BY o.isbn) AS title FROM obs o JOIN part p ON p.p_partkey = CAST(o.source_item_id AS BIGINT) WHERE o.isbn IS NOT NULL", "obs")
def q_series_volumes(spark, sf):
    obs = view(spark, sf, "obs").withColumn("cover_url", F.col("url"))
    entries = obs.where("isbn is not null").select("isbn", F.col("series").alias("series_id")).distinct()
    none = spark.createDataFrame([], "isbn string, title string, author string")
    return readmodels.series_volumes(entries, obs, none, none).select("isbn", "series_id", "title")


_LIKED = "e AS (SELECT CAST(p_partkey AS VARCHAR) AS isbn, p_brand AS series_id, CAST(p_size AS VARCHAR) AS volume, p_name AS title, p_partkey FROM part)"


@query(f"WITH {_LIKED}, fav AS (SELECT series_id, min(row(CAST(volume AS DOUBLE), title)) AS f FROM e WHERE p_partkey % 41 = 0 GROUP BY 1), ids AS (SELECT series_id FROM fav UNION SELECT 'Brand#11'), ok AS (SELECT * FROM ids WHERE series_id NOT IN (SELECT series_id FROM e WHERE p_partkey % 331 = 1)) SELECT e.isbn, CASE WHEN f IS NULL THEN 'watched' WHEN CAST(e.volume AS DOUBLE) > struct_extract_at(f, 1) THEN 'sequel' ELSE 'same series' END AS note FROM e JOIN ok USING (series_id) LEFT JOIN fav USING (series_id) WHERE e.p_partkey % 41 <> 0")
def q_liked_series(spark, sf):
    part, key = table(spark, sf, "part"), F.col("p_partkey")
    isbn = key.cast("string").alias("isbn")
    entries = part.select(isbn, F.col("p_brand").alias("series_id"), F.col("p_size").cast("string").alias("volume"))
    liked, disliked = part.where(key % 41 == 0).select(isbn, F.col("p_name").alias("title")), part.where(key % 331 == 1).select(isbn)
    watched = spark.createDataFrame([("Brand#11",)], "series_id string")
    return readmodels.liked_series(entries, liked, disliked, watched).select("isbn", "note")


@query("+s AS (SELECT *, 0 AS ordinal FROM obs WHERE match_reason = 'profile_author' UNION ALL SELECT *, 1 FROM obs WHERE CAST(source_item_id AS BIGINT) % 2 = 0), f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY source, source_item_id ORDER BY ordinal, id) = 1) SELECT id, ordinal FROM f WHERE CAST(source_item_id AS BIGINT) % 12 <> 0", "obs")
def src_sweep_interests(spark, sf):
    obs, number = view(spark, sf, "obs"), F.col("source_item_id").cast("long")
    dismissed = obs.where(number % 12 == 0).select("source", "source_item_id").distinct()
    return readmodels.swept([obs.where("match_reason = 'profile_author'"), obs.where(number % 2 == 0)], dismissed).select("id", "ordinal")


@query(f"+{LATEST}, d AS (SELECT DISTINCT source, source_item_id, CASE WHEN CAST(source_item_id AS BIGINT) % 3 = 0 THEN 'neu' END AS blurb, CASE WHEN CAST(source_item_id AS BIGINT) % 2 = 0 THEN 100 END AS pages FROM obs) SELECT l.id, coalesce(d.blurb, l.blurb) AS blurb, coalesce(d.pages, l.pages) AS pages, coalesce(d.blurb, l.blurb) IS DISTINCT FROM l.blurb OR coalesce(d.pages, l.pages) IS DISTINCT FROM l.pages AS changed FROM latest l LEFT JOIN d USING (source, source_item_id)", "obs")
def enrich_evidence(spark, sf):
    latest, number = journal.latest_per(view(spark, sf, "obs")).withColumn("cover_url", F.lit(None).cast("string")), F.col("source_item_id").cast("long")
    details = latest.select(
        "source", "source_item_id", F.when(number % 3 == 0, "neu").alias("blurb"), F.when(number % 2 == 0, 100).alias("pages"), F.lit(None).cast("string").alias("cover_url"), F.lit(None).cast("string").alias("series")
    )
    return readmodels.enriched(latest, details).select("id", "blurb", "pages", "changed")


@query(f"WITH RECURSIVE {_TREE}, a AS (SELECT 'R' || r_regionkey AS code, 'top' || r_regionkey AS address FROM region UNION ALL SELECT 'N' || n_nationkey, 'own' || n_nationkey FROM nation WHERE n_nationkey % 4 = 0) SELECT c.code, 'shop' AS source, arg_min(a.address, c.depth) AS address FROM closure c JOIN a ON a.code = c.ancestor GROUP BY 1")
def src_genre_address(spark, sf):
    tree = _tree(spark, sf)
    number = F.substring("code", 2, 10).cast("int")
    listed = tree.where("parent is null or cast(substring(code, 2) as int) % 4 = 0").select(F.lit("shop").alias("source"), "code", F.concat(F.when(F.col("parent").isNull(), "top").otherwise("own"), number).alias("address"))
    return readmodels.genre_addresses(tree.select("code"), catalog.genre_closure(tree), listed)


@query(f"+{DELTAS}, lines AS (SELECT id, CASE WHEN kind = 'became_available' THEN 'available' WHEN kind = 'price_drop' THEN 'price drops' WHEN kind = 'first_seen' AND source LIKE 'lib%' THEN 'library finds' WHEN kind = 'first_seen' THEN 'finds' ELSE 'other changes' END AS section, concat_ws(' – ', title, author, replace(printf('%.2f €', price_cents / 100), '.', ','), kind) AS line FROM deltas WHERE run_id = 5) SELECT section, string_agg(line, chr(10) ORDER BY id, line) AS text FROM lines GROUP BY 1", "obs")
def sink_digest(spark, sf):
    found = diff.deltas(diff.with_previous(view(spark, sf, "obs")), SETTINGS).where("run_id = 5")
    return readmodels.digest_lines(found, diff.digest_section(SETTINGS, LIBRARIES))


@query("SELECT profile, '{\"interests\":[' || string_agg('{\"key\":\"' || key || '\",\"value\":\"' || value || '\"}', ',' ORDER BY key, value) || ']}' AS body FROM (SELECT 'p' || n_regionkey AS profile, 'genre' AS key, n_name AS value FROM nation) GROUP BY 1")
def sink_export(spark, sf):
    rows = table(spark, sf, "nation").select(F.concat(F.lit("p"), "n_regionkey").alias("profile"), F.lit("genre").alias("key"), F.col("n_name").alias("value"))
    return readmodels.export(rows)


@query("SELECT DISTINCT id, CASE match_reason WHEN 'watchlist' THEN 'steht auf deiner Watchlist' WHEN 'profile_author' THEN CASE WHEN author IS NULL THEN 'neu von einer Autor:in, der du folgst' ELSE 'neu von ' || author || ', der du folgst' END ELSE CASE WHEN source LIKE 'lib%' AND availability = 'available' THEN 'sofort ausleihbar aus „Shelf ' || category[7:] || '“' WHEN source LIKE 'lib%' THEN 'aus „Shelf ' || category[7:] || '“' ELSE 'neu im Thema Shelf ' || category[7:] END END AS why FROM obs", "obs")
def str_why_shown(spark, sf):
    return view(spark, sf, "obs").select("id", genres.why_shown(F.col("source").isin(*LIBRARIES)).alias("why"))


_WORDS = ("Psychologischer Horror", "Krimi", "Dark Fantasy", "Liebesroman", "Lyrik", "Fantasy", "Historischer Krimi")


@query("SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'FIC015050' WHEN 1 THEN 'FIC060000' WHEN 2 THEN 'FIC009070' WHEN 3 THEN 'FIC027020' WHEN 4 THEN 'FIC016000' WHEN 5 THEN 'FIC009000' ELSE 'FIC060000' END AS code FROM part")
def str_genre_code(spark, sf):
    genre = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", genres.genre_code(genre, F.lit("mit Humor")).alias("code"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'unknown: tire' WHEN 1 THEN 'unknown tier' WHEN 2 THEN 'removed is true or false' WHEN 3 THEN 'sources is a list of names' END AS fault FROM events")
def json_check_details(spark, sf):
    kinds = ('{"tire":"core","note":"x"}', '{"tier":"weekly"}', '{"removed":"yes"}', '{"sources":[1,2]}', '{"tier":"core","removed":true,"sources":["a"],"reasons":{"drop":["f"]}}')
    text = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", bags.detail_fault(text).alias("fault"))


@query("SELECT o_orderkey AS subject, o_orderkey % 3 <> 0 AS known, CASE WHEN o_orderkey % 3 = 0 THEN 'unknown, but with traits' WHEN o_orderkey % 3 = 1 THEN '2 traits, four to eight are asked for|fewer than three dimensions|no pitch|not in the vocabulary: zz|twice: t1' ELSE '' END AS violations FROM orders")
def json_parse_answer(spark, sf):
    trait = '{"id":"%s","satz":"s","beleg":"text","gewicht":"prägend"}'
    patterns = '"erzaehlmuster":[{"id":"p1","satz":"s","beleg":"wissen"}]'
    listed = lambda *ids: '"merkmale":[' + ",".join(trait % i for i in ids) + "]"
    texts = (
        '{"bekannt":false,' + listed("t1") + "}", "so: {\"bekannt\":true," + listed("t1", "t1", "zz", "t4") + "," + patterns + "}",
        '{"bekannt":true,"pitch":"ein Satz","form":"roman",' + listed("t1", "t2", "t3", "t4") + "," + patterns + "}",
    )
    vocabulary = spark.createDataFrame([(f"t{i}", f"d{i % 3}", False) for i in range(1, 7)] + [("p1", "m", True)], "term string, dimension string, is_pattern boolean")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("subject"), F.element_at(F.array(*map(F.lit, texts)), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("answer"))
    return bags.answers(rows, vocabulary).select("subject", "known", F.concat_ws("|", "violations").alias("violations"))


@query("WITH a AS (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey % 10)) AS old FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_filter(old, lambda x: x <> 3) || [7, 11])), ',') AS merged FROM a")
def intake_adopt(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 10).alias("old"))
    numbers = lambda *n: F.array(*(F.lit(x).cast("long") for x in n))
    out = F.array_sort(bags.merged(F.col("old"), numbers(7, 11), numbers(3)))
    return rows.select("l_orderkey", F.concat_ws(",", F.transform(out, lambda x: x.cast("string"))).alias("merged"))


@query("SELECT p_partkey, p_partkey % 2 = 1 AND regexp_matches(p_name, '[a-z]{4}') AS mismatch FROM part")
def pred_mismatch(spark, sf):
    other = F.when(F.col("p_partkey") % 2 == 1, F.lit("ganz anderes Wort")).otherwise(F.concat(F.col("p_name"), F.lit(" (Roman)")))
    return table(spark, sf, "part").select("p_partkey", readmodels.mismatched(F.col("p_name"), other).alias("mismatch"))


@query("SELECT o_custkey AS profile, max_by(o_orderkey, o_orderkey) AS version, count(*) AS n FROM orders GROUP BY 1")
def win_version(spark, sf):
    log = table(spark, sf, "orders").select(F.col("o_custkey").alias("profile"), F.col("o_orderkey").alias("seq"))
    n = log.groupBy("profile").agg(F.count("*").alias("n"))
    return state.current(log, "profile").join(n, "profile").select("profile", F.col("seq").alias("version"), "n")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def q_seed(spark, sf):
    new = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    there = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("id")).distinct()
    return state.insert_missing(new, there, "id")


@query("SELECT event_id, array_to_string(list_distinct([CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'b' END, 'b', 'c']), '') IS NOT NULL AS ok, CASE WHEN event_id % 2 = 0 THEN 'new,b,c' ELSE 'b,c' END AS ids FROM events")
def arr_current_ids(spark, sf):
    given = F.array(F.when(F.col("event_id") % 2 == 0, "old").otherwise("b"), F.lit("b"), F.lit("c"))
    ids = F.concat_ws(",", state.current_terms(given, {"old": "new"}))
    return table(spark, sf, "events").select("event_id", ids.isNotNull().alias("ok"), ids.alias("ids"))


@query("SELECT doc_id, CASE WHEN length(regexp_extract(text, '(?s)^(.*?[.!?])(\\s|$)', 1)) BETWEEN 1 AND 200 THEN regexp_extract(text, '(?s)^(.*?[.!?])(\\s|$)', 1) ELSE left(text, 200) END AS sentence FROM documents")
def str_one_sentence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.one_sentence(F.col("text")).alias("sentence"))
