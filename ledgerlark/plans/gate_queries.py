"""Queries of the gate, reasons, dates and forms of names, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import dates
from ledgerlark.functions import text as T
from ledgerlark.operators import catalog, diff, eligibility, gate, reasons
from ledgerlark.plans.adapters import table, view, with_views
from ledgerlark.plans.catalog_queries import _TREE, _tree
from ledgerlark.plans.journal_queries import DELTAS, RUNS, SETTINGS, _runs

QUERIES, SQL = {}, {}


def query(sql: str | None = None, *views: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


# --- the gate: portraits are those of items with a place in a series, describing is known where pages are ---

_SUBJECT = "coalesce('isbn:' || isbn, 'item:' || source || ':' || source_item_id)"
_GATE = f"""+{DELTAS}, d AS (SELECT *, {_SUBJECT} AS subject, kind IN ('first_seen', 'became_available') AND match_reason <> 'watchlist' AS discovery FROM deltas),
  portraits AS (SELECT {_SUBJECT} AS subject, CAST(max(length(title)) % 5 AS INT) + 1 AS stars FROM obs WHERE series_index = '3' GROUP BY 1),
  described AS (SELECT {_SUBJECT} AS subject, CASE WHEN max(price_cents) % 3 > 0 THEN CAST(max(length(title)) % 5 AS INT) + 1 END AS stars, min(pages) AS pages FROM obs WHERE blurb IS NOT NULL GROUP BY 1),
  reader AS (SELECT p_partkey AS book_id, p_size % 5 + 1 AS stars FROM part WHERE p_size < 10),
  waiting AS (SELECT * FROM d WHERE discovery AND book_id NOT IN (SELECT book_id FROM reader) AND subject NOT IN (SELECT subject FROM portraits)),
  asked AS (SELECT subject FROM waiting GROUP BY 1 ORDER BY min(id) LIMIT 40),
  tried AS (SELECT DISTINCT source, source_item_id, subject, pages < 80 IS TRUE AS short, (x.subject IS NOT NULL AND NOT (pages < 80 IS TRUE)) AS made FROM (SELECT DISTINCT source, source_item_id, subject FROM waiting) JOIN asked USING (subject) LEFT JOIN (SELECT subject, pages FROM described) x USING (subject)),
  known AS (SELECT *, true AS portrayed FROM portraits UNION ALL SELECT subject, stars, true FROM described JOIN asked USING (subject) WHERE NOT (pages < 80 IS TRUE)),
  h AS (SELECT d.*, coalesce(r.stars, k.stars) AS stars, coalesce(portrayed, false) AS portrayed, t.source IS NOT NULL AS tried, coalesce(made, false) AS made,
    coalesce(t.short, false) OR (match_reason <> 'watchlist' AND (coalesce(d.pages < 80, false) OR regexp_matches(concat(coalesce(title, ''), ' ', coalesce(subtitle, '')), 'Kurzgeschichte|(^|[^a-z])Folge\\s*[0-9]+', 'i'))) AS hidden
    FROM d LEFT JOIN reader r USING (book_id) LEFT JOIN known k USING (subject) LEFT JOIN tried t USING (source, source_item_id)),
  g AS (SELECT *, CASE WHEN hidden THEN 'short_stories' WHEN match_reason <> 'watchlist' AND stars < 3 THEN 'held_back' ELSE 'kept' END AS outcome,
    CASE WHEN hidden THEN 'short_stories' WHEN match_reason = 'watchlist' THEN NULL WHEN stars IS NULL THEN CASE WHEN discovery THEN CASE WHEN portrayed OR tried THEN 'unrated' ELSE 'over_budget' END END WHEN NOT made THEN 'reused' END AS counted FROM h),
  n AS (SELECT count(DISTINCT subject) FILTER (outcome = 'held_back') AS held_back, count(DISTINCT subject) FILTER (counted = 'short_stories') AS short_stories, count(DISTINCT subject) FILTER (counted = 'unrated') AS unrated,
    count(DISTINCT subject) FILTER (counted = 'over_budget') AS over_budget, count(DISTINCT subject) FILTER (counted = 'reused') AS reused FROM g)"""


def _gated(spark: SparkSession, sf: str) -> DataFrame:
    obs = view(spark, sf, "obs").withColumn("subject", eligibility.subject())
    deltas = diff.deltas(diff.with_previous(obs), SETTINGS)
    stars = (F.max(F.length("title")) % 5 + 1).alias("stars")
    portraits = obs.where("series_index = '3'").groupBy("subject").agg(stars)
    described = obs.where("blurb is not null").groupBy("subject").agg(F.when(F.max("price_cents") % 3 > 0, F.max(F.length("title")) % 5 + 1).alias("stars"), F.min("pages").alias("pages"))
    reader = table(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").alias("book_id"), (F.col("p_size") % 5 + 1).alias("stars"))
    return gate.apply(deltas, portraits, described, reader, 3, SETTINGS.gate_budget)


@query(f"{_GATE} SELECT id, kind, outcome, counted FROM g", "obs")
def q_gate(spark, sf):
    return _gated(spark, sf).select("id", "kind", "outcome", "counted")


@query(f"{_GATE} SELECT * FROM n", "obs")
def q_gate_report(spark, sf):
    return gate.report(_gated(spark, sf))


@query(
    f"""{_GATE} SELECT 'Bewertungstor: ' || concat_ws(', ', CASE WHEN held_back > 0 THEN held_back || CASE WHEN held_back = 1 THEN ' Vorschlag' ELSE ' Vorschläge' END || ' unter 3 Sternen zurückgehalten' END,
  CASE WHEN over_budget > 0 THEN over_budget || ' heute nicht bewertet (Budget erschöpft) und deshalb ungeprüft gezeigt' END, CASE WHEN unrated > 0 THEN unrated || ' konnten nicht bewertet werden und werden ungeprüft gezeigt' END,
  CASE WHEN short_stories > 0 THEN short_stories || CASE WHEN short_stories = 1 THEN ' Kurzgeschichte' ELSE ' Kurzgeschichten' END || ' (unter 80 Seiten) nicht gezeigt' END) AS text FROM n""",
    "obs",
)
def agg_gate_text(spark, sf):
    return gate.report(_gated(spark, sf)).select(gate.gate_text(3).alias("text"))


_PORTRAITS = "+p AS (SELECT event_id AS id, 'u' || user_id || event_type AS subject, event_type <> 'error' AS known, value > 30 AS with_text, CASE WHEN value > 80 THEN ['zu wenige Dimensionen'] WHEN value > 50 THEN ['zu lang'] ELSE [] END AS violations FROM events), w AS (SELECT DISTINCT 'u' || user_id || event_type AS subject, user_id AS key FROM events), c AS (SELECT key, CAST(sum(n) AS BIGINT) AS n FROM (SELECT subject, count(*) AS n FROM p WHERE with_text GROUP BY 1) JOIN w USING (subject) GROUP BY 1), t AS (SELECT subject, n FROM w JOIN c USING (key))"


def _portraits(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("value")
    rules = F.when(value > 80, F.array(F.lit("zu wenige Dimensionen"))).when(value > 50, F.array(F.lit("zu lang"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("u"), "user_id", "event_type").alias("subject"), (F.col("event_type") != "error").alias("known"), (value > 30).alias("with_text"), rules.alias("violations"))


@query(_PORTRAITS.replace("+p", "WITH p", 1) + " SELECT subject, n FROM t")
def agg_count_by(spark, sf):
    works = table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id", "event_type").alias("subject"), F.col("user_id").alias("key")).distinct()
    return gate.asked_with_text(_portraits(spark, sf), works)


@query(_PORTRAITS.replace("+p", "WITH p", 1) + ", l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY subject ORDER BY id DESC) = 1), tries AS (SELECT subject, count(*) FILTER (with_text) AS n FROM p GROUP BY 1) SELECT l.id, l.subject FROM l LEFT JOIN tries USING (subject) WHERE known AND with_text AND len(violations) > 0 AND coalesce(n, 0) < 9 ORDER BY list_contains(violations, 'zu wenige Dimensionen') DESC, id DESC LIMIT 25")
def topk_rework(spark, sf):
    log = _portraits(spark, sf)
    latest = log.groupBy("subject").agg(F.max_by(F.struct("id", "known", "with_text", "violations"), "id").alias("p")).select("subject", "p.*")
    tries = gate.asked_with_text(log, log.select("subject", F.col("subject").alias("key")).distinct())
    return gate.to_rework(latest, tries, 25, most_tries=9).select("id", "subject")


@query(f"+l AS (SELECT *, {_SUBJECT} AS subject FROM obs WHERE match_reason <> 'watchlist' QUALIFY row_number() OVER (PARTITION BY source, source_item_id ORDER BY id DESC) = 1) SELECT id, subject FROM l WHERE subject NOT IN (SELECT {_SUBJECT} FROM obs WHERE blurb IS NOT NULL) ORDER BY id DESC LIMIT 40", "obs")
def topk_backlog(spark, sf):
    obs = view(spark, sf, "obs").withColumn("subject", eligibility.subject())
    finds = obs.where("match_reason <> 'watchlist'").groupBy("source", "source_item_id").agg(F.max("id").alias("id"), F.max_by("subject", "id").alias("subject"))
    return gate.backlog(finds, obs.where("blurb is not null").select("subject").distinct(), SETTINGS.gate_budget).select("id", "subject")


@query("SELECT event_id, event_type = 'error' AND CASE WHEN coalesce(value > 30, false) THEN NOT (value > 80) AND user_id < 500 ELSE length(props) > 9 END AS again FROM events WHERE value IS NOT NULL")
def pred_worth_asking_again(spark, sf):
    rows = table(spark, sf, "events").where("value is not null").withColumns({"known": F.col("event_type") != "error", "with_text": F.col("value") > 30, "with_sample": F.col("value") > 80})
    return rows.select("event_id", gate.worth_asking_again(F.length("props") > 9, F.col("user_id") < 500).alias("again"))


@query("WITH p AS (SELECT 'isbn:' || l_partkey AS subject FROM lineitem WHERE l_quantity = 1 UNION SELECT 'book:' || o_orderkey FROM orders WHERE o_orderstatus = 'P'), s AS (SELECT l_orderkey AS book, l_partkey + 1 AS position, 'isbn:' || l_partkey AS subject FROM lineitem UNION ALL SELECT o_orderkey, 0, 'book:' || o_orderkey FROM orders) SELECT book, min_by(subject, position) AS subject FROM s SEMI JOIN p USING (subject) GROUP BY 1")
def verdict_among(spark, sf):
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    isbn, book = F.concat(F.lit("isbn:"), "l_partkey").alias("subject"), F.concat(F.lit("book:"), "o_orderkey").alias("subject")
    portraits = lines.where("l_quantity = 1").select(isbn).unionByName(orders.where("o_orderstatus = 'P'").select(book))
    keys = lines.select(F.col("l_orderkey").alias("book"), (F.col("l_partkey") + 1).alias("position"), isbn).unionByName(orders.select(F.col("o_orderkey").alias("book"), F.lit(0).cast("long").alias("position"), book))
    return gate.first_portrayed(keys, portraits)


# --- reasons: what an order's parts carry, against a small profile ---

_FAMILIES = [(f"f{i}", f"Familie {i}", i == 6, i == 7) for i in range(7)] + [("f7", "Familie 7", False, True)]
_CARRIED = "c AS (SELECT l_orderkey AS subject, 'f' || (l_suppkey % 9) AS family, max((l_suppkey % 9 - 4) / 4.0) AS value, min(l_returnflag || l_linestatus) AS sentence FROM lineitem GROUP BY 1, 2)"
_REASONS = f"""WITH {_CARRIED}, n AS (SELECT c.*, CASE WHEN family = 'f8' THEN 'f8' ELSE 'Familie ' || substr(family, 2) END AS name, family = 'f6' AS pattern, family = 'f7' AS boosted FROM c),
  hit AS (SELECT subject FROM n WHERE family IN ('f5', 'f8') AND value IS NOT NULL GROUP BY 1 HAVING count(*) = 2),
  rule AS (SELECT subject FROM n WHERE family IN ('f2', 'f3') GROUP BY 1 HAVING count(*) = 2),
  l AS (SELECT subject, 0 AS s, 0.0 AS a, 0.0 AS b, 0.0 AS e, '' AS tie, 'facet' AS kind, 'Familie 5 · f8' AS text, false AS boosted, ['f5', 'f8'] AS fam FROM hit
    UNION ALL SELECT subject, 1, CASE WHEN boosted THEN 0.0 ELSE 1.0 END, CASE WHEN pattern THEN 1.0 ELSE 0.0 END, -value, family, CASE WHEN pattern THEN 'pattern' ELSE 'trait' END, name, boosted, [family] FROM n WHERE value >= 0.3 AND NOT (family IN ('f5', 'f8') AND subject IN (FROM hit))
    UNION ALL SELECT DISTINCT subject, 2, 0.0, 0.0, 0.0, '', 'none', 'nothing liked is met', false, [] FROM n WHERE subject NOT IN (SELECT subject FROM n WHERE value >= 0.3)
    UNION ALL SELECT subject, 3, value, 0.0, 0.0, family, 'against', name, false, [family] FROM n WHERE value <= -0.3
    UNION ALL SELECT subject, 4, 1.0, 0.0, 0.0, '', 'against', 'Familie 2 · Familie 3 (R1)', false, ['f2', 'f3'] FROM rule),
  r AS (SELECT subject, s, a, b, e, tie, 0 AS part, kind, text, boosted FROM l UNION ALL SELECT l.subject, s, a, b, e, tie, i, 'sentence', c.sentence, false FROM (SELECT *, unnest(fam) AS f, generate_subscripts(fam, 1) AS i FROM l WHERE len(fam) > 0) l JOIN c ON c.subject = l.subject AND c.family = l.f)
  SELECT subject, CAST(row_number() OVER (PARTITION BY subject ORDER BY s, a, b, e, tie, part) AS INT) AS position, kind,
    CASE kind WHEN 'pattern' THEN 'Erzählmuster: ' WHEN 'against' THEN 'dagegen: ' ELSE '' END || text || CASE WHEN boosted THEN ' (verstärkt)' ELSE '' END AS line FROM r"""


@query(_REASONS)
def alg_reasons(spark, sf):
    lines = eligibility.dealt(table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus"), "l_orderkey").withColumn("family", F.concat(F.lit("f"), F.col("l_suppkey") % 9))
    carried = lines.groupBy(F.col("l_orderkey").alias("subject"), "family").agg(F.max((F.col("l_suppkey") % 9 - 4) / 4.0).alias("value"), F.min(F.concat("l_returnflag", "l_linestatus")).alias("sentence"))
    families = spark.createDataFrame(_FAMILIES, "family string, name string, is_pattern boolean, boosted boolean").distinct()
    facets = spark.createDataFrame([(1, ["f5", "f8"])], "facet int, families array<string>")
    rules = spark.createDataFrame([(1, ["f2", "f3"], None)], "rule int, families array<string>, genre string")
    books = carried.select("subject").distinct().select("subject", F.array().cast("array<string>").alias("ancestors"), F.lit("").alias("genre_text"))
    met = reasons.counterweights_met(rules, carried, books).join(eligibility.small(rules.drop("genre")), "rule").withColumn("genre", F.lit("R1"))
    rows = reasons.reasons(carried.drop("sentence"), carried.select("subject", "family", "sentence"), families, facets, met)
    return rows.select("subject", "position", "kind", reasons.reason_line(F.col("kind"), F.col("text"), F.col("boosted")).alias("line"))


@query(f"WITH RECURSIVE {_TREE}, b AS (SELECT c_custkey AS subject, 'N' || c_nationkey AS code, c_mktsegment AS genre_text FROM customer), rules(rule, f1, f2, genre) AS (VALUES (1, 'f1', 'f2', 'R1'), (2, 'f3', 'f3', 'build'), (3, 'f4', 'f4', 'building'), (4, 'f0', 'f0', NULL)), carried AS (SELECT DISTINCT o_custkey AS subject, 'f' || (o_orderkey % 5) AS family FROM orders) SELECT subject, rule FROM rules JOIN b ON (genre IS NULL OR lower(genre_text) = genre OR EXISTS (SELECT 1 FROM closure c WHERE c.code = b.code AND c.ancestor = genre)) WHERE (subject, f1) IN (SELECT (subject, family) FROM carried) AND (subject, f2) IN (SELECT (subject, family) FROM carried)")
def pred_genre_matches(spark, sf):
    rules = spark.createDataFrame([(1, ["f1", "f2"], "R1"), (2, ["f3"], "build"), (3, ["f4"], "building"), (4, ["f0"], None)], "rule int, families array<string>, genre string")
    carried = table(spark, sf, "orders").select(F.col("o_custkey").alias("subject"), F.concat(F.lit("f"), F.col("o_orderkey") % 5).alias("family"))
    above = catalog.genre_closure(_tree(spark, sf)).groupBy("code").agg(F.collect_set("ancestor").alias("ancestors"))
    books = table(spark, sf, "customer").select(F.col("c_custkey").alias("subject"), F.concat(F.lit("N"), "c_nationkey").alias("code"), F.col("c_mktsegment").alias("genre_text")).join(eligibility.small(above), "code")
    return reasons.counterweights_met(rules, carried, books)


_ANSWERS = "a AS (SELECT l_orderkey * 10 + l_linenumber AS position, l_orderkey AS book, 'f' || (l_suppkey % 4) AS family, CASE l_returnflag WHEN 'A' THEN 'general' WHEN 'N' THEN 'genre' ELSE 'here' END AS scope, 'g' || CAST(l_quantity % 5 AS INT) AS genre, l_linestatus = 'F' AS old FROM lineitem)"


@query(f"WITH {_ANSWERS}, r AS (SELECT family, CASE WHEN scope = 'genre' THEN genre END AS genre, book, old, position FROM a WHERE scope <> 'here'), d AS (SELECT family, genre, book, bool_or(old) AS old, min((CASE WHEN old THEN 0 ELSE 1000000000000 END) + position) AS k FROM r GROUP BY 1, 2, 3) SELECT family, genre, sha256(string_agg(book::VARCHAR, ',' ORDER BY k)) AS books, count(*) > count_if(old) AS changed FROM d GROUP BY 1, 2")
def alg_scoped_counterweight(spark, sf):
    flag = F.col("l_returnflag")
    answers = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), F.col("l_orderkey").alias("book"), F.concat(F.lit("f"), F.col("l_suppkey") % 4).alias("family"), F.when(flag == "A", "general").when(flag == "N", "genre").otherwise("here").alias("scope"), F.concat(F.lit("g"), (F.col("l_quantity") % 5).cast("int")).alias("genre"), "l_linestatus")
    old, new = (reasons.scoped_counterweights(answers.where(c)) for c in ("l_linestatus = 'F'", "l_linestatus <> 'F'"))
    merged = reasons.merge_counterweights(old, new)
    return merged.select(F.col("families")[0].alias("family"), "genre", F.sha2(F.array_join(F.transform("books", lambda b: b.cast("string")), ","), 256).alias("books"), "changed")


@query("SELECT min(s_suppkey) AS position, 'n' || s_nationkey AS name, string_agg('g' || (s_suppkey % 3), ' / ' ORDER BY s_suppkey) AS genre FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey UNION ALL SELECT s_suppkey, 'n' || s_nationkey, NULL FROM supplier WHERE s_acctbal <= 0")
def agg_merge_genres(spark, sf):
    lines = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("position"), F.concat(F.lit("n"), "s_nationkey").alias("name"), F.when(F.col("s_acctbal") > 0, F.concat(F.lit("g"), F.col("s_suppkey") % 3)).alias("genre"), F.array("s_suppkey").alias("books"))
    return reasons.merge_genres(lines).select("position", "name", "genre")


_BAGS = ['\'{"stars": 4, "reasons": {"add": ["f\' || (event_id % 7) || \'"], "drop": ["x", 3, "y"], "other": ["z"]}}\'', '\'{"reasons": {"here": ["f\' || (event_id % 5) || \'", "f\' || (event_id % 5) || \'"], "add": "no list"}}\'', "'{broken'", "'[1]'"]


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'f' || (event_id % 7) ELSE '' END AS added, CASE event_type WHEN 'click' THEN 'x,y' WHEN 'view' THEN 'f' || (event_id % 5) ELSE '' END AS not_counted FROM events")
def json_reasons(spark, sf):
    kind = F.col("event_type")
    bag = F.when(kind == "click", F.expr(_BAGS[0])).when(kind == "view", F.expr(_BAGS[1])).when(kind == "error", F.expr(_BAGS[2])).when(kind == "signup", F.expr(_BAGS[3]))
    rows = table(spark, sf, "events").select("event_id", reasons.parse_reasons(bag).alias("r"))
    return rows.select("event_id", F.array_join(F.coalesce(F.try_element_at("r", F.lit("add")), F.array().cast("array<string>")), ",").alias("added"), F.array_join(reasons.not_counted(F.col("r")), ",").alias("not_counted"))


# --- dates and runs ---

_NOW = "TIMESTAMP '1997-06-02 10:00:00'"


@query(f"SELECT o_orderkey, CAST(floor(epoch({_NOW} - o_orderdate::TIMESTAMP) / 86400) AS INT) AS age, floor(epoch({_NOW} - o_orderdate::TIMESTAMP) / 86400) >= 1 AS stale FROM orders")
def dt_age_days(spark, sf):
    now, at = F.expr(_NOW), F.col("o_orderdate").cast("timestamp")
    return table(spark, sf, "orders").select("o_orderkey", dates.age_days(at, now).alias("age"), dates.is_stale(at, now).alias("stale"))


_LAST = "CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::TIMESTAMP END"


@query(f"SELECT o_orderkey, last IS NULL OR {_NOW} >= last + INTERVAL 7 DAY OR (isodow({_NOW}) = 1 AND last::DATE <> ({_NOW})::DATE) AS due, CASE WHEN last + INTERVAL 7 DAY > {_NOW} THEN CAST(last + INTERVAL 7 DAY AS DATE) END AS next FROM (SELECT *, {_LAST} AS last FROM orders)")
def dt_sweep_extended(spark, sf):
    now, last = F.expr(_NOW), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf, "orders").select("o_orderkey", dates.sweep_is_due(last, now, 0).alias("due"), dates.next_sweep(last, now).alias("next"))


@query(f"+{RUNS}, e AS (SELECT max(started_at) + INTERVAL 2 HOUR AS now FROM runs) SELECT id, CASE WHEN finished_at IS NOT NULL THEN status WHEN status <> 'abandoned' AND now <= started_at + INTERVAL 6 HOUR THEN 'running' ELSE 'abandoned' END AS reads FROM (SELECT *, CASE WHEN finished_at IS NULL AND id % 2 = 0 THEN 'running' ELSE status END AS s FROM runs), e".replace("SELECT id, CASE WHEN finished_at IS NOT NULL THEN status WHEN status", "SELECT id, CASE WHEN finished_at IS NOT NULL THEN s WHEN s"), "obs")
def agg_runs_journal(spark, sf):
    runs = _runs(spark, sf)
    status = F.when(F.col("finished_at").isNull() & (F.col("id") % 2 == 0), "running").otherwise(F.col("status"))
    now = runs.agg((F.max("started_at") + F.expr("INTERVAL 2 HOURS")).alias("now"))
    return runs.crossJoin(F.broadcast(now)).select("id", dates.run_reads(status, F.col("started_at"), F.col("finished_at"), F.col("now")).alias("reads"))


# --- forms of names ---

_TITLED = "t AS (SELECT p_partkey, p_name || CASE p_size % 4 WHEN 0 THEN '. Band ' || p_size WHEN 1 THEN ' - Teil ' || p_size || ' und 3' WHEN 2 THEN ' ' || p_size ELSE '' END AS title, CASE p_size % 3 WHEN 0 THEN 'Thriller: ' || p_type || ' ' || p_size || ' | Roman' WHEN 1 THEN 'Folge ' || p_size ELSE p_type || ' - Band ' || p_size || '.' END AS subtitle FROM part)"
_TITLE_RE, _SUB_RE = r"^(.{3,}?)\s*[.:–-]\s*(?:band|bd\.|teil|buch)\s+(\d{1,2})(?:$|\D.*$)", r"^(.+?)(?:\s*[-–:,]\s*|\s+)(?:(?:band|bd\.?|teil|buch)\s*)?(\d{1,2})$"


@query(f"""WITH {_TITLED}, h AS (SELECT *, rtrim(trim(split_part(subtitle, '|', 1)), '.') AS head, regexp_matches(title, '{_TITLE_RE}', 'i') AS bt FROM t),
  m AS (SELECT p_partkey, CASE WHEN bt AND regexp_matches(title, '(und|&|-|–)\\s*\\d+$') THEN NULL WHEN bt THEN regexp_extract(title, '{_TITLE_RE}', 1, 'i') ELSE regexp_replace(regexp_extract(head, '{_SUB_RE}', 1, 'i'), '^\\w[\\w-]*:\\s*', '') END AS name,
    CASE WHEN bt THEN regexp_extract(title, '{_TITLE_RE}', 2, 'i') ELSE regexp_extract(head, '{_SUB_RE}', 2, 'i') END AS volume FROM h)
  SELECT p_partkey, CASE WHEN ok THEN trim(name, ' -–:,') END AS name, CASE WHEN ok THEN volume END AS volume, CASE WHEN ok THEN trim(name, ' -–:,') || ' · Band ' || volume END AS label FROM (SELECT *, name IS NOT NULL AND name <> '' AND lower(name) <> 'folge' AND NOT regexp_matches(name, '\\d$') AS ok FROM m)""")
def str_series_from_title(spark, sf):
    size, name, kind = F.col("p_size"), F.col("p_name"), F.col("p_type")
    title = F.concat(name, F.when(size % 4 == 0, F.concat(F.lit(". Band "), size)).when(size % 4 == 1, F.concat(F.lit(" - Teil "), size, F.lit(" und 3"))).when(size % 4 == 2, F.concat(F.lit(" "), size)).otherwise(""))
    subtitle = F.when(size % 3 == 0, F.concat(F.lit("Thriller: "), kind, F.lit(" "), size, F.lit(" | Roman"))).when(size % 3 == 1, F.concat(F.lit("Folge "), size)).otherwise(F.concat(kind, F.lit(" - Band "), size, F.lit(".")))
    rows = table(spark, sf, "part").select("p_partkey", T.series_from_title(title, subtitle).alias("s"))
    return rows.select("p_partkey", "s.name", "s.volume", F.when(F.col("s").isNotNull(), T.series_label(F.col("s.name"), F.col("s.volume"))).alias("label"))


@query(r"""WITH e AS (SELECT p_partkey, trim(regexp_replace(p_name || '  -  ' || p_type || CASE WHEN p_size < 20 THEN ' (Grund: ' || p_brand || ')' WHEN p_size < 30 THEN ' 2' ELSE '' END, '\s+', ' ', 'g')) AS t FROM part),
  b AS (SELECT *, nullif(trim(regexp_extract(t, '\s*\(([^()]*)\)\s*$', 1)), '') AS note, trim(regexp_replace(t, '\s*\(([^()]*)\)\s*$', '')) AS bare FROM e)
  SELECT p_partkey, CASE WHEN regexp_matches(bare, '^(.+?)\s+[-–—]\s+([^-–—\d]+)$') THEN trim(regexp_extract(bare, '^(.+?)\s+[-–—]\s+([^-–—\d]+)$', 1)) ELSE bare END AS title, nullif(trim(regexp_extract(bare, '^(.+?)\s+[-–—]\s+([^-–—\d]+)$', 2)), '') AS author, note FROM b""")
def str_split_free_text(spark, sf):
    size = F.col("p_size")
    entry = F.concat("p_name", F.lit("  -  "), "p_type", F.when(size < 20, F.concat(F.lit(" (Grund: "), "p_brand", F.lit(")"))).when(size < 30, " 2").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", T.split_free_text(entry).alias("s")).select("p_partkey", "s.*")


@query("WITH f AS (SELECT p_partkey, str_split(p_name, ' ') AS w, p_type AS t, p_size % 4 AS k FROM part) SELECT p_partkey, CASE k WHEN 0 THEN w[2] || ' ' || w[1] WHEN 1 THEN w[1] || ' ' || w[2] WHEN 2 THEN t || ' K. ' || w[1] || ' ' || w[2] ELSE w[1] END AS author FROM f")
def str_display_author(spark, sf):
    w, k = F.split("p_name", " "), F.col("p_size") % 4
    field = F.when(k == 0, F.concat(w[0], F.lit(", "), w[1])).when(k == 1, F.concat(w[0], F.lit(" "), w[1], F.lit(", "), "p_type", F.lit(" "), w[0])).when(k == 2, F.concat(w[0], F.lit(" "), w[1], F.lit(", "), "p_type", F.lit(" K."))).otherwise(F.concat(w[0], F.lit(" und "), w[1]))
    return table(spark, sf, "part").select("p_partkey", T.display_author(field).alias("author"))


@query("SELECT a.c_custkey, b.s_suppkey FROM customer a JOIN supplier b ON a.c_nationkey = b.s_nationkey WHERE lower(a.c_mktsegment) = 'building' AND (b.s_acctbal < 0 OR b.s_suppkey % 2 = 0)")
def str_names_match(spark, sf):
    # Nations are few and their pairs many, so each nation's customers are dealt over many tasks, and its suppliers go to all of them.
    slots = 64
    entries = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.concat(F.lit(" "), "c_mktsegment").alias("title"), F.pmod(F.xxhash64("c_custkey"), F.lit(slots)).cast("int").alias("slot"))
    books = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("c_nationkey"), F.when(F.col("s_acctbal") >= 0, "Ann Lee").alias("wanted"), F.when(F.col("s_suppkey") % 2 == 0, "ann lee ").otherwise("Bo").alias("author"))
    books = books.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    dealt = entries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_nationkey", "slot")
    return dealt.join(books.hint("merge"), ["c_nationkey", "slot"]).where(T.names_book(F.lit("Building"), F.col("wanted"), F.col("title"), F.col("author"))).select("c_custkey", "s_suppkey")


@query("SELECT id, lower(concat_ws(' ', title, author, series)) AS haystack FROM obs", "obs")
def str_owned_search(spark, sf):
    return view(spark, sf, "obs").select("id", T.owned_search(F.col("title"), F.col("author"), F.col("series")).alias("haystack"))
