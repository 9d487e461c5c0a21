"""Views of the model over other tables: the same expressions for Spark and, as SQL text, for checks in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.operators.eligibility import dealt

_OBSERVATION = """
SELECT e.event_id AS id, CAST(day(e.ts) AS BIGINT) AS run_id,
  CASE e.event_type WHEN 'click' THEN 'shop_a' WHEN 'purchase' THEN 'shop_b' WHEN 'error' THEN 'shop_c' WHEN 'view' THEN 'lib_a' ELSE 'lib_b' END AS source,
  CAST(e.user_id AS {text}) AS source_item_id,
  CASE e.user_id % 3 WHEN 0 THEN 'watchlist' WHEN 1 THEN 'profile_author' ELSE 'genre_category' END AS match_reason,
  e.user_id % 40 AS book_id,
  concat(p.p_name, CASE WHEN e.user_id % 11 = 0 THEN ' Sammelband' WHEN e.user_id % 13 = 0 THEN ' Folge 3' WHEN e.user_id % 29 = 0 THEN ' Band 2' ELSE '' END) AS title,
  CASE WHEN e.user_id % 17 = 0 THEN 'Eine Kurzgeschichte' WHEN e.user_id % 31 = 0 THEN 'Reihe 4' END AS subtitle,
  CASE WHEN e.user_id % 10 <> 9 THEN concat('Author ', CAST(e.user_id % 20 AS {text})) END AS author,
  CASE WHEN e.event_type IN ('click', 'purchase', 'error') THEN CAST(round(e.value * 100) AS BIGINT) END AS price_cents,
  CASE WHEN e.user_id % 5 = 0 AND e.event_type IN ('click', 'purchase', 'error') THEN CAST(round(e.value * 140) AS BIGINT) END AS original_price_cents,
  CASE WHEN e.event_type IN ('view', 'signup') THEN CASE CAST({json}(e.props, '$.k') AS INT) % 3 WHEN 0 THEN 'available' WHEN 1 THEN 'unavailable' ELSE 'unknown' END END AS availability,
  CASE WHEN e.user_id % 3 = 2 THEN concat('shelf ', CAST(e.user_id % 6 AS {text})) END AS category,
  concat('https://shop.example.com/', CASE WHEN e.user_id % 23 = 0 THEN 'fremdsprachige-romane/' ELSE 'romane/' END, CAST(e.user_id AS {text}), '?c=1') AS url,
  CASE WHEN e.user_id % 19 = 0 THEN 'Dieser Text ist KI-generiert.' WHEN e.user_id % 2 = 0 THEN 'Ein Roman über eine KI und das Meer ...' END AS blurb,
  CASE WHEN e.user_id % 7 <> 0 THEN concat('978', CASE WHEN e.user_id % 4 = 0 THEN '0' ELSE '3' END, lpad(CAST(e.user_id AS {text}), 9, '0')) END AS isbn,
  p.p_brand AS series, CASE WHEN e.user_id % 2 = 0 THEN CAST(p.p_size % 5 AS {text}) END AS series_index,
  CASE WHEN e.user_id % 5 <> 1 THEN CAST((e.user_id * 7) % 400 AS INT) END AS pages, e.ts AS observed_at
FROM events e LEFT JOIN part p ON p.p_partkey = e.user_id
"""
_PART_WORKS = "SELECT CAST(p_partkey AS {text}) AS isbn, p_name AS key, p_brand AS series, CAST(p_size AS {text}) AS volume, CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents FROM part"
_TRAITS = """
SELECT l_orderkey AS book, concat('t', CAST(l_partkey % 40 AS {text})) AS term, max(CASE WHEN l_quantity >= 34 THEN 1.0 WHEN l_quantity >= 17 THEN 0.7 ELSE 0.4 END) AS w
FROM lineitem GROUP BY 1, 2
"""
_RATED = "SELECT o_orderkey AS book, CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE -1 END AS sign FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 193 = 1"
_VIEWS = {"obs": _OBSERVATION, "works": _PART_WORKS, "traits": _TRAITS, "rated": _RATED}
_DIALECT = {"spark": {"text": "STRING", "json": "get_json_object"}, "duckdb": {"text": "VARCHAR", "json": "json_extract_string"}}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """obs, works, traits or rated over the tables in a folder."""
    sql = _VIEWS[name].format(**_DIALECT["spark"])
    used = [t for t in TABLES if f" {t} " in f"{sql} ".replace("\n", " ")]
    tables = {t: table(spark, sf_dir, t) for t in used}
    if name == "traits":
        # All that follows is by book: dealt once, in partitions that don't grow with the table.
        tables["lineitem"] = dealt(tables["lineitem"].select("l_orderkey", "l_partkey", "l_quantity"), "l_orderkey")
    return spark.sql(_placed(sql, used), **tables)


def _placed(sql: str, used: list[str]) -> str:
    for t in used:
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {t} ", f"{word} {{{t}}} ").replace(f"{word} {t}\n", f"{word} {{{t}}}\n")
        if sql.endswith(f"FROM {t}"):
            sql = sql[: -len(t)] + f"{{{t}}}"
    return sql


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the views before it; further common tables may follow in sql after "+"."""
    views = ", ".join(f"{n} AS ({_VIEWS[n].format(**_DIALECT['duckdb'])})" for n in names)
    return f"WITH RECURSIVE {views}{', ' + sql[1:] if sql.startswith('+') else ' ' + sql}"
