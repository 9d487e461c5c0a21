"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.alignment import token_alignment
from ledgerlark.llm.backtracking_bpe import backtracking_round_trip
from ledgerlark.llm.byte_bpe import round_trip
from ledgerlark.llm.chat_format import conversation_calls, link_tool_calls
from ledgerlark.llm.embedding_dedup import embedding_near_duplicates
from ledgerlark.llm.fill_in_middle import fill_in_middle_digests
from ledgerlark.llm.line_dedup import line_dedup
from ledgerlark.llm.ngram_jaccard import ngram_jaccard_components
from ledgerlark.llm.packing import best_fit_packing
from ledgerlark.llm.quality_rules import quality_verdicts
from ledgerlark.llm.substring_dedup import substring_dedup
from ledgerlark.llm.token_counts import token_counts
from ledgerlark.llm.url_filters import url_verdicts

#: The rules of op7: verdict, host, path.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_span_text(df: DataFrame) -> DataFrame:
    """removed_spans as text, "start-end" by commas, which every engine compares alike; n_chars follows the text."""
    changed = F.size("removed_spans") > 0
    df = df.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    spans = F.transform("removed_spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return df.withColumns({"n_removed": F.size("removed_spans").cast("long"), "removed_spans": F.concat_ws(",", spans)})


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(*conversation_calls(_table(spark, sf_dir, "conversations")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_span_text(substring_dedup(_table(spark, sf_dir, "documents")))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"), URL_RULES)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_span_text(line_dedup(_table(spark, sf_dir, "documents")))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(_table(spark, sf_dir, "documents"))


def op11_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtracking_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_digests(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_byte_bpe_round_trip, op3_chat_formatting, op4_token_counts, op5_quality_rules, op6_substring_dedup, op7_url_filters,
        op8_line_dedup, op9_embedding_near_dedup, op10_ngram_jaccard_join, op11_backtracking_bpe, op12_token_alignment, op13_fill_in_middle,
    )
}

_WORDS = r"list_filter(regexp_split_to_array(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLE_SQL: dict[str, str] = {
    "op3_chat_formatting": """
WITH RECURSIVE spoken AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE role IN ('user', 'system')),
d AS (
  SELECT s.conv_id, s.turn, 0 AS depth FROM spoken s WHERE role = 'system' OR NOT EXISTS (SELECT 1 FROM spoken p WHERE p.conv_id = s.conv_id AND p.turn = s.turn - 2)
  UNION ALL SELECT s.conv_id, s.turn, d.depth + 1 FROM d JOIN spoken s ON s.conv_id = d.conv_id AND s.turn = d.turn + 2 WHERE s.role = 'user'),
r AS (SELECT conv_id, turn - 1 AS turn, text AS content FROM conversations WHERE role = 'assistant'),
j AS (SELECT coalesce(s.conv_id, r.conv_id) AS conv_id, coalesce(s.turn, r.turn) AS turn, s.role, s.text, r.content, r.conv_id IS NOT NULL AS answered FROM spoken s FULL JOIN r ON r.conv_id = s.conv_id AND r.turn = s.turn)
SELECT j.conv_id, 't' || j.turn AS call_id, CAST(d.depth AS INT) AS depth,
  CASE WHEN role IS NULL THEN 'no call' WHEN role = 'system' THEN 'no schema' WHEN NOT answered THEN 'no result' ELSE 'ok' END AS status,
  '{"after":' || CASE WHEN role = 'user' THEN '"t' || (j.turn - 2) || '"' ELSE 'null' END || ',"arguments":' || CASE WHEN role IS NULL THEN 'null' ELSE '{"n_chars":' || length(text) || ',"text":' || to_json(text) || '}' END
  || ',"id":"t' || j.turn || '","name":' || CASE role WHEN 'user' THEN '"reply"' WHEN 'system' THEN '"instruct"' ELSE 'null' END || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS record
FROM j LEFT JOIN d ON d.conv_id = j.conv_id AND d.turn = j.turn
""",
    "op6_substring_dedup": r"""
WITH t AS (SELECT doc_id, text, regexp_extract(text, '^[\x20\x09-\x0D]*') AS lead, regexp_extract_all(text, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS toks FROM documents),
w AS (SELECT doc_id, lead, toks, list_transform(toks, lambda x: rtrim(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS words FROM t),
g AS (SELECT doc_id, unnest(range(1, len(words) - 48)) AS i, words FROM w WHERE len(words) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS d FROM g),
later AS (SELECT doc_id, i FROM h QUALIFY row_number() OVER (PARTITION BY d ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM later),
k AS (SELECT doc_id, lead, tok, i, sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY i) + length(lead) AS stop FROM (SELECT doc_id, lead, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS i FROM t)),
m AS (SELECT k.*, gone.i IS NOT NULL AS gone, k.i - row_number() OVER (PARTITION BY k.doc_id, gone.i IS NOT NULL ORDER BY k.i) AS island FROM k LEFT JOIN gone USING (doc_id, i)),
s AS (SELECT doc_id, min(stop - length(tok)) AS a, max(stop) AS b FROM m WHERE gone GROUP BY doc_id, island),
l AS (SELECT doc_id, string_agg(CAST(a AS BIGINT) || '-' || CAST(b AS BIGINT), ',' ORDER BY a) AS removed_spans, count(*) AS n_removed FROM s GROUP BY 1),
x AS (SELECT doc_id, any_value(lead) || coalesce(string_agg(tok, '' ORDER BY i) FILTER (NOT gone), '') AS text FROM m GROUP BY 1)
SELECT d.doc_id, coalesce(x.text, d.text) AS text, d.lang, d.source, CASE WHEN n_removed IS NULL THEN d.n_chars ELSE length(x.text) END AS n_chars, coalesce(removed_spans, '') AS removed_spans, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN x USING (doc_id)
""",
    "op9_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS c FROM v UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.node),
m AS (SELECT node, min(c) AS component_id FROM r GROUP BY 1)
SELECT v.vec_id, (SELECT count(*) FROM p WHERE p.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN m ON m.node = v.vec_id
""",
    "op10_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(words) < 5 THEN words ELSE words[i : i + 4] END, ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r AS (SELECT doc_id AS node, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(c) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY 1, 2
""",
}
