"""A corpus pipeline of five of the operators in ledgerlark.llm, from documents to packed sequences.

Each stage takes (spark, docs, sf_dir); run() writes what it returns to the shared checkpoint folder
and reads it again as the next stage's docs, so a lost executor costs the stage at hand at most.
All stages but the last return the columns of documents, doc_id, text, lang, source and n_chars; where a stage rewrites
texts, n_chars follows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.line_dedup import line_dedup
from ledgerlark.llm.ngram_jaccard import ngram_jaccard_components
from ledgerlark.llm.packing import best_fit_packing
from ledgerlark.llm.quality_rules import quality_verdicts
from ledgerlark.llm.storage import sent_if_small, stored
from ledgerlark.llm.substring_dedup import substring_dedup
from ledgerlark.llm.units import row_keys

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _rewritten(docs: DataFrame) -> DataFrame:
    """docs with n_chars brought up to date where the text has changed, without those that have lost all their words.
    Rows with a null text or id, empty texts and repeated rows come through as the operator before gives them."""
    changed = F.size("removed_spans") > 0
    gone = changed & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    n_chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return docs.where(~F.coalesce(gone, F.lit(False))).withColumn("n_chars", n_chars).select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; each row has its own verdict, with any id or none."""
    docs = row_keys(docs.select(*COLUMNS, F.col("doc_id").cast("long").alias("row")), "row", nulls=True)
    bad = stored(quality_verdicts(docs, keep=("row",)).where("not kept").select("row"))
    return docs.join(sent_if_small(bad), "row", "left_anti").select(*COLUMNS)


def drop_repeated_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the later of equal chunks of lines; what has no word left goes. Null, empty and repeated rows: see line_dedup."""
    return _rewritten(line_dedup(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id; of rows with one id each is compared as a row of its
    own. A row whose id is null stays."""
    docs = row_keys(docs.select(*COLUMNS, F.col("doc_id").cast("long").alias("row")), "row")
    groups = ngram_jaccard_components(docs, "row")
    other = stored(groups.where("row <> component_id").select("row").distinct())
    return docs.join(sent_if_small(other), "row", "left_anti").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the later of equal passages of 50 words and more; what has no word left goes. Null, empty and repeated
    rows: see substring_dedup."""
    return _rewritten(substring_dedup(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows as pieces in sequences of 1024 tokens; a null or empty text is one piece, the end id alone."""
    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_chunks),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("substring dedup", drop_repeated_passages),
    ("best-fit packing", pack),
]

#: SQL can't express robust estimates, rolling hashes or packing: tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; an empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
