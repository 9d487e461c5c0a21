"""URL filters: allow and block rules first, then logistic regression on hashed character n-grams of
host and path. Everything runs as DataFrame, SQL and spark.ml operations in the JVM."""

from __future__ import annotations

from itertools import product
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path)
Rule = tuple[str, str, str]

#: Words of the labelled table's host names: what a crawl should leave out, by the topics of common blocklists (gambling, drugs,
#: porn, piracy, fraud, loans), and what it may keep. No host name of the test pages has any of them.
BLOCKED_WORDS = ("pharma", "viagra", "steroids", "poker", "slots", "roulette", "jackpot", "lottery", "xxx", "porn", "escort", "warez", "keygen", "torrent", "phishing", "malware", "loans", "payday", "replica")
ALLOWED_WORDS = (
    "library", "archive", "museum", "science", "history", "college", "research", "journal", "weather", "garden", "recipes", "travel", "theatre", "grammar", "physics",
    "medicine", "council", "statistics", "railway", "forest", "astronomy", "software", "tutorial", "gallery", "football", "chess", "thought", "mathematics",
)
#: Beside words of either class, so that a neighbour tells no label.
BESIDE = ("", "city", "open", "north", "old", "notes", "daily", "children", "best", "online", "deals", "instant")
_PLACES = (("", ".info", "/index.html"), ("shop.", ".co.uk", "/page/3"), ("web.", ".eu", "/2021/04/item"), ("", ".net.au", "/news"), ("", ".biz", "/"), ("home.", ".ca", "/about"))


def _names(words: tuple[str, ...], beside: tuple[str, ...]) -> dict[str, str]:
    """Each word alone where nothing stands beside it, else in both orders; the name's word beside it."""
    return dict(sorted({f"{a}-{b}".strip("-"): w for w, x in product(words, beside) for a, b in ((w, x), (x, w))}.items()))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, name, word, label): each name in three places; label 1.0 is to be blocked."""
    rows = [(f"http://{before}{name}{after}{path}", name, word, label) for words, label in ((BLOCKED_WORDS, 1.0), (ALLOWED_WORDS, 0.0)) for k, (name, word) in enumerate(_names(words, BESIDE).items()) for before, after, path in _PLACES[k % 2 :: 2]]
    return spark.createDataFrame(rows, "url string, name string, word string, label double")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), ascii_uppercase, ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _grams(host: Column, path: Column, sizes: tuple[int, ...]) -> Column:
    """Character n-grams of the host's names and of the path, marked by where they stand."""

    def of(text: Column, mark: str, n: int) -> Column:
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

    return F.concat(*(of(F.concat(F.lit("."), host, F.lit(".")), "h", n) for n in sizes), *(of(path, "p", n) for n in sizes))


def train(labelled: DataFrame, *, sizes: tuple[int, ...] = (3, 4), features: int = 1 << 15, penalty: float = 0.003) -> PipelineModel:
    """Fit the regression on a small table (url, label)."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.select("label", _grams(host, path, sizes).alias("grams"))
    stages = [HashingTF(inputCol="grams", outputCol="features", numFeatures=features, binary=True), LogisticRegression(regParam=penalty, maxIter=60)]
    return Pipeline(stages=stages).fit(rows)


def url_verdicts(pages: DataFrame, rules: tuple[Rule, ...], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", *, sizes: tuple[int, ...] = (3, 4), cut: float = 0.5) -> DataFrame:
    """One row for each page: its id, host, path, rule (the rule that decides, host and path in one; else
    null), score (probability that it should be blocked) and verdict ("allow" or "block").

    A rule fits its host and all subdomains of it if the path begins with the rule's; of several the longest
    decides, then the one with the longer host, then the first in the alphabet. A null URL or one without :// has an empty
    host and path, and is judged by the model as such. Rows are judged each for itself, with any id; an empty table gives an
    empty result; further columns are left out. The model is trained on ``labelled`` (url, label), by default ``labelled_urls``.
    """
    host, path = host_and_path(F.col("_url"))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url")).select("_id", host.alias("host"), path.alias("path"))
    rule, decided = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, on, begin in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((F.col("host") == on) | F.col("host").endswith(f".{on}")) & F.col("path").startswith(begin)
        rule, decided = F.when(fits, F.lit(on + begin)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(decided)
    model = train(labelled if labelled is not None else labelled_urls(pages.sparkSession), sizes=sizes)
    scored = model.transform(rows.withColumn("grams", _grams(F.col("host"), F.col("path"), sizes)))
    score = vector_to_array("probability")[1]
    verdict = F.coalesce(decided, F.when(score > cut, "block").otherwise("allow"))
    return scored.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), score.alias("score"), verdict.alias("verdict"))
