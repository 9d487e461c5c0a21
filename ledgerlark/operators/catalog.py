"""Works, series, bundles and the genre tree."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions import text as T
from ledgerlark.schemas import BISAC_ORIGINS, SERIES_ORIGINS, WORK_ORIGINS
from ledgerlark.settings import Settings


def origin_rank(column: str, origins: tuple[str, ...]) -> Column:
    out = F.lit(len(origins))
    for n, origin in reversed(list(enumerate(origins))):
        out = F.when(F.col(column) == origin, n).otherwise(out)
    return out


def first_by_rank(entries: DataFrame, origins: tuple[str, ...] = SERIES_ORIGINS) -> DataFrame:
    """(isbn, series_id, volume): the series of the first origin, and the volume of the first that names one, each for itself."""
    rank = origin_rank("origin", origins)
    named = F.when(F.coalesce(F.col("volume") != "", F.lit(False)), rank)
    return entries.groupBy("isbn").agg(F.min_by("series_id", rank).alias("series_id"), F.min_by("volume", named).alias("volume"))


def effective_works(entries: DataFrame) -> DataFrame:
    """(isbn, key) by the first origin that names a work."""
    return entries.groupBy("isbn").agg(F.min_by("key", F.struct(origin_rank("origin", WORK_ORIGINS), "key")).alias("key"))


def siblings(works: DataFrame) -> DataFrame:
    """(isbn, key, work, n): the least ISBN of its work and the number of its editions, by window over the key."""
    w = Window.partitionBy("key")
    return works.select("isbn", "key", F.min("isbn").over(w).alias("work"), F.count("*").over(w).alias("n"))


def owned_as(works: DataFrame, owned: DataFrame) -> DataFrame:
    """(isbn, owned_isbn): another edition of the same work that is owned, the least. That is one of the two least that are owned of a
    work, so editions meet these two and not each other."""
    mine = works.join(owned.select("isbn").distinct(), "isbn", "left_semi").select("key", F.col("isbn").alias("owned_isbn")).distinct()
    two = mine.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("owned_isbn"))).where("_n <= 2")
    least = two.groupBy("key").agg(F.min("owned_isbn").alias("_first"), F.max("owned_isbn").alias("_second"))
    other = F.when(F.col("isbn") != F.col("_first"), F.col("_first")).when(F.col("isbn") != F.col("_second"), F.col("_second"))
    return works.join(least, "key").select("isbn", other.alias("owned_isbn")).where("owned_isbn is not null").groupBy("isbn").agg(F.min("owned_isbn").alias("owned_isbn"))


def decided_works(works: DataFrame, decided: DataFrame) -> DataFrame:
    """ISBNs of every edition of a work of which one is decided."""
    keys = works.join(decided.select("isbn").distinct(), "isbn", "left_semi").select("key").distinct()
    return works.join(keys, "key", "left_semi").select("isbn").unionByName(decided.select("isbn")).distinct()


def collapse_works(items: DataFrame, works: DataFrame, cost: list[Column], order: str = "ordinal") -> DataFrame:
    """items (isbn, ordinal, …) with winner and others: of each work the item with the least cost stands for it.
    Without an ISBN an item stands for itself."""
    joined = items.join(siblings(works).select("isbn", "work"), "isbn", "left")
    joined = joined.withColumn("_work", F.when(F.col("isbn").isNull(), F.concat(F.lit("#"), F.col(order).cast("string"))).otherwise(F.coalesce("work", "isbn"))).drop("work")
    w = Window.partitionBy("_work")
    ranked = joined.withColumn("_n", F.row_number().over(w.orderBy(*cost, order)))
    return ranked.withColumn("winner", F.col("_n") == 1).withColumn("others", F.count("*").over(w) - 1).drop("_n", "_work")


def volume_number(volume: Column) -> Column:
    """The number a volume text begins with once non-digits are off, up to three digits."""
    return F.nullif(F.regexp_extract(volume, r"^[^0-9]*([0-9]{1,3})", 1), F.lit("")).cast("int")


def volume_span(rows: DataFrame, by: str, volume: str = "volume") -> DataFrame:
    """(by, span): "2" or "2–5" over the volumes that name a number."""
    out = rows.withColumn("_v", volume_number(F.col(volume))).groupBy(by).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    return out.select(by, F.when(F.col("_a") == F.col("_b"), F.col("_a").cast("string")).otherwise(F.concat(F.col("_a"), F.lit("–"), F.col("_b"))).alias("span"))


def mode_first(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value): its most frequent value, the least of several."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).count()
    return counts.groupBy(by).agg(F.min_by(value, F.struct(-F.col("count"), value)).alias(value))


def ordered_codes(entries: DataFrame, origins: tuple[str, ...] = BISAC_ORIGINS) -> DataFrame:
    """(isbn, codes): codes by origin, then rank, each at its first place."""
    rows = F.array_sort(F.collect_list(F.struct(origin_rank("origin", origins).alias("o"), "origin", "rank", "code")))
    return entries.groupBy("isbn").agg(F.array_distinct(F.transform(rows, lambda r: r["code"])).alias("codes"))


def preferred_spelling(names: DataFrame, by: str, name: str) -> DataFrame:
    """(by, name): no comma before comma, then more accents, then the longer, then the alphabet."""
    n = F.col(name)
    accents = F.length(n) - F.length(F.translate(n, T.ACCENTED, ""))
    return names.groupBy(by).agg(F.min_by(name, F.struct(n.contains(","), -accents, -F.length(n), n)).alias(name))


def longest_blurb(rows: DataFrame, by: str) -> DataFrame:
    """(by, blurb): the longest, of equals the first by id."""
    return rows.where("blurb is not null").groupBy(by).agg(F.max_by("blurb", F.struct(F.length("blurb"), -F.col("id"))).alias("blurb"))


def earliest_volume(rows: DataFrame, by: str) -> DataFrame:
    """(by, volume, title) of the least numeric volume; one that is no number counts last."""
    number = F.coalesce(F.expr("try_cast(volume as double)"), F.lit(float("inf")))
    return rows.groupBy(by).agg(F.min(F.struct(number.alias("n"), "title", "volume")).alias("_m")).select(by, F.col("_m.volume").alias("volume"), F.col("_m.title").alias("title"))


def genre_closure(tree: DataFrame) -> DataFrame:
    """(code, ancestor, depth) of a tree (code, parent), each code its own ancestor at depth 0. The number of joins is the tree's depth."""
    found = level = tree.select("code", F.col("code").alias("ancestor"), F.lit(0).alias("depth"))
    parents = tree.where("parent is not null").select(F.col("code").alias("ancestor"), "parent")
    while not (level := level.join(parents, "ancestor").select("code", F.col("parent").alias("ancestor"), (F.col("depth") + 1).alias("depth"))).isEmpty():
        found = found.unionByName(level)
    return found


def covered(codes: DataFrame, closure: DataFrame, wanted: DataFrame) -> DataFrame:
    """(subject, genre): of the wanted codes the nearest that covers one of the subject's codes."""
    hits = codes.join(closure, "code").join(wanted.select(F.col("code").alias("ancestor")).distinct(), "ancestor", "left_semi")
    return hits.groupBy("subject").agg(F.min_by("ancestor", F.struct("depth", "ancestor")).alias("genre"))


def book_codes(codes: Column, portrait_code: Column, listed: tuple[str, ...], audiences: dict[str, str]) -> Column:
    """Codes of the list: a source's code itself, its audience's, or its group's general one; the portrait's code if the
    source has none of the list, or beside them if it names an audience."""
    on_list = F.array(*map(F.lit, listed))
    by_prefix = F.create_map(*(F.lit(x) for pair in audiences.items() for x in pair))

    def one(code: Column) -> Column:
        return F.when(F.array_contains(on_list, code), code).otherwise(F.coalesce(F.try_element_at(by_prefix, F.substring(code, 1, 3)), F.concat(F.substring(code, 1, 6), F.lit("000"))))

    mapped = F.array_distinct(F.filter(F.transform(F.coalesce(codes, F.array().cast("array<string>")), one), lambda c: F.array_contains(on_list, c)))
    audience = F.when(portrait_code.isin(*audiences.values()), F.array(portrait_code)).otherwise(F.array().cast("array<string>"))
    found = F.array_union(mapped, audience)
    alone = F.when(F.array_contains(on_list, portrait_code), F.array(portrait_code)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(found) > 0, found).otherwise(F.coalesce(alone, F.array().cast("array<string>")))


def all_or_nothing(parts: DataFrame, by: str, price: str) -> DataFrame:
    """(by, n, singles_cents) of groups of two parts or more of which each has a positive price."""
    out = parts.groupBy(by).agg(F.count("*").alias("n"), F.count(F.when(F.col(price) > 0, 1)).alias("_priced"), F.sum(price).alias("singles_cents"))
    return out.where("n >= 2 and n = _priced").drop("_priced")


def bundle_advantage(bundles: DataFrame, settings: Settings) -> DataFrame:
    """bundles (price_cents, singles_cents) that save enough, with saved_pct rounded half to even."""
    pct = F.bround((F.col("singles_cents") - F.col("price_cents")) * 100.0 / F.col("singles_cents"), 0).cast("int")
    worth = (F.col("price_cents") > 0) & (F.col("singles_cents") > F.col("price_cents"))
    return bundles.where(worth).withColumn("saved_pct", pct).where(F.col("saved_pct") >= settings.min_discount_pct)


def written(df: DataFrame) -> DataFrame:
    """df through a Parquet table in the cluster's checkpoint folder, so that its lineage ends; in local mode, where none is set, through a local folder."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not (spark.sparkContext.master or "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ledgerlark-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b), component the least node. Each round every node goes up to its least neighbour, if that is less, and
    three steps further; edges between nodes that went to the same are gone, so rounds work on ever fewer nodes and edges."""
    joined = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left, levels = written(edges.select(*joined(F.col("a"), F.col("b"))).where("a <> b").distinct()), []
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("near")))
        up = written(ends.groupBy("node").agg(F.min("near").alias("up")).select("node", F.least("node", "up").alias("up")))
        for _ in range(2):
            up = written(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("_top")), "up").select("node", F.col("_top").alias("up")))
        levels.append(up)
        ups = [up.select(F.col("node").alias(x), F.col("up").alias(f"_{x}")) for x in "ab"]
        left = written(left.join(ups[0], "a").join(ups[1], "b").select(*joined(F.col("_a"), F.col("_b"))).where("a <> b").distinct())
    label = levels.pop() if levels else edges.select(F.col("a").alias("node"), F.col("a").alias("up")).limit(0)
    while levels:
        above = label.select(F.col("node").alias("up"), F.col("up").alias("_top"))
        label = written(levels.pop().join(above, "up", "left").select("node", F.coalesce("_top", "up").alias("up")))
    return label.withColumnRenamed("up", "component")
