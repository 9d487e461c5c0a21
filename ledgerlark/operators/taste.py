"""Learn a taste from liked and disliked books, and judge others by it, step by step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators.catalog import written
from ledgerlark.operators.eligibility import small
from ledgerlark.settings import Weights


def max_weight_per_term(traits: DataFrame, weights: Weights) -> DataFrame:
    """(subject, term, w): a portrait's terms, each with the largest of its weights."""
    return traits.groupBy("subject", "term").agg(F.max(weights.trait_weight(F.col("weight"))).alias("w"))


def learn(rated: DataFrame, terms: DataFrame, vocabulary: DataFrame, weights: Weights, prior: DataFrame | None = None, limited: DataFrame | None = None, dropped: DataFrame | None = None, added: DataFrame | None = None) -> DataFrame:
    """The taste form: rows (kind "family" or "term", key, family, value in -1..1).

    rated (book, sign), terms (book, term, w), vocabulary (term, family, is_pattern), prior (family, value) for what was tapped,
    limited (book, family) rejections that hold for a genre only, dropped (book, family) not meant, added (book, family) named by the reader.
    """
    fit = terms.join(rated, "book").join(vocabulary.select("term", "family"), "term")
    carried = fit.select("book", "family").distinct()
    if dropped is not None:
        fit = fit.join(dropped, ["book", "family"], "left_anti")
    if limited is not None:
        out = fit.where("sign < 0").join(limited, ["book", "family"], "left_semi")
        fit = fit.join(out.select("book", "family").distinct().withColumn("sign", F.lit(-1)), ["book", "family", "sign"], "left_anti")
    size = rated.agg(F.greatest(F.lit(1), F.count_if(F.col("sign") > 0)).alias("n"), F.greatest(F.lit(1), F.count_if(F.col("sign") < 0)).alias("m"))
    reject = F.sum if weights.rejection_mean else F.max
    by_sign = [F.coalesce(F.sum(F.when(F.col("sign") > 0, F.col("w"))), F.lit(0.0)).alias("liked"), F.coalesce(reject(F.when(F.col("sign") < 0, F.col("w"))), F.lit(0.0)).alias("against")]
    said = fit.select("family", "sign", "w")
    named = None
    if added is not None:
        named = added.join(carried, ["book", "family"], "left_anti").join(rated, "book")
        said = said.unionByName(named.select("family", "sign", F.lit(weights.reader_reason).alias("w")))
    lam = weights.rejection_ratio * F.col("n") / (F.col("m") if weights.rejection_mean else F.lit(1))
    agreed = (F.col("liked") - lam * F.col("against")).alias("agree")
    family = said.groupBy("family").agg(*by_sign).crossJoin(F.broadcast(size)).select("family", agreed)
    start = prior if prior is not None else family.select("family", F.lit(0.0).alias("value")).limit(0)
    if named is not None:
        taps = named.groupBy("family").agg(F.max(F.when(F.col("sign") > 0, F.lit(weights.prior_liked))).alias("up"), F.min(F.when(F.col("sign") < 0, F.lit(-weights.prior_against))).alias("down"))
        start = start.join(taps, "family", "full").select("family", F.coalesce(F.least(F.greatest("value", "up"), "down"), F.lit(0.0)).alias("value"))
    k, kt = weights.prior_books, weights.term_to_family
    family = family.join(start, "family", "full").crossJoin(F.broadcast(size))
    family = family.select("family", "n", ((F.coalesce("agree", F.lit(0.0)) + k * F.coalesce("value", F.lit(0.0))) / (F.col("n") + k)).alias("v"))
    term = fit.groupBy("term", "family").agg(*by_sign).crossJoin(F.broadcast(size)).select("term", "family", agreed)
    term = term.join(family.withColumnRenamed("v", "fv"), "family").select("term", "family", ((F.col("agree") + kt * F.col("fv") * F.col("n")) / (F.col("n") + kt * F.col("n"))).alias("v"))
    liked = F.array_sort(F.collect_list(F.when(F.col("v") > 0.02, F.col("v"))))
    at = F.least(F.floor(F.size("p") * weights.full_quantile), F.size("p") - 1).cast("int")
    top = family.agg(liked.alias("p")).select(F.coalesce(F.try_element_at("p", at + 1), F.lit(1.0)).alias("top"))
    rows = family.select(F.lit("family").alias("kind"), F.col("family").alias("key"), "family", "v").unionByName(term.select(F.lit("term").alias("kind"), F.col("term").alias("key"), "family", "v"))
    return rows.crossJoin(F.broadcast(top)).select("kind", "key", "family", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("v") / F.col("top"))).alias("value"))


def _effects(terms: DataFrame, form: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(subject, term, w, family, is_pattern, known, v): v is the term's value, else its family's."""
    by_term = form.where("kind = 'term'").select(F.col("key").alias("term"), F.col("value").alias("tv"))
    by_family = form.where("kind = 'family'").select("family", F.col("value").alias("fv"), F.lit(True).alias("known"))
    rows = terms.join(small(vocabulary), "term").join(small(by_term), "term", "left").join(small(by_family), "family", "left")
    return rows.select("subject", "term", "w", "family", "is_pattern", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("tv", "fv", F.lit(0.0)).alias("v"))


def overlap(terms: DataFrame, form: DataFrame, vocabulary: DataFrame, weights: Weights, facets: DataFrame | None = None, liked_genre: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """(subject, share, stars, steps): how well each book fits; the steps' deltas add up to the share.

    terms (subject, term, w); facets (facet, family) lift once if a book carries all families of one; liked_genre (subject);
    rules (subject, rule, family) are genre rules whose genre the subject has, and lower the share if it carries all their families.
    A form with no liked family other than patterns knows too little: the result is then empty.
    """
    # Form and vocabulary have few keys and terms are many: sent where small, as a shuffle by term would make tasks of whole terms.
    form = written(form)
    patterns = vocabulary.where("is_pattern").select("family").distinct()
    knows = form.where("kind = 'family' and value > 0").join(patterns, "family", "left_anti").limit(1).select(F.lit(1).alias("_"))
    rows = _effects(terms, form, vocabulary)
    v, w = F.col("v"), F.col("w")
    up, down = F.greatest(v, F.lit(0.0)), F.greatest(-v, F.lit(0.0))
    counts, pattern = F.col("known") & ~F.col("is_pattern"), F.col("known") & F.col("is_pattern")

    def total(condition: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))

    by_family = rows.groupBy("subject", "family").agg(
        total(counts, w).alias("mass"), total(counts, w * up).alias("up"), total(counts, w * down).alias("down"),
        total(pattern, F.lit(1.0)).alias("p_mass"), total(pattern, up).alias("p_up"), total(pattern, down).alias("p_down"), F.max("w").alias("strength"), F.max(counts.cast("int")).alias("counts"),
    )
    book = by_family.groupBy("subject").agg(
        *(F.sum(c).alias(c) for c in ("mass", "up", "down", "p_mass", "p_up", "p_down")),
        F.array_sort(F.collect_list(F.when((F.col("counts") == 1) | (F.col("p_mass") > 0), F.struct(-F.abs(F.col("up") - F.col("down")), "family", (F.col("up") - F.col("down")).alias("e"), (F.col("p_up") - F.col("p_down")).alias("pe"), (F.col("p_mass") > 0).alias("p"))))).alias("effects"),
    )
    if facets is not None:
        wanted = facets.groupBy("facet").agg(F.count_distinct("family").alias("wanted"))
        hit = by_family.select("subject", "family").join(small(facets), "family").groupBy("subject", "facet").agg(F.count_distinct("family").alias("got")).join(small(wanted), "facet").where("got = wanted").select("subject").distinct().withColumn("facet", F.lit(True))
        book = book.join(hit, "subject", "left")
    if liked_genre is not None:
        book = book.join(liked_genre.select("subject").distinct().withColumn("liked_genre", F.lit(True)), "subject", "left")
    if rules is not None:
        met = rules.join(by_family.select("subject", "family", "strength"), ["subject", "family"], "left").groupBy("subject", "rule").agg(F.min("strength").alias("s"), F.count_if(F.col("strength").isNull()).alias("missing")).where("missing = 0")
        book = book.join(met.groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule", "s"))), lambda r: r["s"]).alias("rules")), "subject", "left")

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)) if name in book.columns else F.lit(False)

    a, ap, p0 = weights.smoothing, weights.pattern_smoothing, weights.baseline
    book = book.withColumn("raw", (F.col("up") - F.col("down") + a * p0) / (F.col("mass") + a)).withColumn("s0", F.greatest(F.lit(0.0), F.col("raw")))
    book = book.withColumn("pattern", F.when(F.col("p_mass") > 0, (F.col("p_up") - F.col("p_down") + ap * p0) / (F.col("p_mass") + ap)).otherwise(0.0))
    book = book.withColumn("s1", 1 - (1 - F.col("s0")) * (1 - weights.pattern_for * F.greatest("pattern", F.lit(0.0))))
    book = book.withColumn("s2", F.when(flag("facet"), 1 - (1 - F.col("s1")) * (1 - weights.facet_bonus)).otherwise(F.col("s1")))
    book = book.withColumn("s3", F.when(flag("liked_genre"), 1 - (1 - F.col("s2")) * (1 - weights.genre_bonus)).otherwise(F.col("s2")))
    book = book.withColumn("s4", F.col("s3") * (1 - weights.pattern_against * F.greatest(-F.col("pattern"), F.lit(0.0))))
    strengths = F.coalesce("rules", F.array().cast("array<double>")) if "rules" in book.columns else F.array().cast("array<double>")
    book = book.withColumn("s5", F.aggregate(strengths, F.col("s4"), lambda s, x: s * (1 - weights.genre_counterweight * x)))
    book = book.withColumn("share", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s5"))))

    def step(kind: str, delta: Column, family: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), delta.alias("delta"), (family if family is not None else F.lit(None).cast("string")).alias("family"))

    mass, lift = F.col("mass") + a, (1 - F.col("s0")) * weights.pattern_for / (F.col("p_mass") + ap)
    steps = F.concat(
        F.array(step("baseline", a * p0 / mass)),
        F.transform(F.filter("effects", lambda x: ~x["p"]), lambda x: step("family", x["e"] / mass, x["family"])),
        F.array(step("floor", F.col("s0") - F.col("raw"))),
        F.when(F.col("pattern") > 0, F.concat(F.array(step("pattern_baseline", lift * ap * p0)), F.transform(F.filter("effects", lambda x: x["p"]), lambda x: step("pattern", lift * x["pe"], x["family"])))).otherwise(F.array(step("pattern_baseline", F.lit(0.0)))),
        F.array(step("facet", F.col("s2") - F.col("s1")), step("liked_genre", F.col("s3") - F.col("s2")), step("pattern_against", F.col("s4") - F.col("s3")), step("genre", F.col("s5") - F.col("s4")), step("bounds", F.col("share") - F.col("s5"))),
    )
    kept = F.filter(steps, lambda s: (s["delta"] != 0) | (s["kind"] == "baseline"))
    return book.crossJoin(F.broadcast(knows)).select("subject", "share", weights.stars(F.round("share", 9)).alias("stars"), kept.alias("steps"))


def judge(scores: DataFrame, weights: Weights, liked_series: DataFrame | None = None, reader: DataFrame | None = None) -> DataFrame:
    """scores with percent, verdict_stars and withheld: a liked series lifts to the gate, the reader's own stars override."""
    out = scores
    floor, own = F.lit(0), F.lit(None).cast("int")
    if liked_series is not None:
        out = out.join(liked_series.select("subject").distinct().withColumn("_series", F.lit(weights.gate_stars)), "subject", "left")
        floor = F.coalesce("_series", F.lit(0))
    if reader is not None:
        out = out.join(reader.select("subject", F.col("stars").cast("int").alias("_own")), "subject", "left")
        own = F.col("_own")
    stars = F.coalesce(own, F.greatest(F.col("stars"), floor))
    return out.withColumns({"percent": F.bround(F.col("share") * 100, 0).cast("int"), "borderline": weights.is_borderline(F.col("share")), "verdict_stars": stars, "withheld": stars < weights.gate_stars}).drop("_series", "_own")


def waterfall(scores: DataFrame) -> DataFrame:
    """(subject, position, kind, family, start, end): a score's steps as running sums."""
    rows = scores.select("subject", F.posexplode("steps").alias("position", "step"))
    w = Window.partitionBy("subject").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("step.delta").over(w)
    return rows.select("subject", "position", "step.kind", "step.family", (end - F.col("step.delta")).alias("start"), end.alias("end"))


def derive_facets(carriers: DataFrame) -> DataFrame:
    """(books, families) of carriers (family, book): sets of two books or more that a family, or two families together, are carried
    by, with all families that these books carry; at least two families.

    Such a set is all books that carry its families, so equal families mean equal books, and none lies within another with families
    and all. Sets are told apart by families and counts of books; books are listed once, for the sets that are left."""
    carriers = written(carriers.where("family is not null and book is not null").distinct())
    carried = written(carriers.groupBy("book").agg(F.array_sort(F.collect_list("family")).alias("families")))
    pairs = carried.select("book", "families", F.explode("families").alias("f")).select("book", "families", "f", F.explode("families").alias("g")).where("f <= g")
    sets = pairs.groupBy("f", "g").agg(F.count("*").alias("n")).where("n >= 2")
    shared = pairs.select("f", "g", F.explode("families").alias("family")).groupBy("f", "g", "family").agg(F.count("*").alias("c"))
    whole = shared.join(sets, ["f", "g"]).where("c = n").groupBy("f", "g").agg(F.array_sort(F.collect_list("family")).alias("families")).where(F.size("families") >= 2)
    named = whole.groupBy("families").agg(F.min(F.struct("f", "g")).alias("_by")).select("families", "_by.f", "_by.g")
    held = pairs.select("book", "f", "g").join(small(written(named)), ["f", "g"])
    return held.groupBy("f", "g").agg(F.array_sort(F.collect_list("book")).alias("books"), F.first("families").alias("families")).select("books", "families")


def strength_level(books: Column, defining: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(4), books + defining.cast("int")))
