"""Bags of details and answers of a model, as JSON: read, checked, and turned into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.operators.eligibility import small

# Fixed values.
DETAIL_KEYS = ("tier", "sources", "note", "restrict", "known_missing", "reasons", "removed", "series", "series_ended", "name")
TIERS = ("core", "extended")
RESTRICTIONS = ("library", "shop")
REASON_KINDS = ("drop", "add")
FORMS = ("roman", "novelle", "kurzgeschichte")
ANSWER = (
    "bekannt boolean, titel string, autor string, genre string, untergenre string, pitch string, genre_code string, form string, "
    "merkmale array<struct<id:string,satz:string,beleg:string,gewicht:string>>, erzaehlmuster array<struct<id:string,satz:string,beleg:string>>"
)
WEIGHT_WORDS = {"prägend": "defining", "deutlich": "clear", "am Rande": "marginal"}


def details(text: Column) -> Column:
    """The bag as a map of variants; a broken one is empty."""
    return F.coalesce(F.from_json(text, "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def detail_fault(text: Column) -> Column:
    """What is wrong with a bag, or null: unknown keys, or values outside their domain."""
    bag = details(text)
    unknown = F.array_sort(F.array_except(F.map_keys(bag), F.array(*map(F.lit, DETAIL_KEYS))))
    value = lambda key: F.get_json_object(text, f"$.{key}")
    kind = lambda key: F.schema_of_variant(F.try_element_at(bag, F.lit(key)))
    reason_keys = F.json_object_keys(value("reasons"))
    return (
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.concat_ws(", ", unknown)))
        .when(F.coalesce(kind("removed") != "BOOLEAN", F.lit(False)), "removed is true or false")
        .when(value("reasons").isNotNull() & (F.size(F.array_except(reason_keys, F.array(*map(F.lit, REASON_KINDS)))) > 0), "reasons has unknown kinds")
        .when(~value("restrict").isin(*RESTRICTIONS), "unknown restriction")
        .when(~value("tier").isin(*TIERS), "unknown tier")
        .when(F.coalesce(kind("sources") != "ARRAY<STRING>", F.lit(False)), "sources is a list of names")
    )


def checked(text: Column) -> Column:
    """The text, or an error that says what is wrong with it."""
    fault = detail_fault(text)
    return F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(text)


def answers(rows: DataFrame, vocabulary: DataFrame, text_col: str = "answer", *, evidence: tuple[str, ...] = ("text", "leseprobe", "wissen"), pitch_max: int = 200) -> DataFrame:
    """(subject, known, traits, violations): a model's answers, with every rule that they break.

    vocabulary (term, dimension, is_pattern) is a closed list and is joined term by term. A term outside it is named and left out;
    other faults are named only. Order within violations is the alphabet's. Answers are judged each for itself, also several of one subject.
    The list is sent to all executors if it is small; answers are dealt once, and their items stay together."""
    first = F.regexp_extract(text_col, r"(?s)(\{.*\})", 1)
    keyed = rows.select("subject", text_col, F.sha2(text_col, 256).alias("digest"))
    # Reading costs more than bytes tell, so rows are dealt before it; items of an answer then meet without another shuffle.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parsed = keyed.repartition(parts, "subject", "digest").select("subject", "digest", F.from_json(first, ANSWER).alias("a"))
    listed = F.concat(
        F.transform(F.coalesce("a.merkmale", F.array().cast("array<struct<id:string,satz:string,beleg:string,gewicht:string>>")), lambda t: F.struct(t["id"].alias("term"), t["satz"].alias("sentence"), t["beleg"].alias("evidence"), t["gewicht"].alias("word"), F.lit(False).alias("as_pattern"))),
        F.transform(F.coalesce("a.erzaehlmuster", F.array().cast("array<struct<id:string,satz:string,beleg:string>>")), lambda t: F.struct(t["id"].alias("term"), t["satz"].alias("sentence"), t["beleg"].alias("evidence"), F.lit(None).cast("string").alias("word"), F.lit(True).alias("as_pattern"))),
    )
    known = F.coalesce("a.bekannt", F.lit(False))
    some = (F.size(F.coalesce("a.merkmale", F.array())) > 0) | (F.size(F.coalesce("a.erzaehlmuster", F.array())) > 0)
    of_text = F.array_compact(F.array(
        F.when(F.coalesce(F.trim("a.pitch"), F.lit("")) == "", "no pitch").when(F.length(F.trim("a.pitch")) > pitch_max, "the pitch is too long"),
        F.when(~F.col("a.form").isin(*FORMS), "unknown form"),
    ))
    read = parsed.select("subject", "digest", known.alias("known"), F.coalesce(some, F.lit(False)).alias("some"), F.when(known, of_text).alias("of_text"), F.when(known, listed).alias("listed"))
    each = read.select("subject", "digest", "known", "some", "of_text", F.transform("listed", lambda t: t["term"]).alias("terms"), F.posexplode_outer("listed").alias("pos", "t"))
    items = each.select("subject", "digest", "known", "some", "of_text", "pos", "t.*", (F.array_position("terms", F.col("t.term")) == F.col("pos") + 1).alias("first")).join(small(vocabulary), "term", "left")
    words = F.create_map(*(F.lit(x) for pair in WEIGHT_WORDS.items() for x in pair))
    inside = F.col("dimension").isNotNull()
    kept = inside & F.col("first")
    fault = F.array_compact(F.array(
        F.when(~inside, F.concat(F.lit("not in the vocabulary: "), F.coalesce("term", F.lit("(empty)")))),
        F.when(inside & ~kept, F.concat(F.lit("twice: "), "term")),
        F.when(kept & (F.col("is_pattern") != F.col("as_pattern")), F.concat(F.lit("in the wrong list: "), "term")),
        F.when(kept & ~F.coalesce(F.col("evidence").isin(*evidence), F.lit(False)), F.concat(F.lit("no valid evidence: "), "term")),
        F.when(kept & ~F.col("is_pattern") & F.try_element_at(words, F.coalesce("word", F.lit(""))).isNull(), F.concat(F.lit("no valid weight: "), "term")),
    ))
    weight = F.try_element_at(words, F.coalesce("word", F.lit("")))
    item = F.struct("pos", "term", "sentence", "evidence", weight.alias("weight"), F.coalesce(kept, F.lit(False)).alias("kept"), "is_pattern", "dimension", fault.alias("fault"))
    starts = F.coalesce("pos", F.lit(0)) == 0
    out = items.groupBy("subject", "digest", "known").agg(
        F.count_if(starts).alias("times"), F.first("some").alias("some"), F.first("of_text").alias("of_text"), F.array_sort(F.collect_set(F.when(F.col("pos").isNotNull(), item))).alias("items")
    )
    out = out.withColumn("plain", F.transform(F.filter("items", lambda t: t["kept"] & ~t["is_pattern"]), lambda t: t["dimension"]))
    dimensions = F.array_distinct("plain")
    most = F.array_max(F.transform(dimensions, lambda d: F.size(F.filter("plain", lambda x: x == d))))
    plain, patterns = F.size("plain"), F.size(F.filter("items", lambda t: t["kept"] & t["is_pattern"]))
    whole = F.array_compact(F.array(
        F.when(~plain.between(4, 8), F.concat(plain, F.lit(" traits, four to eight are asked for"))),
        F.when(~patterns.between(1, 3), F.concat(patterns, F.lit(" patterns, one to three are asked for"))),
        F.when((plain > 0) & (F.size(dimensions) < 3), "fewer than three dimensions"),
        F.when(most > 3, "more than three of one dimension"),
    ))
    faults = F.array_sort(F.concat(F.flatten(F.transform("items", lambda t: t["fault"])), whole, "of_text"))
    violations = F.when(F.col("known"), faults).when(F.col("some"), F.array(F.lit("unknown, but with traits"))).otherwise(F.array().cast("array<string>"))
    traits = F.transform(F.filter("items", lambda t: t["kept"]), lambda t: F.struct(*(t[x].alias(x) for x in ("pos", "term", "sentence", "evidence", "weight"))))
    again = F.explode(F.sequence(F.lit(1).cast("long"), "times"))
    return out.select("subject", "known", F.when(F.col("known"), traits).alias("traits"), violations.alias("violations"), again.alias("_")).drop("_")


def merged(old: Column, new: Column, dropped: Column) -> Column:
    """The old without what now stands on the other side, then the new, each once."""
    return F.array_union(F.array_except(old, dropped), new)
