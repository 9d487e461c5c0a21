"""Why a book fits or doesn't: reasons from data, counterweights and their scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.operators.catalog import written
from ledgerlark.operators.eligibility import small

#: From this value on a family is named, for or against.
NAMED_FROM = 0.3
#: Kinds of a reader's own reasons: missing in the portrait, not true, only here.
REASON_KINDS = ("add", "drop", "here")


def parse_reasons(details: Column) -> Column:
    """map(kind, families) of a bag's "reasons": known kinds with a list, only its strings; empty if the bag is broken."""
    reasons = F.try_variant_get(F.try_parse_json(details), "$.reasons", "map<string,variant>")
    known = F.map_filter(reasons, lambda k, v: k.isin(*REASON_KINDS) & F.schema_of_variant(v).startswith("ARRAY"))
    texts = F.transform_values(known, lambda k, v: F.transform(F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string")))
    return F.coalesce(texts, F.create_map().cast("map<string,array<string>>"))


def not_counted(reasons: Column) -> Column:
    """Families that don't count at this book when the taste is learned."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*(F.coalesce(F.try_element_at(reasons, F.lit(k)), empty) for k in ("drop", "here"))))


def scoped_counterweights(answers: DataFrame) -> DataFrame:
    """(position, families, genre, books) that answers (position, book, family, scope, genre) mean: scope "general" holds everywhere,
    "genre" with the book's genre, "here" for nothing. Another scope, or "genre" without a genre, is an error."""
    bad = F.when(~F.coalesce(F.col("scope").isin("general", "genre", "here"), F.lit(False)), F.raise_error(F.concat(F.lit("unknown scope "), F.coalesce("scope", F.lit("null")))))
    genre = F.when(F.col("scope") == "genre", F.when(F.coalesce("genre", F.lit("")) == "", F.raise_error("this book has no genre")).otherwise(F.col("genre")))
    checked = answers.withColumn("genre", F.coalesce(bad.cast("string"), genre)).where("coalesce(scope, '') <> 'here'")
    return checked.select("position", F.array("family").alias("families"), "genre", F.array("book").alias("books"))


def merge_counterweights(old: DataFrame, new: DataFrame) -> DataFrame:
    """(position, families, genre, books, changed) of old and new ones: equal families and genre are one rule, which takes on the books
    in order, each once. changed: the rule is new or took on a book. New ones follow the old."""
    rows = old.withColumn("late", F.lit(0)).unionByName(new.withColumn("late", F.lit(1)))
    grouped = rows.groupBy("families", "genre").agg(F.array_sort(F.collect_list(F.struct("late", "position", "books"))).alias("r"))
    books = F.array_distinct(F.flatten(F.transform("r", lambda x: x["books"])))
    before = F.array_distinct(F.flatten(F.transform(F.filter("r", lambda x: x["late"] == 0), lambda x: x["books"])))
    return grouped.select(F.struct(F.col("r")[0]["late"].alias("late"), F.col("r")[0]["position"].alias("position")).alias("position"), "families", "genre", books.alias("books"), (F.size(books) > F.size(before)).alias("changed"))


def merge_genres(lines: DataFrame) -> DataFrame:
    """Lines (position, name, genre, books) with those of one name and a genre as one, the genres joined by " / ", books each once;
    a line without genre stays by itself."""
    alone = F.when(F.col("genre").isNull(), F.col("position"))
    grouped = lines.groupBy("name", alone.alias("_alone")).agg(F.array_sort(F.collect_list(F.struct("position", "genre", "books"))).alias("r"))
    return grouped.select(F.col("r")[0]["position"].alias("position"), "name", F.nullif(F.array_join(F.transform("r", lambda x: x["genre"]), " / "), F.lit("")).alias("genre"), F.array_distinct(F.flatten(F.transform("r", lambda x: x["books"]))).alias("books"))


def genre_met(rule_genre: Column, ancestors: Column, *texts: Column) -> Column:
    """Whether a counterweight's genre is the book's: none holds for all, a code for itself and all below (ancestors of the book's
    codes), other text as a whole word of the book's genre texts."""
    word = F.concat(F.lit(r"(?iU)(?<!\w)\Q"), rule_genre, F.lit(r"\E(?!\w)"))
    by_text = F.lit(False)
    for text in texts:
        by_text = by_text | F.coalesce(F.regexp(text, word), F.lit(False))
    return rule_genre.isNull() | F.coalesce(F.array_contains(ancestors, rule_genre), F.lit(False)) | by_text


def counterweights_met(rules: DataFrame, carried: DataFrame, books: DataFrame) -> DataFrame:
    """(subject, rule) of rules (rule, families, genre) whose families the subject carries (subject, family) and whose genre it has
    (books: subject, ancestors, genre_text). Rules meet subjects by family, then the genre is tested: no pair without a shared family."""
    parts = rules.select("rule", F.col("genre").alias("rule_genre"), F.size(F.array_distinct("families")).alias("wanted"), F.explode(F.array_distinct("families")).alias("family"))
    met = carried.select("subject", "family").distinct().join(small(parts), "family").groupBy("subject", "rule", "rule_genre", "wanted").agg(F.count("*").alias("got")).where("got = wanted")
    return met.join(books, "subject").where(genre_met(F.col("rule_genre"), F.col("ancestors"), F.col("genre_text"))).select("subject", "rule")


def reasons(named: DataFrame, sentences: DataFrame, families: DataFrame, facets: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """(subject, position, kind, text, boosted): whole facets first, then what is liked, then what speaks against; each with its sentence.

    named (subject, family, value): values of what a subject carries; sentences (subject, family, sentence): the first sentence of
    each; families (family, name, is_pattern, boosted); facets (facet, families); met (subject, rule, families, genre): counterweights.
    Liked families of a facet that is met have no line of their own; boosted ones come first, patterns last, then the stronger, then by id.
    """
    families = small(families)
    carried = named.join(families, "family", "left").withColumns({"name": F.coalesce("name", "family"), "is_pattern": F.coalesce("is_pattern", F.lit(False)), "boosted": F.coalesce("boosted", F.lit(False))})
    parts = facets.select("facet", F.size("families").alias("wanted"), F.posexplode("families").alias("at", "family"))
    hits = carried.join(small(parts), "family").groupBy("subject", "facet", "wanted").agg(F.array_sort(F.collect_list(F.struct("at", "family", "name"))).alias("parts")).where(F.size("parts") == F.col("wanted"))
    in_hits = hits.select("subject", F.explode("parts").alias("p")).select("subject", "p.family").distinct()
    liked = carried.where(F.col("value") >= NAMED_FROM).join(in_hits, ["subject", "family"], "left_anti")
    against = carried.where(F.col("value") <= -NAMED_FROM)
    no = F.lit(False)

    def line(df: DataFrame, section: int, order: list[Column], kind: Column, text: Column, boosted: Column, of: Column) -> DataFrame:
        zero = F.lit(0.0)
        keys = [c.cast("double") for c in order] + [zero] * (3 - len(order))
        return df.select("subject", F.lit(section).alias("section"), F.array(*keys).alias("order"), kind.alias("kind"), text.alias("text"), boosted.alias("boosted"), of.alias("of"))

    lines = line(hits, 0, [F.col("facet")], F.lit("facet"), F.array_join(F.transform("parts", lambda p: p["name"]), " · "), no, F.transform("parts", lambda p: p["family"]))
    lines = lines.unionByName(line(liked, 1, [(~F.col("boosted")).cast("int"), F.col("is_pattern").cast("int"), -F.col("value")], F.when(F.col("is_pattern"), "pattern").otherwise("trait"), F.col("name"), F.col("boosted"), F.array("family")))
    lines = lines.unionByName(line(against, 3, [F.col("value")], F.lit("against"), F.col("name"), no, F.array("family")))
    if met is not None:
        names = small(families.select("family", "name"))
        rule = met.select("subject", "rule", "genre", F.posexplode("families").alias("at", "family")).join(names, "family", "left").groupBy("subject", "rule", "genre").agg(F.array_sort(F.collect_list(F.struct("at", "family", F.coalesce("name", "family").alias("name")))).alias("parts"))
        where = F.when(F.col("genre").isNotNull(), F.concat(F.lit(" ("), "genre", F.lit(")"))).otherwise("")
        lines = lines.unionByName(line(rule, 4, [F.col("rule")], F.lit("against"), F.concat(F.array_join(F.transform("parts", lambda p: p["name"]), " · "), where), no, F.transform("parts", lambda p: p["family"])))
    # Written, as all that follows would work the lines out again.
    lines = written(lines)
    said = lines.where("section <= 1").select("subject").distinct()
    nothing = named.select("subject").distinct().join(said, "subject", "left_anti")
    lines = lines.unionByName(line(nothing, 2, [], F.lit("none"), F.lit("nothing liked is met"), no, F.array().cast("array<string>")))
    keyed = lines.withColumn("tie", F.array_join("of", " "))
    told = keyed.select("subject", "section", "order", "tie", F.posexplode("of").alias("at", "family")).join(sentences.where("sentence <> ''"), ["subject", "family"])
    told = told.select("subject", "section", "order", "tie", (F.col("at") + 1).alias("at"), F.lit("sentence").alias("kind"), F.col("sentence").alias("text"), no.alias("boosted"))
    rows = keyed.select("subject", "section", "order", "tie", F.lit(0).alias("at"), "kind", "text", "boosted").unionByName(told)
    w = Window.partitionBy("subject").orderBy("section", "order", "tie", "at")
    return rows.select("subject", F.row_number().over(w).alias("position"), "kind", "text", "boosted")


def reason_line(kind: Column, text: Column, boosted: Column) -> Column:
    """A reason as text without a picture. The words are fixed values."""
    prefix = F.when(kind == "pattern", "Erzählmuster: ").when(kind == "against", "dagegen: ").otherwise("")
    return F.concat(prefix, text, F.when(boosted, " (verstärkt)").otherwise(""))
