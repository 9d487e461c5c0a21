"""Records out of HTML pages, JSON payloads, MARC-XML and SPARQL results, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions import text as T

CATALOGUE_JSON = (
    "struct<items:array<struct<id:string,title:string,firstCreatorName:string,description:string,type:struct<id:string>,languages:array<struct<id:string>>,bisacCodes:array<string>,"
    "formats:array<struct<id:string,isbn:string>>,ownedCopies:int,availableCopies:int,luckyDayAvailableCopies:int,holdsCount:int,isOwned:boolean,"
    "detailedSeries:struct<seriesName:string,readingOrder:string,seriesId:long>,covers:struct<cover510Wide:struct<href:string>,cover300Wide:struct<href:string>>>>,totalItems:int>"
)
SPARQL_JSON = "struct<results:struct<bindings:array<map<string,struct<value:string>>>>>"
MARC_FIELDS = "struct<datafield:array<struct<_tag:string,subfield:array<struct<_code:string,_VALUE:string>>>>>"


def plain_text(html: Column) -> Column:
    """Text of a page: no scripts, styles or tags, entities of the five signs resolved, white space squeezed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return T.squeeze(text)


def element(html: Column, tag: str) -> Column:
    """Inner text of the first element of a tag, null if there is none."""
    return F.nullif(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1), F.lit(""))


def attribute(html: Column, tag: str, name: str) -> Column:
    return F.nullif(F.regexp_extract(html, rf'(?is)<{tag}\b[^>]*?\b{name}="([^"]*)"', 1), F.lit(""))


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, position, href, label) of each page's links, each href at its first place."""
    found = pages.select(id_col, F.posexplode(F.regexp_extract_all(html_col, F.lit(r'(?is)(<a\b[^>]*href="[^"]*"[^>]*>.*?</a>)'), 1)).alias("position", "a"))
    rows = found.select(id_col, "position", attribute(F.col("a"), "a", "href").alias("href"), plain_text(F.col("a")).alias("label"))
    return rows.groupBy(id_col, "href").agg(F.min(F.struct("position", "label")).alias("m")).select(id_col, F.col("m.position").alias("position"), "href", F.col("m.label").alias("label"))


def tiles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, order_number, title, author, price_cents, url) of listing tiles <article data-order="…">, first of an order number;
    an article without a title or link raises, since the page has changed then."""
    boxes = pages.select(id_col, F.posexplode(F.regexp_extract_all(html_col, F.lit(r'(?is)(<article\b[^>]*data-order="[^"]*".*?</article>)'), 1)).alias("at", "box"))
    rows = boxes.select(
        id_col, "at", attribute(F.col("box"), "article", "data-order").alias("order_number"), F.coalesce(attribute(F.col("box"), "a", "title"), plain_text(element(F.col("box"), "a"))).alias("title"),
        plain_text(element(F.col("box"), "address")).alias("author"), T.parse_price(plain_text(F.col("box"))).alias("price_cents"), T.canonical_url(attribute(F.col("box"), "a", "href")).alias("url"),
    )
    checked = rows.withColumn("url", F.when(F.col("title").isNull() | F.col("url").isNull(), F.raise_error(F.lit("a tile has no title or link"))).otherwise(F.col("url")))
    rest = ["at", "title", "author", "price_cents", "url"]
    return checked.groupBy(id_col, "order_number").agg(F.min_by(F.struct(*rest), "at").alias("m")).select(id_col, "order_number", "m.*").drop("at")


def catalogue_items(payload: DataFrame, json_col: str = "json", language: str = "de") -> DataFrame:
    """One row for each e-book of the language in a catalogue's JSON; availability is unknown without a licence. Children's books are left out."""
    item = F.explode(F.from_json(json_col, CATALOGUE_JSON, {"mode": "FAILFAST"})["items"]).alias("i")
    rows = payload.select(item)
    book = (F.col("i.type.id") == "ebook") & F.exists("i.languages", lambda x: x["id"] == language) & ~F.coalesce(F.exists("i.bisacCodes", lambda c: c.startswith("JUV")), F.lit(False))
    copies = F.coalesce("i.availableCopies", F.lit(0)) + F.coalesce("i.luckyDayAvailableCopies", F.lit(0))
    availability = F.when(F.coalesce("i.ownedCopies", F.lit(0)) == 0, "unknown").when(copies > 0, "available").otherwise("unavailable")
    isbn = F.try_element_at(F.filter("i.formats", lambda f: f["isbn"].isNotNull()), F.lit(1))["isbn"]
    return rows.where(book).select(
        F.col("i.id").alias("source_item_id"), T.squeeze(F.regexp_replace("i.title", "<[^>]*>", "")).alias("title"), F.col("i.firstCreatorName").alias("author"), availability.alias("availability"),
        F.col("i.holdsCount").alias("reservation_count"), isbn.alias("isbn"), F.col("i.bisacCodes").alias("codes"), F.col("i.detailedSeries.seriesName").alias("series"),
        F.col("i.detailedSeries.readingOrder").alias("series_index"), F.coalesce("i.covers.cover510Wide.href", "i.covers.cover300Wide.href").alias("cover_url"),
    )


def marc_records(xml: DataFrame, xml_col: str = "xml") -> DataFrame:
    """One row for each document: title, subtitle, author, series, volume, language, original title, pages, keywords and contained ISBNs of its first record; null title if it has none."""
    field = F.regexp_extract_all(xml_col, F.lit(r'(?s)(<(?:\w+:)?datafield\b.*?</(?:\w+:)?datafield>)'), 1)
    rows = xml.withColumn("_fields", field)

    def of(tag: str, code: str) -> Column:
        tagged = F.filter("_fields", lambda f: f.rlike(rf'tag="{tag}"'))
        return F.flatten(F.transform(tagged, lambda f: F.regexp_extract_all(f, F.lit(rf'(?s)code="{code}"[^>]*>(.*?)</'), 1)))

    def first(tag: str, code: str) -> Column:
        return F.try_element_at(of(tag, code), F.lit(1))

    return rows.select(
        *(c for c in xml.columns if c != xml_col), first("245", "a").alias("title"), first("245", "b").alias("subtitle"), F.coalesce(first("100", "a"), first("245", "c")).alias("author"), first("490", "a").alias("series"),
        first("490", "v").alias("volume"), first("041", "a").alias("language"), first("240", "a").alias("original_title"), F.nullif(F.regexp_extract(first("300", "a"), r"(\d+)\s*S", 1), F.lit("")).cast("int").alias("pages"),
        F.array_distinct(of("653", "a")).alias("keywords"), F.array_distinct(of("770", "z")).alias("contains"),
    )


def sparql_memberships(payload: DataFrame, author: Column, json_col: str = "json") -> DataFrame:
    """(id, item, series, series_name, volume): the one item whose author has the asked last name, with a volume if any; no row if several or none do."""
    def value(name: str) -> Column:
        return F.try_element_at(F.col("b"), F.lit(name))["value"]

    rows = payload.select("id", author.alias("_author"), F.explode(F.from_json(json_col, SPARQL_JSON)["results"]["bindings"]).alias("b"))
    rows = rows.select("id", "_author", value("item").alias("item"), value("authorLabel").alias("label"), value("series").alias("series"), value("seriesLabel").alias("series_name"), value("ord").alias("volume"))
    mine, theirs = T.author_key(F.col("_author")), T.author_key(F.col("label"))
    same = (mine == theirs) | ((mine != "") & (F.substring_index(mine, " ", -1) == F.substring_index(theirs, " ", -1)))
    best = F.min_by(F.struct("series", "series_name", "volume"), F.struct(F.col("series").isNull(), F.col("volume").isNull(), "volume", "series"))
    items = rows.groupBy("id", "item").agg(F.bool_or(F.coalesce(same, F.lit(False))).alias("same"), best.alias("s")).where("same")
    return items.groupBy("id").agg(F.count("*").alias("n"), F.first("item").alias("item"), F.first("s").alias("s")).where("n = 1").select("id", "item", "s.*")


def opening(text: Column, most: int = 800) -> Column:
    """The first ``most`` words."""
    return F.concat_ws(" ", F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, most))


def png_pixels(data: Column) -> Column:
    """Width times height out of a PNG's header; null for other bytes."""
    head = F.hex(F.substring(data, 1, 24))
    size = lambda at: F.conv(F.substring(head, at, 8), 16, 10).cast("long")
    return F.when(F.startswith(head, F.lit("89504E470D0A1A0A")), size(33) * size(41))
