"""Text rules as Column functions: folding, titles, volumes, authors, series, works, blurbs, prices.

All are built-in expressions, so they stay in generated code. ``fold`` covers accents of Latin letters by
table; exact_fold in ``fuzzy`` covers all of Unicode.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that decomposition leaves alone, and their plain spelling.
LETTER_FOLDS = {"ß": "ss", "ẞ": "ss", "ø": "o", "Ø": "o", "ł": "l", "Ł": "l", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "ð": "d", "Ð": "d", "þ": "th", "Þ": "th", "đ": "d", "Đ": "d"}

# Words and patterns that decide what a title says.
BUNDLE_PATTERN = r"(?iU)Sammelband|Sammelausgabe|Gesamtausgabe|Gesamtwerk|\bBundle\b|\d\s*in\s*1|^\s*\d+\s+\w+(?:[-\s]\w+)?\s*:|^\s*(?:Zwei|Drei|Vier|Fünf|Sechs|Sieben|Acht|Neun|Zehn|Zwölf)(?:mal|f?\s)"
EPISODE_PATTERN = r"(?iU)\b(?:Episode|Folge)\s*\d+"
SHORT_PATTERN = r"(?iU)Kurzgeschichte|Kurzkrimi|\bShort Story\b"
EDITION_PATTERN = r"[({\[]\s*(\d{4}|omnibus|anthology|hardcover|audiobook|audio ?cd|paperback|turtleback|mass ?market|edition|ed\.|ebook|ungek[uü]rzt|gek[uü]rzt|h[oö]rbuch|auflage)\s*[\])}]"
EDITION_PHRASE_PATTERN = r"[({\[][^\])}]*?(edition|ed\.|auflage)[^\])}]*?[\])}]"
TRAILING_BRACKET_PATTERN = r"[(\[][^)\]]*[)\]]\s*$"
PUNCTUATION_PATTERN = "[:,;!@$%^&*(){}.`~\"\\[\\]/《》「」“”‘’–—]|(?<=\\s)-|-(?=\\s)"
SUBTITLE_PATTERN = r"\s[-–—]\s|:\s|\s/\s|\s\\\s"
ARTICLE_PATTERN = r"^((the|a|an|of|and|der|die|das|den|dem|des|ein|eine|einen|einem|einer|le|la|les|el|los|il)\s+)+"
FORMAT_WORDS = ("ebook", "e-book", "horbuch", "audiobook", "ungekurzt", "gekurzt", "omnibus", "unabridged", "abridged", "taschenbuch", "gebundene")
JOIN_WORDS = ("a", "and", "the", "und", "of", "de")
VOLUME_PATTERN = r"(?U)\b(?:band|bd|teil|tl|folge|vol|volume|book)\s*\.?\s*(\d{1,3})\b"
MAX_VOLUME = 20
NAME_PREFIXES = ("mr", "mrs", "ms", "dr", "prof", "herr", "frau")
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "phd", "md", "junior", "senior")
NAME_PARTICLES = ("von", "van", "de", "der", "den", "di", "del", "della", "la", "le", "du", "dos", "da")
NON_NAMES = ("unknown", "unbekannt", "diverse", "verschiedene")
ORGANISATION_WORDS = ("verlag", "corporation", "company", "co", "agency", "council", "committee", "inc", "institute", "society", "club", "team", "gmbh", "redaktion")
NAME_PUNCTUATION_PATTERN = "[-+.:;,。；：!@#$%^&*()（）「」{}`~\"\\[\\]/]"
ICON_LIGATURES = ("navigate_next", "navigate_before", "expand_more", "expand_less", "chevron_right", "arrow_forward", "more_horiz")
TRAILING_CONTROL_PATTERN = r"(?i)\s*(?:alles anzeigen|weniger anzeigen|mehr anzeigen|weiterlesen)\s*$"
TEASER_CUT_PATTERN = r"(?i)\s*(?:\.\.\.|…)?\s*alles anzeigen\s*(?:expand_more)?\s*"
MADE_BY_AI_PATTERN = r"(?i)KI-Autor(in)?\b|\bKI[- ](generiert|erzeugt|erstellt|geschrieben)|zum Erstellen (sein|ihr)\w* Texte|mit (Hilfe von )?(KI|künstlicher Intelligenz) (erstellt|erzeugt|geschrieben|verfasst)|AI[- ](generated|assisted|written)"
AI_NEEDLES = ("ki", "ai", "erstellen")
ISBN_GROUPS = {"0": "eng", "1": "eng", "2": "fre", "3": "ger", "4": "jpn", "5": "rus", "606": "rum", "615": "hun", "963": "hun"}
LANGUAGE_NAMES = {
    "ger": "deutsch", "eng": "englisch", "fre": "französisch", "spa": "spanisch", "ita": "italienisch", "dut": "niederländisch", "swe": "schwedisch", "dan": "dänisch",
    "nor": "norwegisch", "pol": "polnisch", "por": "portugiesisch", "tur": "türkisch", "rus": "russisch", "jpn": "japanisch", "hun": "ungarisch", "rum": "rumänisch",
}
NOT_A_LANGUAGE = ("und", "mul", "zxx", "mis")


def _accents() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by Unicode's own decomposition."""
    pairs = [(c, d[0]) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(d := unicodedata.normalize("NFKD", c)) > 1 and all(0x300 <= ord(x) <= 0x36F for x in d[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def fold(text: Column) -> Column:
    """Lower case without accents; a combining mark falls away, ß is ss."""
    out = F.translate(F.regexp_replace(text, "[\\u0300-\\u036f]", ""), ACCENTED, PLAIN)
    for letter, plain in LETTER_FOLDS.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return F.lower(out)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def _without(words: Column, *lists: tuple[str, ...]) -> Column:
    return F.filter(words, lambda w: ~w.isin(*(x for group in lists for x in group)))


def _head(text: Column) -> Column:
    return F.split(text, SUBTITLE_PATTERN, 2)[0]


def normalize_title(title: Column) -> Column:
    """The comparable form of a title: no edition notes, subtitle, punctuation, leading articles or format words."""
    text = fold(title)
    for pattern in (EDITION_PATTERN, EDITION_PHRASE_PATTERN, TRAILING_BRACKET_PATTERN, TRAILING_BRACKET_PATTERN):
        text = F.regexp_replace(text, pattern, " ")
    head = _head(text)
    text = F.when(F.length(F.trim(head)) > 1, head).otherwise(text)
    text = F.regexp_replace(text, r"(\d+),(\d+)", "$1$2")
    text = squeeze(F.regexp_replace(text, PUNCTUATION_PATTERN, " "))
    return F.concat_ws(" ", _without(_words(F.regexp_replace(text, ARTICLE_PATTERN, "")), FORMAT_WORDS))


def title_tokens(title: Column) -> Column:
    return _without(_words(normalize_title(title)), JOIN_WORDS)


def title_is_contained(query: Column, candidate: Column) -> Column:
    """All tokens of the query are among the candidate's, which has more."""
    q, c = title_tokens(query), title_tokens(candidate)
    return (F.size(q) > 0) & (F.size(c) > F.size(q)) & (F.size(F.array_except(q, c)) == 0)


def named_volume(title: Column) -> Column:
    """The volume that a word for it names; null if none does."""
    return F.nullif(F.regexp_extract(fold(title), VOLUME_PATTERN, 1), F.lit("")).cast("int")


def volume_of(title: Column) -> Column:
    """The named volume, or a trailing number up to MAX_VOLUME before the subtitle, if other text stands before it."""
    head = F.trim(_head(fold(title)))
    number = F.nullif(F.regexp_extract(head, r"(?:^|\s)(\d{1,3})\s*$", 1), F.lit("")).cast("int")
    rest = F.trim(F.regexp_replace(head, r"(?:^|\s)(\d{1,3})\s*$", ""))
    return F.coalesce(named_volume(title), F.when((rest != "") & (number <= MAX_VOLUME), number))


def volumes_conflict(left: Column, right: Column) -> Column:
    """Both name a volume and differ, or only the right one does and it is a later one."""
    a, b = volume_of(left), volume_of(right)
    return F.when(a.isNotNull() & b.isNotNull(), a != b).when(b.isNotNull(), b > 1).otherwise(False)


def split_authors(raw: Column) -> Column:
    """The people of an author field. A comma parts people if at least half of what it parts are full names."""
    text = F.regexp_replace(F.replace(F.coalesce(raw, F.lit("")), F.lit("&&"), F.lit("￿")), r"(?iU),?\s+(and|with|und|mit)\s+", "&")
    segments = F.filter(F.transform(F.split(text, "[;&]"), lambda s: F.replace(F.trim(s), F.lit("￿"), F.lit("&"))), lambda s: s != "")

    def people(segment: Column) -> Column:
        parts = F.filter(F.transform(F.split(segment, ","), lambda p: F.trim(p)), lambda p: p != "")
        full = F.filter(parts, lambda p: (F.size(_words(p)) > 1) & F.exists(_words(p), lambda w: F.length(F.trim(F.translate(w, ".", " "))) > 1))
        return F.when((F.size(parts) > 1) & (F.size(full) * 2 >= F.size(parts)), parts).otherwise(F.array(segment))

    return F.flatten(F.transform(segments, people))


def normalize_author(name: Column) -> Column:
    """struct(full, substantial): the name's tokens, first name first, and those of more than two characters."""
    text = F.regexp_replace(fold(name), r"[({\[][^)\]}]*[)\]}]", " ")
    raw = _words(F.regexp_replace(text, NAME_PUNCTUATION_PATTERN, " "))
    organisation = F.arrays_overlap(raw, F.array(*map(F.lit, ORGANISATION_WORDS)))
    flipped = F.when(F.instr(text, ",") > 0, F.concat_ws(" ", F.substring_index(F.regexp_replace(text, r"^[^,]*,", ""), "￿", 1), F.substring_index(text, ",", 1))).otherwise(text)
    tokens = _without(_words(F.regexp_replace(flipped, NAME_PUNCTUATION_PATTERN, " ")), NAME_PREFIXES, NAME_SUFFIXES, NAME_PARTICLES, NON_NAMES)
    tokens = F.when(organisation, raw).otherwise(tokens)
    long = F.when(organisation, raw).otherwise(F.filter(tokens, lambda t: F.length(t) > 2))
    return F.struct(F.concat_ws(" ", tokens).alias("full"), F.concat_ws(" ", F.when(F.size(long) > 0, long).otherwise(tokens)).alias("substantial"))


def author_key(name: Column) -> Column:
    return normalize_author(name)["full"]


def series_key(name: Column) -> Column:
    """By what two names are one series: no addendum, hyphens, leading article or trailing genre word; never empty."""

    def spaced(text: Column) -> Column:
        return squeeze(F.replace(text, F.lit("-"), F.lit(" ")))

    def kept(text: Column, otherwise: Column) -> Column:
        return F.coalesce(F.nullif(text, F.lit("")), otherwise)

    low = F.lower(name)
    text = kept(spaced(F.regexp_replace(low, r"\s*\([^)]*\)$", "")), spaced(low))
    text = kept(F.regexp_replace(text, r"^(?:die|der|das|ein|eine)\s+", ""), text)
    return kept(F.regexp_replace(text, r"\s+(?:reihe|serie|trilogie|saga|zyklus|thriller|krimi|roman|ermittelt|ermitteln)$", ""), text)


def work_title(title: Column, original: Column) -> Column:
    """The original title, with the edition's own trailing number if it has none itself."""
    pattern = r"(?i)(?:(?:teil|band|bd|part|vol)\.?\s*)?(\d+)\s*$"
    number = F.regexp_extract(F.coalesce(title, F.lit("")), pattern, 1)
    return F.when(original.rlike(pattern) | (number == ""), original).otherwise(F.concat_ws(" ", original, number))


def work_key(author: Column, title: Column) -> Column:
    """"author|title" without case, accents and signs; null where one is missing or empty."""
    writer, name = author_key(author), squeeze(F.regexp_replace(fold(title), r"[^\p{L}\p{N}_]+", " "))
    return F.when((author != "") & (title != "") & (writer != "") & (name != ""), F.concat_ws("|", writer, name))


def clean_blurb(blurb: Column) -> Column:
    """A blurb without the controls of the page that slipped in; null if nothing is left."""
    icons = "|".join(ICON_LIGATURES)
    text = F.regexp_replace(blurb, rf"(?i)\s*(?:Mehr|Weiterlesen|mehr lesen)?\s*(?:{icons})\s*$", "")
    text = squeeze(F.regexp_replace(text, rf"\s*\b(?:{icons})\b\s*", " "))
    return F.nullif(F.trim(F.regexp_replace(text, TRAILING_CONTROL_PATTERN, "")), F.lit(""))


def without_teaser(blurb: Column) -> Column:
    """The text behind the first "alles anzeigen", if it begins with what stands before it."""
    parts = F.split(blurb, TEASER_CUT_PATTERN, 2)
    rest = F.trim(F.try_element_at(parts, F.lit(2)))
    teaser = F.regexp_replace(squeeze(parts[0]), r"[. …]+$", "")
    repeats = (rest != "") & F.startswith(squeeze(rest), F.substring(teaser, 1, 60))
    return F.when(F.coalesce(repeats, F.lit(False)), rest).otherwise(F.nullif(blurb, F.lit("")))


def is_truncated(blurb: Column) -> Column:
    return F.coalesce(F.rtrim(blurb).rlike(r"(\.\.\.|…)$"), F.lit(False))


def declares_ai(text: Column) -> Column:
    """A coarse test of words first, so that few texts meet the full pattern."""
    low = F.lower(text)
    coarse = F.contains(low, F.lit(AI_NEEDLES[0]))
    for needle in AI_NEEDLES[1:]:
        coarse = coarse | F.contains(low, F.lit(needle))
    return F.coalesce(coarse & text.rlike(MADE_BY_AI_PATTERN), F.lit(False))


def volume_titles(title: Column) -> Column:
    """Titles that a slash title lists; empty unless there are two and none is shorter than three characters."""
    parts = F.transform(F.split(F.regexp_replace(title, r"(?U)^\s*\d+\s+\w+(?:[-\s]\w+)?\s*:\s*", ""), r"\s+/\s+"), lambda p: F.trim(p))
    return F.when((F.size(parts) >= 2) & F.forall(parts, lambda p: F.length(p) >= 3), parts).otherwise(F.array().cast("array<string>"))


def looks_like_bundle(title: Column) -> Column:
    return F.coalesce(title.rlike(BUNDLE_PATTERN) | (F.size(volume_titles(title)) >= 2), F.lit(False))


def language_of_isbn(isbn: Column) -> Column:
    """What the registration group of a 13-digit ISBN says: its first digit, else its first three; else null."""
    digits = F.regexp_replace(isbn, r"[^0-9]", "")
    groups = F.create_map(*(F.lit(x) for pair in ISBN_GROUPS.items() for x in pair))
    fits = (F.length(digits) == 13) & digits.rlike("^97[89]")
    return F.when(fits, F.coalesce(F.try_element_at(groups, F.substring(digits, 4, 1)), F.try_element_at(groups, F.substring(digits, 4, 3))))


def language_name(code: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, code), code)


def is_other_language(code: Column, languages: tuple[str, ...]) -> Column:
    return F.coalesce((code != "") & ~code.isin(*NOT_A_LANGUAGE, *languages), F.lit(False))


def parse_price(text: Column) -> Column:
    """"1.234,56 €" in cents; null where there is no price."""
    found = F.regexp_extract(F.replace(text, F.lit(" "), F.lit(" ")), r"(\d{1,3}(?:\.\d{3})*|\d+),(\d{2})", 0)
    return F.nullif(F.regexp_replace(found, r"[.,]", ""), F.lit("")).cast("long")


def format_price(cents: Column) -> Column:
    return F.replace(F.format_string("%.2f €", cents / 100), F.lit("."), F.lit(","))


def canonical_url(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def isbn_from_order(number: Column) -> Column:
    return F.nullif(F.regexp_extract(number, r"(97[89]\d{10})", 1), F.lit(""))


def author_slug(author: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(author), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def one_sentence(text: Column, limit: int = 200) -> Column:
    """The first sentence if it ends within the limit, else the first ``limit`` characters."""
    first = F.regexp_extract(text, r"(?s)^(.*?[.!?])(?:\s|$)", 1)
    return F.when((first != "") & (F.length(first) <= limit), first).otherwise(F.substring(text, 1, limit))


def cover_name(url: Column, suffix: str = ".jpg") -> Column:
    return F.concat(F.substring(F.sha2(url, 256), 1, 12), F.lit(suffix))


# The two forms in which a title or a subtitle names series and volume, and words that are no name alone.
TITLE_VOLUME = r"(?iU)^(.{3,}?)\s*[.:–-]\s*(?:band|bd\.|teil|buch)\s+(\d{1,2})(?!\d)(.*)$"
SUBTITLE_VOLUME = r"(?iU)^(.+?)(?:\s*[-–:,]\s*|\s+)(?:(?:band|bd\.?|teil|buch)\s*)?(?<!\d)(\d{1,2})$"
SECOND_VOLUME = r"(?i)^\s*(?:und|&|-|–)\s*\d"
ENDS_IN_NUMBER = r"(?i)\d\s*(?:und|&|-|–)?$"
STRUCTURE_WORDS = ("band", "bd", "folge", "teil", "buch", "episode", "special", "nummer", "nr")
FREE_TEXT = r"^(.+?)\s+[-–—]\s+([^-–—\d]+)$"
TRAILING_NOTE = r"\s*\(([^()]*)\)\s*$"


def series_from_title(title: Column, subtitle: Column) -> Column:
    """struct(name, volume) if the title ("Name. Band 2") or else the subtitle's head ("Name 2", "Name - Band 2") names both; else null.

    A title of that form decides, even if it is vetoed: a second volume after the number, a name that ends in a number, or one of
    structure words only."""
    whole, head = F.trim(title), F.rtrim(F.trim(F.split(subtitle, r"\|", 2)[0]), F.lit("."))
    by_title = F.coalesce(whole.rlike(TITLE_VOLUME), F.lit(False))
    by_subtitle = F.coalesce(head.rlike(SUBTITLE_VOLUME), F.lit(False))
    shelf = F.regexp_replace(F.regexp_extract(head, SUBTITLE_VOLUME, 1), r"(?U)^\w[\w-]*:\s*", "")
    found = F.when(by_title, F.regexp_extract(whole, TITLE_VOLUME, 1)).when(by_subtitle, shelf)
    name = F.regexp_replace(found, "^[ –:,-]+|[ –:,-]+$", "")
    volume = F.when(by_title, F.regexp_extract(whole, TITLE_VOLUME, 2)).otherwise(F.regexp_extract(head, SUBTITLE_VOLUME, 2))
    words = F.filter(F.split(series_key(name), r"(?U)\W+"), lambda w: (w != "") & ~w.isin(*STRUCTURE_WORDS))
    second = by_title & F.regexp_extract(whole, TITLE_VOLUME, 3).rlike(SECOND_VOLUME)
    return F.when(~second & ~name.rlike(ENDS_IN_NUMBER) & (F.size(words) > 0), F.struct(name.alias("name"), volume.alias("volume")))


def split_free_text(entry: Column) -> Column:
    """struct(title, author, note) of "Title - Author (note)"; without a dash between words all of it is the title."""
    text = squeeze(entry)
    note = F.nullif(F.trim(F.regexp_extract(text, TRAILING_NOTE, 1)), F.lit(""))
    bare = F.trim(F.regexp_replace(text, TRAILING_NOTE, ""))
    split = bare.rlike(FREE_TEXT)
    title = F.when(split, F.trim(F.regexp_extract(bare, FREE_TEXT, 1))).otherwise(bare)
    return F.struct(title.alias("title"), F.when(split, F.trim(F.regexp_extract(bare, FREE_TEXT, 2))).alias("author"), note.alias("note"))


def display_author(field: Column) -> Column:
    """The first person of an author field, given name first; "Surname, Given" is turned round, two whole names are two people."""
    first = F.split(field, r"(?U)\s*(?:;|&|\bund\b|\band\b)\s*", 2)[0]
    parts = F.filter(F.transform(F.split(first, ","), squeeze), lambda p: p != "")
    surname, given = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    sorted_form = ~surname.contains(" ") | ~given.contains(" ") | given.rlike(r"(?U)(?:^|\s)\w\.$")
    return F.when(sorted_form, F.concat_ws(" ", given, surname)).otherwise(surname)


def same_name(a: Column, b: Column) -> Column:
    """Equal but for case and outer blanks; null is as empty."""
    return F.lower(F.trim(F.coalesce(a, F.lit("")))) == F.lower(F.trim(F.coalesce(b, F.lit(""))))


def names_book(entry_title: Column, entry_author: Column, title: Column, author: Column) -> Column:
    """An entry means this book: its title is the same, and its author if it names one."""
    return same_name(title, entry_title) & (entry_author.isNull() | same_name(author, entry_author))


def owned_search(title: Column, author: Column, series: Column) -> Column:
    """The text that a search on the shelf looks through."""
    return F.lower(F.concat_ws(" ", title, author, series))


def series_label(name: Column, volume: Column) -> Column:
    return F.concat_ws(" · Band ", name, F.nullif(volume, F.lit("")))
