"""Genre codes from free text, and words for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code and pattern of lower-case "genre | subgenre"; the first that fits decides.
RULES = (
    ("FIC015050", r"psychologischer horror|psycho-?horror"),
    ("FIC031100", r"domestic|familien-?thriller|nachbarschafts?-?thriller|ehe-?thriller"),
    ("FIC031080", r"psycho|psychologisch"),
    ("FIC006000", r"spionage|agenten|polit-?thriller|politthriller"),
    ("FIC036000", r"techno|wissenschafts?-?thriller|öko-?thriller|medizin|bio-?thriller"),
    ("FIC031070", r"übernatürlich(er)? thriller|mystery-thriller|supernatural thriller"),
    ("FIC031010", r"serienm|serienkiller|forensi|procedural-thriller|ermittler-?thriller|crime-?thriller"),
    ("FIC022070", r"cosy|cozy|gemütlich|wohlfühl"),
    ("DE-REGIONALKRIMI", r"regional|heimat|küsten|insel|ostsee|nordsee|alpen|eifel|provinz"),
    ("FIC022020", r"polizei|procedural"),
    ("FIC022080", r"skandinav|nordic|scandi|schweden|norweg|island|irland"),
    ("FIC060000", r"schwarzhumor|kriminalkomödie|krimikomödie|humorvoller krimi|(krimi|kriminal)[^|]*\|[^|]*(komödie|satir|humor)"),
    ("FIC028030", r"space opera|weltraum"),
    ("FIC028050", r"military"),
    ("FIC028100", r"cyberpunk"),
    ("FIC028070", r"post-?apokalyp|apokalyp"),
    ("FIC055000", r"dystop"),
    ("FIC027030", r"romantasy|fantasy-?romance|romantische fantasy"),
    ("FIC009060", r"urban fantasy"),
    ("FIC009070", r"dark fantasy|grimdark"),
    ("FIC009020", r"high fantasy|epische fantasy|epic fantasy|heroische|sword|epos"),
    ("FIC015030", r"kreatur|monster"),
    ("FIC015040", r"übernatürlich|supernatural|paranormal|dämon|geister|okkult|folk horror|spuk"),
    ("FIC027020", r"contemporary romance|liebeskomödie|romantische komödie|liebesroman|romance"),
    ("BIO000000", r"biograf|autobiograf|memoir|erinnerung|zeitzeug"),
    ("FIC028000", r"science|sci-?fi"),
    ("FIC009000", r"fantasy"),
    ("FIC015000", r"horror"),
    ("FIC022000", r"historischer krimi"),
    ("FIC014000", r"historisch"),
    ("FIC002000", r"abenteuer"),
    ("FIC016000", r"humor|komödie|satir"),
    ("FIC019000", r"gegenwart|gesellschaft|familienroman|familiensaga|literarisch|literary"),
    ("FIC031000", r"thriller|suspense"),
    ("FIC022000", r"krimi|crime|mystery|detektiv|kriminalroman"),
)


def genre_code(genre: Column, subgenre: Column) -> Column:
    text = F.lower(F.concat_ws(" | ", F.coalesce(genre, F.lit("")), F.coalesce(subgenre, F.lit(""))))
    out = F.lit(None).cast("string")
    for code, pattern in reversed(RULES):
        out = F.when(text.rlike(pattern), code).otherwise(out)
    return out


def category_name(category: Column) -> Column:
    """The last part of a path, with spaces and capitals."""
    last = F.element_at(F.split(category, "/"), -1)
    return F.nullif(F.initcap(F.replace(F.trim(last), F.lit("-"), F.lit(" "))), F.lit(""))


def why_shown(is_library: Column) -> Column:
    """Why a find stands where it stands, in a sentence."""
    author, name, free = F.trim(F.coalesce("author", F.lit(""))), category_name(F.col("category")), F.coalesce(F.col("availability") == "available", F.lit(False))
    listed = is_library & (F.coalesce("category", F.lit("")) != "") & ~F.col("category").contains("/")
    return (
        F.when(F.col("match_reason") == "watchlist", "steht auf deiner Watchlist")
        .when((F.col("match_reason") == "profile_author") & (author == ""), "neu von einer Autor:in, der du folgst")
        .when(F.col("match_reason") == "profile_author", F.concat(F.lit("neu von "), author, F.lit(", der du folgst")))
        .when(listed & free, F.concat(F.lit("sofort ausleihbar aus „"), name, F.lit("“")))
        .when(listed, F.concat(F.lit("aus „"), name, F.lit("“")))
        .when(name.isNotNull(), F.concat(F.lit("neu im Thema "), name, F.when(is_library & free, ", sofort ausleihbar").otherwise("")))
        .otherwise("neu in einem Thema, dem du folgst")
    )
