"""Arrow functions for what built-ins can't say: exact folding and similarity of token lists."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from ledgerlark.functions.text import LETTER_FOLDS


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel columns."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & places.get(c, 0)
        s = (s + u | s - u) & full
    return (full & ~s).bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 for equal strings, 0 for ones without a common character: 200 * LCS / (len(a) + len(b))."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


@lru_cache(65536)
def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


@lru_cache(65536)
def token_set_ratio(a: str, b: str) -> float:
    """Shared tokens against shared tokens with the rest of either side; 100 if one side has no rest, 0 for an empty side."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    whole_left, whole_right = f"{both} {left}".strip(), f"{both} {right}".strip()
    best = indel_ratio(whole_left, whole_right)
    return max(best, indel_ratio(both, whole_left), indel_ratio(both, whole_right)) if both else best


@F.pandas_udf(IntegerType())
def title_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """The lower of set and sort ratio of two normalised titles, rounded half to even."""
    return pd.Series([None if a is None or b is None else round(min(token_set_ratio(a, b), token_sort_ratio(a, b))) for a, b in zip(left, right)], dtype="Int32")


@F.pandas_udf(DoubleType())
def name_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """The lower of set and sort ratio of two names, not rounded."""
    return pd.Series([min(token_set_ratio(a, b), token_sort_ratio(a, b)) for a, b in zip(left, right)], dtype="float64")


@F.pandas_udf(StructType([StructField("exact", BooleanType()), StructField("best", IntegerType()), StructField("matches", BooleanType())]))
def author_scores(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Of two lists of (full, substantial): whether a full name is in both, the best set ratio, and whether two people match (90 by both ratios)."""
    rows = []
    for ours, theirs in zip(left, right):
        pairs = [(a, b) for a in (ours if ours is not None else []) for b in (theirs if theirs is not None else [])]
        exact = any(a["full"] == b["full"] for a, b in pairs)
        best = max((max(token_set_ratio(a["full"], b["full"]), token_set_ratio(a["substantial"], b["substantial"])) for a, b in pairs), default=0.0)
        match = exact or any(min(token_set_ratio(a["full"], b["full"]), token_sort_ratio(a["full"], b["full"])) >= 90 for a, b in pairs)
        rows.append((exact, round(best), match))
    return pd.DataFrame(rows, columns=["exact", "best", "matches"])


@F.pandas_udf(StringType())
def exact_fold(text: pd.Series) -> pd.Series:
    """Fold by Unicode's compatibility decomposition, for alphabets that the built-in fold doesn't cover."""

    def one(s: str) -> str:
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not 0x300 <= ord(c) <= 0x36F)
        return s.translate(str.maketrans(LETTER_FOLDS)).casefold()

    return text.map(one, na_action="ignore")
