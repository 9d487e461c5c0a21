"""Pre-tokenisation of whole Arrow text columns with numpy, and a bounded table of known pieces.

Two patterns are understood: "spaced", public_tokenizers.PATTERN, whose pieces take the space before
them; and "bare", letters, single numbers or other signs without white space. In both an apostrophe
that begins a piece takes a following s, t, re, ve, m, ll or d.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

from ledgerlark.llm.text_arrays import span_hashes

OTHER, LETTER, NUMBER, SPACE = range(4)
#: What may follow an apostrophe as one piece.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def char_kinds() -> np.ndarray:
    """The kind of every code point."""
    kinds = np.zeros(0x110000, np.uint8)
    chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, chars):
            run = np.frombuffer(m[0].encode("utf-32-le"), np.uint32)
            kinds[run] = kind
    return kinds


def piece_spans(data: np.ndarray, offsets: np.ndarray, style: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and row of every piece of a chunk of UTF-8 rows."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    place = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(chars)
    kind = char_kinds()[chars]
    opens = np.zeros(n + 1, bool)  # the first character of a row
    opens[np.searchsorted(place, offsets)] = True
    change = opens.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    last = change[1:]  # the last character of a run
    start = change[:n].copy()
    space = kind == SPACE
    if style == "spaced":
        # of white space before other text in a row, the last character stands alone or goes with the text
        before_text = last & space & ~opens[1:]
        start |= before_text
        taken = np.zeros(n, bool)
        taken[1:] = before_text[:-1] & (chars[:-1] == 0x20)
        start &= ~taken
    else:
        start |= kind == NUMBER
    for at in np.flatnonzero((chars == 0x27) & start & last):
        tail = chars[at + 1 : at + 3]
        for suffix in SUFFIXES:
            end = at + 1 + len(suffix)
            if end <= n and not opens[at + 1 : end].any() and tail[: len(suffix)].tobytes() == suffix.encode("utf-32-le"):
                start[at + 1] = False
                if end < n and kind[end] == LETTER and not opens[end]:
                    start[end] = True
                break
    first = np.flatnonzero(start)
    ends = np.append(place[first[1:]], len(data))
    if style == "bare":
        ends = ends[~space[first]]
        first = first[~space[first]]
    starts = place[first]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


Encode = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


class PieceTable:
    """Token lists of pieces by two 64-bit hashes, kept between batches of a worker up to ``most`` pieces."""

    def __init__(self, encode: Encode, most: int = 1_500_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks, self.counts, self.at, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _encoded(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of pieces, and where their tokens begin in ``flat``, to which they are added."""
        counts, flat = self.encode([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
        at = len(self.flat) + np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
        return counts, at

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every piece its number of tokens and where they begin in ``flat``; unknown ones are encoded."""
        keys, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        checks = span_hashes(data, starts, ends, seed=1)
        if len(self.keys) + len(keys) > self.most:
            self.clear()
        where = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = where < len(self.keys)
        known[inside] = self.keys[where[inside]] == keys[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            counts, at = self._encoded(data.tobytes(), starts[first[new]], ends[first[new]])
            self.keys = np.insert(self.keys, where[new], keys[new])
            self.checks = np.insert(self.checks, where[new], checks[first[new]])
            self.counts = np.insert(self.counts, where[new], counts)
            self.at = np.insert(self.at, where[new], at)
            where = np.searchsorted(self.keys, keys)
        counts, at = self.counts[where[which]], self.at[where[which]]
        other = np.flatnonzero(self.checks[where[which]] != checks)
        if len(other):  # pieces that share one hash with another piece
            counts[other], at[other] = self._encoded(data.tobytes(), starts[other], ends[other])
        return counts, at

    def gather(self, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The tokens of pieces, one after the other."""
        ends = np.cumsum(counts)
        return self.flat[np.repeat(at - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
