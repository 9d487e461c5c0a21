"""Byte strings by number, all in one array: the bytes of a list of numbers are one numpy gather."""

from __future__ import annotations

import numpy as np


class OffsetTable:
    """``entries[k]`` lies at starts[k] in ``data`` and is sizes[k] long."""

    def __init__(self, entries: list[bytes]):
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        self.sizes = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of ``numbers`` one after the other, and where each begins, with the end of the last."""
        sizes = self.sizes[numbers]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return self.data[np.repeat(self.starts[numbers] - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds


def decimals(n: int) -> OffsetTable:
    """The numbers below n in decimal, each with one more byte, a comma, behind it."""
    return OffsetTable([b"%d," % k for k in range(n)])
