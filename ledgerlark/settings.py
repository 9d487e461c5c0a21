"""Settings of a profile and weights of the scorer, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest dimension that a plan may send to every executor, in rows; beyond it joins shuffle.
BROADCAST_ROWS = 500_000
#: Rows that one task groups or joins at a time where partitions follow the table's size.
ROWS_A_TASK = 250_000


@dataclass(frozen=True)
class Settings:
    languages: tuple[str, ...] = ("ger",)
    strong_deal_max_cents: int = 500
    deal_max_cents: int = 1000
    min_discount_pct: int = 25
    fresh_days: int = 3
    retry_days: int = 7
    sweep_days: int = 7
    cadence_hours: int = 24
    gate_budget: int = 40

    def __post_init__(self) -> None:
        if self.strong_deal_max_cents >= self.deal_max_cents:
            raise ValueError("strong_deal_max_cents must be below deal_max_cents")
        if not 0 <= self.min_discount_pct <= 99:
            raise ValueError("min_discount_pct must be in 0..99")
        if bad := [c for c in self.languages if not (len(c) == 3 and c.isalpha() and c.islower())]:
            raise ValueError(f"not ISO 639-2 codes: {bad}")


@dataclass(frozen=True)
class Weights:
    """Fixed values of the scorer."""

    defining: float = 1.0
    clear: float = 0.7
    marginal: float = 0.4
    unweighted: float = 0.7
    rejection_ratio: float = 0.33
    rejection_mean: bool = True
    reader_reason: float = 1.0
    prior_books: float = 2.0
    prior_liked: float = 0.4
    prior_boosted: float = 0.6
    prior_against: float = 0.4
    term_to_family: float = 1.0
    full_quantile: float = 0.75
    smoothing: float = 4.0
    baseline: float = 0.2
    pattern_smoothing: float = 1.0
    pattern_for: float = 0.35
    pattern_against: float = 0.5
    facet_bonus: float = 0.25
    genre_bonus: float = 0.15
    genre_counterweight: float = 0.5
    gate_stars: int = 3
    borderline: float = 0.07
    bands: tuple[tuple[float, int], ...] = ((0.7, 5), (0.55, 4), (0.4, 3), (0.2, 2))

    def stars(self, share: Column) -> Column:
        out = F.lit(1)
        for least, stars in reversed(self.bands):
            out = F.when(share >= least - 1e-9, stars).otherwise(out)
        return out

    def is_borderline(self, share: Column) -> Column:
        gate = next(least for least, stars in self.bands if stars == self.gate_stars)
        return F.abs(share - gate) < self.borderline

    def trait_weight(self, word: Column) -> Column:
        return F.when(word == "defining", self.defining).when(word == "clear", self.clear).when(word == "marginal", self.marginal).otherwise(self.unweighted)
