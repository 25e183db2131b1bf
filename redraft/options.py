"""Defaults of the engine: fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """Limits and thresholds; the defaults are those of the format."""

    ngram: int = 3
    candidates: int = 32
    anchor_tokens: int = 16
    label_tokens: tuple[int, int] = (2, 32)
    mask_share: float = 0.3
    match_score: float = 0.55
    gap: float = -0.35
    group_penalty: float = -0.05
    margin: float = 0.08
    low_score: float = 0.85
    distance: int = 4096
    bands: int = 16
    band_rows: int = 4

    def __post_init__(self) -> None:
        if self.ngram < 1 or self.candidates < 1 or self.bands < 1 or self.band_rows < 1:
            raise ValueError("sizes must be at least 1")
        if not 0 <= self.mask_share <= 1 or not 0 <= self.match_score <= 1:
            raise ValueError("shares and scores lie between 0 and 1")


DEFAULT = Options()
