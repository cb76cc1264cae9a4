"""Exact thresholds: a similarity is compared as a fraction of whole numbers."""

from __future__ import annotations

from fractions import Fraction


def as_fraction(threshold: float | str | Fraction) -> Fraction:
    """The threshold as it is written: 0.8 means 4/5, not the nearest double."""
    value = threshold if isinstance(threshold, Fraction) else Fraction(str(threshold))
    if not 0 < value <= 1:
        raise ValueError("a similarity threshold lies above 0 and at most at 1")
    return value
