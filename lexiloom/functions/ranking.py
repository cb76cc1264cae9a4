"""Weights and scores of ranked search, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a review's helpfulness counts only above this share.
HELPFUL_SHARE = 0.33


def log_tf(tf: Column) -> Column:
    """1 + log10(tf), and 0 for a missing or zero frequency."""
    return F.when(tf > 0, 1 + F.log10(tf)).otherwise(F.lit(0.0))


def idf(n: Column, df: Column, exact: bool = False) -> Column:
    """log10 of N over df; whole-number division unless ``exact``."""
    if exact:
        return F.log10(n.cast("double") / df)
    return F.log10(F.floor(n / df).cast("double"))


def quality(score: Column, num: Column, den: Column) -> Column:
    """A review's score, raised (or for low scores lowered less) by its helpfulness.

    With r = num / den above HELPFUL_SHARE: score * (1 + r) for scores from 3,
    score * (2 - r) below; else the score itself.  A zero denominator has no r.
    """
    r = F.try_divide(num.cast("double"), den.cast("double"))
    raised = score * (1 + F.when(score >= 3, r).otherwise(1 - r))
    return F.when(r > HELPFUL_SHARE, raised).otherwise(score).cast("double")


def rank_weight(rank: Column, size: Column) -> Column:
    """1 for the first of a list, falling evenly to 1/size for the last."""
    return 1 - (rank - 1) / size
