"""Broadcasts of sides whose size is measured first."""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import salted_join

#: A side of up to so many rows and characters is broadcast.
ROWS, CHARS = 500_000, 16_000_000


#: Measured sides; a batch of queries is measured once however often it is joined.
_measured: weakref.WeakKeyDictionary[DataFrame, bool] = weakref.WeakKeyDictionary()


def is_small(df: DataFrame) -> bool:
    """Whether ``df`` has at most ROWS rows and CHARS characters; the measuring stops after ROWS rows, and is done once per DataFrame."""
    if df not in _measured:
        texts = [F.length(c) for c, kind in df.dtypes if kind == "string"]
        chars = sum(texts[1:], texts[0]) if texts else F.lit(0)
        size = df.limit(ROWS + 1).agg(F.count("*").alias("rows"), F.sum(chars).alias("chars")).first()
        _measured[df] = size["rows"] <= ROWS and (size["chars"] or 0) <= CHARS
    return _measured[df]


def small(df: DataFrame, derived: DataFrame | None = None) -> DataFrame:
    """``df`` marked for broadcast if it is small, unchanged if it isn't.

    With ``derived``, that table (with at most a row per row of ``df``) is
    marked instead.  Only sides that come from a small table (query batches,
    probes) should be given.
    """
    side = df if derived is None else derived
    return F.broadcast(side) if is_small(df) else side


def met_with(big: DataFrame, batch: DataFrame, side: DataFrame, key: str, row: str, counts: DataFrame, weight: str, how: str = "inner") -> DataFrame:
    """``big`` joined with ``side``, which has at most a row per row of ``batch``.

    A small batch is broadcast and ``big`` isn't shuffled.  A large one goes
    through a shuffle in which the heavy keys of ``big`` are spread; ``counts``
    has its rows per key as ``weight``.
    """
    if is_small(batch):
        return big.join(F.broadcast(side), key, how)
    return salted_join(big, side, key, row, counts, weight, how)
