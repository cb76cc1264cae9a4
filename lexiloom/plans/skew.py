"""Joins and keys that stay balanced when one key holds a large share of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most keys that are broadcast as heavy ones; with a cap on the length of a key this bounds the broadcast.
HEAVY_KEYS = 1024
HEAVY_KEY_CHARS = 1024


def heavy_rows(counts: DataFrame, key: str, weight: str, keys: int = HEAVY_KEYS) -> DataFrame:
    """The ``keys`` rows of largest ``weight``: a table of bounded size.

    ``counts`` has one row per key.  Keys longer than HEAVY_KEY_CHARS never
    count as heavy, so the size of the result has a fixed bound.
    """
    fits = F.length(F.col(key).cast("string")) <= HEAVY_KEY_CHARS
    return counts.where(fits).orderBy(F.desc(weight), F.col(key)).limit(keys)


def heavy_light_join(big: DataFrame, small: DataFrame, key: str, weight: str, keys: int = HEAVY_KEYS) -> DataFrame:
    """Inner join of ``big`` with ``small`` (one row per key, ``weight`` = rows of the key in ``big``).

    The heaviest keys are looked up in a broadcast table of bounded size and
    never shuffle the big side; all other keys go through a shuffle join.  No
    key of the shuffle join can hold more than 1/keys of the big side.
    """
    heavy = F.broadcast(heavy_rows(small, key, weight, keys))
    hot = big.join(heavy, key)
    flags = F.broadcast(heavy_rows(small, key, weight, keys).select(key))
    rest = big.join(flags, key, "left_anti").join(small, key)
    return hot.unionByName(rest)


def blocks(count: Column, cap: int) -> Column:
    """Number of blocks into which a key with ``count`` rows is split."""
    return F.greatest(F.lit(1), F.ceil(count / F.lit(cap))).cast("int")


def block_of(row: Column, n_blocks: Column, seed: int = 17) -> Column:
    """The block of a row, by the hash of its id."""
    return F.pmod(F.xxhash64(row, F.lit(seed)), n_blocks.cast("bigint")).cast("int")


def salted_join(big: DataFrame, other: DataFrame, key: str, row: str, counts: DataFrame, weight: str, how: str = "inner", cap: int = 1_000_000, keys: int = HEAVY_KEYS) -> DataFrame:
    """Join of two sides that are both too large to broadcast, with the rows of heavy keys spread.

    ``counts`` has the rows of ``big`` per key as ``weight``.  A heavy key is
    split into blocks of about ``cap`` rows of ``big`` by the hash of ``row``,
    and the rows of ``other`` go to each of its blocks.  ``how`` is inner or a
    left join kind that looks from ``big``.  Only the names and block numbers of
    at most ``keys`` heavy keys are broadcast.
    """
    heavy = heavy_rows(counts.where(F.col(weight) > cap), key, weight, keys).select(key, blocks(F.col(weight), cap).alias("_n"))
    heavy = F.broadcast(heavy)
    left = big.join(heavy, key, "left").withColumn("_s", F.coalesce(block_of(F.col(row), F.col("_n")), F.lit(0))).drop("_n")
    right = other.join(heavy, key, "left").withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
    return left.join(right, [key, "_s"], how).drop("_s")
