"""Group-varint bytes of posting lists, for exchange with byte-oriented stores.

Four numbers form a group: a tag byte with two bits per number (its length in
bytes less one, first number in the highest bits), then their bytes, low byte
first.  A last group of fewer numbers has a tag all the same; the count comes
from the caller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Shifts of the four two-bit lengths in a tag, and the bytes of a whole group by its tag.
SHIFTS = np.array([6, 4, 2, 0])
GROUP_BYTES = 5 + ((np.arange(256)[:, None] >> SHIFTS) & 3).sum(axis=1)


def encode(numbers: list[int] | np.ndarray) -> bytes:
    """Bytes of unsigned 32-bit numbers."""
    x = np.asarray(numbers, dtype=np.int64)
    if not len(x):
        return b""
    if x.min() < 0 or x.max() >= 2**32:
        raise ValueError("numbers lie in 0 to 2^32 - 1")
    extra = (x > 0xFF).astype(np.int64) + (x > 0xFFFF) + (x > 0xFFFFFF)  # bytes beyond the first
    groups = -(-len(x) // 4)
    tags = (np.pad(extra, (0, 4 * groups - len(x))).reshape(groups, 4) << SHIFTS).sum(axis=1)
    ends = np.cumsum(extra + 1)
    at = ends - (extra + 1) + np.arange(len(x)) // 4 + 1  # before a number stand the tags up to its own
    out = np.empty(ends[-1] + groups, np.uint8)
    out[at[::4] - 1] = tags
    for k in range(4):
        long = extra >= k
        out[at[long] + k] = (x[long] >> (8 * k)) & 0xFF
    return out.tobytes()


def decode(data: bytes, count: int) -> np.ndarray:
    """The ``count`` numbers of ``encode``'s bytes."""
    raw = np.frombuffer(data, np.uint8)
    groups = -(-count // 4)
    # A group says where the next one begins: all steps are looked up at once, then followed.
    starts, at, step = np.empty(groups, np.int64), 0, GROUP_BYTES[raw].tolist()
    for g in range(groups):
        starts[g] = at
        at += step[at]
    extra = ((raw[starts].astype(np.int64)[:, None] >> SHIFTS) & 3).reshape(-1)[:count]
    of = np.arange(count) // 4
    before = np.cumsum(extra + 1) - (extra + 1)
    place = starts[of] + 1 + before - before[4 * of] if count else before
    found = np.zeros(count, np.int64)
    for k in range(4):
        long = extra >= k
        found[long] |= raw[place[long] + k].astype(np.int64) << (8 * k)
    return found


def encode_column(numbers: Column) -> Column:
    """BINARY of an array of numbers; null for null."""

    @F.pandas_udf("binary")
    def kernel(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if x is None else encode(x))

    return kernel(numbers)


def decode_column(data: Column, count: Column) -> Column:
    """Array of numbers from BINARY and their count."""

    @F.pandas_udf("array<bigint>")
    def kernel(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bytes_, counts in batches:
            yield pd.Series([None if b is None else decode(b, int(n)) for b, n in zip(bytes_, counts)])

    return kernel(data, count)
