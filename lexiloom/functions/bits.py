"""256-bit signatures held as four BIGINTs, highest bits first."""

from __future__ import annotations

import itertools
import math
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 256
WORDS = ("s0", "s1", "s2", "s3")


def hamming(a: list[Column], b: list[Column]) -> Column:
    """Number of differing bits of two signatures."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)), F.lit(0))


def similarity(a: list[Column], b: list[Column]) -> Column:
    """Share of equal bits; an identical pair has 1."""
    return 1 - hamming(a, b) / F.lit(float(BITS))


def bit_length(a: list[Column]) -> Column:
    """Bits of a signature without its leading zeros."""
    found = F.lit(0)
    for k, word in enumerate(reversed(a)):
        width = F.when(word == 0, 0).otherwise(F.length(F.bin(word)))
        found = F.when(word != 0, F.lit(64 * k) + width).otherwise(found)
    return found


def similarity_compat(a: list[Column], b: list[Column]) -> Column:
    """Equal bits up to the longer of both signatures without leading zeros, over BITS."""
    return (F.greatest(bit_length(a), bit_length(b)) - hamming(a, b)) / F.lit(float(BITS))


def block_count(threshold) -> int:
    """Most differing bits that a similarity of ``threshold`` allows: m blocks can all differ."""
    return math.floor((1 - Fraction(str(threshold))) * BITS)


def block_widths(n: int) -> list[int]:
    """Widths of n blocks that cover all bits; the first ones are one bit wider."""
    base, wider = divmod(BITS, n)
    return [base + (k < wider) for k in range(n)]


def block_column(a: list[Column], start: int, width: int) -> Column:
    """Bits [start, start + width) counted from the highest bit, as a BIGINT (width at most 63)."""
    word, at = divmod(start, 64)
    if at + width <= 64:
        return F.shiftrightunsigned(a[word], 64 - at - width).bitwiseAND(F.lit((1 << width) - 1))
    high, low = 64 - at, at + width - 64
    left = F.shiftleft(a[word].bitwiseAND(F.lit((1 << high) - 1)), low)
    return left.bitwiseOR(F.shiftrightunsigned(a[word + 1], 64 - low).bitwiseAND(F.lit((1 << low) - 1)))


def block_choices(threshold, b: int = 1) -> tuple[list[int], list[tuple[int, ...]]]:
    """Block widths and the choices of b blocks of which one must match exactly.

    Two signatures that differ in at most m bits leave b of m + b blocks equal.
    """
    widths = block_widths(block_count(threshold) + b)
    return widths, list(itertools.combinations(range(len(widths)), b))


def blocks_for(n: int, threshold) -> int:
    """The least b for which the narrowest key of b blocks has at least log2(n) bits."""
    b = 1
    while b * (BITS // (block_count(threshold) + b)) < math.log2(max(2, n)):
        b += 1
    return b


def permutation(widths: list[int], choice: tuple[int, ...]) -> list[int]:
    """Block order that brings the chosen blocks to the front."""
    return [*choice, *[k for k in range(len(widths)) if k not in choice]]


def permute_bits(bits: str, widths: list[int], order: list[int]) -> str:
    """A bit string with its blocks in another order (for checks on single signatures)."""
    ends = list(itertools.accumulate(widths))
    return "".join(bits[ends[k] - widths[k] : ends[k]] for k in order)


def signature_hex(a: list[Column]) -> Column:
    """64 hexadecimal digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in a]))
