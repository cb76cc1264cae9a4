"""Column functions on texts, tokens and word lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token longer than CROP_OVER characters is cut to CROP_TO.
CROP_OVER, CROP_TO = 127, 126


def tokens(text: Column) -> Column:
    """Runs of ASCII word characters, lower-cased after the split; empty for a null text."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\W]")
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.lower(x))


def token_count(text: Column) -> Column:
    """Length of a text in tokens."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\w+")), F.lit(0)).cast("bigint")


def crop(token: Column) -> Column:
    """Long tokens cut to a fixed width (distinct long tokens may become equal)."""
    return F.when(F.length(token) > CROP_OVER, F.substring(token, 1, CROP_TO)).otherwise(token)


def helpfulness(value: Column) -> tuple[Column, Column]:
    """Numerator and denominator of ``a/b``; null where the value has another form."""
    number = lambda i: F.nullif(F.regexp_extract(value, r"^\s*(\d+)\s*/\s*(\d+)\s*$", i), F.lit("")).try_cast("int")
    return number(1), number(2)


def score(value: Column) -> Column:
    """The first character of a score such as ``4.0``."""
    return F.substring(F.trim(value), 1, 1).try_cast("int")


def plain_words(words: Column) -> Column:
    """Words of a line without surrounding white space, nulls and empty ones."""
    return F.filter(F.transform(F.filter(words, lambda w: w.isNotNull()), lambda w: F.trim(w, F.lit(" \t\r\n"))), lambda w: w != "")


def shingles(words: Column, width: int = 4) -> Column:
    """Distinct windows of ``width`` words, joined by blanks, in the order first seen.

    ``words`` should be a plain column: it is read once per window.  Lists
    shorter than ``width`` have none.
    """
    starts = F.sequence(F.lit(1), F.size(words) - (width - 1))
    windows = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(width)), " "))
    return F.when(F.size(words) >= width, F.array_distinct(windows)).otherwise(F.array().cast("array<string>"))


def sorted_shingles(words: Column, width: int = 4) -> Column:
    """The same set, in the order of the windows' word lists."""
    starts = F.sequence(F.lit(1), F.size(words) - (width - 1))
    windows = F.array_sort(F.array_distinct(F.transform(starts, lambda i: F.slice(words, i, F.lit(width)))))
    return F.when(F.size(words) >= width, F.transform(windows, lambda w: F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))


def perturb(words: Column, threshold) -> Column:
    """Leading words replaced by ``**`` as long as the multiset Jaccard similarity stays above ``threshold``.

    With r of n words replaced the similarity is (n - r) / (n + r), so r is the
    largest number below n (1 - t) / (1 + t).
    """
    t = F.lit(threshold)
    most = F.ceil(F.round(F.size(words) * (1 - t) / (1 + t), 9)) - 1
    count = F.greatest(F.lit(0), most)
    return F.transform(words, lambda w, i: F.when(i < count, F.lit("**")).otherwise(w))
