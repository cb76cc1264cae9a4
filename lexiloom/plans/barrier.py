"""A column that is computed once however often it is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that filters and projections above it don't compute again.

    The optimizer moves a filter on a computed column below its projection and
    so evaluates the expression once more; it can't move it below a generator.
    A generator of one row each costs little beside a long array expression.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))
