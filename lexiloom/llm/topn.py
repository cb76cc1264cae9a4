"""Top N rows of every group, by secondary sort and a streaming pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _first_rows(group: str, n: int):
    """Arrow kernel over rows sorted by group: the first n rows of each run, and their places.

    Between batches it keeps the last group's key and its number of rows.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(group)
            changed = pc.fill_null(pc.not_equal(keys.slice(1), keys.slice(0, batch.num_rows - 1)), True).to_numpy(zero_copy_only=False)
            starts = np.r_[True, changed]
            if last is not None and keys[0].as_py() == last:
                starts[0] = False
            else:
                seen = 0
            row = np.arange(batch.num_rows)
            begin = np.maximum.accumulate(np.where(starts, row, -seen))
            place = row - begin + 1
            last, seen = keys[-1].as_py(), int(place[-1])
            keep = pa.array(place <= n)
            out = batch.filter(keep)
            yield pa.record_batch([*out.columns, pa.array(place[place <= n].astype(np.int32))], names=[*out.schema.names, "place"])

    return kernel


def top_n(rows: DataFrame, group: str, order: list[tuple[str, bool]], n: int) -> DataFrame:
    """The first ``n`` rows of each group with their ``place`` (1 to n).

    ``order`` lists (column, descending); to fix the order it ends in a column
    that is distinct within a group, otherwise rows equal in all of them come
    in any order among themselves.  Nulls come last.  Rows with a null group are
    left out.  A column named ``place`` in the input is replaced.

    First each task sorts the rows it has and passes on n per group, so the
    shuffle by group carries at most n rows per task and group however many
    rows a group has; then the same sort and pass decide.  Groups are never held
    in memory, a task sees one Arrow batch at a time.
    """
    if n < 1:
        raise ValueError("n is at least 1")
    rows = rows.drop("place").where(F.col(group).isNotNull())
    by = [F.col(group), *[F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", place int"
    local = rows.sortWithinPartitions(*by).mapInArrow(_first_rows(group, n), schema).drop("place")
    return local.repartition(group).sortWithinPartitions(*by).mapInArrow(_first_rows(group, n), schema)


def latest_rows(rows: DataFrame, key: str, version: str, columns: list[str]) -> DataFrame:
    """Of the rows of each key the one with the largest version (null first), then the largest other values."""
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(version, *columns)).alias("row"))
    return best.select(key, *[F.col(f"row.{c}").alias(c) for c in columns])
