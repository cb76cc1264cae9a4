"""How well sketches and searches do: samples, errors, recall, correlation."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sample_records(records: DataFrame, id_col: str, n: int, seed: str = "1") -> DataFrame:
    """n records without replacement, the same for the same seed: the first by a hash of seed and id."""
    key = F.md5(F.concat_ws("-", F.lit(seed), F.col(id_col).cast("string")))
    return records.where(F.col(id_col).isNotNull()).orderBy(key, id_col).limit(n)


def over_threshold(queries: DataFrame, records: DataFrame, id_col: str, value_col: str, metric: Callable[[Column, Column], Column], threshold: float) -> DataFrame:
    """(a, b, similarity) of every query against every record, by any metric of two columns.

    The direct comparison that other searches are judged by.  The query set is
    small against the records; pairs without a similarity are left out.
    """
    left = queries.select(F.col(id_col).alias("a"), F.col(value_col).alias("x"))
    right = records.select(F.col(id_col).alias("b"), F.col(value_col).alias("y"))
    similarity = metric(F.col("x"), F.col("y"))
    return left.join(right, similarity >= threshold).select("a", "b", similarity.alias("similarity"))


def mean_absolute_error(pairs: DataFrame, truth: str, estimate: str, by: list[str] | None = None) -> DataFrame:
    """(by, trials, mean_error) of two similarity columns; pairs with a null in either are left out."""
    rows = pairs.where(F.col(truth).isNotNull() & F.col(estimate).isNotNull())
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("trials"), F.round(F.avg(F.abs(F.col(truth) - F.col(estimate))), 6).alias("mean_error"))


def recall_precision(found: DataFrame, truth: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(by, true_positives, false_positives, false_negatives, recall, precision) of pair sets, unrounded ratios.

    A group without true pairs has null recall, one without found pairs null precision.
    """
    a = found.select(*keys).distinct().withColumn("f", F.lit(1))
    b = truth.select(*keys).distinct().withColumn("t", F.lit(1))
    both = a.join(b, keys, "full")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    f, t = F.col("f").isNotNull(), F.col("t").isNotNull()
    out = both.groupBy(by).agg(one(f & t).alias("true_positives"), one(f & ~t).alias("false_positives"), one(~f & t).alias("false_negatives"))
    ratio = lambda x, y: F.try_divide(F.col(x).cast("double"), (F.col(x) + F.col(y)).cast("double"))
    return out.withColumn("recall", ratio("true_positives", "false_negatives")).withColumn("precision", ratio("true_positives", "false_positives"))


def accuracy(hits: DataFrame, hit: Column, by: list[str] | None = None) -> DataFrame:
    """(by, trials, percent): share of rows with a hit, in percent with 2 decimals."""
    return hits.groupBy(*(by or [])).agg(F.count("*").alias("trials"), F.round(100 * F.avg(F.when(hit, 1.0).otherwise(0.0)), 2).alias("percent"))


def pearson(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(n, r): Pearson's correlation of two columns, over rows where both are known."""
    there = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return there.agg(F.count("*").alias("n"), F.round(F.corr(F.col(x).cast("double"), F.col(y).cast("double")), 6).alias("r"))


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, chars) of tables; chars is the length of all their strings."""

    def size(name: str, df: DataFrame) -> DataFrame:
        texts = [F.coalesce(F.sum(F.length(c).cast("bigint")), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
        return df.agg(F.count("*").alias("rows"), reduce(lambda a, b: a + b, texts, F.lit(0).cast("bigint")).alias("chars")).select(F.lit(name).alias("name"), "rows", "chars")

    return reduce(DataFrame.unionByName, [size(name, df) for name, df in tables.items()])


def query_times(spark: SparkSession, queries: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """(name, rows, seconds) of queries run one after another, rows being counted as they come out."""
    found = []
    for name, run in queries.items():
        began = time.perf_counter()
        rows = run().count()
        found.append((name, rows, time.perf_counter() - began))
    return spark.createDataFrame(found, "name string, rows bigint, seconds double")


def total_time(times: DataFrame) -> DataFrame:
    """(queries, seconds): how many queries there were, and their time together."""
    return times.agg(F.count("*").alias("queries"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"))
