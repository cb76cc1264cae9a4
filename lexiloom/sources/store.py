"""The index as Parquet tables, laid out for look-ups by term and by review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import Index

#: Bytes of a file of a stored table, as estimated before it is written, and most files of a table.
FILE_BYTES, MOST_FILES = 512 * 2**20, 100_000
TABLES = ("reviews", "postings", "lexicon", "corpus")


def table_files(df: DataFrame) -> int:
    """Files to write a table to: one per FILE_BYTES of the optimizer's estimate, at least the session's shuffle partitions."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST_FILES, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-estimate // FILE_BYTES)))


def write_index(index: Index, path: str, files: int | None = None) -> Index:
    """Write the four tables, replacing what is there, and read them back.

    Postings and lexicon are ranged and sorted by term, reviews by id, so that
    a look-up prunes files and row groups by their statistics.  Ranges of
    postings include the review id: a frequent term spreads over several files.
    The lexicon comes from the written postings, not from the texts again.
    """
    spark = index.postings.sparkSession
    n = files or table_files(index.postings)
    index.reviews.repartitionByRange(n, "review_id").sortWithinPartitions("review_id").write.mode("overwrite").parquet(f"{path}/reviews")
    index.postings.repartitionByRange(n, "term", "review_id").sortWithinPartitions("term", "review_id").write.mode("overwrite").parquet(f"{path}/postings")
    written = spark.read.parquet(f"{path}/postings")
    lexicon = written.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    lexicon.repartitionByRange(n, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/lexicon")
    table = spark.read.parquet(f"{path}/reviews")
    table.agg(F.count("*").alias("n_reviews"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_tokens")).write.mode("overwrite").parquet(f"{path}/corpus")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> Index:
    """Open a written index."""
    return Index(*[spark.read.parquet(f"{path}/{t}") for t in TABLES])


def drop_index(spark: SparkSession, path: str) -> bool:
    """Delete a written index; False if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))


def save_table(df: DataFrame, path: str) -> DataFrame:
    """Save any table (sketches, signatures, query sets) and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(name, files, bytes) of each table under ``path``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for entry in files.listStatus(root):
        summary = files.getContentSummary(entry.getPath())
        rows.append((entry.getPath().getName(), summary.getFileCount(), summary.getLength()))
    return spark.createDataFrame(sorted(rows), "name string, files bigint, bytes bigint")


def save_sketches(sketches: DataFrame, salts: list[str], family: str, path: str) -> tuple[DataFrame, list[str], str]:
    """Write sketches with the salts and the hash family that made them, and open them again."""
    save_table(sketches.sparkSession.createDataFrame([(i, word, family) for i, word in enumerate(salts)], "k int, salt string, family string"), f"{path}/salts")
    save_table(sketches, f"{path}/sketches")
    return open_sketches(sketches.sparkSession, path)


def open_sketches(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], str]:
    """(sketches, salts, family) of saved sketches, so that queries are sketched as the records were."""
    salts = spark.read.parquet(f"{path}/salts").orderBy("k").collect()  # a row per hash of a sketch
    return spark.read.parquet(f"{path}/sketches"), [r["salt"] for r in salts], salts[0]["family"]
