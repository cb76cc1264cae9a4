"""Line documents: an id and words on one line, separated by single blanks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_lines(lines: DataFrame) -> DataFrame:
    """(line_no, doc_id, words) from (line_no, value); empty lines are left out."""
    parts = F.split(F.rtrim("value", F.lit("\r\n")), " ")
    return lines.where("value <> ''").select("line_no", F.element_at(parts, 1).alias("doc_id"), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))).alias("words"))


def read_linedocs(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, doc_id, words); line numbers ascend within a file."""
    return parse_lines(spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value"))


def latest_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, words): of several lines of one document the one with the highest line_no (null first)."""
    last = lines.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("line_no", "words")).alias("l"))
    return last.select("doc_id", "l.words")


def write_linedocs(docs: DataFrame, path: str) -> None:
    """Write (doc_id, words) as lines."""
    docs.select(F.concat_ws(" ", F.col("doc_id"), F.col("words")).alias("value")).write.mode("overwrite").text(path)
