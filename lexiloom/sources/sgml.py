"""News files in SGML: word lists of the bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .reviews import dense_ids

#: What a body is, and what a tag is.
BODY = r"(?is)<body>(.*?)</body>"
TAG = r"(?s)<[^>]*>"


def bodies(text: Column) -> Column:
    """The contents of all body elements of a text, in order."""
    return F.regexp_extract_all(text, F.lit(BODY), F.lit(1))


def body_words(body: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, without tags."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(body, TAG, " ")), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def read_sgml(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, words) of every body in the files, ids dense from 0 in the order of files and bodies."""
    files = spark.read.text(path, wholetext=True)
    rows = files.select(F.explode(bodies(F.col("value"))).alias("body")).withColumn("_at", F.monotonically_increasing_id())
    return dense_ids(rows, "_at", "n").select((F.col("n") - 1).alias("doc_id"), body_words(F.col("body")).alias("words"))


def bodies_in_texts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, part, words) of the body elements inside texts; ``part`` counts from 1 per text."""
    found = rows.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(bodies(F.col(text_col))).alias("part", "body"))
    return found.select(id_col, (F.col("part") + 1).alias("part"), body_words(F.col("body")).alias("words"))
