"""Review files: blocks of ``key: value`` lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

#: The key that begins a block, and the keys that are read.
BLOCK_KEY = "product/productId: "
KEYS = ("review/helpfulness", "review/score", "review/text")


def parse_blocks(blocks: Column) -> dict[str, Column]:
    """Fields of a block without its first key.

    The text runs to the end of the block, its lines joined by blanks.  A field
    that is missing, or of another form, is null; a missing text is empty.
    """
    value = lambda key: F.nullif(F.trim(F.regexp_extract(blocks, rf"(?m)^{key}: (.*)$", 1), F.lit(" \t\r")), F.lit(""))
    num, den = tx.helpfulness(value("review/helpfulness"))
    body = F.regexp_extract(blocks, r"(?ms)^review/text: (.*)\z", 1)
    return {
        "product_id": F.nullif(F.trim(F.regexp_extract(blocks, r"\A([^\n]*)", 1), F.lit(" \t\r")), F.lit("")),
        "helpfulness_num": num,
        "helpfulness_den": den,
        "score": tx.score(value("review/score")),
        "text": F.trim(F.regexp_replace(body, r"\s*\n\s*", " ")),
    }


def read_reviews(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(review_id, product_id, helpfulness_num, helpfulness_den, score, text), ids from 1 in the order of the file.

    Files are split at the first key of a block, so a large file is read in
    parallel; ids come from the order of files, partitions and rows, which one
    pass over the block counts makes dense.  ``limit`` keeps ids up to it.
    """
    raw = spark.read.text(path, lineSep=BLOCK_KEY).where(F.trim("value", F.lit(" \t\r\n")) != "")
    rows = raw.select(*[c.alias(n) for n, c in parse_blocks(F.col("value")).items()], F.monotonically_increasing_id().alias("_at"))
    rows = dense_ids(rows, "_at", "review_id")
    rows = rows.select("review_id", "product_id", "helpfulness_num", "helpfulness_den", "score", "text")
    return rows.where(F.col("review_id") <= limit) if limit is not None else rows


def dense_ids(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Numbers from 1 in the order of ``order``, a monotonically_increasing_id: partition number times 2^33 plus place."""
    part = F.shiftright(order, 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per input partition
    counts = counts.select("_part", before.alias("_before"))
    place = F.pmod(F.col(order), F.lit(2**33))
    with_place = rows.withColumn("_part", part).withColumn("_place", place)
    ranks = with_place.join(F.broadcast(counts), "_part")  # a row per input partition
    return ranks.withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before", order)


def blocks_in_texts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, block, fields) for raw record blocks inside texts; ``block`` counts from 1 per text."""
    parts = F.split(F.col(text_col), BLOCK_KEY)
    found = rows.where(F.col(text_col).contains(BLOCK_KEY)).select(id_col, F.posexplode(parts).alias("block", "value")).where("block > 0")
    return found.select(id_col, "block", *[c.alias(n) for n, c in parse_blocks(F.col("value")).items()])


def write_reviews(reviews: DataFrame, path: str) -> None:
    """Write reviews as ``key: value`` blocks (the inverse of ``read_reviews`` up to white space)."""
    line = lambda key, value: F.concat(F.lit(f"{key}: "), F.coalesce(value, F.lit("")))
    helpful = F.concat_ws("/", F.col("helpfulness_num").cast("string"), F.col("helpfulness_den").cast("string"))
    block = F.concat_ws("\n", F.concat(F.lit(BLOCK_KEY), F.coalesce("product_id", F.lit(""))), line(KEYS[0], helpful), line(KEYS[1], F.concat(F.col("score").cast("string"), F.lit(".0"))), line(KEYS[2], F.col("text")), F.lit(""))
    reviews.select(block.alias("value")).write.mode("overwrite").text(path)
