"""An index that grows by segments while reviews arrive.

Each micro-batch of a stream becomes a segment of postings and review metadata;
look-ups add segments up.  A batch is written under its own number, so a batch
that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index as ix


def append_segment(reviews: DataFrame, path: str, segment: int) -> None:
    """Write raw review rows as one segment of postings and metadata, replacing what it held."""
    rows = ix.latest_reviews(reviews, version=True)
    ix.term_frequencies(rows).write.mode("overwrite").parquet(f"{path}/postings/segment={segment}")
    ix.review_table(rows).write.mode("overwrite").parquet(f"{path}/reviews/segment={segment}")


def start(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Index a stream of raw review rows; returns the StreamingQuery."""
    batch = lambda rows, number: append_segment(rows, path, number)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_segments(spark: SparkSession, path: str) -> ix.Index:
    """All segments as one index; of a review in several segments the latest load counts, then the latest segment."""
    table = spark.read.parquet(f"{path}/reviews")
    last = table.groupBy("review_id").agg(F.max(F.struct("loaded_at", "segment")).alias("l")).select("review_id", "l.segment")
    reviews = table.join(last, ["review_id", "segment"])
    postings = spark.read.parquet(f"{path}/postings").join(last, ["review_id", "segment"]).select("term", "review_id", "tf")
    corpus = reviews.agg(F.count("*").alias("n_reviews"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_tokens"))
    return ix.Index(reviews.drop("segment", "loaded_at"), postings, ix.lexicon_of(postings), corpus)
