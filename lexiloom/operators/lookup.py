"""Index look-ups, for many probes at once; what is unknown has a stated value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sized import met_with, small

#: What a look-up of an unknown review or term gives.
MISSING_NUMBER, MISSING_FREQUENCY = -1, 0


def reviews_by_id(probes: DataFrame, reviews: DataFrame) -> DataFrame:
    """Metadata of each probed review_id: null product and -1 elsewhere if it is unknown.

    A known review without a valid score has -1 too.
    """
    wanted = probes.select("review_id").distinct()
    numbers = ["score", "helpfulness_num", "helpfulness_den", "length"]
    known = reviews.select("review_id", "product_id", *numbers).join(small(wanted), "review_id", "left_semi")
    found = wanted.join(known, "review_id", "left")
    return found.select("review_id", "product_id", *[F.coalesce(F.col(c), F.lit(MISSING_NUMBER)).alias(c) for c in numbers])


def reviews_of_products(probes: DataFrame, reviews: DataFrame) -> DataFrame:
    """(product_id, review_id) of each probed product that has reviews."""
    wanted = probes.select(F.upper(F.trim("product_id", F.lit(" \t\r\n"))).alias("product_id")).where("product_id is not null").distinct()
    counts = reviews.groupBy("product_id").agg(F.count("*").alias("rows"))
    return met_with(reviews.select("product_id", "review_id"), wanted, wanted, "product_id", "review_id", counts, "rows", "left_semi").select("product_id", "review_id")


def _terms(probes: DataFrame) -> DataFrame:
    return probes.select(F.lower("term").alias("term")).where("term is not null").distinct()


def postings_of_terms(probes: DataFrame, postings: DataFrame) -> DataFrame:
    """(term, review_id, tf) of each probed term, in any letter case."""
    wanted = _terms(probes)
    counts = postings.groupBy("term").agg(F.count("*").alias("rows"))
    return met_with(postings, wanted, wanted, "term", "review_id", counts, "rows", "left_semi").select("term", "review_id", "tf")


def frequencies_of_terms(probes: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(term, df, cf) of each probed term; 0 and 0 if the collection lacks it."""
    wanted = _terms(probes)
    found = wanted.join(lexicon.join(small(wanted), "term", "left_semi"), "term", "left")
    return found.select("term", *[F.coalesce(F.col(c), F.lit(MISSING_FREQUENCY)).alias(c) for c in ("df", "cf")])
