"""Term postings of a collection: cleaning, exact frequencies, distinctive terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.skew import HEAVY_KEY_CHARS, HEAVY_KEYS, heavy_light_join
from ..plans.storage import materialize

_BLANK = " \t\r\n"
#: Terms tracked while frequent ones are looked for.
TRACKED = 65_536
#: Logarithms by their base.
LOGS = {2: F.log2, 10: F.log10}


def _plain(term: Column) -> Column:
    return F.lower(F.trim(term, F.lit(_BLANK)))


def clean_postings(postings: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """(review_id, term, tf), one row per review and normalised term, materialised.

    Left out are rows with a null or non-positive tf, a null or blank term, a
    null review_id, or a review_id that ``reviews`` (if given) lacks.  Rows
    equal in the term as spelled, review_id and tf count once, whatever their
    other columns; then terms are trimmed and lower-cased and their tf added up.
    Empty tables give an empty table.
    """
    rows = postings.select("term", F.col("review_id").cast("bigint").alias("review_id"), F.col("tf").cast("bigint").alias("tf"))
    rows = rows.where((F.col("tf") >= 1) & F.col("term").isNotNull() & (F.trim("term", F.lit(_BLANK)) != "") & F.col("review_id").isNotNull())
    # Repeated rows are combined before the shuffle, so a row repeated any number of times is no hot key.
    once = rows.distinct()
    tfs = once.groupBy("review_id", _plain(F.col("term")).alias("term")).agg(F.sum("tf").alias("tf"))
    if reviews is not None:
        known = reviews.select(F.col("review_id").cast("bigint").alias("review_id")).where("review_id is not null").distinct()
        tfs = tfs.join(known, "review_id", "left_semi")
    return materialize(tfs, "postings")


def heavy_terms(rows: DataFrame, term: str = "term", keys: int = HEAVY_KEYS) -> list[str]:
    """Terms that probably occur most often, at most ``keys`` of bounded length.

    From one pass of a frequent-items sketch; a hint for the plan only, which
    changes no count.
    """
    there = rows.where(F.col(term).isNotNull() & (F.length(term) <= HEAVY_KEY_CHARS))
    found = there.agg(F.expr(f"approx_top_k({term}, {keys}, {TRACKED})"), F.count("*")).first()
    floor = max(2, (found[1] or 0) // (10 * keys))
    return sorted(x["item"] for x in (found[0] or []) if x["count"] >= floor)


def _local_counters(heavy: list[str]):
    """Arrow kernel: exact counters for heavy terms, other rows unchanged.

    Each task keeps two arrays of one counter per heavy term and returns them
    when its rows are read; heavy terms so cost one row per task.
    """
    names = pa.array(heavy, pa.string())

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, cf = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for batch in batches:
            at = pc.index_in(batch.column("term"), value_set=names)
            hot = at.is_valid()
            index, tf = pc.drop_null(at).to_numpy(), batch.column("tf").filter(hot).to_numpy()
            df += np.bincount(index, minlength=len(names))
            np.add.at(cf, index, tf)
            rest = batch.filter(pc.invert(hot))
            yield pa.record_batch([rest.column("term"), pa.array(np.ones(rest.num_rows, np.int64)), rest.column("tf"), pa.array(np.zeros(rest.num_rows, bool))], names=["term", "df", "cf", "heavy"])
        seen = np.flatnonzero(df)
        yield pa.record_batch([names.take(pa.array(seen)), pa.array(df[seen]), pa.array(cf[seen]), pa.array(np.ones(len(seen), bool))], names=["term", "df", "cf", "heavy"])

    return kernel


def term_frequencies(tfs: DataFrame, heavy: list[str] | None = None) -> DataFrame:
    """(term, df, cf) of clean postings by heavy-light aggregation.

    ``tfs`` has one row per (review_id, term) with a positive tf and no null.
    Heavy terms are counted in local arrays and only their sums leave a task;
    the remaining terms are shuffled.  Every term of the table has one row.
    """
    heavy = heavy_terms(tfs) if heavy is None else sorted(set(heavy))
    parts = tfs.select("term", "tf").mapInArrow(_local_counters(heavy), "term string, df bigint, cf bigint, heavy boolean")
    # A term is either heavy or light, so grouping the union of both kinds of partial rows is the union of both tables.
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def mark_terms(counts: DataFrame, n: int, rare_df: int = 1, common_share: str = "0.05") -> DataFrame:
    """Adds ``rare`` (df <= rare_df) and ``common`` (df > common_share * n, compared exactly)."""
    return counts.withColumn("rare", F.col("df") <= rare_df).withColumn("common", F.expr(f"cast(df as decimal(20,0)) > {common_share}BD * {int(n)}"))


def distinctive_terms(tfs: DataFrame, per_record: int = 3, counts: str = "tokens", alpha: float = 0.75, base: int = 2, damped: bool = False, min_df: int = 2) -> DataFrame:
    """The terms of each record that are most typical of it in the collection.

    ``tfs`` is a materialised table of clean postings.  The score is the
    positive pointwise mutual information of term and record,

        log(p(t, r) / (p(t) p(r))) = log(c(t, r) C / (c(t) c(r) ** alpha)),

    from the joint counts c(t, r) and both marginals, combined by group-bys and
    joins only.  p(r) is smoothed by the exponent: c(r) ** alpha over its sum C.
    Counts are of ``tokens``, or of ``incidences`` (a term in a record counts
    once).  With alpha 0 all records weigh the same, c(r) ** 0 = 1 and C = N, and
    over incidences the information is log(N / df).  ``damped`` multiplies it by
    1 + log10(tf).

    Scores are logs to ``base``, rounded to 6 decimals.  Terms of fewer than
    ``min_df`` records and scores of 0 are left out, ties go by term in byte
    order.  Returns (review_id, term, tf, df, score, place).
    """
    if counts not in ("tokens", "incidences"):
        raise ValueError(f"unknown counts {counts!r}")
    joint, marginal = ("tf", "cf") if counts == "tokens" else ("one", "df")
    use = materialize(term_frequencies(tfs), "terms").where(F.col("df") >= min_df)
    scored = heavy_light_join(tfs.select("review_id", "term", "tf"), use, "term", "df").withColumn("one", F.lit(1))
    records = tfs.withColumn("one", F.lit(1)).groupBy("review_id").agg(F.sum(joint).alias("held"))
    context = float(records.agg(F.sum(F.pow("held", F.lit(float(alpha))))).first()[0] or 1)
    weight = F.lit(1.0)
    if alpha:  # a weight of 1 for every record needs no join
        scored, weight = scored.join(records, "review_id"), F.pow("held", F.lit(float(alpha)))
    information = LOGS[base](F.col(joint) * F.lit(context) / (F.col(marginal) * weight))
    score = F.greatest(F.lit(0.0), information) * ((1 + F.log10("tf")) if damped else F.lit(1.0))
    scored = scored.withColumn("score", F.round(score, 6)).where("score > 0")
    order = Window.partitionBy("review_id").orderBy(F.desc("score"), "term")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_record).select("review_id", "term", "tf", "df", "score", "place")
