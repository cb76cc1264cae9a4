"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.barrier import with_once
from ..plans.storage import materialize
from . import leakage, mixture, neardup, quality, setsim, terms, topn


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: The characters with Unicode's White_Space property, but for the blank.
_SPACES = r"\t\n\x0b\f\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def shingle_tokens(rows: DataFrame, shingles: str, name: str) -> DataFrame:
    """Adds element hashes of lower-cased shingles whose white space is single blanks; null for null.

    The elements are cleaned as one string, U+0001 between them; nulls fall
    out.  Only strings that have anything to clean, which byte searches tell,
    meet the regular expression.
    """
    rows = with_once(rows, "_line", F.lower(F.array_join(shingles, "\x01")))
    line = F.col("_line")
    untidy = F.length(line) != F.octet_length(line)
    for mark in ("  ", "\n", "\r", "\t", "\x0b", "\f"):
        untidy = untidy | line.contains(mark)
    clean = F.when(untidy, F.regexp_replace(line, f"[{_SPACES} ]{{2,}}|[{_SPACES}]", " ")).otherwise(line)
    parts = F.transform(F.split(clean, "\x01"), lambda x: F.trim(x))
    held = F.exists(shingles, lambda x: x.isNotNull())
    hashes = F.when(held, setsim.element_hashes(parts)).when(F.col(shingles).isNotNull(), F.array().cast("array<bigint>"))
    return with_once(rows, name, hashes).drop("_line")


def _p1(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = shingle_tokens(_table(spark, sf, "shingles").select("doc_id", "built_at", "shingles"), "shingles", "tokens")
    return setsim.similar_pairs(rows.drop("shingles"), "doc_id", "tokens", 0.5, latest_by="built_at", min_size=8)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    links, members = _p1(spark, sf)
    return setsim.expand_pairs(links, members).select(F.col("id_lo").alias("doc_lo"), F.col("id_hi").alias("doc_hi"))


def _postings(spark: SparkSession, sf: str) -> DataFrame:
    return terms.clean_postings(_table(spark, sf, "postings"), _table(spark, sf, "reviews"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return terms.distinctive_terms(_postings(spark, sf), per_record=3, counts="incidences", alpha=0, base=10, damped=True).select("review_id", "term")


def p2_ppmi(spark: SparkSession, sf: str) -> DataFrame:
    found = terms.distinctive_terms(_postings(spark, sf), per_record=3, counts="tokens", alpha=0.75)
    return found.select("review_id", "term", "tf", F.col("score").alias("ppmi"), "place")


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every line document of at least 20 words with its group and class of equal bags."""
    rows = topn.latest_rows(_table(spark, sf, "linedocs"), "doc_id", "line_no", ["words"])
    plain = F.transform(F.filter("words", lambda w: w.isNotNull()), lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{Nd}]", ""))
    rows = with_once(rows, "tokens", neardup.token_hashes(F.filter(plain, lambda w: w != "")))
    return neardup.near_duplicate_groups(rows, "doc_id", "tokens", 0.8, width=1, min_tokens=20).withColumnRenamed("id", "doc_id")


def p3_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every document grouped by its runs of five words, similarity 0.8 or more; a null text counts as an empty one."""
    rows = _table(spark, sf, "documents")
    rows = with_once(rows, "tokens", neardup.token_hashes(quality.word_column(F.coalesce("text", F.lit("")))))
    return neardup.every_record_grouped(rows, "doc_id", "tokens", 0.8, width=5).withColumnRenamed("id", "doc_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = p3_groups(spark, sf)
    large = rows.groupBy("group_id").agg(F.count("*").alias("size")).where("size > 1").select("group_id")
    return rows.join(large, "group_id", "left_semi").select("group_id", "doc_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "reviews")
    rows = topn.latest_rows(rows, "review_id", "loaded_at", ["product_id", "score", "helpfulness_num"])
    rows = rows.where("product_id is not null and score between 1 and 5").select(
        F.upper(F.trim("product_id", F.lit(" \t\r\n"))).alias("product_id"),
        "review_id",
        "score",
        F.greatest(F.coalesce("helpfulness_num", F.lit(0)), F.lit(0)).alias("help"),
    )
    best = topn.top_n(rows, "product_id", [("score", True), ("help", True), ("review_id", False)], 3)
    return best.select("product_id", "place", "review_id")


def p5_terms(spark: SparkSession, sf: str) -> DataFrame:
    tfs = _postings(spark, sf)
    n = tfs.select("review_id").distinct().count()
    return terms.mark_terms(terms.term_frequencies(tfs), n)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    marks = F.array_compact(F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common"))))
    return p5_terms(spark, sf).select("term", F.explode(marks).alias("mark"))


def p6_matches(spark: SparkSession, sf: str) -> DataFrame:
    index = materialize(leakage.positional_index(_table(spark, sf, "documents")), "index")
    return leakage.leaked_items(index, _table(spark, sf, "eval_items"), phrase=10, width=4, share="0.5", slop=2)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_matches(spark, sf).where("match = 'phrase'").select("item_id", "doc_id")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.mix_copies(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets"))


def _mix(spark: SparkSession, sf: str) -> DataFrame:
    sized = mixture.sized_documents(_table(spark, sf, "documents"))
    plan = mixture.mixture(sized, _table(spark, sf, "mix_targets"), ["domain", "lang"])
    return mixture.select_mixture(sized, plan)


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).select("doc_id", "source", "size", "copies")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.reached_shares(_mix(spark, sf), _table(spark, sf, "mix_targets"))


def _statistics(spark: SparkSession, sf: str) -> DataFrame:
    return quality.text_statistics(_table(spark, sf, "documents"), _table(spark, sf, "common_words"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return quality.text_types(_statistics(spark, sf)).select("doc_id", F.explode("faults").alias("fault"))


def p8_stats(spark: SparkSession, sf: str) -> DataFrame:
    ratio = lambda a, b, name: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 6).alias(name)
    return _statistics(spark, sf).select(
        "doc_id",
        "n_words",
        ratio("letters", "n_words", "mean_word_length"),
        ratio("symbols", "chars", "symbol_share"),
        ratio("ended", "n_lines", "ended_share"),
        ratio("n_common", "n_words", "common_share"),
        "n_lines",
    )


def p8_types(spark: SparkSession, sf: str) -> DataFrame:
    return quality.text_types(_statistics(spark, sf)).select("doc_id", "kind", "p_kind", "p_prose")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_ppmi": p2_ppmi,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p3_documents": p3_documents,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_terms": p5_terms,
    "p6_found": p6_found,
    "p6_matches": p6_matches,
    "p7_found": p7_found,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_stats": p8_stats,
    "p8_types": p8_types,
}
