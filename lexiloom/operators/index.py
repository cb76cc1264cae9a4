"""The inverted index of a review collection as four DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.barrier import with_once
from . import codec

#: Review ids of one block in the block-wise encodings.
BLOCK_BITS = 16


@dataclass
class Index:
    """reviews (a row per review), postings (term, review_id, tf), lexicon (term, df, cf), corpus (n_reviews, n_tokens)."""

    reviews: DataFrame
    postings: DataFrame
    lexicon: DataFrame
    corpus: DataFrame


def latest_reviews(reviews: DataFrame, version: bool = False) -> DataFrame:
    """One row per review_id: the latest load, cleaned; ``version`` keeps its loaded_at.

    Products are trimmed and upper-cased, a null or negative helpfulness is 0,
    a score outside 1 to 5 is null and a null text is empty; rows without
    review_id are left out.
    """
    kept = ["product_id", "helpfulness_num", "helpfulness_den", "score", "text"]
    rows = reviews.where("review_id is not null").groupBy("review_id").agg(F.max(F.struct("loaded_at", *kept)).alias("r"))
    extra = ["loaded_at"] if version else []
    rows = rows.select("review_id", *[F.col(f"r.{c}").alias(c) for c in kept + extra])
    whole = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).alias(c)
    return rows.select(
        "review_id",
        F.upper(F.trim("product_id", F.lit(" \t\r\n"))).alias("product_id"),
        whole("helpfulness_num"),
        whole("helpfulness_den"),
        F.when(F.col("score").between(1, 5), F.col("score")).alias("score"),
        F.coalesce("text", F.lit("")).alias("text"),
        *extra,
    )


def review_tokens(reviews: DataFrame, cropped: bool = False) -> DataFrame:
    """(review_id, term), a row per token."""
    rows = reviews.select("review_id", F.explode(tx.tokens(F.col("text"))).alias("term"))
    return rows.withColumn("term", tx.crop(F.col("term"))) if cropped else rows


def term_frequencies(reviews: DataFrame, cropped: bool = False) -> DataFrame:
    """(term, review_id, tf)."""
    return review_tokens(reviews, cropped).groupBy("term", "review_id").agg(F.count("*").alias("tf"))


def lexicon_of(postings: DataFrame) -> DataFrame:
    """(term, df, cf)."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def review_table(reviews: DataFrame) -> DataFrame:
    """Review metadata with the length in tokens, without the text."""
    return reviews.withColumn("length", tx.token_count(F.col("text"))).drop("text")


def indexed_reviews(reviews: DataFrame) -> DataFrame:
    """The review table with the postings of each review in its row, as ``terms``: array of (term, tf).

    Equal tokens are counted in a sorted array of the review, so nothing is shuffled.
    """
    rows = with_once(reviews, "_sorted", F.array_sort(tx.tokens(F.col("text"))))
    token = lambda i: F.get("_sorted", i)
    starts = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda i: (i == 0) | (token(i) != token(i - 1)))
    rows = with_once(rows, "_starts", F.when(F.size("_sorted") > 0, starts).otherwise(F.array().cast("array<int>")))
    end = lambda j: F.coalesce(F.get("_starts", j + 1), F.size("_sorted"))
    terms = F.transform("_starts", lambda i, j: F.struct(token(i).alias("term"), (end(j) - i).cast("bigint").alias("tf")))
    return review_table(rows.withColumn("terms", terms)).drop("_sorted", "_starts")


def corpus_of(reviews: DataFrame) -> DataFrame:
    """(n_reviews, n_tokens), one row."""
    return reviews.agg(F.count("*").alias("n_reviews"), F.coalesce(F.sum(tx.token_count(F.col("text"))), F.lit(0)).alias("n_tokens"))


def build_index(reviews: DataFrame, cropped: bool = False) -> Index:
    """Lazy index over cleaned reviews; ``sources.store.write_index`` makes it a table set."""
    postings = term_frequencies(reviews, cropped)
    return Index(review_table(reviews), postings, lexicon_of(postings), corpus_of(reviews))


def posting_lists(postings: DataFrame) -> DataFrame:
    """(term, block, list): postings nested per term and block of review ids, ascending.

    A list holds at most 2^BLOCK_BITS postings, however frequent its term is.
    """
    block = F.shiftright("review_id", BLOCK_BITS).alias("block")
    return postings.groupBy("term", block).agg(F.array_sort(F.collect_list(F.struct("review_id", "tf"))).alias("list"))


def _before(blocks: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Adds ``before``: ``value`` over the earlier blocks of a key."""
    order = Window.partitionBy(*keys).orderBy("block") if keys else Window.partitionBy().orderBy("block")
    return blocks.withColumn("before", value.over(order.rowsBetween(Window.unboundedPreceding, -1)))


def delta_encode(postings: DataFrame) -> DataFrame:
    """(term, block, seq, gap, tf): review ids as gaps from the one before in the term's list.

    Gaps inside a block come from a window over (term, block), the gap across
    a block border from one row per block, so that no window holds more than a
    block of a frequent term's list.
    """
    rows = postings.withColumn("block", F.shiftright("review_id", BLOCK_BITS))
    inside = Window.partitionBy("term", "block").orderBy("review_id")
    ends = _before(rows.groupBy("term", "block").agg(F.max("review_id").alias("top")), ["term"], F.max("top"))
    coded = rows.withColumn("seq", F.row_number().over(inside)).withColumn("last", F.lag("review_id").over(inside))
    coded = coded.join(ends.select("term", "block", "before"), ["term", "block"])
    return coded.select("term", "block", "seq", (F.col("review_id") - F.coalesce("last", "before", F.lit(0))).alias("gap"), "tf")


def delta_decode(coded: DataFrame) -> DataFrame:
    """(term, review_id, tf) from ``delta_encode``'s rows, by prefix sums within and across blocks."""
    inside = Window.partitionBy("term", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = _before(coded.groupBy("term", "block").agg(F.sum("gap").alias("gaps")), ["term"], F.sum("gaps"))
    rows = coded.withColumn("run", F.sum("gap").over(inside)).join(sums.select("term", "block", "before"), ["term", "block"])
    return rows.select("term", (F.col("run") + F.coalesce("before", F.lit(0))).alias("review_id"), "tf")


def varint_lists(postings: DataFrame) -> DataFrame:
    """(term, block, n, ids, tfs): posting lists as group-varint bytes, ids as gaps from the start of their block."""
    lists = with_once(posting_lists(postings), "list", F.col("list"))
    base = F.shiftleft("block", BLOCK_BITS)
    gaps = F.transform("list", lambda x, i: x["review_id"] - F.when(i > 0, F.get("list", i - 1)["review_id"]).otherwise(base))
    return lists.select("term", "block", F.size("list").alias("n"), codec.encode_column(gaps).alias("ids"), codec.encode_column(F.transform("list", lambda x: x["tf"])).alias("tfs"))


def varint_postings(lists: DataFrame) -> DataFrame:
    """(term, review_id, tf) from ``varint_lists``' rows."""
    rows = lists.withColumn("gaps", codec.decode_column(F.col("ids"), F.col("n"))).withColumn("tf", codec.decode_column(F.col("tfs"), F.col("n")))
    rows = rows.select("term", "block", F.posexplode(F.arrays_zip("gaps", "tf")).alias("pos", "x"))
    run = F.sum("x.gaps").over(Window.partitionBy("term", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select("term", (F.shiftleft("block", BLOCK_BITS) + run).alias("review_id"), F.col("x.tf").alias("tf"))


def product_runs(reviews: DataFrame) -> DataFrame:
    """(product_id, first_review, last_review): runs of consecutive equal products in review order.

    The order is cut into blocks of review ids; what continues over a border
    is settled on one row per block.  A null product is a value of its own.
    """
    rows = reviews.select("review_id", "product_id", F.shiftright("review_id", BLOCK_BITS).alias("block"))
    inside = Window.partitionBy("block").orderBy("review_id")
    rows = rows.withColumn("seq", F.row_number().over(inside)).withColumn("prior", F.lag("product_id").over(inside))
    ends = rows.groupBy("block").agg(F.max_by(F.struct("product_id"), "review_id").alias("end"))
    ends = ends.withColumn("prior_end", F.lag("end").over(Window.orderBy("block")))  # one row per block
    rows = rows.join(ends.select("block", "prior_end"), "block")
    new = F.when(F.col("seq") > 1, ~F.col("prior").eqNullSafe(F.col("product_id"))).otherwise(F.col("prior_end").isNull() | ~F.col("prior_end.product_id").eqNullSafe(F.col("product_id")))
    starts = rows.withColumn("new", new.cast("int"))
    sums = _before(starts.groupBy("block").agg(F.sum("new").alias("n")), [], F.sum("n"))
    run = F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starts = starts.withColumn("run", run).join(sums.select("block", "before"), "block").withColumn("run", F.col("run") + F.coalesce("before", F.lit(0)))
    return starts.groupBy("run").agg(F.first("product_id").alias("product_id"), F.min("review_id").alias("first_review"), F.max("review_id").alias("last_review")).drop("run")


def merge_segments(segments: list[tuple[DataFrame, int]]) -> tuple[DataFrame, DataFrame]:
    """(postings, lexicon) of segments with local review ids, each shifted by its offset."""
    shifted = [p.select("term", (F.col("review_id") + F.lit(offset)).alias("review_id"), "tf") for p, offset in segments]
    merged = shifted[0]
    for part in shifted[1:]:
        merged = merged.unionByName(part)
    return merged, lexicon_of(merged)


def merge_lexicons(chunks: DataFrame) -> DataFrame:
    """(term, df, cf) of chunk lexicons (chunk_id, term, df, cf): figures of a term added up.

    A repeated row of a chunk counts once, terms are trimmed and lower-cased,
    null or blank terms left out, null figures are 0.
    """
    rows = chunks.where("term is not null and chunk_id is not null").select("chunk_id", "term", F.col("df").cast("bigint").alias("df"), F.col("cf").cast("bigint").alias("cf")).distinct()
    rows = rows.withColumn("term", F.lower(F.trim("term", F.lit(" \t\r\n")))).where("term <> ''")
    return rows.groupBy("term").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("df"), F.coalesce(F.sum("cf"), F.lit(0)).alias("cf"))
