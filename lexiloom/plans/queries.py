"""The registered queries of the core operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, ranking
from ..functions import text as tx
from ..operators import evaluate as ev
from ..operators import index as ix
from ..operators import jaccard, lookup, minhash, search, simhash
from ..sources import linedocs, sgml, store
from ..sources import reviews as source_reviews
from . import storage
from .barrier import with_once

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: A word that no collection holds.
ABSENT = "qzxqueryword"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _reviews(spark: SparkSession, sf: str) -> DataFrame:
    return ix.latest_reviews(_table(spark, sf, "reviews"))


def _known_scores(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", F.coalesce("score", F.lit(lookup.MISSING_NUMBER)))


def _index(spark: SparkSession, sf: str) -> ix.Index:
    """The index, written once as a row per review with its terms, so a query tokenises and shuffles each text once."""
    rows = storage.materialize(ix.indexed_reviews(_reviews(spark, sf)), "indexed")
    reviews = rows.drop("terms")
    postings = rows.select("review_id", "length", F.explode("terms").alias("t")).select("t.term", "review_id", "t.tf", "length")
    corpus = reviews.agg(F.count("*").alias("n_reviews"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_tokens"))
    return ix.Index(reviews, postings, storage.materialize(ix.lexicon_of(postings), "lexicon"), corpus)


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of queries: all tokens, with repeats, of each evaluation item; every fiftieth has a word more that the collection lacks."""
    absent = F.when(F.col("item_id") % 50 == 0, F.array(F.lit(ABSENT))).otherwise(F.array().cast("array<string>"))
    terms = F.concat(tx.tokens(F.col("text")), absent)
    return _table(spark, sf, "eval_items").select(F.col("item_id").alias("query_id"), F.posexplode(terms).alias("pos", "term"))


def _review_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The other batch: all tokens, with repeats, of each review whose id is divisible by 50."""
    rows = _reviews(spark, sf).where(F.col("review_id") % 50 == 0)
    return rows.select(F.col("review_id").alias("query_id"), F.posexplode(tx.tokens(F.col("text"))).alias("pos", "term"))


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    rows = linedocs.latest_lines(_table(spark, sf, "linedocs"))
    return with_once(rows, "words", tx.plain_words(F.col("words")))


def _shingle_sets(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", tx.shingles(F.col("words")).alias("shingles"))


def _perturbed(rows: DataFrame) -> DataFrame:
    """The query set of the near-duplicate searches: documents whose number is divisible by 50, with as many leading words
    replaced as a word similarity of 0.95 allows."""
    rows = rows.where(F.regexp_extract("doc_id", r"(\d+)$", 1).try_cast("bigint") % 50 == 0)
    return with_once(rows, "words", tx.perturb(F.col("words"), 0.95))


def _probe_docs(spark: SparkSession, sf: str) -> DataFrame:
    return _perturbed(_docs(spark, sf))


def _probe_shingles(spark: SparkSession, sf: str) -> DataFrame:
    """Shingles of the query set, of words spelled as in the stored shingles: lower case, letters and digits only."""
    plain = F.transform("words", lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{Nd}]", ""))
    rows = _perturbed(with_once(_docs(spark, sf), "words", F.filter(plain, lambda w: w != "")))
    return rows.select("doc_id", tx.shingles(F.col("words")).alias("shingles"))


def _signatures(spark: SparkSession, sf: str) -> DataFrame:
    """The stored signatures: of each document the row built last, without the empty ones."""
    words = ["s0", "s1", "s2", "s3"]
    rows = _table(spark, sf, "signatures").where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("built_at", *words)).alias("r"))
    return rows.select("doc_id", *[F.col(f"r.{w}").alias(w) for w in words]).where("s0 is not null and s1 is not null and s2 is not null and s3 is not null")


def _probe_signatures(spark: SparkSession, sf: str) -> DataFrame:
    features = _probe_shingles(spark, sf).where("size(shingles) > 0")
    return storage.materialize(simhash.signatures(features, "doc_id", "shingles"), "probes")


# Scans and scalar functions


@query
def tokenize_lengths(spark, sf):
    return _reviews(spark, sf).select("review_id", F.size(tx.tokens(F.col("text"))).cast("bigint").alias("length"))


@query
def cropped_terms(spark, sf):
    words = tx.tokens(F.regexp_replace(F.coalesce("text", F.lit("")), r"\W", ""))
    rows = _table(spark, sf, "documents").select("doc_id", F.explode(words).alias("term"))
    return rows.select("doc_id", tx.crop(F.col("term")).alias("term"))


@query
def review_blocks(spark, sf):
    return source_reviews.blocks_in_texts(_table(spark, sf, "documents"), "doc_id", "text")


@query
def sgml_bodies(spark, sf):
    rows = sgml.bodies_in_texts(_table(spark, sf, "documents"), "doc_id", "text")
    return rows.select("doc_id", "part", F.size("words").cast("bigint").alias("n_words"), F.array_join("words", " ").alias("words"))


@query
def line_documents(spark, sf):
    lines = _table(spark, sf, "linedocs").where("doc_id is not null and words is not null").select("line_no", F.concat_ws(" ", F.col("doc_id"), F.col("words")).alias("value"))
    rows = linedocs.latest_lines(linedocs.parse_lines(lines))
    return rows.select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.array_join("words", " ").alias("words"))


@query
def file_reviews(spark, sf):
    """Reviews written as a file of blocks and read again; ids come from the place in the file, so they are left out; no score is -1."""
    path = storage.new_path(spark, "reviews")
    source_reviews.write_reviews(_reviews(spark, sf), path)
    return _known_scores(source_reviews.read_reviews(spark, path).drop("review_id"))


@query
def file_linedocs(spark, sf):
    """Line documents written as a file of lines and read again."""
    path = storage.new_path(spark, "lines")
    linedocs.write_linedocs(_docs(spark, sf), path)
    rows = linedocs.latest_lines(linedocs.read_linedocs(spark, path))
    return rows.select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.array_join("words", " ").alias("words"))


@query
def file_sgml(spark, sf):
    """Every line document as a body of SGML files, read again; ids come from the place in the file, so they are left out."""
    path = storage.new_path(spark, "sgml")
    _docs(spark, sf).select(F.concat(F.lit("<DOC><BODY>"), F.array_join("words", " "), F.lit("</BODY></DOC>")).alias("value")).write.text(path)
    return sgml.read_sgml(spark, path).select(F.size("words").cast("bigint").alias("n_words"), F.array_join("words", " ").alias("words"))


@query
def review_quality(spark, sf):
    q = ranking.quality(F.col("score"), F.col("helpfulness_num"), F.col("helpfulness_den"))
    return _reviews(spark, sf).select("review_id", F.round(q, 6).alias("quality"))


@query
def perturb_docs(spark, sf):
    rows = with_once(_docs(spark, sf), "changed", tx.perturb(F.col("words"), 0.8))
    return rows.select("doc_id", F.size(F.filter("changed", lambda w: w == "**")).cast("bigint").alias("replaced"), F.array_join("changed", " ").alias("words"))


# The index


@query
def term_freqs(spark, sf):
    return ix.term_frequencies(_reviews(spark, sf))


@query
def lexicon(spark, sf):
    return ix.lexicon_of(ix.term_frequencies(_reviews(spark, sf)))


@query
def corpus_stats(spark, sf):
    return ix.corpus_of(_reviews(spark, sf))


@query
def top_terms(spark, sf):
    words = ix.lexicon_of(ix.term_frequencies(_reviews(spark, sf)))
    return words.orderBy(F.desc("cf"), "term").limit(20)  # a report of the 20 most frequent terms


@query
def posting_blocks(spark, sf):
    rows = ix.posting_lists(ix.term_frequencies(_reviews(spark, sf)))
    return rows.select("term", "block", F.size("list").cast("bigint").alias("n"), F.get("list", F.lit(0))["review_id"].alias("first"), F.element_at("list", -1)["review_id"].alias("last"))


@query
def postings_delta(spark, sf):
    return ix.delta_encode(storage.materialize(ix.term_frequencies(_reviews(spark, sf)), "postings")).select("term", "block", "seq", "gap", "tf")


@query
def postings_decode(spark, sf):
    coded = ix.delta_encode(storage.materialize(ix.term_frequencies(_reviews(spark, sf)), "postings"))
    return ix.delta_decode(storage.materialize(coded, "coded"))


@query
def postings_varint(spark, sf):
    return ix.varint_postings(storage.materialize(ix.varint_lists(ix.term_frequencies(_reviews(spark, sf))), "bytes"))


@query
def product_runs(spark, sf):
    return ix.product_runs(storage.materialize(_reviews(spark, sf).select("review_id", "product_id"), "products"))


@query
def segment_merge(spark, sf):
    """Two segments with own review numbers, merged: even and odd ids are numbered apart, then shifted back."""
    rows = ix.term_frequencies(_reviews(spark, sf))
    parts = [rows.where(F.col("review_id") % 2 == k).withColumn("review_id", F.col("review_id") - 1000 * (k + 1)) for k in (0, 1)]
    return ix.merge_segments([(part, 1000 * (k + 1)) for k, part in enumerate(parts)])[1]


@query
def lexicon_merge(spark, sf):
    return ix.merge_lexicons(_table(spark, sf, "lexicon"))


# Look-ups


@query
def review_lookup(spark, sf):
    extra = spark.createDataFrame([(0,), (-2,)], "review_id bigint")
    probes = _table(spark, sf, "postings").select("review_id").where("review_id is not null").unionByName(extra)
    return lookup.reviews_by_id(probes, ix.review_table(_reviews(spark, sf)))


@query
def product_reviews(spark, sf):
    return lookup.reviews_of_products(_table(spark, sf, "documents").select("product_id"), _reviews(spark, sf))


@query
def posting_lookup(spark, sf, batch=_queries):
    return lookup.postings_of_terms(batch(spark, sf), ix.term_frequencies(_reviews(spark, sf)))


def _stored(spark: SparkSession, sf: str) -> ix.Index:
    """The index written as tables and opened again."""
    path = storage.new_path(spark, "index")
    store.write_index(ix.build_index(_reviews(spark, sf)), path)
    return store.read_index(spark, path)


@query
def stored_index_lookup(spark, sf, batch=_queries):
    """The same look-up from an index that is written, opened again and read by term."""
    return lookup.postings_of_terms(batch(spark, sf), _stored(spark, sf).postings)


@query
def stored_lexicon(spark, sf):
    return _stored(spark, sf).lexicon


@query
def stored_reviews(spark, sf):
    return _known_scores(_stored(spark, sf).reviews)


@query
def index_sizes(spark, sf):
    index = _stored(spark, sf)
    return ev.table_sizes({name: getattr(index, name) for name in store.TABLES})


@query
def df_lookup(spark, sf, batch=_queries):
    return lookup.frequencies_of_terms(batch(spark, sf), ix.lexicon_of(ix.term_frequencies(_reviews(spark, sf)))).select("term", "df")


@query
def cf_lookup(spark, sf, batch=_queries):
    return lookup.frequencies_of_terms(batch(spark, sf), ix.lexicon_of(ix.term_frequencies(_reviews(spark, sf)))).select("term", "cf")


# Ranked search


@query
def query_weights(spark, sf, batch=_queries):
    rows = search.query_weights(batch(spark, sf), _index(spark, sf))
    return rows.select("query_id", "term", F.round("weight", 6).alias("weight"))


@query
def query_weights_exact(spark, sf, batch=_queries):
    rows = search.query_weights(batch(spark, sf), _index(spark, sf), exact_idf=True)
    return rows.select("query_id", "term", F.round("weight", 6).alias("weight"))


@query
def vector_space_topk(spark, sf, batch=_queries):
    return search.vector_space_search(batch(spark, sf), _index(spark, sf), 10)


@query
def language_model_topk(spark, sf, batch=_queries):
    return search.language_model_search(batch(spark, sf), _index(spark, sf), 0.5, 10)


@query
def product_topk_vs(spark, sf, batch=_queries):
    return search.products_by_vector_space(batch(spark, sf), _index(spark, sf), 10)


@query
def product_topk_lm(spark, sf, batch=_queries):
    return search.products_by_language_model(batch(spark, sf), _index(spark, sf), 10)


@query
def product_search(spark, sf, batch=_queries):
    return search.product_search(batch(spark, sf), _index(spark, sf), 10)


for _f in (posting_lookup, stored_index_lookup, df_lookup, cf_lookup, query_weights, query_weights_exact, vector_space_topk, language_model_topk, product_topk_vs, product_topk_lm, product_search):
    QUERIES[f"{_f.__name__}_reviews"] = partial(_f, batch=_review_queries)


# Near-duplicates


@query
def shingles(spark, sf):
    return _shingle_sets(spark, sf).select("doc_id", F.posexplode("shingles").alias("pos", "shingle")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "shingle")


@query
def shingles_sorted(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.posexplode(tx.sorted_shingles(F.col("words"))).alias("pos", "shingle"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "shingle")


def _sketch_rows(spark, sf, family):
    found = minhash.sketches(_shingle_sets(spark, sf), minhash.salt_words(50), family)
    return found.select("doc_id", F.posexplode("sketch").alias("k", "least")).withColumn("k", F.col("k").cast("bigint"))


@query
def minhash_sha256(spark, sf):
    return _sketch_rows(spark, sf, "sha256")


@query
def minhash_md5(spark, sf):
    return _sketch_rows(spark, sf, "md5")


@query
def minhash_sha512(spark, sf):
    return _sketch_rows(spark, sf, "sha512")


def _clean(shingles: Column) -> Column:
    """Shingles lower-cased and with single blanks; nulls and empty ones fall out."""
    plain = F.transform(F.array_compact(shingles), lambda x: F.trim(F.regexp_replace(F.lower(x), r"[ \t\r\n]+", " ")))
    return F.filter(plain, lambda x: x != "")


def _stored_shingles(spark: SparkSession, sf: str) -> DataFrame:
    """The stored shingles of the last date of every document."""
    last = _table(spark, sf, "shingles").where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("built_at", "shingles")).alias("r"))
    return with_once(last, "shingles", _clean(F.col("r.shingles")))


def _sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of every document whose stored shingles of the last date aren't empty.

    The stored sketches differ in length and nothing says which salts made
    them, so all are computed from the shingles, with one set of salts that the
    probes share.
    """
    return storage.materialize(minhash.number_sketches(_stored_shingles(spark, sf), minhash.salt_words(50)), "sketches")


def _probe_sketches(spark: SparkSession, sf: str) -> DataFrame:
    return storage.materialize(minhash.number_sketches(_probe_shingles(spark, sf), minhash.salt_words(50)), "probes")


def _links(links: DataFrame) -> DataFrame:
    return links.select("a", "b", F.round("similarity", 6).alias("similarity"), "pairs")


def _found(found: DataFrame) -> DataFrame:
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"), "records")


@query
def minhash_similar(spark, sf):
    """Pairs of similar classes (documents of equal sketches), and how many pairs of documents each stands for."""
    return _links(jaccard.similar_lists(_sketches(spark, sf), "doc_id", "sketch", "0.8")[0])


@query
def minhash_members(spark, sf):
    """Every document with a sketch, its class, and the number of documents similar to it."""
    return jaccard.similar_lists(_sketches(spark, sf), "doc_id", "sketch", "0.8")[1].withColumnRenamed("id", "doc_id")


@query
def minhash_search(spark, sf):
    return _found(jaccard.search_lists(_probe_sketches(spark, sf), _sketches(spark, sf), "doc_id", "sketch", "0.5")[0])


@query
def word_jaccard(spark, sf):
    return _links(jaccard.similar_lists(_docs(spark, sf), "doc_id", "words", "0.7")[0])


@query
def word_jaccard_members(spark, sf):
    return jaccard.similar_lists(_docs(spark, sf), "doc_id", "words", "0.7")[1].withColumnRenamed("id", "doc_id")


@query
def simhash_bits(spark, sf):
    features = _docs(spark, sf).select("doc_id", tx.shingles(F.col("words")).alias("features")).where("size(features) > 0")
    rows = simhash.signatures(features, "doc_id", "features")
    return rows.select("doc_id", bits.signature_hex([F.col(w) for w in bits.WORDS]).alias("signature"))


@query
def simhash_hamming_pairs(spark, sf):
    """The query set against all stored signatures, by direct comparison."""
    rows = storage.materialize(_signatures(spark, sf), "signatures")
    found = simhash.hamming_search(_probe_signatures(spark, sf), rows, "doc_id", "0.7")
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query
def simhash_block_search(spark, sf):
    """The query set against the block index of the stored signatures, which is written and opened again."""
    path = storage.new_path(spark, "blocks")
    simhash.build_block_index(_signatures(spark, sf), "doc_id", "0.9", path=path)
    return _found(simhash.block_search(_probe_signatures(spark, sf), simhash.open_block_index(spark, path), "doc_id"))


def _similar_signatures(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = storage.materialize(_signatures(spark, sf), "signatures")
    return simhash.similar_signatures(rows, "doc_id", simhash.build_block_index(rows, "doc_id", "0.9"))


@query
def simhash_block_pairs(spark, sf):
    """Pairs of similar classes (documents of equal signatures), and how many pairs of documents each stands for."""
    return _links(_similar_signatures(spark, sf)[0])


@query
def simhash_block_members(spark, sf):
    """Every document with a signature, its class, and the number of documents similar to it."""
    return _similar_signatures(spark, sf)[1]


# Evaluation


#: Thresholds and sketch lengths of the sweep.
SWEEP_T, SWEEP_K = ("1", "0.9", "0.7", "0.5", "0.3"), (3, 10, 20, 50, 100, 200)


def _error_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Each document against itself perturbed for each threshold: exact and estimated similarity of the shingle sets."""
    # Hashing outweighs reading here by far, so a small table is spread over all cores.
    docs = _docs(spark, sf).repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "doc_id")
    every = with_once(docs, "own", tx.shingles(F.col("words")))
    sets = {t: f"set_{i}" for i, t in enumerate(SWEEP_T)}
    for t, name in sets.items():
        every = with_once(every, "changed", tx.perturb(F.col("words"), float(t)))
        every = with_once(every, name, tx.shingles(F.col("changed")))
    return minhash.sketch_trials(every, minhash.salt_words(max(SWEEP_K)), list(SWEEP_K), "own", sets)


@query
def minhash_error(spark, sf):
    return ev.mean_absolute_error(_error_trials(spark, sf), "truth", "estimate", ["t", "k"])


@query
def minhash_accuracy(spark, sf):
    """Share of perturbed documents whose sketch is at least as similar to the original's as they were made, less 0.1."""
    return ev.accuracy(_error_trials(spark, sf), F.col("estimate") >= F.round(F.col("t").cast("double") - 0.1, 9), ["t", "k"])


@query
def sketch_over_threshold(spark, sf):
    """The query set against all sketches, by direct comparison."""
    probes, rows = _probe_sketches(spark, sf), _sketches(spark, sf)
    found = jaccard.counted_search(probes, rows, "doc_id", "sketch", "0.03")
    if found is None:
        found = ev.over_threshold(probes, rows, "doc_id", "sketch", minhash.sketch_similarity, 0.03)
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query
def streamed_lexicon(spark, sf):
    """The lexicon of an index that a stream of review files built up, one file per micro-batch."""
    from ..streaming import segments

    path = storage.new_path(spark, "stream")
    source = _table(spark, sf, "reviews")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 4).parquet(f"{sf}/reviews.parquet*")
    segments.start(stream, f"{path}/index", f"{path}/checkpoint").awaitTermination()
    return segments.read_segments(spark, f"{path}/index").lexicon


@query
def recall_precision(spark, sf):
    """The query set's partners by sketches (0.5) against those by word lists (0.5), per query."""

    def partners(queries: DataFrame, records: DataFrame, items: str) -> DataFrame:
        pairs = jaccard.counted_search(queries, records, "doc_id", items, "0.5")
        if pairs is None:
            found, members = jaccard.search_lists(queries, records, "doc_id", items, "0.5")
            pairs = found.select("a", F.col("b").alias("class_id")).join(members, "class_id").withColumnRenamed("id", "b")
        return pairs.select("a", "b")

    found = minhash.sketch_search(_probe_shingles(spark, sf), _stored_shingles(spark, sf), minhash.salt_words(50), "0.5")
    if found is None:
        found = partners(_probe_sketches(spark, sf), _sketches(spark, sf), "sketch")
    truth = partners(_probe_docs(spark, sf), _docs(spark, sf), "words")
    out = ev.recall_precision(found, truth, ["a", "b"], "a")
    return out.select("a", "true_positives", "false_positives", "false_negatives", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@query
def pearson(spark, sf):
    return ev.pearson(ix.review_table(_reviews(spark, sf)), "length", "score")


@query
def sample_docs(spark, sf):
    return ev.sample_records(_docs(spark, sf).select("doc_id"), "doc_id", 100)  # sampling is the operator


@query
def helpful_accuracy(spark, sf):
    """Share of reviews with votes that more than half of the voters found helpful."""
    rows = _reviews(spark, sf).where("helpfulness_den > 0")
    return ev.accuracy(rows, 2 * F.col("helpfulness_num") > F.col("helpfulness_den"))
