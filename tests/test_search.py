import math

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import index as ix
from lexiloom.operators import lookup, search
from lexiloom.plans import storage
from lexiloom.sources import linedocs, reviews, sgml, store
from lexiloom.streaming import segments

BLOCKS = """product/productId: B00000000A
review/helpfulness: 1/1
review/score: 5.0
review/time: 1
review/text: Good good
dog food

product/productId: B00000000A
review/helpfulness: 0/0
review/score: 1.0
review/text: bad food

product/productId: B00000000B
review/helpfulness: 2/4
review/score: 2.0
review/text: dog likes good treats

product/productId: B00000000B
review/helpfulness: 3/4
review/score: 4.0
review/text: cat food, cat toys!
"""


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "reviews.txt"
    path.write_text(BLOCKS)
    return reviews.read_reviews(spark, str(path))


@pytest.fixture(scope="module")
def index(parsed):
    return ix.build_index(parsed)


def ask(spark, *queries):
    rows = [(q, i, w) for q, words in enumerate(queries, 1) for i, w in enumerate(words.split())]
    return spark.createDataFrame(rows, "query_id int, pos int, term string")


def ranked(df, key="review_id"):
    return [(r[key], r["score"]) for r in df.orderBy("query_id", "rank").collect()]


def test_parser(parsed):
    rows = [tuple(r) for r in parsed.orderBy("review_id").collect()]
    assert rows == [
        (1, "B00000000A", 1, 1, 5, "Good good dog food"),
        (2, "B00000000A", 0, 0, 1, "bad food"),
        (3, "B00000000B", 2, 4, 2, "dog likes good treats"),
        (4, "B00000000B", 3, 4, 4, "cat food, cat toys!"),
    ]


def test_parser_limit_and_writer(spark, parsed, tmp_path):
    reviews.write_reviews(parsed.coalesce(1), str(tmp_path / "out"))
    again = reviews.read_reviews(spark, str(tmp_path / "out"), limit=3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, parsed.where("review_id <= 3").collect()))


def test_lexicon_and_corpus(index):
    found = {r["term"]: (r["df"], r["cf"]) for r in index.lexicon.collect()}
    assert (found["good"], found["dog"], found["food"], found["cat"]) == ((2, 3), (2, 2), (3, 3), (1, 2))
    assert tuple(index.corpus.first()) == (4, 14)


def test_lookups(spark, index):
    probes = spark.createDataFrame([(1,), (0,), (5,), (1,)], "review_id bigint")
    assert sorted(map(tuple, lookup.reviews_by_id(probes, index.reviews).collect())) == [(0, None, -1, -1, -1, -1), (1, "B00000000A", 5, 1, 1, 4), (5, None, -1, -1, -1, -1)]
    terms = ask(spark, "GOOD zzz")
    assert sorted((r["review_id"], r["tf"]) for r in lookup.postings_of_terms(terms, index.postings).collect()) == [(1, 2), (3, 1)]
    assert sorted(map(tuple, lookup.frequencies_of_terms(terms, index.lexicon).collect())) == [("good", 2, 3), ("zzz", 0, 0)]
    wanted = spark.createDataFrame([(" b00000000a",), (None,), ("no",)], "product_id string")
    assert sorted(r["review_id"] for r in lookup.reviews_of_products(wanted, index.reviews).collect()) == [1, 2]


def test_vector_space(spark, index):
    assert ranked(search.vector_space_search(ask(spark, "good dog"), index)) == [(1, 1.627074), (3, 1.414214)]
    assert ranked(search.vector_space_search(ask(spark, "good cat food"), index)) == [(4, 1.163677), (1, 0.581838), (3, 0.447214), (2, 0.0)]
    assert ranked(search.vector_space_search(ask(spark, "food zzz"), index)) == [(1, 0.0), (2, 0.0), (4, 0.0)]
    assert ranked(search.vector_space_search(ask(spark, "zzz"), index)) == []


def test_language_model(spark, index):
    assert ranked(search.language_model_search(ask(spark, "good dog"), index, 0.5)) == [(1, -1.153953), (3, -1.34104)]
    assert ranked(search.language_model_search(ask(spark, "good dog"), index, 0.2)) == [(1, -1.350745), (3, -1.439167)]
    assert ranked(search.language_model_search(ask(spark, "good zzz"), index, 0.5)) == [(1, None), (3, None)]
    lam1 = ranked(search.language_model_search(ask(spark, "good cat"), index, 1.0))
    assert [s for _, s in lam1] == [None, None, None]
    twice = ranked(search.language_model_search(ask(spark, "dog dog"), index, 0.5))
    assert twice[0][1] == round(2 * math.log10(0.5 * 1 / 4 + 0.5 * 2 / 14), 6)


def test_products(spark, index):
    q = ask(spark, "good dog")
    assert ranked(search.products_by_vector_space(q, index, 2), "product_id") == [("B00000000A", 10.0), ("B00000000B", 1.5)]
    assert ranked(search.products_by_language_model(q, index, 2), "product_id") == [("B00000000A", 10.0), ("B00000000B", 3.0)]
    assert ranked(search.product_search(q, index, 2), "product_id") == [("B00000000A", 20.0), ("B00000000B", 4.5)]


def test_empty_queries(spark, index):
    none = spark.createDataFrame([], "query_id int, pos int, term string")
    assert search.product_search(none, index).count() == 0


def test_empty_collection(spark):
    none = spark.createDataFrame([], "review_id bigint, product_id string, helpfulness_num int, helpfulness_den int, score int, text string")
    index = ix.build_index(none)
    assert index.lexicon.count() == 0 and tuple(index.corpus.first()) == (0, 0)
    assert search.language_model_search(ask(spark, "good"), index).count() == 0
    assert search.vector_space_search(ask(spark, "good"), index).count() == 0


def test_delta_across_blocks(spark):
    ids = [1, 2, 65_535, 65_536, 65_540, 400_000]
    rows = spark.createDataFrame([("a", i, 1) for i in ids] + [("b", 70_000, 3)], "term string, review_id bigint, tf bigint")
    coded = ix.delta_encode(rows)
    gaps = [r["gap"] for r in coded.where("term = 'a'").orderBy("block", "seq").collect()]
    assert gaps == [1, 1, 65_533, 1, 4, 334_460]
    assert sorted(map(tuple, ix.delta_decode(coded).collect())) == sorted(map(tuple, rows.collect()))


def test_runs_across_blocks(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (65_537, None), (65_538, "a"), (65_539, "b"), (140_000, "b")], "review_id bigint, product_id string")
    found = sorted(map(tuple, ix.product_runs(rows).collect()), key=lambda r: r[1])
    assert found == [("a", 1, 2), (None, 3, 65_537), ("a", 65_538, 65_538), ("b", 65_539, 140_000)]


def test_store_round_trip(spark, index, tmp_path):
    path = str(tmp_path / "index")
    again = store.write_index(index, path, 3)
    assert sorted(map(tuple, again.lexicon.collect())) == sorted(map(tuple, index.lexicon.collect()))
    assert tuple(again.corpus.first()) == (4, 14)
    plan = again.postings.where(F.col("term") == "good")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,good)]" in plan
    assert ranked(search.vector_space_search(ask(spark, "good dog"), again)) == [(1, 1.627074), (3, 1.414214)]
    assert store.drop_index(spark, path) and not store.drop_index(spark, path)


def test_segments_stream(spark, tmp_path):
    source, out = str(tmp_path / "source"), str(tmp_path / "out")
    schema = "review_id bigint, product_id string, helpfulness_num int, helpfulness_den int, score int, text string, loaded_at timestamp"

    def load(rows, day):
        spark.createDataFrame([(*r, None) for r in rows], schema).withColumn("loaded_at", F.lit(f"2020-01-0{day}").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        segments.start(stream, out, str(tmp_path / "checkpoint")).awaitTermination()

    load([(1, "A", 1, 1, 5, "good dog"), (2, "B", 0, 0, 3, "bad cat")], 1)
    load([(2, "B", 0, 0, 4, "good cat cat"), (3, "B", 0, 0, 4, None)], 2)
    index = segments.read_segments(spark, out)
    assert sorted(map(tuple, index.lexicon.collect())) == [("cat", 1, 2), ("dog", 1, 1), ("good", 2, 2)]
    assert tuple(index.corpus.first()) == (3, 5)
    assert {r["review_id"]: r["score"] for r in index.reviews.collect()} == {1: 5, 2: 4, 3: 4}


def test_line_documents(spark, tmp_path):
    path = tmp_path / "docs.txt"
    path.write_text("t1 a b c\nt2 x\nt1 d e\n\nt3\n")
    found = {r["doc_id"]: r["words"] for r in linedocs.latest_lines(linedocs.read_linedocs(spark, str(path))).collect()}
    assert found == {"t1": ["d", "e"], "t2": ["x"], "t3": []}


def test_sgml(spark, tmp_path):
    path = tmp_path / "a.sgm"
    path.write_text("<REUTERS><BODY>Oil <b>prices</b>\nrose 5.2 pct.</BODY></REUTERS><x><body></body><body>Cocoa_x</body>")
    assert [(r["doc_id"], r["words"]) for r in sgml.read_sgml(spark, str(path)).orderBy("doc_id").collect()] == [(0, ["oil", "prices", "rose", "5", "2", "pct"]), (1, []), (2, ["cocoa_x"])]


def test_only_the_best_of_a_block_leave_it_and_no_plan_choice_changes_them(spark, monkeypatch):
    """Against the sums by rows of query, review and term; with ties, copies, zero weights, and terms the collection lacks."""
    import random

    rng = random.Random(4)
    words = ["the", "a", "b", "c", "d", "e", "f", "g"]
    texts = ["the " + " ".join(rng.choices(words, [9, 5, 4, 3, 2, 2, 1, 1], k=rng.randint(1, 6))) for _ in range(60)] + ["the a b"] * 20
    rows = [(i, "P", 0, 0, 3, t, 0) for i, t in enumerate(rng.sample(texts, len(texts)))]
    frame = spark.createDataFrame(rows, "review_id bigint, product_id string, helpfulness_num int, helpfulness_den int, score int, text string, loaded_at bigint")
    built = ix.build_index(ix.latest_reviews(frame))
    built = ix.Index(*[storage.materialize(getattr(built, n), n) for n in ("reviews", "postings", "lexicon", "corpus")])
    asked = [(q, t) for q in range(12) for t in rng.choices(words, k=rng.randint(1, 4))] + [(3, "lacking"), (90, "the"), (91, "lacking"), (None, "a")]
    queries = spark.createDataFrame([(q, i, t) for i, (q, t) in enumerate(asked)], "query_id bigint, pos int, term string")
    plain = lambda frame: sorted(map(tuple, frame.collect()), key=str)
    columns = ["query_id", "rank", "review_id", "score"]
    vs = plain(search.top_k(search.vector_space_scores(queries, built), "review_id", 5).select(columns))
    lm = plain(search.top_k(search.language_model_scores(queries, built, 0.5), "review_id", 5).select(columns))
    for reviews, few, chunk, whole in ((65_536, 8_192, 32_768, 256), (7, 7, 3, 1)):
        for name, value in (("REVIEWS", reviews), ("FEW_REVIEWS", few), ("QUERIES", chunk), ("WHOLE", whole)):
            monkeypatch.setattr(search, name, value)
        assert plain(search.vector_space_search(queries, built, 5)) == vs
        assert plain(search.language_model_search(queries, built, 0.5, 5)) == lm
    monkeypatch.setattr(search, "REVIEWS", 65_536)
    monkeypatch.setattr(search, "FEW_REVIEWS", 8_192)
    one = spark.createDataFrame([(1, "the")], "query_id bigint, term string")
    sums = search.best_sums(one, one.selectExpr("query_id", "term", "1.0D AS weight"), built, F.col("tf") * 1.0, 5)
    # Before, a row of each of the 80 reviews went to the shuffle.
    assert sums.count() <= 5 * len({r["tf"] for r in built.postings.where("term = 'the'").collect()})


def test_the_best_are_found_without_ordering_all_scores(monkeypatch):
    """Ties, copies, untouched places and any number of scores, against a sort; before, each query partitioned all scores of a block."""
    import numpy as np

    rng = np.random.default_rng(12)
    for n in (3, 39, 320, 321, 1000, 5000):
        for scores in (rng.random(n), rng.integers(0, 4, n) / 3, np.where(rng.random(n) < 0.01, rng.random(n), 0.0), np.zeros(n), np.repeat(rng.random(), n) + 1e-7 * rng.integers(0, 9, n)):
            ids, touched = rng.permutation(n), np.flatnonzero((scores > 0) | (rng.random(n) < 0.3))
            best = search._best(scores, lambda: touched, ids, 10)  # noqa: B023
            rounded = sorted(((-round(float(scores[i]), 6), int(ids[i])) for i in touched))[:10]
            assert sorted((-round(float(scores[i]), 6), int(ids[i])) for i in best)[:10] == rounded and set(best) <= set(touched) | set(np.flatnonzero(scores > 0))
    sizes = []
    partition = np.partition
    monkeypatch.setattr(np, "partition", lambda a, *x: sizes.append(len(a)) or partition(a, *x))
    search._best(rng.random(60_000), None, np.arange(60_000), 10)
    assert max(sizes) < 6_000


def test_a_bound_from_a_sample_keeps_the_best_and_drops_the_rest_in_the_tasks(spark, monkeypatch):
    """Against the sums by rows, with blocks of like length; before, every block sent its k best of each query to the shuffle."""
    import random

    rng = random.Random(9)
    words = ["the", "a", "b", "c", "d", "e", "f", "g", "h"]
    texts = [" ".join(rng.choices(words, [30, 12, 8, 5, 4, 3, 2, 1, 1], k=rng.randint(1, 30))) for _ in range(180)] + ["the a b"] * 20
    rows = [(i, "P", 0, 0, 3, t, 0) for i, t in enumerate(rng.sample(texts, len(texts)))]
    frame = spark.createDataFrame(rows, "review_id bigint, product_id string, helpfulness_num int, helpfulness_den int, score int, text string, loaded_at bigint")
    built = ix.build_index(ix.latest_reviews(frame))
    built = ix.Index(*[storage.materialize(getattr(built, n), n) for n in ("reviews", "postings", "lexicon", "corpus")])
    asked = [(q, t) for q in range(15) for t in rng.choices(words, k=rng.randint(1, 9))] + [(3, "lacking"), (90, "the"), (None, "h")]
    queries = spark.createDataFrame([(q, i, t) for i, (q, t) in enumerate(asked)], "query_id bigint, pos int, term string")
    plain = lambda frame: sorted(map(tuple, frame.collect()), key=str)
    columns = ["query_id", "rank", "review_id", "score"]
    for name, size in (("REVIEWS", 9), ("FEW_REVIEWS", 9), ("SAMPLE", 40), ("QUERIES", 10)):
        monkeypatch.setattr(search, name, size)
    assert plain(search.vector_space_search(queries, built, 3, exact_idf=True)) == plain(search.top_k(search.vector_space_scores(queries, built, exact_idf=True), "review_id", 3).select(columns))
    assert plain(search.language_model_search(queries, built, 0.2, 3)) == plain(search.top_k(search.language_model_scores(queries, built, 0.2), "review_id", 3).select(columns))
    one = spark.createDataFrame([(1, "the")], "query_id bigint, term string")
    sums = search.best_sums(one, one.selectExpr("query_id", "term", "1.0D AS weight"), built, F.col("tf") * 1.0, 1)
    assert sums.count() < 12  # of 23 blocks or more


def test_terms_of_a_review_are_counted_in_its_row(spark):
    rows = [(1, "Good good dog, a Dog! good"), (2, ""), (3, None), (4, "one")]
    frame = spark.createDataFrame([(i, "P", 0, 0, 3, t, 0) for i, t in rows], "review_id bigint, product_id string, helpfulness_num int, helpfulness_den int, score int, text string, loaded_at bigint")
    latest = ix.latest_reviews(frame)
    found = ix.indexed_reviews(latest)
    assert sorted((r["review_id"], t["term"], t["tf"]) for r in found.collect() for t in r["terms"]) == sorted((r["review_id"], r["term"], r["tf"]) for r in ix.term_frequencies(latest).collect())
    assert {r["review_id"]: r["length"] for r in found.collect()} == {1: 6, 2: 0, 3: 0, 4: 1}


def _random_block(seed):
    """A block of 400 reviews with 30 terms, dense and rare ones, and its values as a table of reviews by terms."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    values = np.where(rng.random((400, 30)) < np.geomspace(0.9, 0.01, 30), rng.random((400, 30)) + 0.1, 0.0)
    review, no = np.nonzero(values)
    order = rng.permutation(len(no))
    rows = pa.table({"review_id": review[order], "no": no[order], "value": values[review, no][order]})
    return rng, values, search._Block(rows, np.arange(30))


def test_only_what_can_reach_a_bound_is_added_up():
    """Against all sums; before, each query added up all reviews of a block."""
    import numpy as np

    few = 0
    for seed in range(30):
        rng, values, block = _random_block(seed)
        terms = sorted(rng.choice(30, rng.integers(1, 12), replace=False).tolist())
        held = block.held(terms, (rng.random(len(terms)) + 0.01).tolist())
        sums = sum(w * values[:, t] for t, w in held)
        for least in np.sort(sums)[[-1, -5, -40]].tolist():
            if least <= 0:
                continue
            near = block.reaching(held, least)
            assert set(block.ids[near]) >= set(np.flatnonzero(sums >= least)) and len(set(near)) == len(near)
            assert np.array_equal(block.sums(near, held), block.all_sums(held)[near])
            few += len(near) < 200
            best = block.best(held, least, 5)[1]
            assert sorted(best)[-5:] == sorted(block.all_sums(held)[block.all_sums(held) >= least])[-5:]
    assert few > 60


def test_a_bound_is_a_score_that_k_reviews_have():
    """Of any terms, also when the rarer ones are in few reviews; before, a task knew no score of other reviews."""
    import numpy as np

    near = 0
    for seed in range(30):
        rng, values, block = _random_block(100 + seed)
        terms = sorted(rng.choice(30, rng.integers(1, 12), replace=False).tolist())
        held = block.held(terms, rng.choice([0.0, 0.3, 0.7, 1.0], len(terms)).tolist())
        sums = np.sort(block.all_sums(held))
        for k in (1, 5, 10, 500):
            bound = block.bound(held, k)
            assert bound <= (sums[-k] if k <= len(sums) else 0.0)
            near += k == 10 and bound >= 0.8 * sums[-k]
    assert near > 20


def test_what_can_reach_a_bound_is_found_by_sums_in_bytes(monkeypatch):
    """Against all sums, by masks, lists and exceptions; before, a query's other terms were looked up one by one for each place."""
    import numpy as np

    few, asked = 0, []
    monkeypatch.setattr(search, "FEW_ROWS", 0)
    for masked in (128, 4, 1):
        monkeypatch.setattr(search, "MASKED", masked)
        for seed in range(20):
            rng, values, block = _random_block(200 + seed)
            monkeypatch.setattr(block, "add", lambda *x: asked.append(x))
            terms = sorted(rng.choice(30, rng.integers(1, 12), replace=False).tolist())
            held = block.held(terms, rng.choice([0.0, 0.01, 0.5, 1.0, 3.0], len(terms)).tolist())
            sums = block.all_sums(held)
            for least in np.unique(sums)[[-1, -5, -40] if len(np.unique(sums)) > 40 else [-1]].tolist():
                if least <= 0:
                    continue
                near = block.near(held, least)
                assert set(near) >= set(np.flatnonzero(sums >= least)) and len(set(near)) == len(near)
                assert np.array_equal(block.scores(near, held), sums[near])
                at, found = block.best(held, least, 5)
                assert np.array_equal(sums[at], found) and sorted(found)[-5:] == sorted(sums[sums >= least])[-5:]
                few += len(near) < 3 * (sums >= least).sum() + 10
    assert few > 80 and not asked


def test_blocks_that_give_most_come_first(monkeypatch):
    """Then the others find nothing above the bound; before, the last block came first."""
    import types

    import numpy as np
    import pyarrow as pa

    seen, block = [], search._Block
    monkeypatch.setattr(search, "_Block", lambda rows, nos: seen.append(rows.column("r")[0].as_py()) or block(rows, nos))
    asked = search._asked(pa.table({"query_id": [7, 7], "asked": [1, 3], "weight": [1.0, 0.5]}))
    rows = pa.table({"r": [0, 0, 1, 1, 2, 2], "review_id": [10, 11, 20, 21, 30, 31], "no": [1, 3, 1, 9, 3, 9], "value": [2.0, 2.0, 3.0, 9.0, 1.0, 9.0]})
    found = search._kernel(types.SimpleNamespace(value=asked), types.SimpleNamespace(value=np.zeros(1)), 1)(rows)
    assert seen == [0, 1, 2]
    assert found.to_pylist() == [{"query_id": 7, "review_id": 20, "raw": 3.0}]
