import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiloom.llm import neardup, queries, setsim
from lexiloom.plans.components import connected_components


def hashed(spark, docs, extra=""):
    rows = [(k, v, 1) for k, v in docs.items()]
    frame = spark.createDataFrame(rows, "id string, items array<string>, cls int")
    return frame.withColumn("tokens", F.when(F.col("items").isNotNull(), setsim.element_hashes(F.array_compact("items"))))


def brute(docs, num, den, least=1):
    sets = {k: {x for x in v if x is not None} for k, v in docs.items() if v is not None}
    sets = {k: s for k, s in sets.items() if len(s) >= least}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) * den >= len(sets[a] | sets[b]) * num}


def clusters(seed, n=25):
    rng = random.Random(seed)
    docs = {}
    for c in range(n):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 25))]
        for k in range(rng.randint(1, 5)):
            mine = [w for w in base if rng.random() > 0.12] + ["the", "of"] + [f"x{rng.randint(0, 9999)}" for _ in range(rng.randint(0, 3))]
            docs[f"d{c:02}{k}"] = mine
    docs |= {"null": None, "empty": [], "nulls": [None, None], "copy": list(docs["d000"]), "twice": docs["d000"] * 2}
    return docs


@pytest.mark.parametrize("t,num,den", [(0.5, 1, 2), (0.8, 4, 5), (1.0, 1, 1)])
def test_similar_pairs_equal_brute_force(spark, t, num, den):
    docs = clusters(7)
    links, members = setsim.similar_pairs(hashed(spark, docs), "id", "tokens", t, pivots=8)
    found = [tuple(r) for r in setsim.expand_pairs(links, members).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(docs, num, den)


@pytest.mark.parametrize("pivots,radius,block,heavy", [(0, 0.2, 2000, 0), (3, 0.45, 1, 0), (200, 0.0, 3, 10**6), (16, 0.3, 2, 100)])
def test_plan_choices_change_no_result(spark, monkeypatch, pivots, radius, block, heavy):
    docs = clusters(11)
    monkeypatch.setattr(setsim, "BLOCK", block)  # both keys and copies meet in blocks
    every = [r["t"] for r in hashed(spark, docs).select(F.explode("tokens").alias("t")).distinct().collect()]
    monkeypatch.setattr(setsim, "_heavy", lambda rows, tokens: sorted(every)[:heavy])
    links, members = setsim.similar_pairs(hashed(spark, docs), "id", "tokens", 0.5, pivots=pivots, radius=radius)
    assert {tuple(r) for r in setsim.expand_pairs(links, members).collect()} == brute(docs, 1, 2)


def test_similar_pairs_between_tables(spark):
    docs = clusters(3)
    left = {k: v for i, (k, v) in enumerate(docs.items()) if i % 2}
    right = {k: v for i, (k, v) in enumerate(docs.items()) if i % 2 == 0}
    links, members = setsim.similar_pairs(hashed(spark, left), "id", "tokens", 0.5, right=hashed(spark, right))
    found = [tuple(r) for r in setsim.expand_pairs(links, members, within=False).collect()]
    wanted = {(a, b) if a in left else (b, a) for a, b in brute(docs, 1, 2) if (a in left) != (b in left)}
    assert len(found) == len(set(found)) and set(found) == wanted


def test_latest_row_and_least_size(spark):
    rows = [("a", ["p", "q", "r"], 1), ("a", ["x", "y", "z"], 2), ("a", ["x", "y", "z"], 2), ("b", ["x", "y", "z"], None), ("c", ["p", "q", "r"], 1), ("c", ["x"], 3), (None, ["x", "y", "z"], 1), ("d", ["x", "y", "z"], 1), ("d", None, 2)]
    frame = spark.createDataFrame(rows, "id string, items array<string>, at int").withColumn("tokens", setsim.element_hashes(F.col("items")))
    links, members = setsim.similar_pairs(frame, "id", "tokens", 0.5, latest_by="at", min_size=2)
    assert [tuple(r) for r in setsim.expand_pairs(links, members).collect()] == [("a", "b")]


def test_empty_tables(spark):
    links, members = setsim.similar_pairs(hashed(spark, {}), "id", "tokens", 0.5)
    assert links.count() == 0 and members.count() == 0 and setsim.expand_pairs(links, members).count() == 0
    none = spark.createDataFrame([], "id string, tokens array<bigint>")
    assert neardup.near_duplicate_groups(none, "id", "tokens").count() == 0


def test_many_copies_are_one_class(spark):
    docs = {f"c{i:04}": ["a", "b", "c"] for i in range(500)} | {"near": ["a", "b", "c", "d"], "far": ["e"]}
    links, members = setsim.similar_pairs(hashed(spark, docs), "id", "tokens", 0.5)
    assert links.count() == 1 and members.select("cls").distinct().count() == 3
    assert setsim.expand_pairs(links, members).count() == 501 * 500 // 2


def test_frequent_runs_are_counted_across_batches(spark):
    rows = spark.range(30_000).select((F.col("id") % 3).alias("t"), F.col("id").alias("cls")).unionByName(spark.range(5).select((F.col("id") + 10).alias("t"), F.col("id").alias("cls")))
    found = setsim._shared_light(rows).groupBy("t").agg(F.count("*").alias("n"), F.min("df").alias("a"), F.max("df").alias("b")).collect()
    assert sorted(map(tuple, found)) == [(k, 10_000, 10_000, 10_000) for k in range(3)]


def test_shingle_cleaning(spark):
    rows = [(["A  b\tc d", "a b c d ", None, " a b\n\nc d"],), ([],), ([None],), (None,), ([" x y"],), ([""],)]
    made = queries.shingle_tokens(spark.createDataFrame(rows, "s array<string>"), "s", "t")
    found = [r["t"] for r in made.collect()]
    one = lambda x: spark.range(1).select(F.xxhash64(F.lit(x)).alias("h")).first()["h"]
    assert found == [[one("a b c d")], [], [], None, [one("x y")], [one("")]]


def bag_similarity(a, b):
    both = (Counter(a) & Counter(b)).total()
    return both, len(a) + len(b) - both


def grams(words, width):
    return [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


@pytest.mark.parametrize("width", [1, 3])
def test_groups_equal_brute_force(spark, width):
    rng = random.Random(2)
    docs = {}
    for c in range(20):
        base = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 30)) for _ in range(rng.randint(5, 60))]
        for k in range(4):
            mine = list(base)
            for _ in range(rng.randint(0, 3)):
                mine[rng.randrange(len(mine))] = f"new{rng.randint(0, 9999)}"
            docs[f"d{c:02}{k}"] = mine
    docs |= {"copy": docs["d000"], "empty": [], "null": None, "one": ["a"]}
    least = 4
    use = {k: grams(v, width) for k, v in docs.items() if v is not None and len(v) >= max(least, width)}
    parent = {k: k for k in use}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(sorted(use), 2):
        both, total = bag_similarity(use[a], use[b])
        if both * 5 >= total * 4:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    wanted = {k: min(j for j in use if root(j) == root(k)) for k in use}
    frame = spark.createDataFrame(list(docs.items()), "id string, words array<string>").withColumn("tokens", neardup.token_hashes(F.col("words"))).withColumn("n", F.lit(0))
    found = neardup.near_duplicate_groups(frame, "id", "tokens", 0.8, width=width, min_tokens=least).collect()
    assert {r["id"]: r["group_id"] for r in found} == wanted and len(found) == len(wanted)
    assert {r["id"]: r["class_id"] for r in found}["d000"] == "copy"


def test_a_chain_of_edits_is_one_group(spark):
    words = [f"w{i}" for i in range(40)]
    docs = {}
    for i in range(60):
        words = [*words[1:], f"v{i}"]
        docs[f"d{i:02}"] = list(words)
    frame = spark.createDataFrame(list(docs.items()), "id string, words array<string>").withColumn("tokens", neardup.token_hashes(F.col("words")))
    assert {r["group_id"] for r in neardup.near_duplicate_groups(frame, "id", "tokens", width=1).collect()} == {"d00"}


def test_band_plan_reaches_recall():
    for t in (0.5, 0.8, 0.9, 1.0):
        for recall in (0.9, 0.9999):
            bands, rows = neardup.band_plan(t, recall)
            assert 1 - (1 - min(t, 1 - 1e-9) ** rows) ** bands >= recall and bands * rows <= 1024


def test_long_sets_are_sketched_whole(spark, monkeypatch):
    docs = {"a": [f"w{i}" for i in range(3000)], "b": [f"w{i}" for i in range(3000)][::-1] + ["x"]}
    monkeypatch.setattr(neardup, "CELLS", 10_000)
    frame = spark.createDataFrame(list(docs.items()), "id string, words array<string>").withColumn("tokens", neardup.token_hashes(F.col("words")))
    assert {r["group_id"] for r in neardup.near_duplicate_groups(frame, "id", "tokens", width=1).collect()} == {"a"}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 51), (51, 50), (60, 60), (70, 71), (71, 72), (72, 70)] + [(100, k) for k in range(101, 150)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, 50: 50, 51: 50, 70: 70, 71: 70, 72: 70, **{k: 100 for k in range(100, 150)}}


def test_short_empty_and_null_texts_have_a_class(spark, tmp_path):
    long = "one two three four five six"
    texts = ["One, two!", "one two", "two one", "", "...", None, long, long, "a b c d e", "a b c d"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: (r["class_id"], r["group_id"]) for r in queries.p3_documents(spark, str(tmp_path)).collect()}
    assert found == {i: (c, c) for i, c in enumerate([0, 0, 2, 3, 3, 3, 6, 6, 8, 9])}
