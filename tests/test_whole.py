"""Operators return whole results: no document, query term or hash is left out."""

import os

import pytest

from lexiloom.operators import simhash
from lexiloom.plans.oracles import _QUERIES, ORACLES
from lexiloom.plans.queries import ABSENT, QUERIES

from .support import SF, connection
from .test_text import signed


def test_every_similar_pair_follows_from_members_and_class_pairs(spark):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(256) for _ in range(6)]
    values = base + base[:3] * 4 + [b ^ sum(1 << k for k in rng.sample(range(256), rng.randint(1, 30))) for b in base for _ in range(3)] + [base[0]] * 10
    rows = [(f"d{i:03}", *signed(v)) for i, v in enumerate(values)]
    frame = spark.createDataFrame([*rows, ("none", None, None, None, None)], "doc_id string, s0 bigint, s1 bigint, s2 bigint, s3 bigint")
    wanted = {(f"d{i:03}", f"d{j:03}") for i in range(len(values)) for j in range(len(values)) if i != j and (values[i] ^ values[j]).bit_count() <= 25}
    for b in (1, 2, None):
        links, members = simhash.similar_signatures(frame, "doc_id", simhash.build_block_index(frame, "doc_id", "0.9", b))
        members, links = {r["doc_id"]: r for r in members.collect()}, {(r["a"], r["b"]): r["pairs"] for r in links.collect()}
        assert set(members) == {r[0] for r in rows}
        similar = lambda x, y: (min(x, y), max(x, y)) in links  # noqa: B023, E731
        assert {(x, y) for x in members for y in members if x != y and similar(members[x]["class_id"], members[y]["class_id"])} == wanted
        assert {x: r["links"] for x, r in members.items()} == {x: sum(a == x for a, _ in wanted) for x in members}
        assert 2 * sum(links.values()) == len(wanted)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_searches_take_whole_texts_as_queries(spark):
    searches = [name for name, sql in ORACLES.items() if _QUERIES in sql]
    assert len(searches) == 11 and all(f"{name}_reviews" in QUERIES for name in searches)
    words = lambda text: "".join(c if c.isascii() and (c.isalnum() or c == "_") else " " for c in text or "").lower().split()
    items = connection().sql("SELECT item_id, text FROM eval_items").fetchall()
    wanted = {w for _, text in items for w in words(text)} | {ABSENT}
    assert {r["term"] for r in QUERIES["df_lookup"](spark, SF).collect()} == wanted
    texts = connection().sql("SELECT review_id, text FROM reviews WHERE review_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY loaded_at DESC NULLS LAST) = 1").fetchall()
    wanted = {(i, w) for i, text in texts for w in words(text)}
    assert {(r["query_id"], r["term"]) for r in QUERIES["query_weights_reviews"](spark, SF).collect()} == wanted


def test_documents_with_short_or_no_sketches_are_compared(spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    docs = [("t50", words), ("t51", [*words, "x"]), ("t52", words[::-1]), ("t53", ["too", "short"]), ("t54", [w.upper() for w in words])]
    spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "line_no bigint, doc_id string, words array<string>").write.parquet(f"{tmp_path}/linedocs.parquet")
    shingles = [(d, 1, [" ".join(w[i : i + 4]).lower() for i in range(len(w) - 3)]) for d, w in docs]
    spark.createDataFrame(shingles, "doc_id string, built_at bigint, shingles array<string>").write.parquet(f"{tmp_path}/shingles.parquet")
    stored = [("t50", 1, [str(i) for i in range(20)]), ("t52", 1, [f"h{i}" for i in range(50)])]
    spark.createDataFrame(stored, "doc_id string, built_at bigint, sketch array<string>").write.parquet(f"{tmp_path}/sketches.parquet")
    rows = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert {(r["a"], r["b"], r["pairs"]) for r in rows("minhash_similar")} == {("t50", "t50", 1), ("t50", "t51", 2)}
    assert {r["doc_id"]: (r["class_id"], r["links"]) for r in rows("minhash_members")} == {"t50": ("t50", 2), "t54": ("t50", 2), "t51": ("t51", 2), "t52": ("t52", 0)}
    assert {(r["a"], r["b"], r["records"]) for r in rows("minhash_search")} == {("t50", "t50", 2), ("t50", "t51", 1)}
    # The reversed document has the same words in other shingles: the search by words alone finds it; capitals are other words there.
    assert [(r["a"], r["true_positives"], r["false_positives"], r["false_negatives"]) for r in rows("recall_precision")] == [("t50", 2, 1, 1)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_sketch_variants_and_sweep_have_all_lengths(spark):
    for name in ("minhash_md5", "minhash_sha512"):
        assert {r["k"] for r in QUERIES[name](spark, SF).select("k").distinct().collect()} == set(range(50))
    found = {(r["t"], r["k"]): r["mean_error"] for r in QUERIES["minhash_error"](spark, SF).collect()}
    assert set(found) == {(t, k) for t in ("1", "0.9", "0.7", "0.5", "0.3") for k in (3, 10, 20, 50, 100, 200)}
    assert all(found["1", k] == 0 for k in (3, 200)) and found["0.5", 200] < found["0.5", 3]
