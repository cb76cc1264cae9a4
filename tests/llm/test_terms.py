import math
import random
from collections import Counter, defaultdict

import pytest

from lexiloom.llm import terms, topn

SCHEMA = "term string, review_id bigint, tf bigint, chunk_id int, df string"


def postings(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


ROWS = [
    ("Dog", 1, 2, 0), ("Dog", 1, 2, 1), ("dog ", 1, 3, 0), ("dog", 2, 1, 0), ("cat", 2, 4, 0), ("cat", 9, 1, 0), (None, 1, 1, 0), (" ", 1, 1, 0),
    ("", 2, 1, 0), ("owl", 1, 0, 0), ("owl", 1, -3, 0), ("owl", 1, None, 0), ("owl", None, 1, 0), ("yak", 3, 1, 0), ("\tcat", 3, 4, None),
]


def test_cleaning(spark):
    reviews = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "review_id bigint")
    found = sorted(map(tuple, terms.clean_postings(postings(spark, ROWS), reviews).select("review_id", "term", "tf").collect()))
    assert found == [(1, "dog", 5), (2, "cat", 4), (2, "dog", 1), (3, "cat", 4), (3, "yak", 1)]
    assert (9, "cat", 1) in set(map(tuple, terms.clean_postings(postings(spark, ROWS)).select("review_id", "term", "tf").collect()))


def test_empty(spark):
    none = terms.clean_postings(postings(spark, []), spark.createDataFrame([], "review_id bigint"))
    assert terms.term_frequencies(none).count() == 0
    for counts, alpha in (("tokens", 0.75), ("incidences", 0), ("incidences", 0.5)):
        assert terms.distinctive_terms(none, counts=counts, alpha=alpha).count() == 0
    with pytest.raises(ValueError):
        terms.distinctive_terms(none, counts="letters")


@pytest.mark.parametrize("heavy", [None, [], ["a", "b"], ["a", "absent", "a"]])
def test_frequencies_do_not_depend_on_what_is_heavy(spark, heavy):
    rng = random.Random(4)
    rows = {(i, rng.choice("aaaaabcdefg")): rng.randint(1, 9) for i in range(300) for _ in range(4)}
    frame = spark.createDataFrame([(i, t, n) for (i, t), n in rows.items()], "review_id bigint, term string, tf bigint")
    df, cf = Counter(t for _, t in rows), Counter()
    for (_, t), n in rows.items():
        cf[t] += n
    found = terms.term_frequencies(frame, heavy).collect()
    assert {r["term"]: (r["df"], r["cf"]) for r in found} == {t: (df[t], cf[t]) for t in df} and len(found) == len(df)


def test_marks_compare_exactly(spark):
    counts = spark.createDataFrame([("a", 1, 1), ("b", 5, 9), ("c", 6, 9)], "term string, df bigint, cf bigint")
    assert {r["term"]: (r["rare"], r["common"]) for r in terms.mark_terms(counts, 100).collect()} == {"a": (True, False), "b": (False, False), "c": (False, True)}


@pytest.mark.parametrize("keys", [0, 1, 1024])
def test_scores_equal_brute_force(spark, monkeypatch, keys):
    from lexiloom.plans import skew

    monkeypatch.setattr(terms, "heavy_light_join", lambda big, small, key, weight: skew.heavy_light_join(big, small, key, weight, keys))
    rng = random.Random(8)
    tf = {(i, f"t{int(rng.expovariate(0.3))}"): rng.randint(1, 5) for i in range(60) for _ in range(6)}
    frame = spark.createDataFrame([(i, t, n) for (i, t), n in tf.items()], "review_id bigint, term string, tf bigint")
    df, cf, length = Counter(t for _, t in tf), Counter(), Counter()
    for (i, t), n in tf.items():
        cf[t] += n
        length[i] += n
    kinds = Counter(i for i, _ in tf)
    total, incidences = sum(length.values()), len(tf)
    damp = lambda n: 1 + math.log10(n)

    def pmi(joint, term, record, every, of, alpha):
        smoothed = record**alpha / sum(n**alpha for n in of.values())
        return (joint / every) / (term / every * smoothed)

    scores = {
        ("tokens", 0.75, 2, False): lambda i, t, n: max(0, math.log2(pmi(n, cf[t], length[i], total, length, 0.75))),
        ("tokens", 1.0, 10, True): lambda i, t, n: max(0, math.log10(pmi(n, cf[t], length[i], total, length, 1.0))) * damp(n),
        ("incidences", 0.5, 2, False): lambda i, t, n: max(0, math.log2(pmi(1, df[t], kinds[i], incidences, kinds, 0.5))),
        ("incidences", 0, 10, True): lambda i, t, n: damp(n) * math.log10(len(length) / df[t]),
    }
    for (counts, alpha, base, damped), score in scores.items():
        wanted = defaultdict(list)
        for (i, t), n in tf.items():
            if df[t] >= 2 and round(score(i, t, n), 6) > 0:
                wanted[i].append((-round(score(i, t, n), 6), t))
        found = defaultdict(list)
        for r in sorted(terms.distinctive_terms(frame, 3, counts, alpha, base, damped).collect(), key=lambda r: (r["review_id"], r["place"])):
            found[r["review_id"]].append(r["term"])
        assert found == {i: [t for _, t in sorted(x)[:3]] for i, x in wanted.items()}


@pytest.mark.parametrize("batch", [2, 10_000])
def test_top_n_equals_brute_force(spark, batch):
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 6 + list("abc")) if rng.random() > 0.05 else None, rng.choice([1, 2, 3, None]), i, i, "x") for i in range(500)]
    frame = spark.createDataFrame(rows, "g string, s int, id bigint, place bigint, extra string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = sorted((r["g"], r["place"], r["id"], r["extra"]) for r in topn.top_n(frame, "g", [("s", True), ("id", False)], 4).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = defaultdict(list)
    for g, s, i, _, _ in rows:
        if g is not None:
            groups[g].append((-(s or 0), i))
    assert found == sorted((g, k + 1, i, "x") for g, x in groups.items() for k, (_, i) in enumerate(sorted(x)[:4]))


def test_top_n_of_nothing(spark):
    none = spark.createDataFrame([], "g string, s int")
    assert topn.top_n(none, "g", [("s", True)], 3).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(none, "g", [("s", True)], 0)


def test_latest_rows(spark):
    rows = [(1, None, "a", 9), (1, 5, "b", 1), (1, 5, "b", 1), (2, None, None, None), (None, 1, "x", 1), (3, 4, "p", 1), (3, 4, "p", 2)]
    found = topn.latest_rows(spark.createDataFrame(rows, "k int, v int, a string, b int"), "k", "v", ["a", "b"])
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == [(1, "b", 1), (2, None, None), (3, "p", 2)]
