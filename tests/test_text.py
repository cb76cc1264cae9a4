import hashlib

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import bits, ranking
from lexiloom.functions import text as tx
from lexiloom.operators import codec, jaccard, minhash, simhash


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_tokens_split_before_lowering(spark):
    assert one(spark, "Good-good, DOG's\n9oz!", tx.tokens) == ["good", "good", "dog", "s", "9oz"]
    assert one(spark, "5 K a", tx.tokens) == ["5", "a"]  # the Kelvin sign is no ASCII word character
    assert one(spark, None, tx.tokens) == [] and one(spark, "", tx.tokens) == []
    assert one(spark, None, tx.token_count) == 0 and one(spark, "a b_c d-e", tx.token_count) == 4


def test_crop(spark):
    assert one(spark, "a" * 127, tx.crop) == "a" * 127
    assert one(spark, "a" * 128, tx.crop) == "a" * 126


def test_field_parsers(spark):
    assert one(spark, " 2/4 ", lambda c: F.array(*tx.helpfulness(c))) == [2, 4]
    assert one(spark, "two", lambda c: F.array(*tx.helpfulness(c))) == [None, None]
    assert one(spark, "4.0", tx.score) == 4 and one(spark, "x", tx.score) is None and one(spark, None, tx.score) is None


def test_shingles(spark):
    kind = "array<string>"
    assert one(spark, list("abcde"), tx.shingles, kind) == ["a b c d", "b c d e"]
    assert one(spark, ["x", "y"], tx.shingles, kind) == []
    assert one(spark, list("zabczabcz"), tx.shingles, kind) == ["z a b c", "a b c z", "b c z a", "c z a b"]
    assert one(spark, list("zabczabcz"), tx.sorted_shingles, kind) == sorted(["z a b c", "a b c z", "b c z a", "c z a b"])


def test_perturb_keeps_similarity_above_threshold(spark):
    words = [f"w{i}" for i in range(30)]
    for t in (0.9, 0.8, 0.5):
        changed = one(spark, words, lambda c, t=t: tx.perturb(c, t), "array<string>")
        r = changed.count("**")
        assert (30 - r) / (30 + r) > t >= (30 - r - 1) / (30 + r + 1)


def test_quality(spark):
    rows = spark.createDataFrame([(5, 1, 1), (1, 0, 0), (2, 2, 4), (4, 3, 4), (None, 1, 2)], "s int, n int, d int")
    assert [r["q"] for r in rows.select(ranking.quality(F.col("s"), F.col("n"), F.col("d")).alias("q")).collect()] == [10.0, 1.0, 3.0, 7.0, None]


def test_multiset_similarity(spark):
    items = spark.createDataFrame([("x", i) for i in "aab"] + [("y", i) for i in "abb"] + [("p", i) for i in "abcde"] + [("q", i) for i in "abcdf"], "id string, item string")
    pairs = spark.createDataFrame([("x", "y"), ("p", "q"), ("x", "none"), ("none", "nil")], "a string, b string")
    found = {(r["a"], r["b"]): r["similarity"] for r in jaccard.pair_similarity(pairs, items).collect()}
    assert found[("x", "y")] == 0.5 and abs(found[("p", "q")] - 4 / 6) < 1e-12
    assert found[("x", "none")] == 0 and found[("none", "nil")] is None


def similar_counts(docs, num, den):
    """All similar pairs of ids, and classes of equal lists, by comparing every pair."""
    import itertools
    from collections import Counter

    bags = {k: Counter(x for x in v or [] if x is not None) for k, v in docs.items()}
    sizes = {k: len(v or []) for k, v in docs.items()}
    pairs = set()
    for a, b in itertools.combinations(sorted(docs), 2):
        both = (bags[a] & bags[b]).total()
        if both and both * den >= (sizes[a] + sizes[b] - both) * num:
            pairs.add((a, b))
    key = {k: (sizes[k], tuple(sorted(bags[k].items()))) for k in docs}
    return pairs, {k: min(x for x in docs if key[x] == key[k]) for k in docs}


def list_docs(rng):
    docs = {f"d{i}": [rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))] for i in range(60)}
    return docs | {"none": None, "nulls": [None, "a"], "nulls2": ["a", None], "void": [None, None], "void2": [None, None], "copy": list(docs["d3"]), "copy2": list(docs["d3"])[::-1]}


def test_similar_lists_equals_brute_force(spark):
    import random

    docs = list_docs(random.Random(5))
    frame = spark.createDataFrame([(*r, "x") for r in docs.items()], "id string, items array<string>, class_id string")
    jaccard_block = jaccard.BLOCK
    try:
        for t, exact, block in (("0.5", (1, 2), 2_000), ("0.8", (4, 5), 2), ("1", (1, 1), 2), ("0.3", (3, 10), 2_000)):
            jaccard.BLOCK = block  # hot keys in blocks give the same pairs
            pairs, classes = similar_counts(docs, *exact)
            links, members = jaccard.similar_lists(frame, "id", "items", t)
            wanted = {}
            for a, b in pairs:
                x, y = sorted((classes[a], classes[b]))
                wanted[x, y] = wanted.get((x, y), 0) + 1
            assert {(r["a"], r["b"]): r["pairs"] for r in links.collect()} == wanted
            assert {r["id"]: (r["class_id"], r["links"]) for r in members.collect()} == {k: (classes[k], sum(k in p for p in pairs)) for k in docs}
    finally:
        jaccard.BLOCK = jaccard_block


def test_search_lists_equals_brute_force(spark):
    import random
    from collections import Counter

    rng = random.Random(7)
    docs = list_docs(rng)
    asked = {f"d{i}": list(docs[f"d{i}"]) for i in range(3, 12)} | {"q1": list("abcabc"), "q2": None, "q3": ["zzz"], "q4": docs["d3"][::-1]}
    kind = "id string, items array<string>"
    found, members = jaccard.search_lists(spark.createDataFrame(list(asked.items()), kind), spark.createDataFrame(list(docs.items()), kind), "id", "items", "0.5")
    _, classes = similar_counts(docs, 1, 2)
    wanted = {}
    for q, x in asked.items():
        for k, y in docs.items():
            both = (Counter(x or []) & Counter(v for v in y or [] if v is not None)).total()
            if both and 2 * both >= len(x) + len(y) - both:
                wanted[q, classes[k]] = wanted.get((q, classes[k]), 0) + 1
    assert {(r["a"], r["b"]): r["records"] for r in found.collect()} == wanted
    assert {r["id"]: r["class_id"] for r in members.collect()} == classes


def test_many_copies_form_no_pairs(spark):
    rows = spark.range(1000).select(F.format_string("c%04d", "id").alias("id"), F.array(F.lit("a"), F.lit("b"), F.lit("a")).alias("items"))
    links, members = jaccard.similar_lists(rows, "id", "items", "0.8")
    assert [(r["a"], r["b"], r["pairs"]) for r in links.collect()] == [("c0000", "c0000", 999 * 500)]
    assert {(r["class_id"], r["links"]) for r in members.collect()} == {("c0000", 999)} and members.count() == 1000
    signed = rows.select("id", *[F.lit(7).cast("bigint").alias(w) for w in bits.WORDS])
    links, members = simhash.similar_signatures(signed, "id", simhash.build_block_index(signed, "id", "0.9"))
    assert [(r["a"], r["b"], r["pairs"]) for r in links.collect()] == [("c0000", "c0000", 999 * 500)] and members.count() == 1000
    none = rows.limit(0)
    assert all(x.count() == 0 for x in jaccard.similar_lists(none, "id", "items", "0.8"))


def test_sketches(spark):
    rows = spark.createDataFrame([("d", ["a b c d", None, "b c d e", "a b c d"]), ("n", None), ("e", []), ("m", [None]), (None, ["a"])], "doc_id string, shingles array<string>")
    found = minhash.sketches(rows, ["abcd", "WXYZ"]).collect()
    assert [r["doc_id"] for r in found] == ["d"]
    assert [h[:16] for h in found[0]["sketch"]] == ["5f2741415fd55132", "3f34c610a6889994"]
    assert len(set(minhash.salt_words(50))) == 50 and minhash.salt_words(3) == minhash.salt_words(50)[:3]
    same = spark.createDataFrame([(["a"] * 2 + ["b"], ["a", "b", "b"])], "p array<string>, q array<string>")
    assert same.select(minhash.sketch_similarity(F.col("p"), F.col("q")).alias("s")).first()["s"] == 0.5


def test_signatures(spark):
    rows = spark.createDataFrame([("one", ["a b c d"]), ("two", ["a b c d", "b c d e"]), ("none", []), ("null", None)], "id string, f array<string>")
    made = simhash.signatures(rows, "id", "f")
    found = {r["id"]: r["h"] for r in made.where("s0 is not null").select("id", bits.signature_hex([F.col(w) for w in bits.WORDS]).alias("h")).collect()}
    assert found["one"] == "f82ce1b653e30b1ceb5711bbf75965dd24513011d7daa48bbd8610550154a1fd" == hashlib.sha256(b"a b c d").hexdigest()
    assert found["two"] == "9020c124502200102a0611a0330100582451300197d2a00a1802100401008081"
    assert set(found) == {"one", "two"} and made.where("s0 is null").count() == 2


def test_blocks_and_permutations():
    assert [bits.block_count(t) for t in ("0.9", "0.8", "0.7", "0.6")] == [25, 51, 76, 102]
    assert bits.block_widths(26) == [10] * 22 + [9] * 4
    for t, tables in (("0.9", (26, 351)), ("0.8", (52, 1378))):
        assert tuple(len(bits.block_choices(t, b)[1]) for b in (1, 2)) == tables
    word, widths = "".join(str(i % 10) for i in range(256)), bits.block_widths(26)
    turned = bits.permute_bits(word, widths, bits.permutation(widths, (3,)))
    assert turned.startswith(word[30:40]) and sorted(turned) == sorted(word)


def signed(value):
    """The four words of a 256-bit number."""
    return [x - 2**64 if x >= 2**63 else x for x in ((value >> (192 - 64 * k)) & (2**64 - 1) for k in range(4))]


def test_blocks_grow_with_the_table():
    assert [bits.blocks_for(n, "0.9") for n in (1, 100, 10_000, 10**8)] == [1, 1, 2, 3]
    assert bits.blocks_for(10**6, "0.7") > bits.blocks_for(10**6, "0.9")


def test_block_search_finds_what_direct_comparison_finds(spark, tmp_path):
    """All thresholds and block numbers of the sweep; the index is written and opened again, hot keys are split."""
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(256) for _ in range(4)]
    values = base + base[:2] * 3 + [b ^ sum(1 << k for k in rng.sample(range(256), rng.randint(1, 80))) for b in base for _ in range(4)]
    schema = "doc_id string, s0 bigint, s1 bigint, s2 bigint, s3 bigint"
    frame = spark.createDataFrame([(f"d{i:03}", *signed(v)) for i, v in enumerate(values)] + [("none", None, None, None, None)], schema)
    asked = spark.createDataFrame([(f"q{i}", *signed(values[i] ^ i)) for i in range(5)] + [("nil", None, 1, 1, 1)], schema)
    simhash.BLOCK, kept = 3, simhash.BLOCK
    try:
        for t, m in (("0.9", 25), ("0.8", 51), ("0.7", 76)):
            first = {v: f"d{values.index(v):03}" for v in values}
            wanted = {}
            for i in range(5):
                for v in values:
                    if ((values[i] ^ i) ^ v).bit_count() <= m:
                        wanted[f"q{i}", first[v]] = wanted.get((f"q{i}", first[v]), 0) + 1
            direct = {}
            for r in simhash.hamming_search(asked, frame, "doc_id", t).collect():
                key = (r["a"], first[values[int(r["b"][1:])]])
                direct[key] = direct.get(key, 0) + 1
            assert direct == wanted
            for b in (1, 2, 3) if t == "0.9" else (1, 2):
                simhash.build_block_index(frame, "doc_id", t, b, f"{tmp_path}/{t}-{b}")
                index = simhash.open_block_index(spark, f"{tmp_path}/{t}-{b}")
                found = simhash.block_search(asked, index, "doc_id").collect()
                assert {(r["a"], r["b"]): r["records"] for r in found} == wanted and len(found) == len(wanted)
    finally:
        simhash.BLOCK = kept


def test_compat_similarity_ignores_shared_leading_zeros(spark):
    frame = spark.createDataFrame([(0, 0, 0, 7, 0, 0, 0, 7), (0, 0, 0, 119, 0, 0, 0, 113), (-1, 0, 0, 0, -1, 0, 0, 1)], ", ".join(f"{p}{k} bigint" for p in "ab" for k in range(4)))
    a, b = ([F.col(f"{p}{k}") for k in range(4)] for p in "ab")
    found = frame.select(bits.similarity(a, b).alias("s"), bits.similarity_compat(a, b).alias("c")).collect()
    assert [r["s"] for r in found] == [1.0, 1 - 2 / 256, 1 - 1 / 256]
    assert [r["c"] for r in found] == [3 / 256, 5 / 256, 255 / 256]


def test_codec_round_trip(spark):
    import random

    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 9):
        numbers = [rng.choice([0, 1, 255, 256, 65_535, 65_536, 2**24 - 1, 2**24, 2**32 - 1]) for _ in range(n)]
        assert codec.decode(codec.encode(numbers), n).tolist() == numbers
    assert codec.encode([1, 300, 70_000]) == bytes([0b00_01_10_00, 1, 44, 1, 0x70, 0x11, 1])
    for wrong in ([-1], [2**32]):
        with pytest.raises(ValueError):
            codec.encode(wrong)
    frame = spark.createDataFrame([([1, 300, 70_000],), (None,)], "x array<bigint>")
    back = frame.withColumn("b", codec.encode_column(F.col("x"))).withColumn("y", codec.decode_column(F.col("b"), F.size("x")))
    assert [r["y"] for r in back.collect()] == [[1, 300, 70_000], None]


def test_sketch_trials_equal_sketches_and_hash_each_shingle_once(spark, monkeypatch):
    import hashlib

    import pyarrow as pa

    salts = minhash.salt_words(20)
    docs = {f"d{i}": ([f"x{j}" for j in range(i, i + 12)], [f"x{j}" for j in range(i + 3, i + 15)], ["y"] * 1 + [f"x{j}" for j in range(i, i + 5)]) for i in range(4)}
    frame = spark.createDataFrame([(d, *sets) for d, sets in docs.items()] + [("empty", ["x"], [], ["x"])], "doc_id string, own array<string>, p array<string>, q array<string>")
    found = {(r["doc_id"], r["t"], r["k"]): (r["truth"], r["estimate"]) for r in minhash.sketch_trials(frame, salts, [3, 20], "own", {"0.9": "p", "0.5": "q"}).collect()}
    least = lambda part, k: [min(hashlib.sha256(f"{x} {w}".encode()).hexdigest() for x in part) for w in salts[:k]]
    wanted = {}
    for d, (own, *others) in docs.items():
        for t, part in zip(("0.9", "0.5"), others):
            for k in (3, 20):
                same = sum(a == b for a, b in zip(least(own, k), least(part, k)))
                wanted[d, t, k] = (len({*own} & {*part}) / len({*own} | {*part}), same / (2 * k - same))
    assert found == wanted
    hashed = []
    monkeypatch.setitem(minhash.FAMILIES, "sha256", lambda x=b"": hashed.append(x) or hashlib.sha256(x))
    batch = pa.record_batch([pa.array(list(docs)), pa.array([list(sets) for sets in docs.values()])], names=["doc_id", "_sets"])
    list(minhash._trial_kernel(salts, [3, 20], ["0.9", "0.5"], "sha256", "doc_id")(iter([batch])))
    distinct = {x for sets in docs.values() for part in sets for x in part}
    assert len([x for x in hashed if x]) == len(distinct) * len(salts)


def test_block_pairs_keep_few_rows_and_meet_in_groups_of_any_size(spark, monkeypatch):
    """What is stored doesn't grow with the choices of blocks; hot keys in many blocks and batches, and tiles, change nothing."""
    import random

    rng = random.Random(9)
    values = [rng.getrandbits(200) for _ in range(30)]  # the first blocks of all are 0
    values += [v ^ sum(1 << k for k in rng.sample(range(256), n)) for v, n in zip(values, [1, 24, 25, 26, 27, 3])]
    frame = spark.createDataFrame([(f"d{i:03}", *signed(v)) for i, v in enumerate(values)], "id string, s0 bigint, s1 bigint, s2 bigint, s3 bigint")
    wanted = {(f"d{i:03}", f"d{j:03}", (v ^ w).bit_count()) for i, v in enumerate(values) for j, w in enumerate(values) if i < j and (v ^ w).bit_count() <= 25}
    for block, tile, batch in ((20_000, 1_000_000, 10_000), (4, 7, 5)):
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "TILE", tile)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            index = simhash.build_block_index(frame, "id", "0.9")
            links = simhash.similar_signatures(frame, "id", index)[0].collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {(r["a"], r["b"], round(256 * (1 - r["similarity"]))) for r in links} == wanted and len(links) == len(wanted)
        # Before, a row per class and choice of blocks was stored.
        assert index.keys.count() < len(values)
        asked = frame.where("id >= 'd030'")
        found = simhash.block_search(asked, index, "id").collect()
        near = {(a, b) for x, y, _ in wanted for a, b in ((x, y), (y, x)) if a >= "d030"} | {(f"d{i:03}",) * 2 for i in range(30, 36)}
        assert {(r["a"], r["b"]) for r in found} == near and len(found) == len(near)


def test_counted_search_equals_brute_force_without_a_join(spark, monkeypatch):
    """Nulls, empty lists, repeats, and lists of many records; in one pass or several."""
    import random
    from collections import Counter

    rng = random.Random(8)
    docs = {f"d{i}": [rng.choice("aaabcdefgh") for _ in range(rng.randint(0, 9))] for i in range(40)} | {"null": None, "holes": ["a", None, "b", "c"]}
    asked = {d: docs[d] for d in ("d1", "d2", "d3", "d5", "holes", "null")} | {"q": ["a", "a", "b"], "none": []}
    near = lambda x, y, t: (both := sum((Counter(w for w in x if w) & Counter(w for w in y if w)).values())) and both / (len(x) + len(y) - both) >= t and both / (len(x) + len(y) - both)
    kind = "id string, items array<string>"
    left, right = (spark.createDataFrame(list(part.items()), kind) for part in (asked, docs))
    for t in ("0.5", "0.03"):
        wanted = {(a, b): s for a, x in asked.items() for b, y in docs.items() if x and y and (s := near(x, y, float(t)))}
        for queries in (100, 3):
            monkeypatch.setattr(jaccard, "PASS", queries)
            found = jaccard.counted_search(left, right, "id", "items", t)
            assert {(r["a"], r["b"]): r["similarity"] for r in found.collect()} == wanted and found.count() == len(wanted)
    # Before, records met the queries in a join.
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
    monkeypatch.setattr(jaccard, "HELD", 3)
    assert jaccard.counted_search(left, right, "id", "items", "0.5") is None


def test_number_sketches_are_the_heads_of_sketches(spark):
    frame = spark.createDataFrame([("a", ["x y", "z", None]), ("b", []), (None, ["x"]), ("c", ["q"])], "doc_id string, shingles array<string>")
    heads = {r["doc_id"]: [int(h[:16], 16) for h in r["sketch"]] for r in minhash.sketches(frame, minhash.salt_words(7)).collect()}
    found = {r["doc_id"]: [x % 2**64 for x in r["sketch"]] for r in minhash.number_sketches(frame, minhash.salt_words(7)).collect()}
    assert found == heads and set(found) == {"a", "c"}


def test_sketch_search_equals_sketches_and_hashes_only_records_that_can_be_similar(spark, monkeypatch):
    """Nulls, repeats, empty sets, copies, thresholds that are met exactly; in one pass or several."""
    import hashlib
    import random

    import pyarrow as pa

    rng, salts = random.Random(10), minhash.salt_words(9)
    docs = {f"d{i}": [rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 9))] for i in range(40)} | {f"far{i}": [f"x{i}", "y"] for i in range(5)}
    docs |= {"copy": docs["d1"], "holes": ["a", None, "b", "b"], "null": None, "none": [], None: ["a"]}
    asked = {d: docs[d] for d in ("d1", "d2", "d3", "holes", "null", "none", None)} | {"q": ["a", "b"]}
    least = {d: [min(hashlib.sha256(f"{x} {w}".encode()).digest() for x in part if x) for w in salts] for d, part in (docs | asked).items() if part and d}
    left, right = (spark.createDataFrame(list(part.items()), "doc_id string, shingles array<string>") for part in (asked, docs))
    for t, need in (("0.5", 6), ("0.2", 3), ("0", 1)):
        wanted = {(a, b): same / (18 - same) for a in asked if a in least for b in docs if b in least and (same := sum(x == y for x, y in zip(least[a], least[b]))) >= need}
        for queries in (100, 2):
            monkeypatch.setattr(minhash, "PASS", queries)
            found = minhash.sketch_search(left, right, salts, t).collect()
            assert {(r["a"], r["b"]): r["similarity"] for r in found} == wanted and len(found) == len(wanted)
    monkeypatch.setattr(minhash, "HELD", 3)
    assert minhash.sketch_search(left, right, salts, "0.5") is None
    # Before, every record was hashed with every salt.
    hashed = []
    monkeypatch.setitem(minhash.FAMILIES, "sha256", lambda x=b"": hashed.append(x) or hashlib.sha256(x))
    one = pa.table({"a": ["q"], "sketch": pa.array([[int.from_bytes(h[:8], signed=True) for h in least["q"]]], pa.list_(pa.int64())), "least": [[min("ab", key=lambda x: hashlib.sha256(f"{x} {w}".encode()).digest()) for w in salts]]})  # noqa: B023
    shared = type("Shared", (), {"value": minhash._by_shingle(one, len(salts))})
    batch = pa.record_batch([pa.array(["far", "near"]), pa.array([["x", "y", "z"], ["b", "a"]])], names=["doc_id", "_set"])
    found = pa.Table.from_batches(minhash._partner_kernel(shared, salts, 6, "sha256", "doc_id")(iter([batch]))).to_pylist()
    assert found == [{"q": 0, "b": "near", "similarity": 1.0}] and {x[:1] for x in hashed if x} == {b"a", b"b"}


def test_hashes_of_shingles_are_kept_from_task_to_task(monkeypatch):
    """Before, every task hashed again what the one before it in the same worker had hashed."""
    import hashlib

    import pyarrow as pa

    hashed = []
    monkeypatch.setitem(minhash.FAMILIES, "counted", lambda x=b"": hashed.append(x) or hashlib.sha256(x))
    kernel = minhash._trial_kernel(minhash.salt_words(20), [3, 20], ["1", "0.5"], "counted", "doc_id")
    sets = [[["a b", "b c", "c d"], ["a b", "b c", "c d"], ["x b", "b c", "c d"]]]
    task = lambda: [b.to_pydict() for b in kernel(iter([pa.record_batch([["d"], sets], names=["doc_id", "_sets"])]))]
    first, n = task(), len(hashed)
    assert n >= 4 * 20 and task() == first and len(hashed) == n
    plain = minhash._kernel(minhash.salt_words(20), "sha256", "doc_id")
    own, other = (next(plain(iter([pa.record_batch([["d"], [x]], names=["doc_id", "_set"])]))).to_pydict()["sketch"][0] for x in (sets[0][0], sets[0][2]))
    same = sum(a == b for a, b in zip(own, other))
    assert first[0]["estimate"] == [1.0, 1.0, sum(a == b for a, b in zip(own[:3], other[:3])) / (6 - sum(a == b for a, b in zip(own[:3], other[:3]))), same / (40 - same)]
