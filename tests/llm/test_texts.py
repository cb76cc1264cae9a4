import os
import random
import re
import shutil
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import leakage, mixture, quality

DOCS = "doc_id bigint, text string, item_id string"


def docs(spark, texts, partitions=1):
    return spark.createDataFrame([(i, t, "clash") for i, t in texts], DOCS).repartition(partitions)


def grams(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def words_of(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", (text or "").replace("\u00ad", "").replace("\u200b", ""))]


def brute_matches(documents, items, width=4, slop=2):
    """{(item, doc): (windows, near, of_windows, longest)} by looking at every place of every document."""
    texts = {d: words_of(t) for d, t in documents if d is not None and t is not None}
    frequency = Counter(w for words in texts.values() for w in words)
    found = {}
    for i, text in items:
        a = words_of(text)
        own = set(grams(a, width))
        for d, b in texts.items():
            held = own & set(grams(b, width))
            near = set()
            for g in own:
                k = min(range(width), key=lambda k: (frequency[g[k]], k))
                for p in (p for p, w in enumerate(b) if w == g[k]):
                    if all(g[j] in b[max(0, p + j - k - slop) : max(0, p + j - k + slop + 1)] for j in range(width)):
                        near.add(g)
            longest = max((n for n in range(width, len(a) + 1) if set(grams(a, n)) & set(grams(b, n))), default=0)
            if near:
                found[i, d] = (len(held), len(near), len(own), longest)
    return found


def kinds(matches, phrase=10):
    return {k: "phrase" if n >= phrase or 2 * held >= of else "proximity" for k, (held, near, of, n) in matches.items() if n >= phrase or 2 * near >= of}


def leak_tables():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(12)] + [f"r{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))) for i in range(30)] + [(99, None), (98, ""), (97, "a b c"), (96, "x y x y x y x")]
    texts = []
    for d in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.7:
            source = words_of(rng.choice(items[:30])[1])
            a = rng.randint(0, len(source) // 2)
            part = source[a : a + rng.randint(4, 24)]
            if d % 3 == 1:  # small edits: words put in, left out, swapped
                for k in range(3, len(part), 4):
                    part[k : k + 1] = rng.choice([[part[k], "new"], [], ["new", part[k]], part[k : k + 1]])
            words[5:5] = part
        texts.append((d, rng.choice([" ", ", ", "\n"]).join(words).upper()))
    return texts + [(200, None), (201, ""), (202, "soft\u00adware a\u200bb"), (203, "x y"), (204, "X y x y! x y x")], items


@pytest.mark.parametrize("batch", [3, 10_000])
def test_leaks_equal_brute_force(spark, monkeypatch, tmp_path, batch):
    texts, items = leak_tables()
    if batch == 3:  # small pieces give the same
        for name, n in (("CANDIDATES", 7), ("BLOCK", 4)):
            monkeypatch.setattr(leakage, name, n)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        leakage.positional_index(docs(spark, texts, 3)).write.parquet(f"{tmp_path}/index")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    index, table = spark.read.parquet(f"{tmp_path}/index"), spark.createDataFrame(items, "item_id bigint, text string")
    wanted = brute_matches(texts, items)
    rows = leakage.probe_index(index, table).collect()
    found = {(r["item_id"], r["doc_id"]): (r["windows"], r["near"], r["of_windows"], r["longest"]) for r in rows}
    assert len(found) == len(rows) and found == wanted
    named = {(r["item_id"], r["doc_id"]): r["match"] for r in leakage.leaked_items(index, table).collect()}
    assert named == kinds(wanted) and set(named.values()) == {"phrase", "proximity"}
    exact = leakage.probe_index(index, table, slop=0).where("near <> windows").count()
    assert exact == 0


def test_stored_index_serves_other_items_without_the_texts(spark, monkeypatch, tmp_path):
    texts = [(k, f"say: One two THREE four five {k} six seven!") for k in range(10)]
    spark.createDataFrame(texts, DOCS.removesuffix(", item_id string")).write.parquet(f"{tmp_path}/documents")
    leakage.positional_index(spark.read.parquet(f"{tmp_path}/documents")).write.parquet(f"{tmp_path}/index")
    shutil.rmtree(f"{tmp_path}/documents")
    index = spark.read.parquet(f"{tmp_path}/index")
    for n, text in ((8, "one two three four five {} six seven"), (5, "other words say one two three four {}")):
        items = [(i, text.format(i)) for i in range(n)]
        wanted = kinds(brute_matches(texts, items))
        table = spark.createDataFrame(items, "item_id bigint, text string")
        assert {(r["item_id"], r["doc_id"]): r["match"] for r in leakage.leaked_items(index, table).collect()} == wanted and wanted
        monkeypatch.setattr(leakage, "ITEM_CHARS", 50)  # several portions
        assert {(r["item_id"], r["doc_id"]): r["match"] for r in leakage.leaked_items(index, table).collect()} == wanted
        monkeypatch.undo()


def test_leaks_of_nothing_and_repeats(spark, tmp_path):
    def leaks(texts, items):
        name = f"{tmp_path}/{len(os.listdir(tmp_path))}"
        leakage.positional_index(docs(spark, texts, 2)).write.parquet(name)
        return sorted((r["item_id"], r["doc_id"]) for r in leakage.leaked_items(spark.read.schema(leakage.SHARD).parquet(name), spark.createDataFrame(items, "item_id bigint, text string")).collect())

    assert leaks([(1, "a b c d")], []) == []
    assert leaks([], [(1, "a b c d")]) == []
    assert leaks([(None, "a b c d"), (2, None)], [(1, "a b c d"), (None, "a b c d")]) == []
    # Repeated documents and items count once; of an item's rows the longest text.
    assert leaks([(1, "a b c d")] * 3, [(1, "a b c d"), (1, "a b"), (1, "a b c d")]) == [(1, 1)]
    assert leaks([(1, "a b c d"), (2, "a b")], [(1, "x"), (1, "a b c d")]) == [(1, 1)]


def test_statistics_and_faults(spark):
    common = spark.createDataFrame([("en", "The"), ("de", "und"), ("en", None), ("fr", "the")], "lang string, word string")
    texts = [(1, None), (2, ""), (3, "The caté und x2."), (4, "ab\r\n\n c d! \t\nxyz?\n\"q\"\n"), (5, "★★ a­")]
    found = {r["doc_id"]: r.asDict() for r in quality.text_statistics(docs(spark, texts), common).collect()}
    assert set(found) == {2, 3, 4, 5}
    assert [found[2][c] for c in ("n_words", "letters", "chars", "symbols", "n_lines", "ended", "n_common")] == [0] * 7
    assert [found[3][c] for c in ("n_words", "letters", "chars", "symbols", "n_lines", "ended", "n_common")] == [4, 12, 16, 1, 1, 1, 2]
    assert [found[4][c] for c in ("n_words", "letters", "symbols", "n_lines", "ended")] == [5, 8, 4, 4, 3]
    assert found[5]["symbols"] == 3
    rows = spark.createDataFrame(
        [(1, 14, 1, 99, 99, 9, 0, 0), (2, 20, 160, 200, 40, 5, 2, 3), (3, 20, 161, 200, 41, 5, 1, 2), (4, 20, 59, 10, 0, 3, 0, 20)],
        "doc_id int, n_words bigint, letters bigint, chars bigint, symbols bigint, n_lines bigint, ended bigint, n_common bigint",
    )
    assert {r["doc_id"]: r["faults"] for r in rows.select("doc_id", quality.faults().alias("faults")).collect()} == {1: ["short"], 2: [], 3: ["wordlen", "symbols", "lineends", "common"], 4: ["wordlen"]}


def test_long_word_lists_are_joined(spark, monkeypatch):
    common = spark.createDataFrame([("en", "a"), ("en", "b")], "lang string, word string")
    frame = docs(spark, [(1, "a b a c"), (1, "a"), (2, "x"), (3, "")])
    wanted = sorted(map(tuple, quality.text_statistics(frame, common).collect()))
    monkeypatch.setattr(quality, "INLINE_WORDS", 1)
    assert sorted(map(tuple, quality.text_statistics(frame, common).collect())) == wanted


def test_votes_recover_classes():
    rng = np.random.default_rng(1)
    types = ("prose", "list", "noise")
    rules = {"a": (quality.Level("", ("list",)),), "b": (quality.Level("", ("noise",)), quality.Level("", ("list",))), "c": (quality.Level("", ("noise",)),), "d": (quality.Level("", ("list", "noise")),)}
    chances = [[[0.97, 0.03], [0.2, 0.8], [0.9, 0.1]], [[0.9, 0.05, 0.05], [0.3, 0.1, 0.6], [0.2, 0.7, 0.1]], [[0.95, 0.05], [0.9, 0.1], [0.1, 0.9]], [[0.98, 0.02], [0.3, 0.7], [0.3, 0.7]]]
    truth = rng.choice(3, 20_000, p=[0.7, 0.2, 0.1])
    votes = np.stack([(rng.random(len(truth))[:, None] > np.cumsum(np.array(c), axis=1)[truth]).sum(axis=1) for c in chances], axis=1)
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_votes(rows, counts.astype(float), quality.first_guess(rules, types))
    assert np.abs(model.share - [0.7, 0.2, 0.1]).max() < 0.03
    assert max(np.abs(a - np.array(b)).max() for a, b in zip(model.chances, chances)) < 0.06
    assert (model.posterior(votes).argmax(axis=1) == truth).mean() > 0.93
    # The same fit over single rows instead of counted patterns.
    alone = quality.fit_votes(votes[:2000], np.ones(2000), quality.first_guess(rules, types), rounds=20)
    rows, counts = np.unique(votes[:2000], axis=0, return_counts=True)
    again = quality.fit_votes(rows, counts.astype(float), quality.first_guess(rules, types), rounds=20)
    assert np.abs(alone.share - again.share).max() < 1e-9


def test_patterns_are_digits(spark):
    rows = spark.createDataFrame(
        [(1, 20, 59, 10, 0, 3, 0, 0, 0, 0, 20), (2, 20, 161, 200, 41, 5, 1, 0, 0, 5, 2), (3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)],
        "doc_id int, n_words bigint, letters bigint, chars bigint, symbols bigint, n_lines bigint, ended bigint, marked bigint, celled bigint, keyed bigint, n_common bigint",
    )
    found = rows.select("doc_id", quality.vote_pattern().alias("p")).orderBy("doc_id").collect()
    votes = quality.digits(np.array([r["p"] for r in found]), [len(x) + 1 for x in quality.RULES.values()])
    assert votes.tolist() == [[1, 0, 0, 0, 0, 0, 0], [2, 1, 1, 1, 0, 0, 1], [0, 0, 0, 0, 0, 0, 0]]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_types_separate_prose_from_the_rest(spark):
    """Against what can be told from the texts themselves: raw records, marked lists, rows of cells, symbol runs, hashes, spaced letters."""
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").collect()}
    found = {r["doc_id"]: r for r in quality.text_types(quality.text_statistics(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/common_words.parquet"))).collect()}
    assert set(found) == set(texts)
    wanted = {}
    for d, text in texts.items():
        lines = [x for x in text.split("\n") if x.strip()]
        share = lambda shape: sum(bool(re.search(shape, x)) for x in lines) / max(1, len(lines))  # noqa: B023, E731
        if text.count("review/score:") and share(r"^\w+/\w+: ") >= 0.5:
            wanted[d] = "record"
        elif len(lines) >= 4 and share(r"^.[^.!?]*( \| | {2,}|[,;])\S+(( \| | {2,}|[,;])\S+)+$") >= 0.8:
            wanted[d] = "table"
    assert len(wanted) > 20
    assert sum(found[d]["kind"] == kind for d, kind in wanted.items()) >= 0.9 * len(wanted)
    faulty = {d for d, r in found.items() if set(r["faults"]) & {"wordlen", "symbols", "common"}} | set(wanted)
    apart = {d for d, r in found.items() if r["kind"] != "prose"}
    assert len(faulty & apart) >= 0.95 * len(faulty)
    long = {d for d in apart if "short" not in found[d]["faults"]}
    assert len({d for d in long if found[d]["faults"]} | (long & set(wanted))) >= 0.95 * len(long)
    assert {r["kind"] for r in found.values()} == set(quality.TYPES)


def test_types_of_nothing(spark):
    none = quality.text_statistics(docs(spark, []), spark.createDataFrame([], "lang string, word string"))
    assert quality.text_types(none).count() == 0


def test_plan_copies_and_redistribution():
    plan = {x.path: x for x in mixture.plan_mixture([(("a",), Fraction(1, 2), 100, 3), (("b",), Fraction(1, 2), 500, 2), (("c",), Fraction(0), 50, 2), (("d",), Fraction(1, 4), 0, 2)])}
    assert [plan[(k,)].epochs for k in "abcd"] == [3, 1, 0, 0]  # targets 260, 260, 0, 130
    assert plan[("a",)].budget + plan[("b",)].budget == 650 and plan[("a",)].budget == 300
    tree = [(("x", "p"), Fraction(2, 5), 10, 1), (("x", "q"), Fraction(1, 5), 1000, 5), (("y", "r"), Fraction(2, 5), 1000, 5)]
    plan = {x.path[1]: x.budget for x in mixture.plan_mixture(tree)}
    assert plan == {"p": 10, "q": 402 + 804 - 10, "r": 804}  # the shortage stays with the sibling
    assert mixture.plan_mixture([]) == []


def mix_tables(spark, n=400):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["EN ", "en", None, "de"]), rng.choice([" Big-Web", "big-web", "big-web ", "Small-wire", "other-web", None])) for i in range(n)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    targets = spark.createDataFrame([("big-web", 0.4, 1), ("small-wire ", 0.5, 3), ("absent", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    return rows, documents, targets


def test_copies(spark):
    rows, documents, targets = mix_tables(spark)
    size = defaultdict(int)
    for _, text, _, source in rows:
        size[(source or "").strip().lower()] += len(text.split())
    total = size["big-web"] + size["small-wire"]
    found = {r["source"]: r["copies"] for r in mixture.mix_copies(documents, targets).collect()}
    assert found == {"big-web": min(1, -(-4 * total // (10 * size["big-web"]))), "small-wire": min(3, -(-5 * total // (10 * size["small-wire"]))), "absent": 0}
    assert {r["copies"] for r in mixture.mix_copies(documents.limit(0), targets).collect()} == {0}


@pytest.mark.parametrize("bins", [4, 4096])
def test_prefixes_equal_brute_force(spark, monkeypatch, bins):
    monkeypatch.setattr(mixture, "BINS", bins)
    _, documents, targets = mix_tables(spark)
    sized = documents.where("source is not null").select("doc_id", F.lit("web").alias("domain"), F.lit("en").alias("lang"), mixture.source_name(F.col("source")).alias("source"), mixture.word_count(F.col("text")).alias("size"))
    plan = mixture.mixture(sized, targets, ["domain", "lang"])
    found = {r["doc_id"]: r["copies"] for r in mixture.select_mixture(sized, plan, seed=5).collect()}
    wanted = {}
    for leaf in plan:
        if not leaf.size or not leaf.budget:
            continue
        epochs, rest = divmod(leaf.budget, leaf.size)
        rows = sized.where(F.col("source") == leaf.path[-1]).withColumn("o", F.xxhash64(F.lit(5), F.lit(epochs).cast("bigint"), "doc_id")).collect()
        key = lambda r: (r["o"] % 2**64 if bins else 0, r["doc_id"])
        done = 0
        for r in sorted(rows, key=key):
            done += r["size"]
            wanted[r["doc_id"]] = epochs + (done <= rest)
    assert found == {d: n for d, n in wanted.items() if n}


def planned(leaves):
    """Budgets by water-filling over (path, weight, size, cap): a plainer way than the operator's, by fixed point over the levels."""
    weights, total = sum(w for _, w, _, _ in leaves), sum(s for _, _, s, _ in leaves)
    budget = [min(w / weights * total, s * c) for _, w, s, c in leaves]
    short = {i: w / weights * total - b for i, ((_, w, _, _), b) in enumerate(zip(leaves, budget))}
    for depth in (2, 1, 0):  # shortages go to siblings, then to the siblings of ancestors
        for top in {path[:depth] for path, *_ in leaves}:
            inside = [i for i, (path, *_) in enumerate(leaves) if path[:depth] == top]
            rest = sum(short[i] for i in inside)

            def pour(members, amount, level):
                names = {}
                for i in members:
                    names.setdefault(leaves[i][0][level], []).append(i)
                while amount > 0:
                    room = {n: sum(leaves[i][2] * leaves[i][3] - budget[i] for i in m) for n, m in names.items()}
                    open_ = {n: sum(leaves[i][1] for i in m) for n, m in names.items() if room[n] > 0 and sum(leaves[i][1] for i in m) > 0}
                    if not open_:
                        return amount
                    left = Fraction(0)
                    for n, w in open_.items():
                        part = amount * w / sum(open_.values())
                        if level == 2:
                            given = min(part, room[n])
                            budget[names[n][0]] += given
                            left += part - given
                        else:
                            left += pour(names[n], part, level + 1)
                    if left == amount:
                        return amount
                    amount = left
                return amount

            rest = pour(inside, rest, depth)
            for i in inside:
                short[i] = Fraction(0)
            short[inside[0]] = rest
    return {leaf[0]: int(b) for leaf, b in zip(leaves, budget)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_shares_of_the_test_tables_equal_brute_force(spark, sf):
    """p7_shares and p7_mix from the raw tables without Spark: tokens, tree, budgets, seeded prefixes."""
    import pandas as pd

    from lexiloom.llm.queries import QUERIES

    kernel = mixture._tokenizer(mixture.TOKENIZER)
    name = lambda x: x.strip(" \t\r\n").lower()
    rows = [r for r in pd.read_parquet(f"{sf}/documents.parquet").astype(object).where(lambda x: x.notna(), None).to_dict("records") if r["source"] is not None]
    leaf_of = {r["doc_id"]: (name(r["source"]).split("-")[-1], name(r["lang"]) if r["lang"] is not None else "und", name(r["source"])) for r in rows}
    size = {r["doc_id"]: len(kernel.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows}
    targets = {}
    for r in pd.read_parquet(f"{sf}/mix_targets.parquet").to_dict("records"):
        if isinstance(r["source"], str):
            share, cap = targets.get(name(r["source"]), (Fraction(0), 0))
            targets[name(r["source"])] = (share + Fraction(str(r["target_share"])), max(cap, int(r["max_repeats"])))
    sizes = Counter()
    for d, leaf in leaf_of.items():
        sizes[leaf] += size[d]
    of = Counter()
    for leaf, n in sizes.items():
        of[leaf[-1]] += n
    leaves = [(leaf, targets[leaf[-1]][0] * Fraction(n, of[leaf[-1]]) if of[leaf[-1]] else Fraction(0), n, targets[leaf[-1]][1]) for leaf, n in sorted(sizes.items()) if leaf[-1] in targets]
    leaves += [(("", "", s), w, 0, c) for s, (w, c) in targets.items() if not of[s]]
    budget = planned(leaves)
    order = {r["doc_id"]: r for r in spark.createDataFrame([(d, budget.get(leaf_of[d], 0) // (sizes[leaf_of[d]] or 1)) for d in size], "doc_id bigint, e bigint").withColumn("o", F.xxhash64(F.lit(1), "e", "doc_id")).collect()}
    used, done = {}, Counter()
    for d in sorted(size, key=lambda d: (order[d]["o"] % 2**64, d)):
        leaf = leaf_of[d]
        if budget.get(leaf) and sizes[leaf]:
            done[leaf] += size[d]
            used[d] = order[d]["e"] + (done[leaf] <= budget[leaf] % sizes[leaf])
    used = {d: n for d, n in used.items() if n}
    assert {r["doc_id"]: (r["size"], r["copies"]) for r in QUERIES["p7_mix"](spark, sf).collect()} == {d: (size[d], n) for d, n in used.items()}
    tokens = Counter()
    for d, n in used.items():
        tokens[leaf_of[d][-1]] += size[d] * n
    found = {r["source"]: (r["target_share"], r["tokens"], r["share"]) for r in QUERIES["p7_shares"](spark, sf).collect()}
    total, weights = sum(tokens.values()), sum(w for w, _ in targets.values())
    assert {s: x[1] for s, x in found.items()} == {s: tokens[s] for s in targets}
    assert all(abs(x[0] - float(targets[s][0] / weights)) < 1e-6 and abs(x[2] - tokens[s] / total) < 1e-6 for s, x in found.items())


def test_shares_are_reported(spark):
    _, documents, targets = mix_tables(spark)
    sized = mixture.sized_documents(documents)
    plan = mixture.mixture(sized, targets, ["domain", "lang"])
    chosen = mixture.select_mixture(sized, plan)
    found = {r["source"]: r for r in mixture.reached_shares(chosen, targets).collect()}
    assert set(found) == {"big-web", "small-wire", "absent"} and found["absent"]["tokens"] == 0
    assert abs(sum(r["share"] for r in found.values()) - 1) < 1e-5
    assert mixture.reached_shares(chosen.limit(0), targets).where("tokens > 0").count() == 0


def test_token_sizes_are_of_whole_texts(spark):
    frame = docs(spark, [(1, None), (2, ""), (3, "a cat"), (4, "a cat " * 2000), (5, "<|endoftext|>")])
    found = {r["doc_id"]: r["size"] for r in mixture.token_sizes(frame, ["doc_id"], "text").collect()}
    assert found[1] == found[2] == 0 and found[3] == 2 and found[4] >= 4000 and found[5] > 1
