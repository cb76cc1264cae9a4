import os

import pytest

from lexiloom.operators import evaluate
from lexiloom.plans import sized, skew, storage
from lexiloom.sources import store


class Elsewhere:
    """A session on a cluster, without a shared folder."""

    class conf:
        get = staticmethod(lambda name, default=None: default)

    class sparkContext:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_no_local_folder_on_a_cluster():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        Elsewhere.sparkContext.master = master
        with pytest.raises(RuntimeError):
            storage.shared_dir(Elsewhere)
    Elsewhere.sparkContext.getCheckpointDir = staticmethod(lambda: "hdfs://x/y/")
    assert storage.shared_dir(Elsewhere) == "hdfs://x/y"


def test_a_scope_leaves_nothing_behind(spark):
    kept = storage.materialize(spark.range(3), "kept")
    root = storage._root(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(root))
    with storage.scope(spark):
        assert storage.materialize(spark.range(5), "gone").count() == 5
        assert len(os.listdir(root)) == len(before) + 1
    assert set(os.listdir(root)) == before and kept.count() == 3


@pytest.mark.parametrize("keys", [0, 1, 5])
def test_salted_join_equals_join(spark, keys):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(200)] + [(999, None)], "id int, k string")
    other = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("none", 4), (None, 5)], "k string, v int")
    counts = big.groupBy("k").count()
    for how in ("inner", "left", "left_semi"):
        found = skew.salted_join(big, other, "k", "id", counts, "count", how, cap=10, keys=keys)
        wanted = big.join(other, "k", how)
        assert sorted(map(repr, found.select(wanted.columns).collect())) == sorted(map(repr, wanted.collect()))


def test_large_batches_take_the_salted_way(spark, monkeypatch):
    big = spark.createDataFrame([(i, f"k{i % 5}") for i in range(50)], "id int, k string")
    side = spark.createDataFrame([("k1",), ("k2",)], "k string")
    counts = big.groupBy("k").count()
    wanted = sorted(r["id"] for r in sized.met_with(big, side, side, "k", "id", counts, "count", "left_semi").collect())
    monkeypatch.setattr(sized, "ROWS", 1)
    again = spark.createDataFrame([("k1",), ("k2",)], "k string")
    assert not sized.is_small(again)
    assert sorted(r["id"] for r in sized.met_with(big, again, again, "k", "id", counts, "count", "left_semi").collect()) == wanted


def test_sizes_and_times(spark, tmp_path):
    frame = spark.createDataFrame([(1, "ab"), (2, None)], "i int, t string")
    assert [tuple(r) for r in evaluate.table_sizes({"x": frame, "y": spark.range(3)}).orderBy("name").collect()] == [("x", 2, 2), ("y", 3, 0)]
    times = evaluate.query_times(spark, {"a": lambda: frame, "b": lambda: spark.range(4)})
    assert [(r["name"], r["rows"]) for r in times.orderBy("name").collect()] == [("a", 2), ("b", 4)]
    total = evaluate.total_time(times).first()
    assert total["queries"] == 2 and total["seconds"] > 0
    store.save_table(frame, f"{tmp_path}/set/one")
    found = store.stored_bytes(spark, f"{tmp_path}/set").collect()
    assert [r["name"] for r in found] == ["one"] and found[0]["bytes"] > 0


def test_salts_are_stored_with_sketches(spark, tmp_path):
    from lexiloom.operators import minhash

    docs = spark.createDataFrame([("a", ["x y", "y z"])], "doc_id string, shingles array<string>")
    store.save_sketches(minhash.sketches(docs, ["one", "two"], "md5"), ["one", "two"], "md5", f"{tmp_path}/s")
    sketches, salts, family = store.open_sketches(spark, f"{tmp_path}/s")
    assert (salts, family) == (["one", "two"], "md5")
    assert sketches.first()["sketch"] == minhash.sketches(docs, salts, family).first()["sketch"]
