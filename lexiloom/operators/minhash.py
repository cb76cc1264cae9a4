"""MinHash sketches of shingle sets, with stored salts and a choice of hashes."""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.barrier import with_once
from ..plans.storage import materialize

#: Hash families by name; the bytes of a digest compare as the numbers they spell.
FAMILIES = {"sha256": hashlib.sha256, "sha512": hashlib.sha512, "md5": hashlib.md5}

#: Shingles whose hashes a worker keeps from task to task; at 200 salts they take about 120 MB.
KEPT = 65_536
#: Least hashes of a batch of queries, at most, whose shingles every task holds; queries of a pass.
HELD, PASS = 4_000_000, 16_384


def salt_words(k: int, version: int = 1, letters: int = 4) -> list[str]:
    """k words of ASCII letters, the same for the same version, so sketches stay comparable."""
    found = []
    for i in range(k):
        digest = hashlib.sha256(f"salt {version} {i}".encode()).digest()
        found.append("".join(string.ascii_letters[b % 52] for b in digest[:letters]))
    return found


def _kernel(salts: list[str], family: str, id_col: str):
    words, digest = [b" " + w.encode() for w in salts], FAMILIES[family]

    def sketch(shingles: list[str]) -> list[str]:
        plain = [x.encode() for x in shingles]
        return [min(digest(x + w).digest() for x in plain).hex() for w in words]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                found = [sketch(row) for row in part.column("_set").to_pylist()]
                yield pa.record_batch([part.column(id_col), pa.array(found, pa.list_(pa.string()))], names=[id_col, "sketch"])

    return kernel


def sketches(records: DataFrame, salts: list[str], family: str = "sha256", id_col: str = "doc_id", set_col: str = "shingles") -> DataFrame:
    """(id, sketch): for each salt the least hash of "shingle salt" over a record's shingles, in hexadecimal digits.

    ``set_col`` is an array of shingles; repeats and nulls in it don't matter.
    A record's minima come from its own array, so nothing is shuffled or
    sorted.  Records without shingles have no row, nor have null ids.
    """
    kind = records.schema[id_col].dataType.simpleString()
    rows = with_once(records.where(F.col(id_col).isNotNull()).select(id_col, set_col), "_set", F.array_compact(F.col(set_col))).where("size(_set) > 0")
    return rows.select(id_col, "_set").mapInArrow(_kernel(salts, family, id_col), f"`{id_col}` {kind}, sketch array<string>")


@lru_cache(1)
def _numbers(salts: tuple[str, ...], family: str) -> Callable[[str], np.ndarray]:
    """The first 64 bits of a shingle's hash with each salt; those of the shingles seen last are kept."""
    words, digest = [b" " + w.encode() for w in salts], FAMILIES[family]
    step = digest().digest_size // 8

    def numbers(shingle: str) -> np.ndarray:
        x = shingle.encode()
        return np.frombuffer(b"".join([digest(x + w).digest() for w in words]), ">u8")[::step].astype(np.uint64)

    return lru_cache(KEPT)(numbers)


def number_sketches(records: DataFrame, salts: list[str], family: str = "sha256", id_col: str = "doc_id", set_col: str = "shingles") -> DataFrame:
    """(id, sketch) as ``sketches`` gives it, of the first 64 bits of each hash as a number: enough to compare by, an eighth as long."""
    kind = records.schema[id_col].dataType.simpleString()
    rows = records.where(F.col(id_col).isNotNull()).select(id_col, F.array_compact(F.col(set_col)).alias("_set")).where("size(_set) > 0")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _numbers(tuple(salts), family)
        for batch in batches:
            found = [np.minimum.reduce([numbers(x) for x in row]).view(np.int64) for row in batch.column("_set").to_pylist()]
            yield pa.record_batch([batch.column(id_col), pa.array(found, pa.list_(pa.int64()))], names=[id_col, "sketch"])

    return rows.mapInArrow(kernel, f"`{id_col}` {kind}, sketch array<bigint>")


def _asked_kernel(salts: list[str], family: str, id_col: str):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, k = _numbers(tuple(salts), family), np.arange(len(salts))
        for batch in batches:
            sketch, least = [], []
            for row in batch.column("_set").to_pylist():
                table = np.array([numbers(x) for x in row])
                at = table.argmin(axis=0)
                sketch.append(table[at, k].view(np.int64))
                least.append([row[i] for i in at])
            yield pa.record_batch([batch.column(id_col), pa.array(sketch, pa.list_(pa.int64())), pa.array(least, pa.list_(pa.string()))], names=["a", "sketch", "least"])

    return kernel


def _by_shingle(asked: pa.Table, k: int) -> tuple:
    """The sketches of queries, and the shingles of their least hashes: of the i-th, queries and numbers of hashes from starts[i] on."""
    sketches = asked.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, k)
    shingle = asked.column("least").combine_chunks().flatten().dictionary_encode()
    n = max(1, len(sketches))
    pairs, times = np.unique(shingle.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(len(sketches)), k), return_counts=True)
    starts = np.flatnonzero(np.diff(pairs // n, prepend=-1))
    return sketches, shingle.dictionary.take(pa.array(pairs[starts] // n)).to_pylist(), starts, pairs % n, times


def _partner_kernel(shared, salts: list[str], need: int, family: str, id_col: str):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _numbers(tuple(salts), family)
        sketches, shingles, starts, query, times = shared.value
        held = dict(zip(shingles, zip(starts.tolist(), [*starts[1:].tolist(), len(query)])))
        for batch in batches:
            places, asked, same = [], [], []
            for i, row in enumerate(batch.column("_set").to_pylist()):
                met = [held[x] for x in set(row) if x in held]
                if not met:
                    continue
                most = np.bincount(np.concatenate([query[lo:hi] for lo, hi in met]), np.concatenate([times[lo:hi] for lo, hi in met]))
                near = np.flatnonzero(most >= need)
                if len(near):
                    both = (sketches[near] == np.minimum.reduce([numbers(x) for x in row]).view(np.int64)).sum(axis=1)
                    near, both = near[both >= need], both[both >= need]
                    places.append(np.full(len(near), i))
                    asked.append(near)
                    same.append(both)
            if places:
                both = np.concatenate(same)
                ids = batch.column(id_col).take(pa.array(np.concatenate(places)))
                yield pa.record_batch([pa.array(np.concatenate(asked), pa.int64()), ids, pa.array(both / (2 * len(salts) - both), pa.float64())], names=["q", "b", "similarity"])

    return kernel


def sketch_search(queries: DataFrame, records: DataFrame, salts: list[str], threshold, family: str = "sha256", id_col: str = "doc_id", set_col: str = "shingles") -> DataFrame | None:
    """(a, b, similarity) of every query and every record whose sketches have at least the similarity, or None if the queries have more than HELD hashes.

    A record can have a least hash of a query only if it has that hash's
    shingle.  So every task counts for each query how many of its least hashes
    have their shingle in the record, and only a record that has enough of some
    query's is hashed and compared; the others can't be similar.  Nothing of the
    records is shuffled or stored.  Hashes are compared by their first 64 bits;
    salts are distinct and equally long, so those of different salts are never
    equal.  Records and queries without shingles or with null ids have no row.
    """
    if len(set(salts)) < len(salts) or len({len(w) for w in salts}) > 1:
        raise ValueError("salts are distinct and equally long")
    spark, t, k = queries.sparkSession, Fraction(str(threshold)), len(salts)
    need = max(1, -(-2 * k * t.numerator // (t.denominator + t.numerator)))
    sets = lambda rows: rows.where(F.col(id_col).isNotNull()).select(id_col, F.array_compact(F.col(set_col)).alias("_set")).where("size(_set) > 0")
    asked_kind, kind = (rows.schema[id_col].dataType.simpleString() for rows in (queries, records))
    asked = materialize(sets(queries).mapInArrow(_asked_kernel(salts, family, id_col), f"a {asked_kind}, sketch array<bigint>, least array<string>"), "asked")
    n = asked.count()
    if n * k > HELD:
        return None
    found, passes = None, max(1, -(-n // PASS))
    for at in range(passes):
        part = asked.where(F.pmod(F.xxhash64("a"), F.lit(passes)) == at).toArrow()
        shared = spark.sparkContext.broadcast(_by_shingle(part, k))
        met = sets(records).mapInArrow(_partner_kernel(shared, salts, need, family, id_col), f"q bigint, b {kind}, similarity double")
        names = spark.createDataFrame(pa.table({"q": pa.array(range(part.num_rows), pa.int64()), "a": part.column("a")}))
        met = met.join(F.broadcast(names), "q").select("a", "b", "similarity")  # about PASS rows
        found = met if found is None else found.unionByName(met)
    return found


def _trial_kernel(salts: list[str], lengths: list[int], names: list[str], family: str, id_col: str):
    at, k = np.array(lengths) - 1, np.array(lengths)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _numbers(tuple(salts), family)
        for batch in batches:
            truth, estimate = [], []
            for own, *others in batch.column("_sets").to_pylist():
                place = {x: i for i, x in enumerate(dict.fromkeys(x for part in (own, *others) for x in part))}
                table = np.array([numbers(x) for x in place])  # each shingle once, however many sets have it
                least = [table[[place[x] for x in part]].min(axis=0) for part in (own, *others)]
                for part, found in zip(others, least[1:]):
                    both = len(set(own).intersection(part))
                    truth += [both / (len(own) + len(part) - both)] * len(k)
                    same = np.cumsum(found == least[0])[at]
                    estimate.append(same / (2 * k - same))
            ids = batch.column(id_col).take(pa.array(np.repeat(np.arange(batch.num_rows), len(names) * len(k))))
            t = pa.array([name for name in names for _ in lengths] * batch.num_rows, pa.string())
            values = np.concatenate(estimate) if estimate else np.zeros(0)
            yield pa.record_batch([ids, t, pa.array(np.tile(k, len(estimate)), pa.int32()), pa.array(truth, pa.float64()), pa.array(values, pa.float64())], names=[id_col, "t", "k", "truth", "estimate"])

    return kernel


def sketch_trials(records: DataFrame, salts: list[str], lengths: list[int], own: str, others: dict[str, str], family: str = "sha256", id_col: str = "doc_id") -> DataFrame:
    """(id, t, k, truth, estimate): Jaccard similarity of a record's set ``own`` with each other set of it, exact and by sketches of k salts.

    ``others`` has the column of each set by its name t; all are arrays of
    distinct shingles.  The first k minima of a sketch are the sketch of the
    first k salts, so one pass serves all lengths, and a shingle that several
    sets of a record have is hashed once.  Minima are compared by their first
    64 bits.  Salts are distinct and equally long, so minima of different salts
    are never equal.  Records of which a set is empty have no row.
    """
    if len(set(salts)) < len(salts) or len({len(w) for w in salts}) > 1 or max(lengths) > len(salts):
        raise ValueError("salts are distinct, equally long, and enough for the lengths")
    kind = dict(records.dtypes)[id_col]
    columns = [own, *others.values()]
    rows = records.where(" and ".join(f"size(`{c}`) > 0" for c in columns)).select(id_col, F.array(*columns).alias("_sets"))
    return rows.mapInArrow(_trial_kernel(salts, lengths, list(others), family, id_col), f"`{id_col}` {kind}, t string, k int, truth double, estimate double")


def sketch_similarity(a: Column, b: Column) -> Column:
    """Multiset Jaccard similarity of two sketches, whatever the position: m in common of k each give m / (2k - m)."""
    times = lambda side, x: F.size(F.filter(side, lambda y: y == x))
    rest = F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))
    return F.try_divide(rest.cast("double"), (F.size(a) + F.size(b) - rest).cast("double"))
