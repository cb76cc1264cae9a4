"""Groups of near-duplicate records by MinHash banding.

A record is a bag of tokens (words, or the n-grams of its words); the k-th
occurrence of a token is an element of its own, so the Jaccard similarity of
the element sets is the multiset Jaccard similarity of the bags.  Records with
equal bags form one class.  Band and row counts are chosen for a target recall;
classes are shuffled on their band hashes, and every candidate is verified on
the full element sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.skew import block_of, blocks, heavy_light_join
from ..plans.storage import materialize
from .ratios import as_fraction

#: A bucket is split into blocks of about so many classes where pairs of it are formed.
BLOCK = 2_000
#: Elements hashed at once, times hash functions, in the kernel.
CELLS = 4_000_000


def band_plan(threshold, recall: float = 0.9999, max_hashes: int = 1024) -> tuple[int, int]:
    """(bands, rows): the most selective banding within the hash budget.

    A pair of similarity s shares a band with probability 1 - (1 - s^rows)^bands;
    that is at least ``recall`` at the threshold, and more above it.
    """
    t = float(as_fraction(threshold))
    best = (math.ceil(math.log(1 - recall) / math.log(1 - min(t, 1 - 1e-9))), 1)
    for rows in range(2, 65):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-min(t, 1 - 1e-9) ** rows))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit words (multiply and xor-shift), in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    return x


def _elements(tokens: np.ndarray) -> np.ndarray:
    """Sorted hashes of (token, occurrence) of one bag."""
    tokens = np.sort(tokens)
    row = np.arange(len(tokens))
    start = np.maximum.accumulate(np.where(np.r_[True, tokens[1:] != tokens[:-1]], row, 0)) if len(tokens) else row
    return np.sort(_mix(tokens.view(np.uint64) + (row - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))


def _grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in order."""
    if width == 1:
        return hashes
    n = len(hashes) - width + 1
    if n < 1:
        return hashes[:0]
    key = np.zeros(n, np.uint64)
    for j in range(width):
        key = _mix(key * np.uint64(3) ^ hashes[j : j + n].view(np.uint64))
    return key.view(np.int64)


def _bag_kernel(width: int, least: int):
    """Arrow kernel: the element set of each record of at least ``least`` words and one run of ``width``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            offsets = lists.offsets.to_numpy()
            values = lists.flatten().to_numpy(zero_copy_only=False)
            offsets = offsets - offsets[0]
            sizes = np.diff(offsets)
            use = np.flatnonzero(sizes >= max(least, width))
            parts = [_elements(_grams(values[offsets[i] : offsets[i + 1]], width)) for i in use]
            flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
            ends = np.r_[0, np.cumsum(sizes[use] - width + 1)].astype(np.int32)
            yield pa.record_batch([batch.column("id").take(pa.array(use)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "elements"])

    return kernel


def _band_kernel(bands: int, rows: int):
    """Arrow kernel: (cls, n, band hash) of each class, a row per band."""
    seeds = np.random.Generator(np.random.PCG64(20_240_229)).integers(1, 2**63, bands * rows, dtype=np.uint64)
    salts = _mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def sketch(elements: np.ndarray) -> np.ndarray:
        least = np.full(bands * rows, np.uint64(2**64 - 1))
        step = max(1, CELLS // len(seeds))
        for i in range(0, len(elements), step):  # whole sets, in pieces that fit in memory
            np.minimum(least, _mix(elements[i : i + step, None] ^ seeds[None, :]).min(axis=0), out=least)
        return least

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("elements")
            offsets = lists.offsets.to_numpy()
            values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            offsets = offsets - offsets[0]
            for lo in range(0, batch.num_rows, 2_000):
                hi = min(lo + 2_000, batch.num_rows)
                out = np.empty((hi - lo, bands), np.uint64)
                for i in range(lo, hi):
                    mins = sketch(values[offsets[i] : offsets[i + 1]]).reshape(bands, rows)
                    key = salts.copy()
                    for j in range(rows):
                        key = _mix(key ^ mins[:, j])
                    out[i - lo] = key
                index = pa.array(np.repeat(np.arange(lo, hi), bands))
                yield pa.record_batch([batch.column("cls").take(index), batch.column("n").take(index), pa.array(out.reshape(-1).view(np.int64))], names=["cls", "n", "band"])

    return kernel


def token_hashes(words: Column) -> Column:
    """64-bit hashes of the words, in order and with repeats."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _verified(pairs: DataFrame, sets: DataFrame, threshold) -> DataFrame:
    """The (a, b) of ``pairs`` whose element sets have Jaccard similarity >= threshold, compared exactly."""
    t = as_fraction(threshold)
    left = sets.select(F.col("cls").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("elements").alias("y"))
    near = pairs.select("a", "b").distinct().join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("x", "y")).cast("bigint")
    return near.where(both * (t.denominator + t.numerator) >= (F.size("x").cast("bigint") + F.size("y")) * t.numerator).select("a", "b")


def near_duplicate_groups(
    records: DataFrame, id_col: str, tokens_col: str, threshold=0.8, width: int = 5, recall: float = 0.9999, min_tokens: int = 1, max_hashes: int = 1024
) -> DataFrame:
    """(id, group_id, class_id): a row per record of at least ``min_tokens`` tokens and one run of ``width``.

    Elements are the runs of ``width`` tokens; with width 1, the tokens.

    ``records`` has a distinct id and an array of token hashes
    (``token_hashes``) with repeats; other columns are ignored, rows with a
    null id or array are left out.  class_id is the smallest id among records
    with an equal bag, group_id the smallest id of the connected component of
    the relation "similarity >= threshold"; a record alone has its own id as
    both.  A pair just at the threshold becomes a candidate with probability
    ``recall``; what is compared is compared exactly.

    First each class is compared with the first class of each of its buckets,
    which joins a bucket of copies with small edits into one component without
    forming its pairs.  Then only classes of a bucket that are still in
    different components are compared with each other.
    """
    t = as_fraction(threshold)
    num, den = t.numerator, t.denominator
    rows = records.where(F.col(id_col).isNotNull() & F.col(tokens_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(tokens_col).alias("tokens"))
    kind = dict(rows.dtypes)["id"]
    bags = rows.mapInArrow(_bag_kernel(width, max(1, min_tokens)), f"id {kind}, elements array<bigint>")
    bags = materialize(bags.withColumn("fp", F.md5(F.array_join(F.col("elements").cast("array<string>"), ","))), "bags")
    sets = bags.groupBy("fp").agg(F.min("id").alias("rep"), F.first("elements").alias("elements"))
    # Numbers stand for classes from here on: ids can be long, and minima of numbers are hash aggregates.
    sets = materialize(sets.select(F.monotonically_increasing_id().alias("cls"), "fp", "rep", F.size("elements").alias("n"), "elements"), "bagsets")
    bands, length = band_plan(threshold, recall, max_hashes)
    keys = sets.select("cls", "n", "elements").mapInArrow(_band_kernel(bands, length), "cls bigint, n int, band bigint")
    keys = materialize(keys, "bands")
    # Buckets of one class are dropped by a count that is combined on the map side.
    buckets = keys.groupBy("band").agg(F.min("cls").alias("lead"), F.min_by("n", "cls").alias("lead_n"), F.count("*").alias("rows")).where("rows > 1")
    # The largest buckets are looked up in a broadcast of a few numbers each, so a bucket of a third of all classes isn't one task.
    shared = materialize(heavy_light_join(keys, materialize(buckets, "buckets"), "band", "rows").select(*keys.columns, "lead", "lead_n"), "shared")
    fits = f"n * {num} <= lead_n * {den} and lead_n * {num} <= n * {den}"
    star = shared.where("cls <> lead").where(fits).select(F.col("lead").alias("a"), F.col("cls").alias("b"))
    links = materialize(_verified(star, sets, threshold), "links")
    parts = materialize(connected_components(links, "a", "b"), "parts")

    # What is left: classes of one bucket in different components.
    placed = shared.join(parts, shared["cls"] == parts["node"], "left").select("band", "cls", "n", F.coalesce("component", "cls").alias("part"))
    mixed = placed.groupBy("band").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("rows")).where("p <> q")
    open_ = materialize(placed.join(mixed.select("band", blocks(F.col("rows"), BLOCK).alias("blocks")), "band"), "open")
    left = open_.withColumn("i", block_of(F.col("cls"), F.col("blocks"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = open_.withColumn("j", block_of(F.col("cls"), F.col("blocks"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("band", "i", "j", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("part").alias("pa"))
    right = right.select("band", "i", "j", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("part").alias("pb"))
    met = left.join(right, ["band", "i", "j"]).where(f"a < b and pa <> pb and na * {num} <= nb * {den} and nb * {num} <= na * {den}")
    more = materialize(_verified(met.select("a", "b"), sets, threshold), "more")
    final = parts if more.isEmpty() else materialize(connected_components(links.unionByName(more), "a", "b"), "final")
    named = final.join(sets.select(F.col("cls").alias("node"), "rep"), "node")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    groups = named.join(least, "component").select(F.col("node").alias("cls"), "least")
    labels = sets.select("cls", "fp", "rep").join(groups, "cls", "left").select("fp", F.col("rep").alias("class_id"), F.coalesce("least", "rep").alias("group_id"))
    return bags.select("id", "fp").join(labels, "fp").select("id", "group_id", "class_id")


def every_record_grouped(records: DataFrame, id_col: str, tokens_col: str, threshold=0.8, width: int = 5, recall: float = 0.9999) -> DataFrame:
    """(id, group_id, class_id) as by ``near_duplicate_groups``, also of records of fewer than ``width`` tokens.

    Those have no run of ``width``: records of equal token lists, the empty one
    among them, are one class and one group.  Rows with a null id or array are
    left out.
    """
    rows = records.where(F.col(id_col).isNotNull() & F.col(tokens_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(tokens_col).alias("tokens"))
    short = rows.where(F.size("tokens") < width)
    classes = short.groupBy("tokens").agg(F.min("id").alias("class_id"), F.count("*").alias("size"))
    key = F.concat_ws(",", F.col("tokens").cast("array<string>")).alias("key")
    joined = heavy_light_join(short.select("id", key), classes.select(key, "class_id", "size"), "key", "size")
    return near_duplicate_groups(rows, "id", "tokens", threshold, width, recall).unionByName(joined.select("id", F.col("class_id").alias("group_id"), "class_id"))
