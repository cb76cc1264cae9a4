"""Multiset Jaccard similarity of item lists, and the join of similar records.

Records of equal lists (as multisets) are one class, whatever their number;
only classes are compared.  Results name classes by their smallest id and say
for how many records they stand; membership has the class of every record.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.skew import block_of, blocks, heavy_light_join
from ..plans.storage import materialize

#: A join key is split into blocks of about so many classes.
BLOCK = 2_000
#: Items of a batch of queries, at most, for which every task holds the queries of each item; queries of a pass.
HELD, PASS = 4_000_000, 16_384


def numbered_items(records: DataFrame, id_col: str, items_col: str) -> DataFrame:
    """(id, n, e): a row per item; e is a 64-bit hash of the item and its occurrence number.

    Sets of such numbers are the multisets of the items.
    """
    rows = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.size(items_col).alias("n"), F.explode(items_col).alias("item")).where("item is not null")
    counts = rows.groupBy("id", "n", "item").agg(F.count("*").cast("int").alias("c"))
    return counts.select("id", "n", F.inline(F.transform(F.sequence(F.lit(1), "c"), lambda i: F.struct(F.xxhash64("item", i).alias("e")))))


def overlap_similarity(both: Column, a: Column, b: Column) -> Column:
    """Items in common over all items; null for two empty lists."""
    return F.try_divide(both.cast("double"), (a + b - both).cast("double"))


def pair_similarity(pairs: DataFrame, items: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Adds the multiset Jaccard similarity of the lists of both ids of each (distinct) pair.

    ``items`` has (id, item) rows with repeats.  An id without items counts as
    an empty list.
    """
    counts = items.where("item is not null").groupBy("id", "item").agg(F.count("*").alias("c"))
    sizes = counts.groupBy("id").agg(F.sum("c").alias("n"))
    left = pairs.join(counts.select(F.col("id").alias(a), "item", F.col("c").alias("ca")), a)
    met = left.join(counts.select(F.col("id").alias(b), "item", F.col("c").alias("cb")), [b, "item"])
    both = met.groupBy(a, b).agg(F.sum(F.least("ca", "cb")).alias("both"))
    out = pairs.join(both, [a, b], "left").join(sizes.select(F.col("id").alias(a), F.col("n").alias("na")), a, "left").join(sizes.select(F.col("id").alias(b), F.col("n").alias("nb")), b, "left")
    filled = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("both", "na", "nb")}
    return out.withColumn("similarity", overlap_similarity(filled["both"], filled["na"], filled["nb"])).drop("both", "na", "nb")


def _keyed(records: DataFrame, id_col: str, items_col: str) -> DataFrame:
    """(id, n, items, key): lists without their nulls, sorted, with 128 bits that stand for the multiset and the length."""
    held = F.coalesce(F.col(items_col), F.array().cast(dict(records.dtypes)[items_col]))
    rows = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.size(held).alias("n"), F.sort_array(F.array_compact(held)).alias("items"))
    return rows.withColumn("key", F.concat_ws("-", *[F.hex(F.xxhash64(F.lit(seed), "n", "items")) for seed in (1, 2)]))


def _classes(rows: DataFrame) -> DataFrame:
    """(cls, key, class_id, size, asked, n, items) of ``_keyed`` rows with a flag ``asked``: records and queries of equal lists are one class."""
    of = rows.groupBy("key").agg(F.min(F.when(~F.col("asked"), F.col("id"))).alias("class_id"), F.count(F.when(~F.col("asked"), 1)).alias("size"), F.max("asked").alias("asked"), F.first("n").alias("n"), F.first("items").alias("items"))
    return materialize(of.select(F.monotonically_increasing_id().alias("cls"), "key", "class_id", "size", "asked", "n", "items"), "classes")


def _similar_classes(classes: DataFrame, threshold, search: bool) -> DataFrame:
    """(a, b, similarity) of the numbers of different similar classes: each pair once with a < b, or from those asked for to those with records.

    Exact: lists with at least the similarity share one of the n - ceil(t n) + 1
    items that are rarest in the collection, so only those are joined, and each
    pair found is counted in full.  Keys of very frequent items are split into
    blocks.
    """
    t = Fraction(str(threshold))
    num, den = t.numerator, t.denominator
    items = materialize(numbered_items(classes, "cls", "items").select("id", "e"), "items")
    df = items.groupBy("e").agg(F.count("*").alias("df")).where("df > 1")
    held = items.join(df, "e").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("held"))
    held = held.join(classes.select(F.col("cls").alias("id"), "n", "asked", "size"), "id")
    need = F.expr(f"cast(ceil(cast(n as decimal(20,0)) * {num} / {den}) as int)")
    held = held.withColumn("need", need).where("size(held) >= need").withColumn("own", F.col("n") - F.size("held"))
    held = materialize(held.select("id", "n", "asked", "size", "need", "own", "held", F.col("held.e").alias("es")), "held")
    keys = held.select("id", "n", "asked", "size", "need", "own", F.posexplode(F.expr("slice(held, 1, n - need + 1 - own)")).alias("pos", "k"))
    keys = keys.select("id", "n", "asked", "size", (F.col("own") + F.col("pos")).alias("pos"), "k.e", blocks(F.col("k.df"), BLOCK).alias("b"))
    left, right = (keys.where("asked"), keys.where("size > 0")) if search else (keys, keys)
    left = left.withColumn("i", block_of(F.col("id"), F.col("b"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    right = right.withColumn("j", block_of(F.col("id"), F.col("b"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    left = left.select("e", "i", "j", F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    right = right.select("e", "i", "j", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    order = "a <> b" if search else "a < b"
    # Lengths must fit, and what follows the first common item in both lists must suffice.
    fits = f"na * {num} <= nb * {den} and nb * {num} <= na * {den} and least(na - pa, nb - pb) * {den + num} >= (na + nb) * {num}"
    pairs = left.join(right, ["e", "i", "j"]).where(f"{order} and {fits}").select("a", "b", "na", "nb").distinct()
    lists = held.select("id", "es")
    met = pairs.join(lists.select(F.col("id").alias("a"), F.col("es").alias("xa")), "a").join(lists.select(F.col("id").alias("b"), F.col("es").alias("xb")), "b")
    met = met.withColumn("both", F.size(F.array_intersect("xa", "xb"))).where(f"both * {den + num} >= (na + nb) * {num}")
    return met.select("a", "b", overlap_similarity(F.col("both"), F.col("na"), F.col("nb")).alias("similarity"))


def _itself(threshold) -> Column:
    """Whether a list is similar to its own copies: items in common over the length, of which nulls are never in common."""
    t = Fraction(str(threshold))
    both = F.size("items").cast("bigint")
    return (both > 0) & (both * (t.denominator + t.numerator) >= 2 * F.col("n").cast("bigint") * t.numerator)


def similar_lists(records: DataFrame, id_col: str, items_col: str, threshold) -> tuple[DataFrame, DataFrame]:
    """Records whose multiset Jaccard similarity is at least ``threshold``, as two tables.

    links   (a, b, similarity, pairs)   similar classes a <= b, named by their
            smallest ids, and the number of record pairs they stand for; a = b
            are the copies inside a class;
    members (id, class_id, links)       a row per record: its class, and how
            many other records are similar to it.

    Lists that are null or empty are similar to nothing, a null item is an item
    of the list that nothing shares; rows with a null id are left out, ids are
    distinct, other columns are ignored.  Empty tables give empty tables.
    """
    rows = _keyed(records, id_col, items_col).withColumn("asked", F.lit(False))
    classes = _classes(rows)
    pairs = materialize(_similar_classes(classes, threshold, False), "similar")
    names = classes.select("cls", "class_id", "size")
    side = lambda c: names.select(F.col("cls").alias(c), F.col("class_id").alias(f"{c}_id"), F.col("size").alias(f"{c}_size"))
    named = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = named.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "similarity", (F.col("a_size") * F.col("b_size")).alias("pairs"))
    copies = classes.where(_itself(threshold) & (F.col("size") > 1))
    same = F.size("items") / (2 * F.col("n") - F.size("items"))
    links = apart.unionByName(copies.select(F.col("class_id").alias("a"), F.col("class_id").alias("b"), same.alias("similarity"), F.expr("size * (size - 1) div 2").alias("pairs")))
    both = named.select(F.col("a").alias("cls"), F.col("b_size").alias("more")).unionByName(named.select(F.col("b").alias("cls"), F.col("a_size").alias("more")))
    more = both.groupBy("cls").agg(F.sum("more").alias("more"))
    own = F.when(_itself(threshold), F.col("size") - 1).otherwise(F.lit(0))
    counted = classes.join(more, "cls", "left").select("key", "class_id", "size", (own + F.coalesce("more", F.lit(0))).alias("links"))
    members = heavy_light_join(rows.select("id", "key"), materialize(counted, "counted"), "key", "size").select("id", "class_id", "links")
    return links, members


def _elements(flat: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Numbers of items and their occurrence in a row, so that sets of them are the multisets; rows are in order."""
    order = np.lexsort((flat, row))
    a, r = flat[order], row[order]
    new = np.flatnonzero(np.diff(r, prepend=-1).astype(bool) | (a != np.roll(a, 1)))
    nth = np.arange(len(a)) - np.repeat(new, np.diff(new, append=len(a)))
    out = np.empty(len(a), np.int64)
    out[order] = a ^ (nth * 0x1E3779B97F4A7C15)  # the first occurrence is the item itself
    return out


class _Asked:
    """The queries of each item, as places of the queries; items of many queries have a row of counts for all of them."""

    def __init__(self, lengths: np.ndarray, sizes: np.ndarray, flat: np.ndarray):
        self.lengths = lengths
        query = np.repeat(np.arange(len(sizes)), sizes)
        element = _elements(flat, query)
        order = np.argsort(element, kind="stable")
        self.queries, element = query[order].astype(np.int32), element[order]
        starts = np.flatnonzero(np.diff(element, prepend=element[:1] - 1)) if len(element) else np.zeros(0, np.int64)
        self.items, self.starts, self.ends = element[starts], starts, np.append(starts[1:], len(element))
        often = np.flatnonzero(8 * (self.ends - self.starts) > len(lengths))
        self.row = np.full(len(starts), -1)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), len(lengths)), np.int16)
        for i, k in enumerate(often):
            self.rows[i, self.queries[self.starts[k] : self.ends[k]]] = 1

    def counts(self, elements: np.ndarray) -> np.ndarray:
        """Items in common with every query."""
        at = np.searchsorted(self.items, elements)
        near = at < len(self.items)
        at, elements = at[near], elements[near]
        at = at[self.items[at] == elements]
        total = np.zeros(len(self.lengths), np.int16 if len(at) < 2**15 else np.int64)
        for i in self.row[at]:
            if i >= 0:
                total += self.rows[i]
        rest = [self.queries[self.starts[k] : self.ends[k]] for k in at[self.row[at] < 0]]
        total = total.astype(np.int64)
        return total + np.bincount(np.concatenate(rest), minlength=len(total)) if rest else total


def _search_kernel(shared, num: int, den: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _Asked(*shared.value)
        for batch in batches:
            n, column = batch.column("n").to_numpy(), batch.column("items")
            sizes = np.diff(column.offsets.to_numpy())
            flat = _elements(column.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes))
            ends = np.cumsum(sizes)
            places, query, both = [], [], []
            for i in range(len(sizes)):
                count = asked.counts(flat[ends[i] - sizes[i] : ends[i]])
                found = np.flatnonzero((count > 0) & (count * (den + num) >= (asked.lengths + n[i]) * num))
                if len(found):
                    places.append(np.full(len(found), i))
                    query.append(found)
                    both.append(count[found])
            if places:
                ids = batch.column("id").take(pa.array(np.concatenate(places)))
                query, both = np.concatenate(query), np.concatenate(both)
                similarity = both / (asked.lengths[query] + n[np.concatenate(places)] - both)
                yield pa.record_batch([pa.array(query, pa.int64()), ids, pa.array(similarity, pa.float64())], names=["q", "b", "similarity"])

    return kernel


def counted_search(queries: DataFrame, records: DataFrame, id_col: str, items_col: str, threshold) -> DataFrame | None:
    """(a, b, similarity) of every query and every record with at least the similarity, or None if the queries have more than HELD items.

    Direct comparison without a join: every task holds the queries of each item
    and counts a record's items in common with all of them.  Nothing of the
    records is shuffled or stored.  Nulls count as in ``similar_lists``.
    """
    spark = queries.sparkSession
    t = Fraction(str(threshold))
    hashed = lambda rows: rows.where(F.col(id_col).isNotNull() & F.col(items_col).isNotNull()).select(F.col(id_col).alias("id"), F.size(items_col).cast("bigint").alias("n"), F.transform(F.array_compact(items_col), lambda x: F.xxhash64(x)).alias("items"))
    asked = materialize(hashed(queries), "asked")
    if (asked.agg(F.sum(F.size("items"))).first()[0] or 0) > HELD:
        return None
    held, rows = asked.toArrow().combine_chunks(), hashed(records)
    kind = dict(records.dtypes)[id_col]
    found = None
    for lo in range(0, max(1, held.num_rows), PASS):
        part = held.slice(lo, PASS).combine_chunks()
        lists = part.column("items").combine_chunks()
        shared = spark.sparkContext.broadcast((part.column("n").to_numpy(), lists.value_lengths().to_numpy(), lists.flatten().to_numpy()))
        met = rows.mapInArrow(_search_kernel(shared, t.numerator, t.denominator), f"q bigint, b {kind}, similarity double")
        names = spark.createDataFrame(pa.table({"q": pa.array(range(part.num_rows), pa.int64()), "a": part.column("id")}))
        met = met.join(F.broadcast(names), "q").select("a", "b", "similarity")  # at most PASS rows
        found = met if found is None else found.unionByName(met)
    return found


def search_lists(queries: DataFrame, records: DataFrame, id_col: str, items_col: str, threshold) -> tuple[DataFrame, DataFrame]:
    """Records similar to each query, as two tables.

    found   (a, b, similarity, records) a query, a class of records that are
            similar to it, named by its smallest id, and their number;
    members (id, class_id)              the class of every record.

    Both inputs have distinct ids and lists; a query may equal a record, and
    then finds it.  Nulls count as in ``similar_lists``.
    """
    rows = _keyed(queries, id_col, items_col).withColumn("asked", F.lit(True)).unionByName(_keyed(records, id_col, items_col).withColumn("asked", F.lit(False)))
    classes = _classes(rows)
    same = F.size("items") / (2 * F.col("n") - F.size("items"))
    equal = classes.where(F.col("asked") & (F.col("size") > 0) & _itself(threshold)).select(F.col("cls").alias("a"), F.col("cls").alias("b"), same.alias("similarity"))
    pairs = materialize(_similar_classes(classes, threshold, True).unionByName(equal), "similar")
    asking = rows.where("asked").select("id", "key").join(classes.where("asked").select("key", F.col("cls").alias("a")), "key").select(F.col("id").alias("query"), "a")
    found = asking.join(pairs, "a").join(classes.select(F.col("cls").alias("b"), "class_id", "size"), "b")
    members = heavy_light_join(rows.where("not asked").select("id", "key"), classes.where("size > 0").select("key", "class_id", "size"), "key", "size")
    return found.select(F.col("query").alias("a"), F.col("class_id").alias("b"), "similarity", F.col("size").alias("records")), members.select("id", "class_id")
