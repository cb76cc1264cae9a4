"""All similar pairs between set-valued records, by metric pivot partitioning.

Jaccard distance is a metric.  Records are assigned to the nearest of a bounded
number of pivots if it lies within ``radius`` (their home cell); a record y is
replicated into the cell of pivot p whenever the triangle inequality lets it
have a partner there, that is d(y, p) <= r_p + eps, where r_p is the largest
distance of a home record of p and eps = 1 - threshold.  Records farther than
``radius`` from every pivot share the outer cell; a partner of theirs with a
home elsewhere meets them in its own cell, into which they are replicated.  So
each similar pair meets in at least one cell.

Inside the cells the join is exact.  With eps = 0.5, unrelated records lie at
distance 1 from each other and from every pivot, so no bound on distances can
separate them and the outer cell is large; joining every cell on its records'
rarest elements (two records with Jaccard >= t share one of the
n - ceil(t n) + 1 rarest elements of each) keeps that join linear in practice.
Elements are ordered by frequency; one that no other record holds can make no
pair, and a record with fewer than ceil(t n) shared elements is dropped at once.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.skew import block_of, blocks
from ..plans.storage import materialize
from .ratios import as_fraction

#: Elements tracked while frequent ones are looked for; heavy ones kept, at most.
HEAVY_TRACKED, HEAVY_ELEMENTS = 65_536, 4_096
#: There is a pivot for PIVOT_SHARE records that share enough elements to have a partner, but at least LEAST_PIVOTS and at most
#: MOST_PIVOTS.  They are taken among records of at most PIVOT_ELEMENTS elements; PIVOT_CHOICE times as many are looked at, of
#: PIVOT_TOTAL elements together.  This bounds what is collected and sent out.
PIVOT_SHARE, LEAST_PIVOTS, MOST_PIVOTS, PIVOT_ELEMENTS, PIVOT_CHOICE, PIVOT_TOTAL = 4, 256, 20_000, 1_024, 2, 400_000
#: A key of the join inside the cells is split into blocks of about so many records.
BLOCK = 2_000
#: The cell of the records that no pivot has within its radius.
OUTER = -1


def element_hashes(elements: Column) -> Column:
    """Sorted distinct 64-bit hashes of the elements of an array of strings without nulls."""
    return F.sort_array(F.array_distinct(F.transform(elements, lambda x: F.xxhash64(x))))


def _fingerprint(tokens: Column) -> Column:
    """128 bits of a set, from two hashes of different seeds."""
    return F.concat(F.hex(F.xxhash64(F.lit(1), tokens)), F.lit("-"), F.hex(F.xxhash64(F.lit(2), tokens)))


def _heavy(rows: DataFrame, tokens: str) -> list[int]:
    """Elements that an approximate sketch finds most often: those above 1/50,000 of all rows of elements, and 100.

    Only a hint for the plan: which elements are in the list changes no result.
    """
    found = rows.select(F.explode(tokens).alias("t")).agg(F.expr(f"approx_top_k(t, {HEAVY_ELEMENTS}, {HEAVY_TRACKED})"), F.count("*")).first()
    floor = max(100, (found[1] or 0) // 50_000)
    return sorted(x["item"] for x in (found[0] or []) if x["count"] >= floor)


def _in(marks: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(marks):
        return np.zeros(len(values), dtype=bool)
    return marks[np.minimum(np.searchsorted(marks, values), len(marks) - 1)] == values


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Elements of all rows in one array, and the number of elements of each row."""
    lists = batch.column("tokens")
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


def _light(heavy: list[int]):
    """Arrow kernel: a row for each element of a class that isn't heavy."""
    marks = np.array(heavy, dtype=np.int64)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = _lists(batch)
            owner = np.repeat(batch.column("cls").to_numpy(), sizes)
            keep = ~_in(marks, values)
            yield pa.record_batch([pa.array(values[keep]), pa.array(owner[keep])], names=["t", "cls"])

    return kernel


def _hot(heavy: list[int]):
    """Arrow kernel: adds to each class its heavy elements, ascending."""
    marks = np.array(heavy, dtype=np.int64)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = _lists(batch)
            keep = _in(marks, values)
            ends = np.r_[0, np.cumsum(sizes)]
            held = np.r_[0, np.cumsum(keep)][ends].astype(np.int32)
            hot = pa.ListArray.from_arrays(pa.array(held), pa.array(values[keep]))
            yield pa.record_batch([batch.column("cls"), batch.column("n"), batch.column("tokens"), hot], names=["cls", "n", "tokens", "hot"])

    return kernel


def _shared_light(light: DataFrame) -> DataFrame:
    """(cls, t, df) of the light elements that at least two classes hold.

    One shuffle: rows are sorted by element within partitions and streamed; a
    run's length is its document frequency, counted exactly up to RUN rows and
    as RUN beyond, which is the same for all rows of the element.
    """
    RUN = 100_000

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the last run, while it is short
        last, size, long = None, 0, False

        def out(t, cls, df):
            return pa.record_batch([pa.array(cls), pa.array(t), pa.array(df)], names=["cls", "t", "df"])

        def close():
            if size >= 2 and not long:
                cls = np.concatenate(held)
                yield out(np.full(size, last), cls, np.full(size, size, dtype=np.int64))

        for batch in batches:
            t, cls = batch.column("t").to_numpy(), batch.column("cls").to_numpy()
            if not len(t):
                continue
            starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            ends = np.r_[starts[1:], len(t)]
            first, final = 0, len(starts) - 1
            if last is not None and t[0] == last:  # the open run goes on
                rows = cls[: ends[0]]
                size += len(rows)
                if long:
                    yield out(t[: ends[0]], rows, np.full(len(rows), RUN, dtype=np.int64))
                else:
                    held.append(rows)
                    if size > RUN:
                        long, cls_all = True, np.concatenate(held)
                        held = []
                        yield out(np.full(size, last), cls_all, np.full(size, RUN, dtype=np.int64))
                first = 1
            if first <= final:
                yield from close()
                inner = slice(first, final)  # runs that begin and end in this batch
                lengths = ends[inner] - starts[inner]
                if len(lengths):
                    df = np.repeat(lengths, lengths)
                    rows = slice(starts[first], ends[final - 1])
                    keep = df >= 2
                    if keep.any():
                        yield out(t[rows][keep], cls[rows][keep], df[keep].astype(np.int64))
                held, last = [cls[starts[final] :].copy()], t[starts[final]]
                size, long = len(held[0]), False
        if last is not None:
            yield from close()

    return light.repartition("t").sortWithinPartitions("t").mapInArrow(kernel, "cls bigint, t bigint, df bigint")


def _pivots(alive: DataFrame, pivots: int, apart: float) -> list[np.ndarray]:
    """Up to ``pivots`` records from dense regions, more than ``apart`` from each other.

    A record of a large group of similar ones has rare elements that many others
    hold.  Records are grouped by their most frequent prefix element, and of
    each group the record with the smallest number stands for it; those of the
    most frequent elements come first.  One that is close to a pivot already
    taken is passed over, so that a large group doesn't fill all cells alike.
    """
    if not pivots:
        return []
    regions = alive.where(f"n <= {PIVOT_ELEMENTS}").select("cls", "n", F.element_at("prefix", -1).alias("top")).groupBy("top.t", "top.df").agg(F.min(F.struct("cls", "n")).alias("r"))
    listed = regions.orderBy(F.desc("df"), "t").limit(PIVOT_CHOICE * pivots).select("r.cls", "r.n", "df").collect()  # two numbers a row
    fits = [r for r, total in zip(listed, np.cumsum([r["n"] for r in listed])) if total <= PIVOT_TOTAL]
    chosen = alive.sparkSession.createDataFrame([(r["cls"], r["df"]) for r in fits], "cls bigint, df bigint")
    rows = alive.join(F.broadcast(chosen), "cls").select("cls", "df", "tokens").collect()  # at most PIVOT_TOTAL elements
    taken: list[np.ndarray] = []
    holders: dict[int, list[int]] = defaultdict(list)  # of an element the pivots that have it
    for row in sorted(rows, key=lambda r: (-r["df"], r["cls"])):
        both = Counter(p for t in row["tokens"] for p in holders.get(t, ()))
        n = len(row["tokens"])
        if all(1 - c / (n + len(taken[p]) - c) > apart for p, c in both.items()):
            for t in row["tokens"]:
                holders[t].append(len(taken))
            taken.append(np.array(row["tokens"], dtype=np.int64))
            if len(taken) == pivots:
                break
    return taken


def _cells(pivots: list[np.ndarray], reach: float):
    """Arrow kernel: distances of each record to the pivots, kept up to ``reach``."""
    tokens = np.concatenate([np.empty(0, np.int64), *pivots])
    sizes = np.array([len(t) for t in pivots], dtype=np.int64)
    index = np.repeat(np.arange(len(pivots)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, index = tokens[order], index[order]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            offsets = lists.offsets.to_numpy()
            values = lists.flatten().to_numpy(zero_copy_only=False)
            offsets = offsets - offsets[0]
            lo, hi = np.searchsorted(tokens, values, "left"), np.searchsorted(tokens, values, "right")
            found = []
            for i in range(batch.num_rows):
                a, b = offsets[i], offsets[i + 1]
                hits = np.flatnonzero(hi[a:b] > lo[a:b]) + a
                cells: list[dict] = []
                if len(hits):
                    spans = [index[lo[j] : hi[j]] for j in hits]
                    pivot, both = np.unique(np.concatenate(spans), return_counts=True)
                    distance = 1.0 - both / (sizes[pivot] + (b - a) - both)
                    near = np.flatnonzero(distance <= reach + 1e-9)
                    near = near[np.argsort(distance[near], kind="stable")]
                    cells = [{"cell": int(pivot[k]), "d": float(distance[k])} for k in near]
                found.append(cells)
            kind = pa.list_(pa.struct([("cell", pa.int32()), ("d", pa.float64())]))
            yield pa.record_batch([batch.column("cls"), pa.array(found, kind)], names=["cls", "near"])

    return kernel


def similar_classes(classes: DataFrame, threshold=0.5, pivots: int | None = None, radius: float = 0.2) -> DataFrame:
    """Pairs (cls_a < cls_b, both, n_a, n_b) of classes with Jaccard similarity >= threshold.

    ``classes`` has (cls BIGINT distinct, n, tokens sorted distinct BIGINTs);
    it is read several times and should be materialised.  Empty sets make no
    pair.  The share of elements in common is compared without rounding.
    """
    t = as_fraction(threshold)
    eps = 1 - float(t)
    radius = min(radius, 0.99 * float(t))  # so that r_p + eps stays below 1
    up = f"cast(ceil(n * {t.numerator} / cast({t.denominator} as decimal(20,0))) as int)"
    heavy = _heavy(classes, "tokens")
    shared = _shared_light(classes.select("cls", "tokens").mapInArrow(_light(heavy), "t bigint, cls bigint"))
    lists = shared.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("light"))
    base = classes.select("cls", "n", "tokens").mapInArrow(_hot(heavy), "cls bigint, n int, tokens array<bigint>, hot array<bigint>")
    # Heavy elements come last in the order, by value; they are counted and kept without a shuffle of their own.
    top = F.lit(2**62).cast("bigint")
    joined = base.join(lists, "cls", "left").withColumn("light", F.coalesce("light", F.array().cast("array<struct<df:bigint,t:bigint>>")))
    hot = F.transform("hot", lambda x: F.struct(top.alias("df"), x.alias("t")))
    ordered = joined.withColumn("held", F.concat("light", hot)).withColumn("need", F.expr(up))
    alive = ordered.where("n > 0 and size(held) >= need")
    # The first n - need + 1 places of the order; those before the shared elements hold elements of no other record.
    alive = alive.withColumn("own", F.expr("n - size(held)")).withColumn("length", F.expr("n - need + 1 - own"))
    alive = alive.where("length > 0").select("cls", "n", "need", "own", "tokens", F.expr("slice(held, 1, length)").alias("prefix"))
    alive = materialize(alive, "alive")
    pivots = min(MOST_PIVOTS, max(LEAST_PIVOTS, alive.count() // PIVOT_SHARE)) if pivots is None else pivots
    centres = _pivots(alive, pivots, eps)
    near = alive.select("cls", "tokens").mapInArrow(_cells(centres, radius + eps), "cls bigint, near array<struct<cell:int,d:double>>")
    near = materialize(near, "cells")
    first = F.get("near", F.lit(0))
    at_home = (F.size("near") > 0) & (first["d"] <= radius)
    near = near.select("cls", F.when(at_home, first["cell"]).otherwise(OUTER).alias("home"), "near")
    widest = near.where(f"home <> {OUTER}").groupBy("home").agg(F.max(first["d"]).alias("r")).collect()  # a row per pivot
    placed = near.select("cls", "home", F.col("home").alias("cell"))
    if widest:
        limits = alive.sparkSession.createDataFrame([(int(w["home"]), float(w["r"]) + eps + 1e-9) for w in widest], "cell int, most double")
        guests = near.select("cls", "home", F.inline("near")).where("cell <> home").join(F.broadcast(limits), "cell").where("d <= most")
        placed = placed.unionByName(guests.select("cls", "home", "cell"))
    keys = placed.join(alive.select("cls", "n", "need", "own", F.posexplode(F.col("prefix")).alias("pos", "e")), "cls")
    keys = keys.select("cell", "home", "cls", "n", "need", (F.col("own") + F.col("pos")).alias("pos"), F.col("e.t").alias("t"), F.col("e.df").alias("df"))
    keys = materialize(keys, "keys")
    # Hot keys are split into blocks: a home record meets each block of the others once.
    counts = keys.groupBy("cell", "t").agg(F.count("*").alias("rows")).where("rows > 1")
    counts = materialize(counts.withColumn("b", blocks(F.col("rows"), BLOCK)).select("cell", "t", "b"), "blocks")
    keys = keys.join(counts, ["cell", "t"])
    left = keys.where("cell = home").withColumn("i", block_of(F.col("cls"), F.col("b"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    right = keys.withColumn("j", block_of(F.col("cls"), F.col("b"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    left = left.select("cell", "t", "i", "j", F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"))
    right = right.select("cell", "t", "i", "j", F.col("cls").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), (F.col("cell") == F.col("home")).alias("at_home"))
    num, den = t.numerator, t.denominator
    met = left.join(right, ["cell", "t", "i", "j"]).where(
        # both at home: each pair once; length filter; what can still follow the common element must suffice
        f"x <> y and (not at_home or x < y) and nx * {num} <= ny * {den} and ny * {num} <= nx * {den}"
        f" and (least(nx - px, ny - py)) * {den + num} >= (nx + ny) * {num}"
    )
    pairs = met.select(F.least("x", "y").alias("cls_a"), F.greatest("x", "y").alias("cls_b")).distinct()
    sets = alive.select("cls", "n", "tokens")
    both = pairs.join(sets.select(F.col("cls").alias("cls_a"), F.col("n").alias("n_a"), F.col("tokens").alias("a")), "cls_a")
    both = both.join(sets.select(F.col("cls").alias("cls_b"), F.col("n").alias("n_b"), F.col("tokens").alias("b")), "cls_b")
    both = both.select("cls_a", "cls_b", "n_a", "n_b", F.size(F.array_intersect("a", "b")).alias("both"))
    return both.where(f"both * {den + num} >= (n_a + n_b) * {num}")


def similar_pairs(
    left: DataFrame,
    id_col: str,
    tokens_col: str,
    threshold=0.5,
    right: DataFrame | None = None,
    latest_by: str | None = None,
    min_size: int = 1,
    pivots: int | None = None,
    radius: float = 0.2,
) -> tuple[DataFrame, DataFrame]:
    """Similar pairs within ``left``, or between ``left`` and ``right``.

    Inputs have an id and sorted distinct element hashes (``element_hashes``);
    other columns are ignored.  Of several rows of one id the one with the
    largest ``latest_by`` counts (null first), of equal ones the larger set,
    then the larger fingerprint.  A null array is an empty set.  Rows with a
    null id are left out, as are ids whose set has fewer than ``min_size``
    elements; an empty set is similar to nothing.  Empty inputs give empty
    tables.  Returns two tables:

    links   (cls_a, cls_b, both, n_a, n_b)  pairs of different sets with
            Jaccard >= threshold, each once;
    members (id, side, cls, copies)         the class of every record and its
            number of members, side 0 for left and 1 for right.

    Records of one class are copies of each other, and are not expanded.
    """
    kept = [F.col(id_col).alias("id"), F.col(tokens_col).alias("tokens"), (F.col(latest_by) if latest_by else F.lit(None).cast("int")).alias("v")]
    rows = left.select(*kept, F.lit(0).alias("side"))
    if right is not None:
        rows = rows.unionByName(right.select(*kept, F.lit(1).alias("side")))
    # A null set may be the one that counts for its id, which then has none.
    rows = rows.where("id is not null").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<bigint>"))).withColumn("fp", _fingerprint(F.col("tokens"))).withColumn("n", F.size("tokens"))
    # Only ids and fingerprints are shuffled to find the rows that count; each set is shuffled once.
    last = rows.groupBy("id", "side").agg(F.max(F.struct("v", "n", "fp")).alias("last")).select("id", "side", "last.n", "last.fp")
    members = materialize(last.where(F.col("n") >= max(1, min_size)).select("id", "side", "fp"), "members")
    sets = rows.where(F.col("n") >= max(1, min_size)).groupBy("fp").agg(F.first("tokens").alias("tokens"))
    sets = sets.join(members.groupBy("fp").agg(F.count("*").alias("copies")), "fp")
    classes = materialize(sets.select(F.monotonically_increasing_id().alias("cls"), "fp", "copies", F.size("tokens").alias("n"), "tokens"), "classes")
    members = members.join(classes.select("fp", "cls", "copies"), "fp").select("id", "side", "cls", "copies")
    return similar_classes(classes, threshold, pivots, radius), members


def expand_pairs(links: DataFrame, members: DataFrame, within: bool = True) -> DataFrame:
    """Record pairs (id_lo, id_hi) from linked classes and from copies inside a class.

    ``within``: pairs of different ids of one table, id_lo < id_hi.  Otherwise
    pairs (id_left, id_right).  The number of rows is that of the result asked
    for; members of a class of many copies meet in blocks, so that no task makes
    all pairs of a class.
    """
    placed = members.withColumn("b", blocks(F.col("copies"), BLOCK)).withColumn("at", block_of(F.col("id"), F.col("b")))
    sizes = placed.select("cls", "b", "copies").distinct()
    same = sizes.where("copies > 1").select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"))
    ways = links.select("cls_a", "cls_b").unionByName(same)
    if not within:
        ways = ways.unionByName(links.select(F.col("cls_b").alias("cls_a"), F.col("cls_a").alias("cls_b")))
    for side in "ab":
        ways = ways.join(sizes.select(F.col("cls").alias(f"cls_{side}"), F.col("b").alias(f"b_{side}")), f"cls_{side}")
    ways = ways.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("b_a") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b_b") - 1)))
    a = placed.where("side = 0").select(F.col("cls").alias("cls_a"), F.col("at").alias("i"), F.col("id").alias("a"))
    b = placed.where("side = 0" if within else "side = 1").select(F.col("cls").alias("cls_b"), F.col("at").alias("j"), F.col("id").alias("b"))
    out = ways.select("cls_a", "cls_b", "i", "j").join(a, ["cls_a", "i"]).join(b, ["cls_b", "j"])
    if not within:
        return out.select(F.col("a").alias("id_left"), F.col("b").alias("id_right"))
    # Of a class with itself each pair would come twice; the ordered condition keeps one.
    return out.where("cls_a <> cls_b or a < b").select(F.least("a", "b").alias("id_lo"), F.greatest("a", "b").alias("id_hi"))
