"""Mixing sources to target weights, by hierarchical budgeting.

Sources are the leaves of a tree domain - language - source.  Weights are
propagated down to token budgets; what a leaf cannot supply even at its cap of
repeats goes to its siblings, then to the siblings of its ancestors.  Each leaf
then gives its documents in seeded epochs: whole epochs, and of the last one
the prefix that the rest of the budget allows.
"""

from __future__ import annotations

import functools
import math
import os
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialize

#: The vocabulary that counts tokens by default; any file of the tokenizers library does.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Most leaves of a tree; the plan is made on the driver, a row per leaf.
LEAVES = 100_000
#: Bins of the seeded order in which the cut of a prefix is looked for.
BINS = 4_096


def source_name(source: Column) -> Column:
    """Sources are compared trimmed and in lower case."""
    return F.lower(F.trim(source, F.lit(" \t\r\n")))


def word_count(text: Column) -> Column:
    """Number of maximal runs of letters or decimal digits; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{Nd}]+")), F.lit(0)).cast("bigint")


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def _token_kernel(path: str, names: list[str], text: str):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            sizes: list[int] = []
            for i in range(0, len(texts), 64):
                part = [t or "" for t in texts[i : i + 64]]
                sizes += [len(e.ids) for e in tokenizer.encode_batch(part, add_special_tokens=False)]
            yield pa.record_batch([*[batch.column(n) for n in names], pa.array(sizes, pa.int64())], names=[*names, "size"])

    return kernel


def token_sizes(rows: DataFrame, keep: list[str], text_col: str, path: str = TOKENIZER) -> DataFrame:
    """``keep`` columns and ``size``, the number of tokens of the whole text (0 for null)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", size bigint"
    return rows.select(*keep, text_col).mapInArrow(_token_kernel(path, keep, text_col), schema)


@dataclass
class Node:
    """A node of the tree; of a leaf, ``size`` is one epoch and ``cap`` the most repeats."""

    path: tuple[str, ...]
    weight: Fraction = Fraction(0)
    size: int = 0
    cap: int = 0
    children: dict[str, Node] = field(default_factory=dict)
    budget: Fraction = Fraction(0)
    target: Fraction = Fraction(0)

    def room(self) -> Fraction:
        """What the node can give beyond its budget."""
        if self.children:
            return sum((c.room() for c in self.children.values()), Fraction(0))
        return self.size * self.cap - self.budget

    def leaves(self) -> Iterator[Node]:
        if not self.children:
            yield self
        for child in self.children.values():
            yield from child.leaves()


def _pour(node: Node, amount: Fraction) -> Fraction:
    """Give ``amount`` to the leaves under ``node`` by weight, as far as they have room; returns the rest."""
    if not node.children:
        given = min(amount, node.room())
        node.budget += given
        return amount - given
    while amount > 0:
        open_ = [c for c in node.children.values() if c.weight > 0 and c.room() > 0]
        total = sum((c.weight for c in open_), Fraction(0))
        if not open_:
            return amount
        left = Fraction(0)
        for child in open_:
            left += _pour(child, amount * child.weight / total)
        if left == amount:
            return amount
        amount = left
    return amount


def _settle(node: Node) -> Fraction:
    """Cut every leaf to what it can give; shortages go to siblings first, then up. Returns what no one took."""
    if not node.children:
        given = min(node.target, Fraction(node.size * node.cap))
        node.budget = given
        return node.target - given
    short = sum((_settle(c) for c in node.children.values()), Fraction(0))
    return _pour(node, short) if short else short


@dataclass
class Leaf:
    path: tuple[str, ...]
    share: Fraction
    size: int
    target: Fraction
    epochs: int
    budget: int


def plan_mixture(leaves: list[tuple[tuple[str, ...], Fraction, int, int]]) -> list[Leaf]:
    """Budgets of leaves (path, weight, size, cap); the total is the size of all leaves once.

    ``target`` is weight over the sum of weights times the total, ``epochs``
    the least whole number of copies that reaches it, at most the cap and 0 for
    an empty leaf or weight, all exactly.  ``budget`` is the whole number of
    tokens after redistribution.
    """
    if len(leaves) > LEAVES:
        raise ValueError(f"more than {LEAVES} leaves")
    root = Node(())
    for path, weight, size, cap in leaves:
        at = root
        at.weight += weight
        for depth, name in enumerate(path):
            at = at.children.setdefault(name, Node(path[: depth + 1]))
            at.weight += weight
        at.size, at.cap = size, max(0, cap)
    total, weights = sum(x.size for x in root.leaves() if x.path), root.weight
    for leaf in root.leaves():
        leaf.target = leaf.weight / weights * total if weights else Fraction(0)
    if root.children:
        _settle(root)
    return [
        Leaf(x.path, x.weight / weights if weights else Fraction(0), x.size, x.target, min(x.cap, math.ceil(x.target / x.size)) if x.size and x.weight else 0, math.floor(x.budget))
        for x in root.leaves()
        if x.path
    ]


def read_targets(targets: DataFrame) -> dict[str, tuple[Fraction, int]]:
    """(share, most repeats) of each source; shares of one name are added, a null share is 0, a null cap 1."""
    rows = targets.where("source is not null").select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").limit(LEAVES + 1).collect()
    if len(rows) > LEAVES:
        raise ValueError(f"more than {LEAVES} targets")
    found: dict[str, tuple[Fraction, int]] = {}
    for r in rows:
        share, cap = found.get(r["source"], (Fraction(0), 0))
        own = Fraction(str(r["target_share"])) if r["target_share"] is not None else Fraction(0)
        found[r["source"]] = (share + max(own, Fraction(0)), max(cap, 1 if r["max_repeats"] is None else r["max_repeats"]))
    return found


def mixture(sized: DataFrame, targets: DataFrame, levels: list[str]) -> list[Leaf]:
    """Plan for documents with columns source (normalised), ``levels`` above it, and size.

    The weight of a source is split over its leaves by their size; a source
    without documents stays as a leaf of size 0.  Only sizes per leaf reach the
    driver; sources that have no target are left out.
    """
    wanted = read_targets(targets)
    spark = sized.sparkSession
    names = F.broadcast(spark.createDataFrame([(s,) for s in wanted], "source string"))  # at most LEAVES names
    held = sized.join(names, "source").groupBy(*levels, "source").agg(F.sum("size").alias("size")).limit(LEAVES + 1).collect()
    of: dict[str, list] = defaultdict(list)
    for r in held:
        of[r["source"]].append((tuple(r[c] for c in levels) + (r["source"],), int(r["size"] or 0)))
    leaves = []
    for source, (share, cap) in sorted(wanted.items()):
        rows = of.get(source) or [(("",) * len(levels) + (source,), 0)]
        size = sum(n for _, n in rows)
        for path, n in sorted(rows):
            leaves.append((path, share * n / size if size else share, n, cap))
    return plan_mixture(leaves)


def tree_columns(documents: DataFrame, domain: Column | None = None) -> list[Column]:
    """domain, lang and source of each document: the path of its leaf.

    The domain is by default what follows the last hyphen of the source, a null
    language is ``und``.
    """
    name = source_name(F.col("source"))
    above = domain if domain is not None else F.element_at(F.split(name, "-"), -1)
    return [above.alias("domain"), F.coalesce(source_name(F.col("lang")), F.lit("und")).alias("lang"), name.alias("source")]


def mix_copies(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, copies): of every source of ``targets``, the whole epochs that reach its target, by words.

    The plan is that of the tree.  A source's weight is split over its leaves
    by their size, so all its leaves that hold anything need the same number of
    epochs, which is that of the source.  A null text has size 0; documents
    whose source is null or not listed don't count.  Empty documents give 0
    copies everywhere.
    """
    sized = documents.where("source is not null").select(*tree_columns(documents), word_count(F.col("text")).alias("size"))
    copies: dict[str, int] = {}
    for leaf in mixture(sized, targets, ["domain", "lang"]):
        copies[leaf.path[-1]] = max(copies.get(leaf.path[-1], 0), leaf.epochs)
    return documents.sparkSession.createDataFrame(sorted(copies.items()), "source string, copies int")


def sized_documents(documents: DataFrame, tokenizer: str = TOKENIZER, domain: Column | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, size in tokens), materialised; rows without id or source are left out."""
    rows = documents.where("doc_id is not null and source is not null").select("doc_id", *tree_columns(documents, domain), "text")
    return materialize(token_sizes(rows, ["doc_id", "domain", "lang", "source"], "text", tokenizer), "sized")


def select_mixture(sized: DataFrame, plan: list[Leaf], seed: int = 1) -> DataFrame:
    """(doc_id, domain, lang, source, size, copies): each document with the times it is used (0 left out).

    A leaf gives floor(budget / size) whole epochs, and of the next one the
    longest prefix in the order of a seeded hash that fits into the rest.  The
    cut is found in two steps, over BINS sums per leaf and then inside one bin,
    so a leaf with a third of all documents is never sorted as one group.
    """
    spark = sized.sparkSession
    path = ["domain", "lang", "source"]
    rows = [(*x.path, x.budget // x.size, x.budget % x.size) for x in plan if x.size and x.budget]
    leaves = F.broadcast(spark.createDataFrame(rows, "domain string, lang string, source string, epochs bigint, rest bigint"))  # at most LEAVES rows
    docs = sized.join(leaves, path).withColumn("order", F.xxhash64(F.lit(seed), F.col("epochs"), "doc_id"))
    docs = docs.withColumn("bin", F.shiftrightunsigned("order", 64 - BINS.bit_length() + 1))
    sums = docs.groupBy(*path, "bin").agg(F.sum("size").alias("binned"))
    before = F.sum("binned").over(Window.partitionBy(*path).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*path, "bin", F.coalesce(before, F.lit(0)).alias("before"), "binned")
    placed = docs.join(sums, [*path, "bin"])
    whole = placed.where("before + binned <= rest").withColumn("extra", F.lit(1))
    none = placed.where("before > rest").withColumn("extra", F.lit(0))
    cut = placed.where("before <= rest and before + binned > rest")
    run = F.sum("size").over(Window.partitionBy(*path).orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = cut.withColumn("extra", F.when(F.col("before") + run <= F.col("rest"), 1).otherwise(0))
    used = whole.unionByName(none).unionByName(cut).withColumn("copies", F.col("epochs") + F.col("extra"))
    return used.where("copies > 0").select("doc_id", *path, "size", F.col("copies").cast("bigint").alias("copies"))


def reached_shares(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, share): what each source of ``targets`` has of the mix."""
    wanted = read_targets(targets)
    weights = sum((s for s, _ in wanted.values()), Fraction(0)) or Fraction(1)
    spark = selected.sparkSession
    names = spark.createDataFrame([(s, float(w / weights)) for s, (w, _) in sorted(wanted.items())], "source string, target_share double")
    held = selected.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("tokens"))
    out = names.join(F.broadcast(held), "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))  # held: a row per source of the plan
    share = F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy()))
    return out.select("source", F.round("target_share", 6).alias("target_share"), "tokens", F.round(share, 6).alias("share"))
