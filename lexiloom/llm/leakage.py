"""Test items leaking into a training corpus, by a distributed positional inverted index.

The index holds the postings (document, position) of every token of the corpus.
It is partitioned by document: a row is a shard, one batch of documents, with
its distinct terms, ascending, and their position lists in flat arrays.  It is
written once and knows nothing of test items, so any number of item sets can be
looked up without reading the texts again.

Items are looked up as windows of a few words.  The collection frequencies of
the items' terms, added up over the shards, say which word of a window is the
rarest of the corpus; its positions, shifted by the word's offset, are
intersected with the lists of the window's other words.  Lists met exactly give
phrase matches, lists met within a slop give proximity matches.  A document
lies in one shard, so look-ups shuffle nothing; what leaves a shard are matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.barrier import with_once
from ..plans.storage import materialize

#: Soft hyphen and zero-width space, removed before texts are split into words; what a word is.
INVISIBLE = "\u00ad\u200b"
WORD = r"([\p{L}\p{Nd}]+)"
#: Most characters of test items that are looked up at once; further items are looked up in further passes over the index.
ITEM_CHARS = 8_000_000
#: Tokens of a shard (a longer document is a shard of its own), items looked up in a shard at once, candidate positions formed at once.
TOKENS, BLOCK, CANDIDATES = 4_000_000, 256, 500_000
SHARD = "docs array<bigint>, ends array<int>, terms array<bigint>, offsets array<int>, positions array<int>"
MATCHES = "item_id bigint, doc_id bigint, windows bigint, near bigint, of_windows bigint, longest bigint"


def term_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text, lower-cased, in order; null for null.

    Two of a billion different words have equal hashes with a chance of about
    0.03; an item is touched only if one of its own few words is concerned.
    """
    words = F.regexp_extract_all(F.translate(text, INVISIBLE, ""), F.lit(WORD), F.lit(1))
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column in one array, and the number of values of each row."""
    lists = batch.column(name)
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


def _shard_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of at most TOKENS tokens; every document has a free place behind it, so that no phrase runs into the next."""
    kinds = {"docs": pa.int64(), "ends": pa.int32(), "terms": pa.int64(), "offsets": pa.int32(), "positions": pa.int32()}
    for batch in batches:
        every, lengths = _lists(batch, "tokens")
        docs, last = batch.column("doc_id").to_numpy(), np.cumsum(lengths)
        lo = 0
        while lo < batch.num_rows:
            before = last[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(last, before + TOKENS, "right")))
            tokens, sizes = every[before : last[hi - 1]], lengths[lo:hi]
            place = np.arange(len(tokens)) + np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(tokens, kind="stable")
            terms, first = np.unique(tokens[order], return_index=True)
            row = {"docs": docs[lo:hi], "ends": np.cumsum(sizes + 1), "terms": terms, "offsets": np.r_[first, len(tokens)], "positions": place[order]}
            yield pa.record_batch([pa.array([row[name]], pa.list_(kind)) for name, kind in kinds.items()], names=list(kinds))
            lo = hi


def positional_index(documents: DataFrame) -> DataFrame:
    """The index of (doc_id, text), a row per shard; write it (``materialize`` or any table) before it is looked up.

    Rows with a null id or text are left out; a repeated row is indexed
    repeatedly, which look-ups make good.  Texts are split into words inside
    the JVM, whole; only hashes reach the kernel.
    """
    rows = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), term_hashes(F.col("text")).alias("tokens"))
    return rows.mapInArrow(_shard_kernel, SHARD)


def item_tokens(items: DataFrame) -> DataFrame:
    """(item_id, chars, tokens): of several rows of one item the longest text counts, then the larger; nulls are left out."""
    rows = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.max(F.struct(F.length("text").alias("n"), "text")).alias("t"))
    return with_once(rows.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("t.n").alias("chars"), F.col("t.text").alias("text")), "tokens", term_hashes(F.col("text"))).drop("text")


@dataclass
class Probes:
    """Windows of a portion of items: distinct phrases of ``width`` terms, and where the items have them."""

    vocabulary: np.ndarray  # distinct term hashes, ascending
    phrases: np.ndarray  # phrase x width, as places in the vocabulary
    items: np.ndarray  # item ids
    used: np.ndarray  # use x (item, place of the window), grouped by phrase
    used_at: np.ndarray  # where the uses of each phrase begin
    distinct: np.ndarray  # distinct windows of each item
    width: int
    order: np.ndarray | None = None  # of each phrase the offsets of its words, the rarest word of the corpus first

    @classmethod
    def of(cls, rows: list[tuple[int, list[int]]], width: int) -> Probes:
        tokens = np.concatenate([np.empty(0, np.int64), *(np.array(t, np.int64) for _, t in rows)])
        sizes = np.array([len(t) for _, t in rows], np.int64)
        vocabulary, numbers = np.unique(tokens, return_inverse=True)
        windows = np.maximum(sizes - width + 1, 0)
        item = np.repeat(np.arange(len(rows)), windows)
        place = np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = place + (np.cumsum(sizes) - sizes)[item]
        every = numbers[start[:, None] + np.arange(width)] if len(item) else np.empty((0, width), np.int64)
        phrases, of = np.unique(every, axis=0, return_inverse=True)
        of = of.reshape(-1)
        order = np.argsort(of, kind="stable")
        distinct = np.bincount(np.unique(np.stack([item, of]), axis=1)[0], minlength=len(rows)) if len(item) else np.zeros(len(rows), np.int64)
        used_at = np.searchsorted(of[order], np.arange(len(phrases) + 1))
        return cls(vocabulary, phrases, np.array([i for i, _ in rows], np.int64), np.stack([item, place], axis=1)[order], used_at, distinct, width)

    def anchored(self, frequency: np.ndarray) -> Probes:
        """With the order in which the words of each phrase are looked up: by the corpus frequencies of the vocabulary, ties by offset."""
        order = np.argsort(frequency[self.phrases], axis=1, kind="stable") if len(self.phrases) else np.empty((0, self.width), np.int64)
        return replace(self, order=order)


def _frequency_kernel(vocabulary: np.ndarray):
    """Arrow kernel: (place in the vocabulary, tokens) of the terms that a task's shards hold, added up per task."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                terms, offsets = (batch.column(name)[row].values.to_numpy(zero_copy_only=False) for name in ("terms", "offsets"))
                at = np.minimum(np.searchsorted(terms, vocabulary), max(0, len(terms) - 1))
                held = (terms[at] == vocabulary) if len(terms) else np.zeros(len(vocabulary), bool)
                total[held] += np.diff(offsets)[at[held]]
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], names=["term", "n"])

    return kernel


def term_frequencies(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Tokens of the corpus for each of the given terms; reads the terms and offsets of the index only."""
    rows = index.select("terms", "offsets").mapInArrow(_frequency_kernel(vocabulary), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()  # at most a row per term of the portion
    found = np.zeros(len(vocabulary), np.int64)
    for r in rows:
        found[r["term"]] = r["n"]
    return found


def _longest_runs(doc: np.ndarray, item: np.ndarray, place: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For matched windows: the number of windows in the unbroken diagonal run each belongs to."""
    diagonal = start - place
    order = np.lexsort((place, diagonal, item))
    i, d, p = item[order], diagonal[order], place[order]
    new = np.r_[True, (i[1:] != i[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)]
    run = np.cumsum(new) - 1
    length = np.bincount(run)[run]
    out = np.empty_like(length)
    out[order] = length
    return out


def _intersect(probes: Probes, positions: np.ndarray, lists: np.ndarray, here: np.ndarray, owner: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(phrase, start, exact) of phrases in one shard, starting from the list of each one's rarest word.

    ``here`` has for every place of the shard its word in the vocabulary or -1:
    all lists at once, so that "does this word's list hold that position" is
    one look; ``owner`` has the document of every place.  The free place
    between documents keeps exact matches inside one of them, for near ones
    the documents are compared.  Yields in pieces of about CANDIDATES positions.
    """
    rarest = probes.order[:, 0]
    anchor = probes.phrases[np.arange(len(probes.phrases)), rarest]
    held = np.diff(lists)[anchor]
    use = np.flatnonzero((np.diff(lists) > 0)[probes.phrases].all(axis=1))
    margin = probes.width + slop
    padded = np.pad(here, margin, constant_values=-1)
    document = np.pad(owner, margin, constant_values=-1)
    ends = np.cumsum(held[use])
    lo = 0
    while lo < len(use):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CANDIDATES, "right")))
        some = use[lo:hi]
        lo = hi
        times = held[some]
        phrase = np.repeat(some, times)
        place = positions[np.repeat(lists[anchor[some]], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        start = place.astype(np.int64) - rarest[phrase]
        exact, mine = np.ones(len(phrase), bool), owner[place]
        for k in range(1, probes.width):  # the rarest word is where it is
            offset = probes.order[phrase, k]
            word, at = probes.phrases[phrase, offset], start + offset + margin
            there = padded[at] == word
            exact &= there
            for shift in (d for n in range(1, slop + 1) for d in (-n, n)):  # another may stand up to slop places aside
                rest = np.flatnonzero(~there)
                rest = rest[padded[at[rest] + shift] == word[rest]]
                there[rest[document[at[rest] + shift] == mine[rest]]] = True
            phrase, start, exact, mine = phrase[there], start[there], exact[there], mine[there]
        yield phrase, start, exact


def _matches(probes: Probes, docs, ends, terms, offsets, positions, slop: int) -> pa.RecordBatch | None:
    """Matches of a block of items in one shard."""
    at = np.minimum(np.searchsorted(terms, probes.vocabulary), max(0, len(terms) - 1))
    held = (terms[at] == probes.vocabulary) if len(terms) else np.zeros(len(at), bool)
    if not held.any():
        return None
    counts = np.where(held, np.diff(offsets)[at], 0)
    lists = np.r_[0, np.cumsum(counts)]
    mine = positions[np.repeat(offsets[:-1][at], counts) + np.arange(lists[-1]) - np.repeat(lists[:-1], counts)]
    here = np.full(int(ends[-1]), -1, np.int32)
    here[mine] = np.repeat(np.arange(len(counts)), counts)
    owner = np.repeat(np.arange(len(docs), dtype=np.int32), np.diff(np.r_[0, ends]))
    parts = list(_intersect(probes, mine, lists, here, owner, slop))
    phrase, start, exact = (np.concatenate([p[k] for p in parts]) for k in range(3)) if parts else (np.empty(0, np.int64),) * 3
    if not len(phrase):
        return None
    doc = owner[start + probes.order[phrase, 0]].astype(np.int64)
    # Each match once for every place at which an item has the phrase.
    times = probes.used_at[phrase + 1] - probes.used_at[phrase]
    which = np.repeat(np.arange(len(phrase)), times)
    within = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    item, place = probes.used[probes.used_at[phrase[which]] + within].T
    keys, inverse = np.unique(item * len(docs) + doc[which], return_inverse=True)
    whole = exact[which].astype(bool)
    marks = inverse * len(probes.phrases) + phrase[which]

    def distinct(marks: np.ndarray) -> np.ndarray:
        """Distinct phrases of each key among the given matches."""
        return np.bincount(np.unique(marks) // len(probes.phrases), minlength=len(keys))

    longest = np.zeros(len(keys), np.int64)
    if whole.any():
        np.maximum.at(longest, inverse[whole], _longest_runs(doc[which][whole], item[whole], place[whole], start[which][whole]) + probes.width - 1)
    items = keys // len(docs)
    columns = [probes.items[items], docs[keys % len(docs)], distinct(marks[whole]), distinct(marks), probes.distinct[items], longest]
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "windows", "near", "of_windows", "longest"])


def _match_kernel(blocks: list[Probes], slop: int):
    """Arrow kernel: the matches of all blocks of items in each shard."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = [batch.column(name)[row].values.to_numpy(zero_copy_only=False) for name in ("docs", "ends", "terms", "offsets", "positions")]
                for probes in blocks:
                    if (found := _matches(probes, *shard, slop)) is not None:
                        yield found

    return kernel


def probe_index(index: DataFrame, items: DataFrame, width: int = 4, slop: int = 2, wanted: str = "true") -> DataFrame:
    """(item_id, doc_id, windows, near, of_windows, longest): documents with a window of an item.

    Of the item's of_windows distinct windows of ``width`` words the document
    holds ``windows`` as they are, and ``near`` with the rarest word in its
    place and every other word at most ``slop`` places from its own (exact ones
    included; two words may be met by one place).  longest is the longest run
    of words in common made of exact windows, 0 without any.  Only rows that
    satisfy the condition ``wanted`` on these columns are kept.

    The length of the item table is checked first.  A portion of at most
    ITEM_CHARS characters (and the chance of hashing) is on the driver at a
    time: its matches are written before the next one is read.  Items of fewer
    than ``width`` words match nothing, an empty table gives an empty table.
    """
    rows = materialize(item_tokens(items), "items")
    portions = max(1, -(-(rows.agg(F.sum("chars")).first()[0] or 0) // ITEM_CHARS))
    found = None
    for k in range(portions):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(portions)) == k)
        texts = [(r["item_id"], r["tokens"]) for r in part.orderBy("item_id").collect()]
        vocabulary = np.unique(np.concatenate([np.empty(0, np.int64), *(np.array(t, np.int64) for _, t in texts)]))
        frequency = term_frequencies(index, vocabulary)
        blocks = [Probes.of(texts[i : i + BLOCK], width) for i in range(0, len(texts), BLOCK)]
        blocks = [b.anchored(frequency[np.searchsorted(vocabulary, b.vocabulary)]) for b in blocks]
        matched = materialize(index.mapInArrow(_match_kernel(blocks, slop), MATCHES).where(wanted), "matches")
        found = matched if found is None else found.unionByName(matched)
    return found


def leaked_items(index: DataFrame, items: DataFrame, phrase: int = 10, width: int = 4, share="0.5", slop: int = 2) -> DataFrame:
    """(item_id, doc_id, windows, near, of_windows, longest, match): documents that hold passages of test items.

    ``index`` is a written ``positional_index``.  match is ``phrase`` if an item
    and a document have ``phrase`` consecutive words in common, or if the
    document holds at least ``share`` of the item's distinct windows of
    ``width`` words as they are; it is ``proximity`` if only the windows that
    are near reach the share, as after words were inserted, dropped or swapped.
    Other pairs are left out, see ``probe_index``.  A repeated document row is
    reported once.
    """
    limit = Fraction(str(share))
    enough = lambda c: f"{c} * {limit.denominator} >= of_windows * {limit.numerator}"
    exact = f"(longest >= {phrase} or {enough('windows')})"
    found = probe_index(index, items, width, slop, f"{exact} or {enough('near')}")
    return found.withColumn("match", F.expr(f"if({exact}, 'phrase', 'proximity')")).distinct()
