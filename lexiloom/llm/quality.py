"""Text quality statistics, and text types learned from them.

Statistics are built-in expressions over each text.  Each threshold on them is
a noisy labelling function; how accurate each one is for each type of text
comes out of their agreements by expectation-maximization over the counts of
vote patterns, a table whose size the number of rules fixes, so all documents
count and the fit is the same work at any scale.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.barrier import with_once
from ..plans.skew import heavy_light_join
from ..plans.storage import materialize

WORDS = r"([\p{L}\p{Nd}]+)"
SYMBOL = r"[^\p{L}\p{Nd} \t\r\n]"
#: Lines that begin with a list mark; with a key and a colon; that hold two or more separators of cells.
MARKED = r"(?dm)^[ \t]*+(?:[-*+>\x{2022}\x{2013}]|\d++[.)]|[a-z][.)])[ \t]"
KEYED = r"(?dm)^[^\s:]++: "
_CELL = r"(?:[,;](?=\S)|[|\t]|  +)"
CELLED = rf"(?dm)^[^\n]*?{_CELL}[^\n]*?{_CELL}"
#: A word list of up to so many entries becomes part of the expression; a longer one is joined.
INLINE_WORDS = 10_000

TYPES = ("prose", "list", "table", "record", "noise", "broken")


@dataclass(frozen=True)
class Level:
    """A threshold on a statistic: where it holds, the text is probably of one of the types ``votes``."""

    rule: str
    votes: tuple[str, ...]
    fault: bool = False


#: The labelling functions: of each statistic one ordinal vote, the first level that holds or none.  Levels marked as
#: faults are the fixed thresholds of the fault report.
RULES: dict[str, tuple[Level, ...]] = {
    "wordlen": (Level("letters < 3 * n_words", ("broken",), True), Level("letters > 8 * n_words", ("broken", "noise"), True)),
    "symbols": (Level("5 * symbols > chars", ("noise", "table"), True), Level("12 * symbols > chars", ("table", "list"))),
    "lineends": (Level("n_lines >= 4 and 5 * ended < 2 * n_lines", ("list", "table", "record"), True),),
    "common": (Level("20 * n_common < 3 * n_words", ("noise", "list", "table"), True), Level("10 * n_common < 3 * n_words", ("list", "broken"))),
    "marked": (Level("n_lines >= 2 and 2 * marked >= n_lines", ("list",)),),
    "celled": (Level("n_lines >= 2 and 2 * celled >= n_lines", ("table",)), Level("n_lines >= 2 and 5 * celled > n_lines", ("table",))),
    "keyed": (Level("n_lines >= 2 and 2 * keyed >= n_lines", ("record",)), Level("n_lines >= 2 and 5 * keyed > n_lines", ("record",))),
}
FAULTS = tuple(name for name, levels in RULES.items() if any(x.fault for x in levels))
#: Prior of prose, and chances that a level holds in a type it votes for and in another, at the start of the fit.
PROSE_PRIOR, VOTED, UNVOTED = 0.75, 0.6, 0.1


def word_column(text: Column) -> Column:
    """Maximal runs of letters or decimal digits, lower-cased, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORDS), F.lit(1)), lambda w: F.lower(w))


def text_statistics(documents: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, letters, chars, symbols, n_lines, ended, marked, celled, keyed, n_common) per row with a text.

    Rows with a null text are left out; an empty text has zeros.  letters is
    the total length of the words, symbols the number of code points that are
    neither letters, digits, blank, tab, CR nor LF, ended the number of lines
    whose last character is one of . ! ? and the double quote, marked, celled
    and keyed the numbers of lines with a list mark, with several cells, and
    with a key before a colon, n_common the number of words in ``common_words``
    under any language (null words are ignored).  Other columns of
    ``documents`` are ignored.
    """
    listed = common_words.where("word is not null").select(F.lower("word").alias("w")).distinct()
    known = [r["w"] for r in listed.limit(INLINE_WORDS + 1).collect()]
    rows = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))
    rows = with_once(rows, "words", word_column(F.col("text")))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.rtrim(x, F.lit(" \t\r"))), lambda x: x != "")
    rows = with_once(rows, "lines", lines)
    counted = [
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("letters"),
        F.length("text").cast("bigint").alias("chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("bigint").alias("symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size(F.filter("lines", lambda x: F.substring(x, -1, 1).isin(".", "!", "?", '"'))).cast("bigint").alias("ended"),
        *[F.regexp_count("text", F.lit(shape)).cast("bigint").alias(name) for name, shape in (("marked", MARKED), ("celled", CELLED), ("keyed", KEYED))],
    ]
    if len(known) <= INLINE_WORDS:
        common = F.size(F.filter("words", lambda w: w.isin(known))).cast("bigint") if known else F.lit(0).cast("bigint")
        return with_once(rows.select(id_col, "text", "words", "lines"), "_all", F.struct(*counted, common.alias("n_common"))).select(id_col, "_all.*")
    # A long word list is met by a join.  Rows are written once, so that both reads see the same row numbers, and a
    # word is counted per row first; words that many rows hold are looked up in a bounded broadcast.
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("_row"), id_col, "words", F.struct(*counted).alias("_rest")), "words")
    held = materialize(rows.select("_row", F.explode("words").alias("w")).groupBy("_row", "w").agg(F.count("*").alias("times")), "held")
    seen = listed.join(held.groupBy("w").agg(F.count("*").alias("rows")), "w")
    common = heavy_light_join(held, seen, "w", "rows").groupBy("_row").agg(F.sum("times").alias("n_common"))
    return rows.join(common, "_row", "left").select(id_col, "_rest.*", F.coalesce("n_common", F.lit(0)).alias("n_common"))


def faults(least_words: int = 15) -> Column:
    """The array of fault rules that hold for a row of ``text_statistics``, compared without rounding.

    A text of fewer than ``least_words`` words has only the fault ``short``.
    Others: wordlen, mean word length below 3 or above 8; symbols, more than a
    fifth of the characters; lineends, four or more lines of which fewer than
    0.4 end a sentence; common, fewer than 0.15 of the words are common ones.
    """
    rules = {name: " or ".join(f"({x.rule})" for x in RULES[name] if x.fault) for name in FAULTS}
    fired = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in rules.items()]))
    return F.when(F.col("n_words") < least_words, F.array(F.lit("short"))).otherwise(fired)


def vote_pattern(rules: dict[str, tuple[Level, ...]] | None = None) -> Column:
    """The votes of a row of ``text_statistics`` as one number: a digit per statistic, 0 where no level holds."""
    found, base = F.lit(0), 1
    for levels in (rules or RULES).values():
        digit = F.lit(0)
        for k, level in reversed(list(enumerate(levels, 1))):
            digit = F.when(F.expr(level.rule), k).otherwise(digit)
        found, base = found + digit * base, base * (len(levels) + 1)
    return found.cast("int")


def digits(patterns: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The vote of each statistic (a column each) from pattern numbers."""
    bases = np.cumprod([1, *sizes[:-1]])
    return (np.asarray(patterns, np.int64)[:, None] // bases) % np.array(sizes)


@dataclass
class Model:
    """Share of each type, and of each statistic the chance of each level by type (type x level)."""

    share: np.ndarray
    chances: list[np.ndarray]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of each type (columns) for rows of votes."""
        logs = np.log(self.share)[None] + sum(np.log(p[:, votes[:, j]]).T for j, p in enumerate(self.chances))
        odds = np.exp(logs - logs.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)


def first_guess(rules: dict[str, tuple[Level, ...]], types: tuple[str, ...] = TYPES) -> Model:
    """Where the fit starts, which settles what each type means: rules are more often right than not."""
    chances = []
    for levels in rules.values():
        table = np.full((len(types), len(levels) + 1), UNVOTED)
        table[:, 0], table[0, 0] = 0.5, 0.9
        for k, level in enumerate(levels, 1):
            for name in level.votes:
                table[types.index(name), k] = VOTED
        chances.append(table / table.sum(axis=1, keepdims=True))
    rest = (1 - PROSE_PRIOR) / (len(types) - 1)
    return Model(np.array([PROSE_PRIOR] + [rest] * (len(types) - 1)), chances)


def fit_votes(votes: np.ndarray, count: np.ndarray, start: Model, rounds: int = 500, tol: float = 1e-9) -> Model:
    """The model by expectation-maximization from distinct rows of votes and how often each occurs.

    Add-one smoothing of each distribution keeps every probability inside (0, 1).
    """
    model = start
    for _ in range(rounds):
        weight = model.posterior(votes) * count[:, None]
        chances = []
        for j, old in enumerate(model.chances):
            levels = old.shape[1]
            held = np.stack([weight[votes[:, j] == k].sum(axis=0) for k in range(levels)], axis=1) + 1 / levels
            chances.append(held / held.sum(axis=1, keepdims=True))
        share = (weight.sum(axis=0) + 1) / (weight.sum() + len(model.share))
        moved = np.abs(share - model.share).sum() + sum(np.abs(a - b).sum() for a, b in zip(chances, model.chances))
        model = Model(share, chances)
        if moved < tol:
            break
    return model


def text_types(statistics: DataFrame, id_col: str = "doc_id", rules: dict[str, tuple[Level, ...]] | None = None) -> DataFrame:
    """(id, faults, kind, p_kind, p_prose) for each row of ``text_statistics``.

    faults is the array of fault rules that hold (see ``faults``), kind the
    likeliest type by the posterior (the first of TYPES on a tie), p_kind and
    p_prose the posteriors of that type and of prose, rounded to 6 decimals.

    The texts are read once: ids, faults and vote patterns are written, and
    the model sees every document through the counts of patterns.  At most as
    many rows as there are patterns (the product of levels plus one, 648 with
    the rules given) reach the driver, whatever the number of documents.
    """
    rules = rules or RULES
    sizes = [len(x) + 1 for x in rules.values()]
    if prod(sizes) > 100_000:
        raise ValueError("more than 100,000 vote patterns")
    rows = materialize(statistics.select(id_col, faults().alias("faults"), vote_pattern(rules).alias("pattern")), "votes")
    counts = sorted((r["pattern"], r["count"]) for r in rows.groupBy("pattern").count().collect())
    votes = digits(np.array([p for p, _ in counts], np.int64), sizes)
    start = first_guess(rules)
    model = fit_votes(votes, np.array([n for _, n in counts], float), start) if counts else start
    scores = model.posterior(votes) if counts else np.empty((0, len(TYPES)))
    best = scores.argmax(axis=1)
    table = [(p, TYPES[k], round(float(s[k]), 6), round(float(s[0]), 6)) for (p, _), k, s in zip(counts, best, scores)]
    named = F.broadcast(statistics.sparkSession.createDataFrame(table, "pattern int, kind string, p_kind double, p_prose double"))  # a row per pattern
    return rows.join(named, "pattern").select(id_col, "faults", "kind", "p_kind", "p_prose")
