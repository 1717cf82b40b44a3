"""Quality rules as a learned decision list.

``with_stats`` counts each whole text once, on Arrow batches. ``FEATURES`` are Spark expressions
over those counts. ``learn`` does sequential covering on a bounded labelled sample: a rule grows by
the threshold condition of the largest FOIL gain, is pruned from its end on rows it was not grown
on, and is kept if it is precise there; the rows it covers are left out and the next rule
grows. ``DecisionList.keep`` is the list as one ordered Spark conditional expression.

Texts that are null count as empty. Rows with a null label, id or text don't teach; of repeated ids one row does
(``common.labelled_sample``). Without labels of both classes the list is empty and rejects nothing. Ties between
conditions go to the first feature and least threshold. Repeated rows get a row each, an empty table none; columns may
have any names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stonecrop.llm.common import append_column, free_name, labelled_sample

#: Labelled rows that are learned from at most.
TRAIN_ROWS = 12_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits", "n_distinct", "n_top_word", "n_twice"]
STATS = T.StructType([T.StructField(x, T.LongType()) for x in COUNTS])
SPACE, SYMBOLS, MARKS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", b"!?;:"
LATER_BYTES = bytes(range(0x80, 0xC0))
UPPER, DIGITS = bytes(range(65, 91)), b"0123456789"


def stats(raw: bytes) -> tuple[int, ...]:
    """The counts of ``COUNTS`` of a UTF-8 text; words are runs without ASCII white space."""
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), *[0] * (len(COUNTS) - 3))
    packed = raw.translate(None, SPACE)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeated, size = 0, len(number)
    if n >= 4:
        if size < 2_000_000:
            grams = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
            order = np.argsort(grams, kind="stable")
            same = np.diff(grams[order]) == 0
            twice = np.zeros(n - 2, bool)
            twice[order] = np.r_[same, False] | np.r_[False, same]
        else:  # three numbers don't fit in 63 bits
            seen = Counter(zip(words, words[1:], words[2:], strict=False))
            twice = np.fromiter((seen[x] > 1 for x in zip(words, words[1:], words[2:], strict=False)), bool, n - 2)
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeated = int(covered.sum())
    return (
        n,
        len(packed.translate(None, LATER_BYTES)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(raw) - len(raw.translate(None, UPPER)),
        len(raw) - len(raw.translate(None, MARKS)),
        len(raw) - len(raw.translate(None, DIGITS)),
        size,
        int(np.bincount(ids).max()),
        int((ids[1:] == ids[:-1]).sum()),
    )


def with_stats(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` with the struct of counts in column ``name``."""
    return append_column(docs, name, STATS, text_col, lambda texts: [dict(zip(COUNTS, stats(x), strict=True)) for x in texts])


def base_failed(s: str) -> Column:
    c = lambda x: F.col(f"{s}.{x}")
    return (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))


def features(s: str) -> dict[str, Column]:
    """Ratios of the counts in struct ``s``, as doubles; an empty text has zeros."""
    c = lambda x: F.col(f"{s}.{x}").cast("double")
    share = lambda a, b: F.when(F.col(f"{s}.{b}") > 0, c(a) / c(b)).otherwise(0.0)
    return {
        "words": c("n_words"),
        "word_length": share("word_chars", "n_words"),
        "symbols_a_char": share("n_symbols", "word_chars"),
        "symbols_a_word": share("n_symbols", "n_words"),
        "duplicate_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "words_a_line": share("n_words", "n_lines"),
        "upper_a_char": share("n_upper", "word_chars"),
        "marks_a_word": share("n_marks", "n_words"),
        "digits_a_char": share("n_digits", "word_chars"),
        "distinct_words": share("n_distinct", "n_words"),
        "top_word": share("n_top_word", "n_words"),
        "word_twice": share("n_twice", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values >= self.threshold if self.above else values < self.threshold

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] >= self.threshold if self.above else of[self.feature] < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a text that meets all conditions of one is rejected."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def keep(self, s: str) -> Column:
        of, out = features(s), None
        for rule in self.rules:
            met = rule[0].column(of)
            for c in rule[1:]:
                met = met & c.column(of)
            out = F.when(met, False) if out is None else out.when(met, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def __str__(self) -> str:
        return "\n".join(" and ".join(map(str, r)) for r in self.rules)


def learn(names: list[str], x: np.ndarray, bad: np.ndarray, grow: np.ndarray, precision: float = 0.9, least: int = 3, conditions: int = 4, rules: int = 24, cuts: int = 64) -> DecisionList:
    """Sequential covering of the rows where ``bad``; ``grow`` marks those rules are grown on, the others prune.

    A rule must be right on ``precision`` of the rows it covers in either part, by the
    Laplace estimate where it prunes, and cover ``least`` bad rows.
    """
    left = np.ones(len(bad), bool)
    grids = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts + 1), method="nearest")) if len(bad) else np.empty(0) for j in range(len(names))]
    found = []

    def right(met: np.ndarray, part: np.ndarray) -> tuple[int, int]:
        return int((met & part & bad).sum()), int((met & part & ~bad).sum())

    while len(found) < rules:
        part, rule, met = left & grow, [], left.copy()
        while len(rule) < conditions:
            p0, n0 = right(met, part)
            if p0 < least or not n0:
                break
            before, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
            rows = met & part
            for j, name in enumerate(names):
                values, sick = x[rows, j], bad[rows]
                grid = np.unique(np.r_[grids[j], np.quantile(values[sick], np.linspace(0, 1, 17), method="nearest")])
                order = np.argsort(values, kind="stable")
                sums = np.r_[0, np.cumsum(sick[order])]
                at = np.searchsorted(values[order], grid, "left")
                for above in (True, False):
                    p = p0 - sums[at] if above else sums[at]
                    n = (len(values) - at if above else at) - p
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(p >= least, p * (np.log2(p / (p + n)) - before), 0)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], Condition(name, above, float(grid[k])))
            if best[1] is None:
                break
            rule.append(best[1])
            met &= best[1].holds(x[:, names.index(best[1].feature)])
        if not rule:
            break

        def worth(n: int) -> float:
            met = left.copy()
            for c in rule[:n]:
                met &= c.holds(x[:, names.index(c.feature)])
            p, q = right(met, left & ~grow)
            return (p - q) / max(1, p + q)

        best = max(range(1, len(rule) + 1), key=lambda n: (worth(n), -n))
        met = left.copy()
        for c in rule[:best]:
            met &= c.holds(x[:, names.index(c.feature)])
        p, q = right(met, grow)
        p2, q2 = right(met, ~grow)
        if p < least or p / (p + q) < precision or (p2 + 1) / (p2 + q2 + 2) < precision - 0.15 or (p + p2) / (p + p2 + q + q2) < precision:
            break
        found.append(tuple(rule[:best]))
        left &= ~met
    return DecisionList(tuple(found))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_ROWS) -> DecisionList:
    """Learn from at most ``limit`` labelled documents (label 0 is bad), those that pass the base rules."""
    rows = with_stats(labelled_sample(docs, labels, label_col, limit, id_col, text_col), "text", "s").filter(~base_failed("s"))
    of = features("s")
    got = rows.select((F.xxhash64("doc_id") % 3).alias("fold"), "label", *[v.alias(k) for k, v in of.items()]).orderBy("doc_id", *of).toPandas() if not labels.isEmpty() else None
    if got is None or got["label"].nunique() < 2:
        return DecisionList()
    return learn(list(of), got[list(of)].to_numpy(float), (got["label"] == 0).to_numpy(), (got["fold"] != 0).to_numpy())


def judge(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the counts, base_failed, kept): a row per document."""
    rows = with_stats(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "s")
    return rows.select("doc_id", "s.*", base_failed("s").alias("base_failed"), (~base_failed("s") & rules.keep("s")).alias("kept"))


def keep_good(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """The documents that neither the base rules nor ``rules`` reject. Columns as in ``docs``."""
    s = free_name(docs, "quality_stats")
    return with_stats(docs, text_col, s).filter(~base_failed(s) & rules.keep(s)).select(*docs.columns)
