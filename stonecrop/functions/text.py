"""Tokens, shingles, Jaccard similarity and sentence chunks as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores; one suffix goes: ed, ing or s of words over four characters, s of four."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.transform(found, lambda w: F.when(F.length(w) > 4, F.regexp_replace(w, "(ed|ing|s)$", "")).when(F.length(w) == 4, F.regexp_replace(w, "s$", "")).otherwise(w))


def shingles(text: Column, k: int = 3) -> Column:
    """Distinct runs of ``k`` tokens, space-joined; of fewer tokens all are one shingle.

    The tokens are bound as the variable of an outer lambda: an optimizer that inlines this
    expression, as into a pushed filter, can't make them anew for each shingle.
    """
    def of(t: Column) -> Column:
        n = F.size(t)
        # items one by one: slice() within a lambda copies the whole array each time
        each = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(t, i + j) for j in range(k)]))
        return F.when(n < k, F.array(F.array_join(t, " "))).otherwise(F.array_distinct(each))

    return F.get(F.transform(F.array(tokens(F.coalesce(text, F.lit("")))), of), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def minhash(items: Column, permutations: int = 128, seed: int = 1) -> Column:
    """Signature of longs: for each seed the least hash over the items."""
    return F.array(*[_least(items, seed + i) for i in range(permutations)])


def _least(items: Column, seed: int) -> Column:
    return F.array_min(F.transform(items, lambda x: F.xxhash64(F.lit(seed), x)))


def sentences(text: Column) -> Column:
    """Split after . ! or ? before white space."""
    return F.split(text, r"(?<=[.!?])\s+")


def sentence_list(text: str) -> list[str]:
    """The sentences of a text without white space around them; none is empty."""
    return [s for s in map(str.strip, _SENTENCE_END.split(text)) if s]


def chunked(text: str, max_tokens: int = 512) -> list[str]:
    """Sentences packed greedily into chunks of at most three quarters of ``max_tokens`` words; a longer sentence is a chunk of its own.

    A text without sentences is one chunk of its first ``4 * max_tokens`` characters.
    """
    most, out, now, n = int(max_tokens * 0.75), [], [], 0
    for s in sentence_list(text):
        words = len(s.split())
        if now and n + words > most:
            out.append(" ".join(now))
            now, n = [], 0
        now.append(s)
        n += words
    return [*out, " ".join(now)] if now else [text.strip()[: 4 * max_tokens]]


def chunks(text: Column, max_tokens: int = 512) -> Column:
    """``chunked`` of a column, in Arrow batches: the rule is sequential, and a fold of expressions copies all chunks at each sentence. Null for null."""
    @F.pandas_udf("array<string>")
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else chunked(t, max_tokens))

    return made(text)


#: Kept hashes of normalized words in a worker.
REMEMBERED = 300_000


class _Known(dict):
    """Hashes of normalized words, made when they are first asked for."""

    def __missing__(self, word: str) -> int:
        made = self[word] = xxhash.xxh64_intdigest(_stemmed(word).encode(), 7)
        return made


def shingle_reader(k: int = 3) -> Callable[[pa.Array], list[np.ndarray]]:
    """A function from texts to the distinct 64-bit hashes of the ``shingles`` of each, sorted. Null counts as empty."""
    find, known = re.compile(r"\w+").findall, _Known()

    def of(text: str | None) -> np.ndarray:
        words = find((text or "").lower())
        if len(known) > REMEMBERED:
            known.clear()
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(h) - k + 1
        total = np.full(max(n, 1), len(words) if n < 1 else k, np.uint64)
        for j in range(k if n > 0 else len(h)):
            part = h[j : j + n] if n > 0 else h[j : j + 1]
            total = (total ^ part) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(32)
        total.sort()
        return total[np.r_[True, total[1:] != total[:-1]]].view(np.int64)

    return lambda texts: [of(x) for x in texts.to_pylist()]


def shingle_hashes(df: DataFrame, id_col: str, text_col: str, k: int = 3) -> DataFrame:
    """(id, items): the distinct 64-bit hashes of each text's ``shingles``, sorted, in Arrow batches. Null counts as empty."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = shingle_reader(k)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(read(batch.column(1)), pa.list_(pa.int64()))], names=["id", "items"])

    return rows.mapInArrow(run, T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("items", T.ArrayType(T.LongType()))]))


def _stemmed(w: str) -> str:
    """The rule of ``tokens``."""
    return re.sub("(ed|ing|s)$", "", w) if len(w) > 4 else w.removesuffix("s") if len(w) == 4 else w


def line_slice(text: Column, first: int = 1, last: int | None = None, max_chars: int | None = None) -> Column:
    """Lines ``first`` to ``last``, from 1, of a text."""
    lines = F.split(text, "\n", -1)
    taken = F.slice(lines, F.lit(first), F.lit(last - first + 1) if last is not None else F.greatest(F.size(lines) - first + 1, F.lit(0)))
    out = F.array_join(taken, "\n")
    return F.substring(out, 1, max_chars) if max_chars else out
