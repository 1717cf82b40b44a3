"""Benchmark decontamination: word-pair seeds that no alignment can avoid, then Smith-Waterman.

1. The test items are read in blocks of at most ``BLOCK_WORDS`` words; a block is all that is
   broadcast, so the benchmark may be of any size.
2. All documents are scanned for how many occurrences each of the block's word pairs has.
3. All documents are scanned again. A seed found in a document gives a window of words around
   where the item would stand; the item is aligned to it (match 2, mismatch and gap -1), and the
   score is that alignment's over the score of the item against itself.

An alignment of m words of an item of n at the threshold t has at most 2m - 2tn edits, which cut it
into one run more than that; so at least (2t - 1)n - 1 of the item's pairs stand unbroken in the document.
Half as many less one of the item's pairs, the most frequent ones, are no seeds; of the others a document
must hold the rest of that number near one place. No alignment is lost. Items of up to five words may have
none unbroken, and then each word is followed by exactly one other: those are also sought with a word
between. This holds for thresholds of 0.6 and more; under that, short items may be missed.

Per document and item the best alignment is returned if its score reaches ``threshold``.

Words are Unicode word characters, lower-cased. Items of fewer than three words have no seeds and
match nothing. Null texts and items count as empty. Repeated rows give a row each; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stonecrop.llm.common import append_column, free_name, parts, strings

#: Words of a seed, and the least words of an item.
SEED, SHORTEST = 2, 3
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.6
BLOCK_WORDS = 2_000_000
MATCHES = "doc_id long, item_id long, score double, start_word long, end_word long, n_seeds long"
words = re.compile(r"\w+").findall


def align(window: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: the best score, and the first and one past the last word of ``window`` in it."""
    n = len(window)
    at = np.arange(n + 1)
    row, begin = np.zeros(n + 1, np.int64), at.copy()
    best = (0, 0, 0)
    for x in item.tolist():
        step = np.where(window == x, MATCH, MISMATCH)
        diagonal, up = row[:-1] + step, row[1:] + GAP
        value = np.r_[0, np.maximum(np.maximum(diagonal, up), 0)]
        start = np.r_[0, np.where(diagonal >= up, begin[:-1], begin[1:])]
        start = np.where(value > 0, start, at)
        # gaps along the row: the best of what stands to the left, less a penalty a word
        lifted = value - GAP * at
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, at, 0))
        row = top + GAP * at
        begin = start[source]
        j = int(np.argmax(row))
        if row[j] > best[0]:
            best = (int(row[j]), int(begin[j]), j)
    return best


class Items:
    """A block of test items with its seeds."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = [x for x, _ in items]
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        self.words = [np.array([number(w, len(self.vocabulary)) for w in words(t.lower())], np.int64) for _, t in items]
        self.base = len(self.vocabulary) + 1
        self.size = np.array([len(x) for x in self.words], np.int64)
        self.kinds = [np.unique(x, return_counts=True) for x in self.words]
        grams = [self.grams(x) if len(x) >= SHORTEST else x[:0] for x in self.words]
        self.codes = np.unique(np.concatenate([*grams, np.empty(0, np.int64)]))
        self.grams_of = [np.searchsorted(self.codes, g) for g in grams]
        self.short = bool(((self.size >= SHORTEST) & (self.size <= 5)).any())
        # of each pair, the items that have it as a seed and where: those from start[gram] to start[gram + 1]
        self.start = np.zeros(len(self.codes) + 1, np.int64)
        self.item = self.place = self.need = np.empty(0, np.int64)

    def grams(self, ids: np.ndarray, apart: int = 1) -> np.ndarray:
        """A code for each pair of words ``apart``, -1 if one of them is in no item."""
        a, b = ids[:-apart], ids[apart:]
        return np.where((a < 0) | (b < 0), -1, a * self.base + b)

    def encode(self, text: str) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words(text.lower())], np.int64)

    def _found(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = np.flatnonzero(codes >= 0)
        if not len(places) or not len(self.codes):
            return places[:0], places[:0]
        index = np.minimum(np.searchsorted(self.codes, codes[places]), len(self.codes) - 1)
        same = self.codes[index] == codes[places]
        return places[same], index[same]

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pairs of the items stand, and which."""
        at, gram = self._found(self.grams(ids))
        if not self.short:
            return at, gram
        wide, other = self._found(self.grams(ids, 2))
        return np.r_[at, wide], np.r_[gram, other]

    def choose(self, counts: np.ndarray, threshold: float = THRESHOLD) -> None:
        """Take as seeds each item's pairs but the most frequent ones, as many as an alignment can spare."""
        gram, item, place, need = [], [], [], []
        for i, grams in enumerate(self.grams_of):
            sure = int(np.ceil((2 * threshold - 1) * len(self.words[i]) - 1 - 1e-9))
            spare = max(0, (sure - 1) // 2)
            order = np.lexsort((np.arange(len(grams)), counts[grams]))[: len(grams) - spare]
            gram.append(grams[order])
            item.append(np.full(len(order), i, np.int64))
            place.append(order)
            need.append(max(1, sure - spare))
        gram, item, place = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (gram, item, place))
        order = np.argsort(gram, kind="stable")
        self.start = np.searchsorted(gram[order], np.arange(len(self.codes) + 1))
        self.item, self.place, self.need = item[order], place[order], np.array(need, np.int64)

    def matches(self, ids: np.ndarray, threshold: float) -> dict[int, tuple[float, int, int, int]]:
        """By item: score, first word, one past the last, seeds found."""
        at, gram = self.found(ids)
        n = self.start[gram + 1] - self.start[gram]
        if not n.sum():
            return {}
        index = np.repeat(self.start[gram] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item = self.item[index]
        diagonal = np.repeat(at, n) - self.place[index]
        # windows of an item are neighbours by key; those of two items never are
        width = len(ids) + 3
        keys, counts = np.unique(item * width + diagonal // self.size[item] + 1, return_counts=True)
        # the edits of an alignment shift it by less than an item, so its seeds lie in a window and the next
        near, beside = counts.copy(), np.diff(keys) == 1
        near[1:] += counts[:-1] * beside
        near[:-1] += counts[1:] * beside
        enough = np.flatnonzero(near >= self.need[keys // width])
        best: dict[int, tuple[float, int, int, int]] = {}
        for key, seeds in zip(keys[enough].tolist(), counts[enough].tolist(), strict=True):
            item_, block = key // width, key % width - 1
            own = self.words[item_]
            size, pad = len(own), 2 + int(2 * len(own) * (1 - threshold))
            low = max(0, block * size - pad)
            window = ids[low : max(0, block * size + 2 * size + pad)]
            # an alignment at the threshold needs this many words in common
            kinds, own_counts = self.kinds[item_]
            which = np.minimum(np.searchsorted(kinds, window), len(kinds) - 1)
            common = np.minimum(np.bincount(which[kinds[which] == window], minlength=len(kinds)), own_counts).sum()
            if common < threshold * size - 1e-9:
                continue
            whole = self._whole(window, own) if common == size else -1
            if whole >= 0:
                score, first, end = 1.0, low + whole, low + whole + size
            else:
                got, first, end = align(window, own)
                score, first, end = got / (MATCH * size), low + first, low + end
            if score >= threshold and (item_ not in best or (score, -first) > (best[item_][0], -best[item_][1])):
                best[item_] = (score, first, end, seeds)
        return best

    @staticmethod
    def _whole(window: np.ndarray, own: np.ndarray) -> int:
        """Where ``own`` first stands unaltered in ``window``, or -1."""
        for at in np.flatnonzero(window[: max(0, len(window) - len(own) + 1)] == own[0]).tolist():
            if np.array_equal(window[at : at + len(own)], own):
                return at
        return -1


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items, fetched partition by partition, in blocks of at most ``BLOCK_WORDS`` words."""
    rows = benchmark.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))).distinct()
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        n = len(words(text))
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    if block:
        yield block


def prepared(docs: DataFrame, text_col: str, block: list[tuple[int, str]], threshold: float = THRESHOLD) -> Items:
    """The block with its seeds, after a scan of all documents for how frequent its word pairs are."""
    block.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    items = Items(block)
    handle = docs.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = handle.value
        total = np.zeros(len(own.codes), np.int64)
        for batch in parts(batches):
            for text in strings(batch.column(0)):
                np.add.at(total, own.found(own.encode(text))[1], 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["gram", "n"])

    counts = np.zeros(len(items.codes), np.int64)
    # as many rows as the block has pairs, at most
    for gram, n in docs.select(text_col).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():
        counts[gram] = n
    items.choose(counts, threshold)
    return items


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, item_id, score, start_word, end_word, n_seeds)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    out = None
    for block in blocks(benchmark, item_id_col, item_text_col):
        handle = spark.sparkContext.broadcast(prepared(rows, "text", block, threshold))

        def search(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:
            items = handle.value
            for batch in parts(batches):
                got = []
                for doc, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                    got += [(doc, items.ids[i], *m) for i, m in items.matches(items.encode(text), threshold).items()]
                if got:
                    columns = list(zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 2 else pa.int64()) for k, c in enumerate(columns)], names=[x.split()[0] for x in MATCHES.split(", ")])

        part = rows.mapInArrow(search, MATCHES)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], MATCHES)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that hold a test item. Columns as in ``docs``; no shuffle."""
    spark = docs.sparkSession
    rows, columns = docs, docs.columns
    for block in blocks(benchmark, item_id_col, item_text_col):
        handle = spark.sparkContext.broadcast(prepared(docs, text_col, block, threshold))
        name = free_name(rows, "leaked")

        def leaked(texts: list[bytes], handle=handle) -> list[bool]:
            items = handle.value
            return [bool(items.matches(items.encode(x.decode()), threshold)) for x in texts]

        rows = append_column(rows, name, T.BooleanType(), text_col, leaked).filter(~F.col(name)).select(*columns)
    return rows
