"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its lower-cased words, their first four and five letters,
word pairs, triples and pairs with one word between, from the whole text. FTRL-proximal (McMahan et al. 2013) has a learning
rate per coordinate and an L1 term that keeps most weights at exactly zero; what is broadcast is
the non-zero ones, at most 2**BITS.

What is learned from is a bounded sample by two arguments: ``limit`` labelled rows, and as many of them, in the order of a
hash of the id, as have ``features`` features in all.

Null texts count as empty; a text without words scores by the bias alone. Without labels of both
classes every text scores 0. Rows with a null label, id or text don't teach; of repeated ids one row does
(``common.labelled_sample``). Repeated rows get a row each, an empty table none.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonecrop.llm.common import labelled_sample, map_rows, materialize, raw_texts

#: 2**BITS weights of 4 bytes: 4 MB.
BITS = 20
#: Labelled rows that are learned from at most, and features of them in all: 4 bytes each on the driver.
TRAIN_ROWS, TRAIN_FEATURES = 12_000, 50_000_000
#: Words whose hashes a worker keeps, about 50 MB.
REMEMBERED = 300_000
words = re.compile(r"[^\W\d_]+").findall


class Memory:
    """Hashes of words and of their first four and five letters, kept between texts."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.hashes = np.empty((1024, 3), np.uint64)

    def of(self, found: list[str]) -> np.ndarray:
        if len(self.number) > REMEMBERED:
            self.number.clear()
        number = self.number
        if new := [w for w in dict.fromkeys(found) if w not in number]:
            start, end = len(number), len(number) + len(new)
            number.update(zip(new, range(start, end), strict=True))
            while end > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.empty_like(self.hashes)])
            crc = zlib.crc32
            flat = [crc(x) for w in new for x in (w.encode(), b"4" + w[:4].encode(), b"5" + w[:5].encode())]
            self.hashes[start:end] = (np.array(flat, np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(-1, 3)
        return self.hashes[np.fromiter(map(number.__getitem__, found), np.int64, len(found))].T


def codes(text: str, bits: int = BITS, memory: Memory | None = None) -> np.ndarray:
    """The feature numbers of a text, repeats included."""
    found = words(text.lower())
    if not found:
        return np.empty(0, np.int64)
    h, four, five = (memory or Memory()).of(found)
    p, q = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    grams = [h, four, five]
    if len(h) > 1:
        grams.append((h[:-1] * p) ^ (h[1:] * q))
    if len(h) > 2:
        grams += [((h[:-2] * p) ^ (h[1:-1] * q)) * q ^ (h[2:] * p), (h[:-2] * q) ^ (h[2:] * p) + np.uint64(1)]
    mixed = np.concatenate(grams)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * p
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def hashed(text: str, bits: int = BITS, memory: Memory | None = None) -> np.ndarray:
    """The distinct feature numbers of a text, sorted."""
    return np.unique(codes(text, bits, memory))


@dataclass
class Model:
    bits: int
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.index] = self.weight
        return w


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0, epochs: int = 5) -> Model:
    """Online FTRL-proximal over ``rows`` of (feature numbers, 0 or 1)."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias = rate = 0.0
    for _ in range(epochs):
        for x, y in rows:
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) <= l1, 0.0, (np.sign(zx) * l1 - zx) / ((beta + root) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / alpha * w
            n[x] = nx + g * g
            rate += g * g
            bias -= 0.1 * g / (1 + np.sqrt(rate))
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    used = np.flatnonzero(w)
    return Model(bits, used, w[used].astype(np.float32), float(bias))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_ROWS, features: int = TRAIN_FEATURES) -> Model | None:
    """Learn from at most ``limit`` of the labelled documents. The texts become feature numbers on the executors."""
    sample = labelled_sample(docs, labels, label_col, limit, id_col, text_col)

    def make(batch) -> list[list]:
        memory = Memory()
        return [batch.column(0), batch.column(1), [hashed(x.decode(), BITS, memory) for x in raw_texts(batch.column(2))]]

    kind = f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, label int, x array<int>"
    made = materialize(map_rows(sample.select("doc_id", "label", "text"), kind, make), "toxicity-sample")
    sizes = sorted((zlib.crc32(str(r[0]).encode()), r[0], r[1]) for r in made.select("doc_id", F.size("x")).collect())
    fits = int(np.searchsorted(np.cumsum([n for _, _, n in sizes]), features, "right")) if sizes else 0
    if fits < len(sizes):
        few = docs.sparkSession.createDataFrame([(i,) for _, i, _ in sizes[:fits]], made.select("doc_id").schema)
        made = made.join(F.broadcast(few), "doc_id")  # at most ``limit`` ids
    rows = []
    for batch in made.select("doc_id", "label", "x").toArrow().to_batches():
        ids, y, x = batch.columns
        # views of the batch's memory, not copies
        flat, cuts = x.flatten().to_numpy(), np.r_[0, np.cumsum(x.value_lengths().to_numpy())]
        rows += [(i, flat[a:b], int(k > 0)) for i, k, a, b in zip(ids.to_pylist(), y.to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    if len({y for _, _, y in rows}) < 2:
        return None
    rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    return ftrl([(x, y) for _, x, y in rows])


def margin(text: str, model: Model, dense: np.ndarray, memory: Memory) -> float:
    """Bias and weights of the distinct features; only those with a weight are told apart."""
    found = codes(text, model.bits, memory)
    return model.bias + float(dense[np.unique(found[dense[found] != 0])].sum(dtype=float))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): a row per document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double"
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    handle = docs.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    def make(batch) -> list[list]:
        if not state:
            state.update(dense=handle.value.dense(), memory=Memory())
        sums = np.array([margin(x.decode(), handle.value, state["dense"], state["memory"]) for x in raw_texts(batch.column(1))])
        return [batch.column(0), 1 / (1 + np.exp(-np.clip(sums, -35, 35)))]

    return map_rows(rows, kind, make)
