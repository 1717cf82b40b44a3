"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is cut into blocks of ``BLOCK`` bytes, all of which are compressed with either dictionary. Its
difference is the mean over the blocks of (bad size - good size) / (bad size + good size): above 0
if the text is more like good text. A logistic curve of it, of the logarithm of the text's bytes and of their product,
fitted on labelled rows that no dictionary saw, turns it into a score: few bytes tell little.

What is learned from is a bounded sample by two arguments: ``limit`` labelled rows, and of their blocks ``blocks`` a
class, the least by a hash of id and place. No whole text goes to the driver.

Null and empty texts have difference 0 and no bytes. Without labels of both classes, in the part for the dictionaries and in that for the
curve, every text scores 1. Rows with a null label, id or text don't teach; of repeated ids one row does
(``common.labelled_sample``). Repeated rows get a row each, an empty table none.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonecrop.llm.common import labelled_sample, let, map_rows, materialize, raw_texts

#: Labelled rows that are learned from at most, and blocks of them for the dictionary of a class at most: 8 MB.
TRAIN_ROWS, TRAIN_BLOCKS = 6_000, 32_768
BLOCK, DICTIONARY, LEVEL = 256, 112_640, 3


@dataclass
class Model:
    """Dictionaries, and the curve's weights of the difference, the product, the logarithm and 1."""

    good: bytes
    bad: bytes
    weights: tuple[float, float, float, float]


class Differ:
    """Compressors of a model's dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        def ready(x: bytes) -> zstandard.ZstdCompressor:
            d = zstandard.ZstdCompressionDict(x)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False)

        self.good, self.bad = ready(good), ready(bad)

    def __call__(self, raw: bytes) -> float:
        total, n = 0.0, 0
        for a in range(0, len(raw), BLOCK):
            block = raw[a : a + BLOCK]
            g, b = len(self.good.compress(block)), len(self.bad.compress(block))
            total += (b - g) / (b + g) * len(block)
            n += len(block)
        return total / n if n else 0.0


def dictionary(blocks: list[bytes]) -> bytes:
    """A dictionary of ``blocks``; the blocks themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY:] or b"\0" * 8


def terms(difference: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What the curve weighs."""
    log = np.log2(1 + n_bytes)
    return np.stack([difference, difference * log, log, np.ones(len(log))], 1)


def logistic(a: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, ...]:
    """Weights of the columns of ``a`` by Newton's method, with a slight pull to zero."""
    scale = a.std(0)
    scale[scale == 0] = 1.0
    a = a / scale
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + 0.01 * np.eye(len(w))
        w += np.clip(np.linalg.solve(h, a.T @ (y - p) - 0.01 * w), -3, 3)
    return tuple((w / scale).tolist())


def cut(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, place, block): the ``BLOCK``-byte blocks of the texts."""
    def of(raw: F.Column) -> F.Column:
        n = F.ceil(F.octet_length(raw) / BLOCK).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(raw, i * BLOCK + 1, F.lit(BLOCK))))

    return rows.select("doc_id", F.posexplode(let(F.col(text_col).cast("binary"), of)).alias("place", "block"))


def differences(rows: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """(doc_id, difference, n_bytes) of rows (doc_id, text)."""
    handle = rows.sparkSession.sparkContext.broadcast((good, bad))
    state: dict = {}

    def make(batch) -> list[list]:
        if not state:
            state["differ"] = Differ(*handle.value)
        raw = raw_texts(batch.column(1))
        return [batch.column(0), list(map(state["differ"], raw)), list(map(len, raw))]

    return map_rows(rows.select("doc_id", "text"), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, difference double, n_bytes long", make)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_ROWS, blocks: int = TRAIN_BLOCKS) -> Model | None:
    """Learn from at most ``limit`` labelled documents: a third of them for the curve, the rest for the dictionaries, of at most ``blocks`` blocks a class."""
    rows = labelled_sample(docs, labels, label_col, limit, id_col, text_col)
    curve = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(" curve")).cast("binary")) % 3 == 0
    rows = materialize(rows.select("doc_id", "text", (F.col("label") > 0).alias("good"), curve.alias("curve")), "compression-sample")
    if rows.groupBy("good", "curve").count().count() < 4:
        return None
    made = []
    for good in (True, False):
        part = cut(rows.filter(F.col("good") == good).filter("not curve"))
        least = part.orderBy(F.xxhash64("doc_id", "place"), "doc_id", "place").limit(blocks).select("block")
        made.append(dictionary([bytes(r["block"]) for r in least.collect()]))
    seen = differences(rows.filter("curve"), *made).join(rows.filter("curve").select("doc_id", "good"), "doc_id").select("difference", "n_bytes", "good").collect()
    x, n, y = (np.array(c, float) for c in zip(*sorted(map(tuple, seen)), strict=True))
    return Model(*made, logistic(terms(x, n), y))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, difference, score): a row per document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("difference"), F.lit(1.0).alias("score"))
    log, d = F.log2(1.0 + F.col("n_bytes")), F.col("difference")
    weighed = functools.reduce(operator.add, [F.lit(w) * x for w, x in zip(model.weights, (d, d * log, log, F.lit(1.0)), strict=True)])
    margin = F.greatest(F.lit(-35.0), F.least(F.lit(35.0), weighed))
    return differences(rows, model.good, model.bad).select("doc_id", "difference", (1 / (1 + F.exp(-margin))).alias("score"))
