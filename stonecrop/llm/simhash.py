"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits by majority over the hashes of the text's word shingles. Each bit
position has a non-zero vector of r + 1 bits over GF(2); mask v keeps the positions whose vector
has an odd product with v. The vectors of r positions span at most r dimensions, so some v is
orthogonal to all of them: any two fingerprints that differ in at most r bits are equal under
some of the 2**(r + 1) - 1 masks. No pair within the radius is lost.

Buckets hold distinct fingerprints only. A bucket is compared in one task, and gives a star per
connected part rather than its pairs. A bucket over ``BUCKET`` fingerprints is not compared:
its fingerprints are dealt anew by the same construction over the bits that its mask leaves
out, which halves them; after three rounds some eight bits are left, hence at most a few hundred
fingerprints. Memory in a task is bounded by ``BUCKET``, and the result stays exact.

Connected components come from alternating large-star and small-star steps on tables.

Null texts count as empty; texts without words have fingerprint 0 and link like any other.
Rows with equal ids keep a row each. A component whose ids are all null has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stonecrop.llm.common import append_column, free_name, materialize, raw_texts

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints of a bucket that are compared directly.
BUCKET = 4096
#: Rounds of dealing after which every bucket is small by its number of free bits.
DEPTH = 4
CHUNK = 65_536


def fingerprint(raw: bytes, k: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text over its ``k``-word shingles, repeats included."""
    words = raw.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    ends = ends[min(k, len(words)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for a in range(0, n, CHUNK):
        hashes = np.array([digest(joined[i:j], seed) for i, j in zip(starts[a : a + CHUNK], ends[a : a + CHUNK], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def covering_masks(free: int, radius: int = RADIUS) -> list[int]:
    """Masks over the bit positions set in ``free``: 2**(radius + 1) - 1 of them."""
    places = [i for i in range(BITS) if free >> i & 1]
    top = 2 ** (radius + 1)
    # where there are more vectors than positions, they are taken in steps, so that each mask keeps many positions
    step = 1 if top <= BITS else round(top * 0.618) | 1
    vector = {p: 1 + i * step % (top - 1) for i, p in enumerate(places)}
    return [sum(1 << p for p in places if (vector[p] & v).bit_count() & 1) for v in range(1, top)]


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprints(docs: DataFrame, text_col: str, name: str, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the signed 64-bit fingerprint in column ``name``."""
    return append_column(docs, name, T.LongType(), text_col, lambda texts: [signed(fingerprint(x, shingle)) for x in texts])


def stars(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(fingerprint, least fingerprint of its connected part) within one bucket, the least one left out."""
    n = len(values)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    step = max(1, 1_000_000 // n)
    for a in range(0, n, step):
        near = np.bitwise_count(values[a : a + step, None] ^ values[None, a:]) <= radius
        for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            p, q = root(a + int(i)), root(a + int(j))
            if p != q:
                parent[max(p, q)] = min(p, q)
    return [(int(values[i]), int(values[r])) for i in range(n) if (r := root(i)) != i]


def _deal(keys: np.ndarray, values: np.ndarray, taken: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each bucket in the sorted ``keys``."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
        yield keys[a:b], values[a:b], taken[a:b]


def compare(rows: DataFrame, radius: int, bucket: int, last: bool) -> DataFrame:
    """Links within buckets of (key, fp, taken): (a, b, null), or (fp, key, taken) of what is dealt anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64)] * 3
        over = None  # key of a bucket too large to compare, whose rows pass through

        def out(a: np.ndarray, b: np.ndarray, taken: np.ndarray | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64()) if taken is None else pa.array(taken, pa.int64())], names=["a", "b", "taken"])

        def compared(values: np.ndarray) -> pa.RecordBatch | None:
            values = np.unique(values.view(np.uint64))
            if len(values) > 1 and (found := stars(values, radius)):
                a, b = (np.array(x, np.uint64).view(np.int64) for x in zip(*found, strict=True))
                return out(a, b, None)
            return None

        def again(values: np.ndarray, taken: np.ndarray) -> Iterator[pa.RecordBatch]:
            for used in np.unique(taken).tolist():
                part = values[taken == used]
                for mask in covering_masks(~used & (2**BITS - 1), radius):
                    m = signed(mask | used & (2**BITS - 1))
                    yield out(part, part & m, np.full(len(part), m, np.int64))

        def settle(columns: list[np.ndarray], ended: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rest, over
            keys, values, taken = columns
            if over is not None:
                n = int(np.searchsorted(keys != over, True))
                yield from again(values[:n], taken[:n])
                keys, values, taken = keys[n:], values[n:], taken[n:]
                if len(keys) or ended:
                    over = None
            if not len(keys):
                rest = [keys, values, taken]
                return
            start = 0 if ended else int(np.flatnonzero(keys == keys[-1])[0])
            done = (keys, values, taken) if ended else (keys[:start], values[:start], taken[:start])
            rest = [keys[:0], values[:0], taken[:0]] if ended else [keys[start:], values[start:], taken[start:]]
            if len(done[0]):
                # most buckets have one fingerprint
                single = np.r_[True, np.diff(done[0]) != 0] & np.r_[np.diff(done[0]) != 0, True]
                found = []
                for _, v, t in _deal(*(x[~single] for x in done)) if not single.all() else ():
                    if len(v) > bucket and not last:
                        yield from again(v, t)
                    elif (b := compared(v)) is not None:
                        found.append(b)
                yield from found
            if len(rest[0]) > bucket and not last:
                over = int(rest[0][0])
                yield from again(rest[1], rest[2])
                rest = [x[:0] for x in rest]

        for batch in batches:
            columns = [np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, batch.columns, strict=True)]
            yield from settle(columns, False)
        yield from settle(rest, True)

    dealt = rows.repartition("key").sortWithinPartitions("key")
    return materialize(dealt.mapInArrow(run, "a long, b long, taken long"), "simhash-links")


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) with a > b among the fingerprints in column ``fp``: enough to connect all within ``radius``."""
    masks = [signed(m) for m in covering_masks(2**BITS - 1, radius)]
    fp = F.col("fp")
    rows = distinct.select(F.explode(F.array(*[F.struct(F.xxhash64(F.lit(m), fp.bitwiseAND(F.lit(m))).alias("key"), fp, F.lit(m).alias("taken")) for m in masks])).alias("x")).select("x.key", "x.fp", "x.taken")
    found = compare(rows, radius, bucket, False)
    edges = found.filter("taken is null").select("a", "b")
    for depth in range(2, DEPTH + 1):
        more = found.filter("taken is not null")
        if more.isEmpty():
            break
        rows = more.select(F.xxhash64("taken", "b").alias("key"), F.col("a").alias("fp"), "taken")
        found = compare(rows, radius, bucket, depth == DEPTH)
        edges = edges.unionByName(found.filter("taken is null").select("a", "b"))
    return edges


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b) that isn't the least of its component."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    state = None
    while True:
        edges = materialize(edges, "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max("b")).first()
        if not now[0] or now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
        # large-star: neighbours above a node join the least node around it
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        # small-star: a node and its lesser neighbours join the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = joined.unionByName(least.select("a", F.col("m").alias("b"))).filter("a > b").distinct()


def rooted(prints: DataFrame, radius: int, bucket: int, order: list[str]) -> DataFrame:
    """From rows (doc_id, fp), a row per fingerprint: (fp, root of its component, least id, best), ``best`` the least of the columns ``order``, rows without id last."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), *order)
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(first).alias("best"))
    roots = components(links(distinct.select("fp"), radius, bucket))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "best", F.coalesce("root", "fp").alias("root"))


def classes(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """From rows (doc_id, fp), a row per fingerprint: (fp, component_id), the least id of its component."""
    each = rooted(prints, radius, bucket, ["doc_id"])
    return each.select("fp", "root").join(each.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): a row per document."""
    prints = fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", "fp", shingle).select("doc_id", "fp")
    prints = materialize(prints, "simhash-prints")
    return prints.join(classes(prints, radius), "fp").select("doc_id", "fp", "component_id")


#: Rows that go, up to which their row ids (8 bytes each) are broadcast; beyond, the ids are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """One row of each near-duplicate group. Columns as in ``docs``.

    It is the row with the least id (nulls last); of several rows with that id the one whose text has the least
    hash, then the one read first. Texts are read once and written once with a row id; all else moves ids and
    fingerprints only, unless more than ``broadcast_ids`` rows go.
    """
    fp, uid = free_name(docs, "simhash_fp"), free_name(docs, "simhash_uid")
    marked = fingerprints(docs, text_col, fp, shingle).withColumn(uid, F.monotonically_increasing_id())
    # once written, row ids are data: a task that runs again reads the same ones
    marked = materialize(marked, "simhash-rows")
    prints = marked.select(F.col(id_col).cast("long").alias("doc_id"), F.col(fp).alias("fp"), F.xxhash64(F.col(text_col)).alias("h"), F.col(uid).alias("uid"))
    prints = materialize(prints, "simhash-prints")
    kept = rooted(prints, radius, BUCKET, ["doc_id", "h", "uid"]).groupBy("root").agg(F.min("best").alias("best")).select("best.uid")
    gone = materialize(prints.select("uid").join(kept, "uid", "left_anti").select(F.col("uid").alias(uid)), "simhash-gone")
    few = gone.count() <= broadcast_ids
    return marked.join(F.broadcast(gone) if few else gone, uid, "left_anti").select(*docs.columns)
