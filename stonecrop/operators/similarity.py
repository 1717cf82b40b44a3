"""Exact set-similarity and Hamming joins, greedy leaders, and vector search."""

from __future__ import annotations

import functools
import hashlib
import math
import operator
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from stonecrop.functions import hashing
from stonecrop.functions import text as text_functions
from stonecrop.sources.files import materialize

#: Distance up to which covering masks are fewer than what they save.
MASKED = 7
#: Rows that masks are chosen by, and pairs to check that cost as much as to deal, shuffle and sort a row.
MEASURED, DEALING = 4096, 100

#: Counters that the order of items goes by: an item ranks by how many places of all sets fall to its counter. 4 bytes each are broadcast.
SLOTS = 1 << 20
_BLOCKS = 16
#: Sets of a bucket that meet on a second item too.
BUCKET = 1_000
#: Sets of one side of a part of a bucket that is still too large then.
PART = 500
#: Rows of a task that joins first items, and items of a task that verifies, on average; sets of a group that are verified together.
DEALT, CHECKED, TOGETHER = 500_000, 2_000_000, 256
#: Rows up to which a table of ids is broadcast; beyond, it is joined by a shuffle.
BROADCAST_IDS = 1_000_000


@dataclass
class Source:
    """Rows whose first column is an id, and what makes a reader of the second one: from an Arrow array to the items of each row, 64-bit and distinct."""

    rows: DataFrame
    reader: Callable[[], Callable[[pa.Array], list[np.ndarray]]]

    def some(self, ids: DataFrame, how: str = "left_semi") -> Source:
        """The rows whose id is in ``ids``, or with ``left_anti`` is not."""
        return Source(self.rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, self.rows.columns[0], how), self.reader)

    @property
    def kind(self) -> T.DataType:
        return self.rows.schema[0].dataType


def _listed(column: pa.Array) -> list[np.ndarray]:
    values, at = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


class Tally:
    """Counts items by slot, without a row for each."""

    def __init__(self) -> None:
        self.counts, self.sets, self.pending, self.held = np.zeros(SLOTS, np.int64), 0, [], 0

    def see(self, items: list[np.ndarray]) -> None:
        self.sets += len(items)
        self.pending += items
        self.held += sum(map(len, items))
        if self.held > SLOTS:
            self.settle()

    def settle(self) -> None:
        if self.held:
            self.counts += np.bincount(_slot(np.concatenate(self.pending)), minlength=SLOTS)
        self.pending, self.held = [], 0

    def blocks(self) -> list[bytes]:
        self.settle()
        return [zlib.compress(x.tobytes(), 1) for x in self.counts.reshape(_BLOCKS, -1)]


def _slot(items: np.ndarray) -> np.ndarray:
    """Of codes that needn't be even: the top bits of a product."""
    return ((items.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).view(np.int64)


@dataclass
class Order:
    """Counts by slot, the number of sets and that of items: items come by their slot's count, then by value, which is a total order."""

    counts: np.ndarray
    sets: int
    items: int


def _order(tallied: DataFrame) -> Order:
    """Of rows (block, counts, sets) from each task."""

    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary()), "sets": pa.array([pc.sum(table.column("sets")).as_py()], pa.int64())})

    found = {r["block"]: r for r in tallied.groupBy("block").applyInArrow(run, "block int, counts binary, sets long").collect()}
    if not found:
        return Order(np.zeros(SLOTS, np.uint32), 0, 0)
    counts = np.concatenate([np.frombuffer(zlib.decompress(found[i]["counts"]), np.int64) for i in range(_BLOCKS)])
    return Order(np.minimum(counts, 2**32 - 1).astype(np.uint32), found[0]["sets"], int(counts.sum()))


def sketch(items: np.ndarray) -> bytes:
    """A bit for each of some two places an item: whether an odd number of items falls there. Sets differ in at least as many items as their sketches in bits."""
    bits = max(9, (2 * len(items)).bit_length())
    place = (items.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)
    return np.packbits((np.bincount(place.view(np.int64), minlength=1 << bits) & 1).astype(bool)).tobytes()


def sketched_apart(a: bytes, b: bytes) -> int:
    """Items that two sets differ in, at least."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    if len(x) == len(y):
        return int(np.bitwise_count(x ^ y).sum())
    x, y = np.unpackbits(x), np.unpackbits(y)
    return int((x ^ np.bitwise_xor.reduce(y.reshape(len(x), -1), axis=1)).sum())


def _digested(source: Source) -> DataFrame:
    """(id, key, n, sketch, block, counts, sets): a row per set with a digest that only equal sets share, its size and sketch; and of each task its tally."""
    make, kind = source.reader, to_arrow_type(source.kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, tally = make(), Tally()
        names = ["id", "key", "n", "sketch", "block", "counts", "sets"]
        for batch in batches:
            items = read(batch.column(1))
            tally.see(items)
            made = [pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in items], pa.binary()), pa.array([len(x) for x in items], pa.int32()), pa.array([sketch(x) for x in items], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *[pa.nulls(len(items), x) for x in (pa.int32(), pa.binary(), pa.int64())]], names=names)
        none = [pa.nulls(_BLOCKS, x) for x in (kind, pa.binary(), pa.int32(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(range(_BLOCKS), pa.int32()), pa.array(tally.blocks(), pa.binary()), pa.array([tally.sets] * _BLOCKS, pa.int64())], names=names)

    rest = [("key", T.BinaryType()), ("n", T.IntegerType()), ("sketch", T.BinaryType()), ("block", T.IntegerType()), ("counts", T.BinaryType()), ("sets", T.LongType())]
    return source.rows.mapInArrow(run, T.StructType([T.StructField("id", source.kind), *[T.StructField(n, t) for n, t in rest]]))


def _likely(pairs: DataFrame, digests: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` whose sketches don't show that they differ in more items than similar sets do."""
    of = lambda x: digests.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = batch.column(2).to_numpy() * (1 - 2 * threshold / (1 + threshold)) + 1e-6
            good = [sketched_apart(x, y) <= m for x, y, m in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), most, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, pairs.schema)


def _first(v: np.ndarray, order: np.ndarray | Order, many: int, sorter: np.ndarray | None = None) -> np.ndarray:
    """The first ``many`` of the items by the order."""
    if isinstance(order, Order):
        rank = order.counts[_slot(v)]
    else:
        rank = np.zeros(len(v), np.int64)
        if len(order):
            i = np.minimum(np.searchsorted(order, v, sorter=sorter), len(order) - 1)
            rank = np.where(order[sorter[i]] == v, sorter[i] + 1, 0)
    return v[np.lexsort((v, rank))[:many]]


def _keep(n: int, threshold: float) -> int:
    return n - math.ceil(n * threshold - 1e-9) + 1


def prefixes(sets: DataFrame | Source, threshold: float, order: np.ndarray | Order, deeper: DataFrame | None = None) -> DataFrame:
    """Rows (id, n, item, second) of the first items of each set (id, items) by a total order.

    ``order`` may be an array of the frequent items, the rarest first: they come after all others, which go by value. Without ``deeper`` a set has a row
    for each of its first ``n - ceil(t * n) + 1`` items, and ``second`` is null. With ``deeper`` (item), it has a row for each
    of those that are in it, with each later item of the first ``n - ceil(t * n) + 2``; sets that can be similar to another
    with a single item in common (at most 1 / t items) have the item without a second one, too.
    """
    source = sets if isinstance(sets, Source) else Source(sets.select("id", "items"), lambda: _listed)
    handle = source.rows.sparkSession.sparkContext.broadcast((order, None if isinstance(order, Order) else np.argsort(order), None if deeper is None else deeper.toArrow().column("item").to_numpy()))
    make = source.reader

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (order, sorter, wanted), read = handle.value, make()
        for batch in batches:
            rows: list[tuple] = []
            for at, v in enumerate(read(batch.column(1))):
                n = len(v)
                keep = _keep(n, threshold)
                ordered = _first(v, order, keep + 1, sorter)
                if wanted is None:
                    rows.append((at, n, ordered[:keep], pa.nulls(len(ordered[:keep]), pa.int64())))
                    continue
                for j in np.flatnonzero(np.isin(ordered[:keep], wanted)).tolist():
                    rows.append((at, n, np.full(len(ordered) - j - 1, ordered[j]), pa.array(ordered[j + 1 :], pa.int64())))
                    if n <= 1 / threshold + 1e-9:
                        rows.append((at, n, ordered[j : j + 1], pa.nulls(1, pa.int64())))
            if rows:
                sizes = [len(r[2]) for r in rows]
                ids = batch.column(0).take(pa.array(np.repeat([r[0] for r in rows], sizes)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.repeat([r[1] for r in rows], sizes), pa.int32()), pa.array(np.concatenate([r[2] for r in rows]), pa.int64()), pa.concat_arrays([r[3] for r in rows])], names=["id", "n", "item", "second"])

    return source.rows.mapInArrow(run, T.StructType([T.StructField("id", source.kind), T.StructField("n", T.IntegerType()), T.StructField("item", T.LongType()), T.StructField("second", T.LongType())]))


def _packets(source: Source, threshold: float, order: Order, parts: int) -> DataFrame:
    """Rows (part, ids, n, place, items): the first items of sets, those of one task for one part in a row, so that little but the values is shuffled."""
    handle = source.rows.sparkSession.sparkContext.broadcast(order)
    make = source.reader
    kind = source.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, read = handle.value, make()
        held: list[tuple] = []
        size = 0

        def dealt() -> pa.RecordBatch:
            ids = pa.concat_arrays([x[0] for x in held])
            n, place, items = (np.concatenate([y for x in held for y in x[i]]) for i in (1, 2, 3))
            part = ((items.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)).view(np.int64) % parts
            by = np.argsort(part, kind="stable")
            found, at = np.unique(part[by], return_index=True)
            cuts = pa.array(np.r_[at, len(by)], pa.int32())
            listed = [pa.ListArray.from_arrays(cuts, x) for x in (ids.take(pa.array(by)), pa.array(n[by], pa.int32()), pa.array(place[by], pa.int32()), pa.array(items[by], pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *listed], names=["part", "ids", "n", "place", "items"])

        for batch in batches:
            first = []
            sizes = []
            for v in read(batch.column(1)):
                first.append(_first(v, order, _keep(len(v), threshold)))
                sizes.append(len(v))
            many = [len(x) for x in first]
            if sum(many):
                held.append((batch.column(0).take(pa.array(np.repeat(np.arange(len(first)), many))), [np.repeat(np.array(sizes, np.int32), many)], [np.arange(m, dtype=np.int32) for m in many], first))
                size += sum(many)
            if size > DEALT:
                yield dealt()
                held, size = [], 0
        if held:
            yield dealt()

    each = [T.StructField("ids", T.ArrayType(kind)), *[T.StructField(x, T.ArrayType(T.IntegerType())) for x in ("n", "place")], T.StructField("items", T.ArrayType(T.LongType()))]
    return source.rows.mapInArrow(run, T.StructType([T.StructField("part", T.IntegerType()), *each]))


def _compared(packets: DataFrame, threshold: float, parts: int, bucket: int, kind: T.DataType) -> DataFrame:
    """(a, b, item) of ``_packets``: sets that share an item and may be similar by their sizes and the item's places, without an item; and each set of an item of over ``bucket`` sets, as a, with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        n, place, items = (np.concatenate([b.column(i).flatten().to_numpy() for b in held]) for i in (2, 3, 4))
        coded = pa.chunked_array([b.column(1).flatten() for b in held]).combine_chunks().dictionary_encode()
        by = pc.sort_indices(coded.dictionary)
        codes = np.empty(len(by), np.int64)
        codes[by.to_numpy()] = np.arange(len(by))
        ids = codes[coded.indices.to_numpy()]
        names = coded.dictionary.take(by)
        del held, coded
        order = np.lexsort((ids, items))
        items = items[order]
        starts = np.flatnonzero(np.r_[True, items[1:] != items[:-1]])
        sizes = np.diff(np.r_[starts, len(items)])
        big = sizes > bucket

        def out(a: np.ndarray, b: np.ndarray | None, item: np.ndarray | None) -> pa.RecordBatch:
            other = pa.nulls(len(a), names.type) if b is None else names.take(pa.array(b))
            return pa.RecordBatch.from_arrays([names.take(pa.array(a)), other, pa.nulls(len(a), pa.int64()) if item is None else pa.array(item, pa.int64())], names=["a", "b", "item"])

        if big.any():
            these = np.repeat(big, sizes)
            yield out(ids[order[these]], None, items[these])
        left = np.repeat(starts + sizes, sizes) - np.arange(len(items))
        left[np.repeat(big, sizes)] = 0
        at = np.flatnonzero(left > 1)
        left = left[at]
        ids, n, place = ids[order], n[order].astype(np.int64), place[order].astype(np.int64)
        found: list[np.ndarray] = []
        many, step = 0, 1
        while len(at):
            p, q = at, at + step
            # if this is the first item in common, so many are shared at most
            most = np.minimum(n[p] - place[p], n[q] - place[q])
            good = (ids[p] != ids[q]) & (np.minimum(n[p], n[q]) >= np.maximum(n[p], n[q]) * threshold - 1e-9) & (most * (1 + threshold) >= threshold * (n[p] + n[q]) - 1e-6)
            found.append(ids[p[good]] << 32 | ids[q[good]])
            many += len(found[-1])
            if many > DEALT:
                found = [np.unique(np.concatenate(found))]
                if len(found[0]) > DEALT // 2:
                    yield out(found[0] >> 32, found[0] & (2**32 - 1), None)
                    found = []
                many = sum(map(len, found))
            step += 1
            on = left > step
            at, left = at[on], left[on]
        if many:
            pairs = np.unique(np.concatenate(found))
            yield out(pairs >> 32, pairs & (2**32 - 1), None)

    return packets.repartition(parts, "part").mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("item", T.LongType())]))


def _met(rows: DataFrame, threshold: float, keys: list[str], others: DataFrame | None = None) -> DataFrame:
    """(a, b) of rows (id, n, *keys) that share the keys, with sizes within the threshold of each other."""
    a, b = rows.alias("a"), (rows if others is None else others).alias("b")
    close = (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * threshold - 1e-9) & (F.col("a.id") < F.col("b.id"))
    same = functools.reduce(operator.and_, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    return a.join(b, same & close).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def _met_in_parts(rows: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """As ``_met``, but each bucket is dealt to parts, and each two parts to a task of their own."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = rows.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    columns = ["id", "n", *keys, "part", "other"]
    left = dealt.withColumn("other", every).select(*columns)
    right = dealt.withColumn("other", F.col("part")).withColumn("part", every).select(*columns)
    return _met(left, threshold, [*keys, "part", "other"], right)


def _verified(source: Source, pairs: DataFrame, threshold: float, mean: float) -> DataFrame:
    """(a, b, similarity) of those of ``pairs`` that reach the threshold.

    Sets are verified where they meet: those of a group, known by its least neighbour, in up to so many parts, so a set goes to a task once
    however many of its pairs are there. Only sets that are in a pair are made and shuffled.
    """
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nodes = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("g"))
    sizes = nodes.groupBy("g").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    blocks = materialize(nodes.join(sizes, "g").select("id", F.xxhash64("g", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block")), "set-blocks")
    tasks = max(1, math.ceil(blocks.count() * mean / CHECKED))
    of = lambda x: blocks.select(F.col("id").alias(x), F.col("block").alias(f"block_{x}"))
    dealt = materialize(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.pmod(F.xxhash64("block_a", "block_b"), F.lit(tasks)).cast("int").alias("task")), "set-meetings")
    wanted = dealt.select(F.col("a").alias("id"), "task").unionByName(dealt.select(F.col("b").alias("id"), "task")).distinct()
    wanted = materialize(wanted.groupBy("id").agg(F.collect_set("task").alias("tasks")), "set-tasks")
    chosen = source.some(wanted.select("id"))
    make, kind, given = chosen.reader, chosen.kind, chosen.rows.schema[1].dataType
    numbers = not isinstance(given, T.ArrayType) or given.elementType == T.LongType()
    if numbers:

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = make()
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(r(batch.column(1)), pa.list_(pa.int64()))], names=["id", "items"])

        sets = chosen.rows.mapInArrow(read, T.StructType([T.StructField("id", kind), T.StructField("items", T.ArrayType(T.LongType()))]))
    else:
        sets = chosen.rows
    sent = sets.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "id").select("id", "items", F.explode("tasks").alias("task"))

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        at = {x: i for i, x in enumerate(left.column("id").to_pylist())}
        items, good, shares = left.column("items").combine_chunks(), [], []
        if isinstance(items, pa.ChunkedArray):
            items = pa.concat_arrays(items.chunks)
        each = _listed(items) if numbers else [set(x) for x in items.to_pylist()]
        for i, (a, b) in enumerate(zip(right.column("a").to_pylist(), right.column("b").to_pylist(), strict=True)):
            x, y = each[at[a]], each[at[b]]
            k = len(np.intersect1d(x, y, assume_unique=True)) if numbers else len(x & y)
            if (share := k / (len(x) + len(y) - k)) >= threshold:
                good.append(i)
                shares.append(share)
        found = right.take(pa.array(good, pa.int64()))
        return pa.table({"a": found.column("a"), "b": found.column("b"), "similarity": pa.array(shares, pa.float64())})

    return sent.groupBy("task").cogroup(dealt.groupBy("task")).applyInArrow(check, T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("similarity", T.DoubleType())]))


def set_pairs(sets: DataFrame, threshold: float, id_col: str = "id", items_col: str = "items", bucket: int = BUCKET) -> DataFrame:
    """(a, b, similarity) with a < b of all sets of Jaccard similarity ``threshold`` or more. Exact.

    Items have a total order, the frequent ones last. Two similar sets share one of
    the first ``n - ceil(t * n) + 1`` items of either, so only those are joined, with sizes
    within the threshold of each other; what meets and isn't ruled out by the parities of its items is verified on the whole sets. An item that more than ``bucket`` sets have there
    doesn't join them: similar sets of more than one item in common share a second one, too, of one more of their first items, so (item, second) does;
    what is still as frequent is dealt in parts, each two of which are a task. Sets must be distinct
    (``classes_of_sets``), so a group of copies is one row. ``sets`` is read several times; what is written are its first items, and what is verified.
    """
    sets = sets.select(F.col(id_col).alias("id"), F.col(items_col).alias("items")).filter("id is not null and items is not null")
    # items of any type are compared by 64-bit hashes until they are verified
    numbers = sets.schema["items"].dataType.elementType == T.LongType()
    coded = sets if numbers else sets.select("id", F.transform("items", lambda x: F.xxhash64(x)).alias("items"))
    source = Source(coded, lambda: _listed)
    return _pairs(source, source if numbers else Source(sets, lambda: _listed), threshold, bucket)


def _pairs(source: Source, whole: Source, threshold: float, bucket: int = BUCKET, digests: DataFrame | None = None) -> DataFrame:
    """``set_pairs`` of a source; ``whole`` has the items that are verified, ``digests`` those of the source and maybe others."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    digests = materialize(_digested(source), "set-digests") if digests is None else digests
    order = _order(digests.filter("block is not null").select("block", "counts", "sets"))
    parts = max(1, math.ceil(((1 - threshold) * order.items + order.sets) / DEALT))
    found = materialize(_compared(_packets(source, threshold, order, parts), threshold, parts, bucket, source.kind), "set-candidates")
    met = found.filter("item is null").select("a", "b")
    often = found.filter("item is not null")
    hot = materialize(often.select("item").distinct(), "hot-items")
    if n_hot := hot.count():
        some = source.some(materialize(often.select(F.col("a").alias("id")).distinct(), "hot-sets"))
        blocks = -(-n_hot // BROADCAST_IDS)
        each = [prefixes(some, threshold, order, hot.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i)) for i in range(blocks)]
        second = materialize(functools.reduce(DataFrame.unionByName, each), "set-second-items")
        many = materialize(second.filter("second is not null").groupBy("item", "second").agg(F.count("*").alias("m")).filter(F.col("m") > bucket).select("item", "second"), "hot-pairs")
        met = met.unionByName(_met(second.join(many, ["item", "second"], "left_anti").filter("second is not null"), threshold, ["item", "second"]))
        met = met.unionByName(_met_in_parts(second.join(many, ["item", "second"], "left_semi"), threshold, ["item", "second"]))
        # similar sets that share a single item have at most 1 / t each
        met = met.unionByName(_met_in_parts(second.filter("second is null"), threshold, ["item"]))
    likely = _likely(met.distinct(), digests.filter("block is null"), threshold)
    return _verified(whole, materialize(likely, "set-likely"), threshold, order.items / max(order.sets, 1))


def classes_of_sets(rows: DataFrame, id_col: str, items_col: str) -> DataFrame:
    """``rows`` with ``rep``, the least id of those with an equal set."""
    key = F.sha2(F.array_join(F.transform(F.sort_array(items_col), lambda x: x.cast("string")), "\x1f"), 256)
    keyed = rows.withColumn("__key", key)
    least = keyed.groupBy("__key").agg(F.min(id_col).alias("rep"))
    return keyed.join(least, "__key").drop("__key")


def near_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Membership (id, rep) and pairs (a, b, similarity) between representatives of equal shingle sets.

    Sets are several times as large as packed texts, so none is kept: they are made from the texts again where they are needed,
    of all texts twice, and of those that may have a similar one to verify them.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = Source(rows, lambda: text_functions.shingle_reader(k))
    digests = materialize(_digested(texts), "shingle-digests")
    keys = digests.filter("block is null").select("id", "key")
    members = keys.join(keys.groupBy("key").agg(F.min("id").alias("rep")), "key")
    named = members.groupBy("id").agg(F.count_if(F.col("id") == F.col("rep")).alias("firsts"), F.count("*").alias("n"))
    copies = materialize(named.filter("id is not null and (firsts = 0 or n > 1)"), "shingle-copies")
    if copies.filter("n > 1").isEmpty():
        firsts = Source(rows.filter("id is not null"), texts.reader).some(copies.select("id"), "left_anti")
        return members.select("id", "rep"), _pairs(firsts, firsts, threshold, digests=digests)
    # ids that are not unique are told apart by their sets
    sets = classes_of_sets(text_functions.shingle_hashes(rows, "id", "text", k), "id", "items")
    sets = materialize(sets.filter("id = rep").dropDuplicates(["id"]).select("id", "items"), "distinct-sets")
    return members.select("id", "rep"), set_pairs(sets, threshold)


def leaders(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, leader) by the greedy rule: in the order of nodes, one not yet taken leads and takes all its untaken neighbours.

    In rounds: an undecided node without an undecided lesser neighbour leads; undecided
    neighbours of leaders join the least of them. Nodes without pairs have no row.
    """
    both = pairs.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct(), "leaders-edges")
    decided, open_edges = None, both
    while not open_edges.isEmpty():
        new = open_edges.groupBy("u").agg(F.min("v").alias("least")).filter("u < least").select(F.col("u").alias("leader"))
        taken = both.join(new, both["v"] == new["leader"]).groupBy("u").agg(F.min("leader").alias("leader")).select(F.col("u").alias("node"), "leader")
        if decided is not None:
            taken = taken.join(decided.select("node"), "node", "left_anti")
        step = new.select(F.col("leader").alias("node"), "leader").unionByName(taken)
        decided = materialize(step if decided is None else decided.unionByName(step), "leaders")
        done = decided.select("node")
        open_edges = materialize(open_edges.join(done.withColumnRenamed("node", "u"), "u", "left_anti").join(done.withColumnRenamed("node", "v"), "v", "left_anti").select("u", "v"), "leaders-open")
    if decided is None:
        return both.select(F.col("u").alias("node"), F.col("v").alias("leader"))
    # whose neighbours have all joined others leads itself alone
    alone = both.select(F.col("u").alias("node")).distinct().join(decided.select("node"), "node", "left_anti")
    return decided.unionByName(alone.select("node", F.col("node").alias("leader")))


def _masks(hashes: DataFrame, most: int) -> list[int]:
    """Of the lists of masks for ``most`` bits, the one that costs a join of ``hashes`` (a column h) least: rows dealt, and pairs that meet as often as in some rows, or more."""
    n = hashes.count()
    some = np.array([r["h"] for r in hashes.select("h").orderBy(F.xxhash64("h"), "h").limit(MEASURED).collect()], np.int64).view(np.uint64)
    pairs = max(1, len(some) * (len(some) - 1))

    def meeting(m: int) -> float:
        counts = np.unique(some & np.uint64(m), return_counts=True)[1].astype(float)
        return max((counts * (counts - 1)).sum() / pairs, 2.0 ** -m.bit_count())

    return min(hashing.joining_masks(most, MASKED), key=lambda masks: sum(DEALING + n * meeting(m) for m in masks))


def hamming_pairs(rows: DataFrame, most: int, id_col: str = "id", hash_col: str = "hash") -> DataFrame:
    """(a, b, distance) with a < b of 64-bit hex hashes at most ``most`` bits apart. Exact.

    Any such pair is equal under one of some masks, so an equi-join on (mask, masked bits) finds all; it gives a pair at the first
    of them only. Few rows get few masks of few bits, many rows more masks of more bits, 2**(most + 1) - 1 of about half the bits at most, so that few others meet.
    Rows must have distinct hashes. Of more than ``MASKED`` bits bands are joined: of ``most + 1`` of them one is equal.

    The join is never by broadcast. Spark takes a row dealt to all masks for a single one, so its estimate is too low by their number.
    """
    number = F.conv(F.col(hash_col), 16, -10).cast("long")
    one = materialize(rows.select(F.col(id_col).alias("id"), number.alias("h")).filter("h is not null"), "hamming-hashes")
    masks = [F.lit(m - 2**64 if m >= 2**63 else m).cast("long") for m in _masks(one, most)]
    dealt = one.select("id", "h", F.explode(F.array(*masks)).alias("mask"))
    a, b = dealt.alias("a").hint("merge"), dealt.alias("b").hint("merge")
    differing = F.col("a.h").bitwiseXOR(F.col("b.h"))
    distance = F.bit_count(differing).cast("long")
    first = F.coalesce(*[F.when(differing.bitwiseAND(m) == 0, m) for m in masks])
    masked = [F.col(f"{x}.h").bitwiseAND(F.col(f"{x}.mask")) for x in "ab"]
    met = a.join(b, (F.col("a.mask") == F.col("b.mask")) & (masked[0] == masked[1]) & (F.col("a.id") < F.col("b.id")) & (distance <= most) & (F.col("a.mask") == first))
    return met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), distance.alias("distance")).distinct()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


#: Queries that go out to all tasks, and rows or queries of a block of the grid: with 1024 doubles each, 16 MB.
QUERY_BLOCK = 2048
NEIGHBOURS = "query long, neighbour long, similarity double"


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


class _Best:
    """The ``k`` rows of greatest cosine, or product, for each of some queries, from blocks of rows."""

    def __init__(self, names: np.ndarray, vectors: np.ndarray, k: int, skip_self: bool, cosine: bool) -> None:
        self.scaled = _unit if cosine else lambda m: m
        self.names, self.vectors, self.k, self.skip_self = names, self.scaled(vectors), k, skip_self
        self.s, self.i = np.full((len(names), 0), 0.0), np.full((len(names), 0), 0, np.int64)

    def see(self, ids: np.ndarray, m: np.ndarray) -> None:
        for a in range(0, len(ids), QUERY_BLOCK):
            some, s = ids[a : a + QUERY_BLOCK], self.vectors @ self.scaled(m[a : a + QUERY_BLOCK]).T
            if self.skip_self:
                s[self.names[:, None] == some[None]] = -np.inf
            s = np.concatenate([self.s, s], 1)
            i = np.concatenate([self.i, np.broadcast_to(some, (len(self.names), len(some)))], 1)
            order = np.lexsort((i, -s), axis=1)[:, : self.k]
            self.s, self.i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def rows(self) -> list[pa.Array]:
        good = np.isfinite(self.s)
        return [pa.array(np.repeat(self.names, good.sum(1)), pa.int64()), pa.array(self.i[good], pa.int64()), pa.array(self.s[good], pa.float64())]


def _stacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)) if isinstance(column, pa.Array) else np.stack(column.to_numpy())


def _by_broadcast(data: DataFrame, asked: list, k: int, skip_self: bool, cosine: bool) -> DataFrame:
    handle = data.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in asked], np.int64), np.array([r["v"] for r in asked], float)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(*handle.value, k, skip_self, cosine)
        for batch in batches:
            if batch.num_rows:
                best.see(batch.column(0).to_numpy(), _stacked(batch.column(1)))
        yield pa.RecordBatch.from_arrays(best.rows(), names=["query", "neighbour", "similarity"])

    return data.mapInArrow(search, NEIGHBOURS)


def _by_grid(data: DataFrame, asked: DataFrame, k: int, skip_self: bool, cosine: bool, block: int) -> DataFrame:
    """Blocks of queries against blocks of rows, each two of them in a task of their own."""
    across, down = (max(1, -(-t.count() // block)) for t in (asked, data))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    q = asked.select("id", "v", deal(across).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("r"))
    r = data.select("id", "v", deal(down).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("q"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({"query": pa.array([], pa.int64()), "neighbour": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        best = _Best(left.column("id").to_numpy(), _stacked(left.column("v")), k, skip_self, cosine)
        best.see(right.column("id").to_numpy(), _stacked(right.column("v")))
        return pa.Table.from_arrays(best.rows(), names=["query", "neighbour", "similarity"])

    return q.groupBy("q", "r").cogroup(r.groupBy("q", "r")).applyInArrow(search, NEIGHBOURS)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "id", vector_col: str = "vector", skip_self: bool = True, block: int = QUERY_BLOCK, cosine: bool = True) -> DataFrame:
    """(query, rank, neighbour, similarity): the ``k`` rows of greatest cosine, or of greatest product, for each query, ties by id. Exact.

    Up to ``block`` queries are sent to all tasks; each batch of rows is a matrix product. More of them are dealt, like the rows, in
    blocks, each two of which are a task, and none passes through the driver. A task keeps ``k`` rows a query, so what is merged
    doesn't grow with the rows of a block. Null vectors match nothing; a zero vector has similarity 0 to all.
    """
    data = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).dropna()
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).dropna()
    few = asked.limit(block + 1).collect()
    found = _by_broadcast(data, sorted(few, key=lambda r: r["id"]), k, skip_self, cosine) if 0 < len(few) <= block else None
    if found is None:
        if not few:
            return rows.sparkSession.createDataFrame([], "query long, rank int, neighbour long, similarity double")
        found = _by_grid(data, asked, k, skip_self, cosine, block)
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "neighbour"))), 1, k)
    return found.groupBy("query").agg(top.alias("top")).select("query", F.posexplode("top").alias("at", "x")).select("query", (F.col("at") + 1).alias("rank"), "x.neighbour", (-F.col("x.s")).alias("similarity"))


def blended(weights: dict[str, float]) -> Column:
    """A vector whose cosine is the weighted mean of the cosines of several vector columns."""
    total = sum(weights.values())
    parts = []
    for c, w in weights.items():
        v = F.transform(F.col(c), lambda x: x.cast("double"))
        norm = F.sqrt(dot(v, v))
        parts.append(F.transform(v, _scaled(math.sqrt(w / total), norm)))
    return F.concat(*parts)


def _scaled(w: float, norm: Column):
    return lambda x: F.when(norm == 0, 0.0).otherwise(x * w / norm)
