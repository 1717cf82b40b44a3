"""Relational verbs with a defined order: as-of joins, describe, column profiles, set operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stonecrop.sources.files import materialize


def as_of(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], span: Callable[[Column], Column] | None = None) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` at or before its ``on``, within equal ``by``.

    One sort of the union carries the last row forward, so no pairs are made. Of rows of ``right`` at one
    time the greatest values count. ``span`` maps ``on`` to a growing span, such as its day: then rows are
    sorted by key and span, and what each span begins with comes from the last rows of the spans before, so a
    key with a large share of all rows isn't one task.
    """
    keys = [*by, on]
    packed = right.groupBy(*keys).agg(F.max(F.struct(*values)).alias("__v"))
    both = left.withColumn("__v", F.lit(None).cast(packed.schema["__v"].dataType)).withColumn("__left", F.lit(1))
    rows = both.unionByName(packed.withColumn("__left", F.lit(0)), allowMissingColumns=True)
    if span is None:
        rows, parts, found = rows.withColumn("__carried", F.lit(None).cast(packed.schema["__v"].dataType)), by, F.col("__v")
    else:
        rows = rows.withColumn("__span", span(F.col(on)))
        ends = rows.groupBy(*by, "__span").agg(F.max_by("__v", F.when(F.col("__left") == 0, F.col(on))).alias("__end"))
        before = Window.partitionBy(*by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*by, "__span", F.last("__end", ignorenulls=True).over(before).alias("__carried"))
        rows, parts, found = rows.join(carried, [*by, "__span"]), [*by, "__span"], F.col("__v")
    w = Window.partitionBy(*parts).orderBy(on, "__left").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("__v", F.coalesce(F.last(found, ignorenulls=True).over(w), F.col("__carried"))).filter("__left = 1")
    return out.select(*left.columns, *[F.col(f"__v.{v}").alias(v) for v in values])


def describe(df: DataFrame, columns: list[str], percentiles: tuple[float, ...] = (0.25, 0.5, 0.75), exact: bool = True) -> DataFrame:
    """A row per column: n, null_count, mean, std, min, the percentiles (nearest value), max; one pass.

    Exact percentiles keep a count of each distinct value; for columns with very many, ``exact=False``
    sketches them to within a ten-thousandth of the ranks, in bounded memory.
    """
    at = "percentile_disc({p}) within group (order by cast(`{c}` as double))" if exact else "approx_percentile(cast(`{c}` as double), {p}, 10000)"
    packed = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.count(F.when(F.col(c).isNull(), 1)).alias("null_count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(F.col(c).cast("double")).alias("min"), *[F.expr(at.format(p=p, c=c)).alias(f"p{round(p * 100)}") for p in percentiles], F.max(F.col(c).cast("double")).alias("max")) for c in columns]
    return df.agg(F.array(*packed).alias("x")).select(F.inline("x"))


def info(df: DataFrame) -> DataFrame:
    """(column, type, null_count)."""
    packed = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count(F.when(F.col(f"`{f.name}`").isNull(), 1)).alias("null_count")) for f in df.schema]
    return df.agg(F.array(*packed).alias("x")).select(F.inline("x"))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(value, n), the most frequent first, nulls counted."""
    out = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("value"))
    return out.limit(top) if top else out


def column_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: n, n_unique (null counts as a value), null_count, null_pct, and mean, std, min, max of a numeric column."""
    c = F.col(column)
    number = isinstance(df.schema[column].dataType, T.NumericType)
    null = F.count(F.when(c.isNull(), 1))
    parts = [F.count("*").alias("n"), (F.countDistinct(c) + (null > 0).cast("int")).alias("n_unique"), null.alias("null_count"), F.bround(null * 100.0 / F.count("*"), 2).alias("null_pct")]
    if number:
        parts += [F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")]
    return df.agg(*parts)


def sort(df: DataFrame, by: str | list[str], descending: bool = False) -> DataFrame:
    """One direction for all keys, nulls first."""
    keys = [by] if isinstance(by, str) else by
    return df.orderBy(*[F.desc_nulls_first(k) if descending else F.asc_nulls_first(k) for k in keys])


def unique(df: DataFrame, subset: list[str], order: list[str]) -> DataFrame:
    """The first row by ``order`` for each value of ``subset``."""
    w = Window.partitionBy(*subset).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def with_row_index(df: DataFrame, order: list[str], name: str = "index", offset: int = 0) -> DataFrame:
    """``df`` with each row's place by ``order``: rows are dealt by ranges, numbered in each, and moved by the counts of the ranges before."""
    dealt = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()), "row-index")
    sizes = dealt.groupBy("__p").agg(F.count("*").alias("n"), F.min("__i").alias("__low"))
    # one row a partition
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__p", "__low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    return dealt.join(F.broadcast(starts), "__p").select(*df.columns, (F.col("__i") - F.col("__low") + F.col("__start") + offset).alias(name))


def within(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float, by: list[str] = ()) -> DataFrame:
    """An inequality join: rows of ``left`` with those of ``right`` whose [low, high) holds ``value``, within equal ``by``.

    Intervals are cut at multiples of ``width``, so it is an equi-join on (by, cell) and no product. All column names must differ but ``by``.
    """
    cell = lambda x: F.floor(F.col(x).cast("double") / width).cast("long")
    cut = right.filter(F.col(low) < F.col(high)).withColumn("__cell", F.explode(F.sequence(cell(low), cell(high))))
    met = left.withColumn("__cell", cell(value)).join(cut, [*by, "__cell"])
    return met.filter((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("__cell")


def transpose(df: DataFrame, names: str) -> DataFrame:
    """A row for each column but ``names``, whose values become the columns; for tables of a few rows, as their values are all named."""
    columns = sorted(r[0] for r in df.select(F.col(names).cast("string")).distinct().collect())
    others = [c for c in df.columns if c != names]
    long = df.select(F.col(names).cast("string").alias("__name"), *[F.col(c).cast("string").alias(c) for c in others]).unpivot(["__name"], others, "column", "__value")
    return long.groupBy("column").pivot("__name", columns).agg(F.first("__value"))


def unnest(df: DataFrame, column: str) -> DataFrame:
    """The fields of a struct as columns in its place."""
    return df.select(*[F.col(f"`{c}`") if c != column else F.col(f"`{c}`.*") for c in df.columns])


def tail(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last ``n`` rows by ``order``, in that order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of each group, the least by a hash of ``key``; the same ones each time."""
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    w = Window.partitionBy(group).orderBy(h, key)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")
