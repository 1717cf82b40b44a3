"""Temporal list join: captures against dated block-list entries, as of fetch time. Native.

Entries (list, domain, action add or remove, day) become validity intervals [day, next entry's
day), written once. A capture is under an entry if its host is the domain or below it.

1. Distinct hosts give the parent domains that have as many labels as some listed domain has, and keep
   those that are listed: a parent that no list has, such as ``com``, goes before any day is looked at.
2. Distinct (host, day) with the host's listed domains meet the intervals in an equi-join on (domain,
   span); intervals are cut at the borders of ``SPAN``-day spans, so a domain with a long history isn't
   compared as a whole.
3. What was found for a (host, day) goes back to the captures.

In each join the side with the captures is salted, and the other one repeated ``SALTS`` times: a listed
domain over most hosts, or a host with a third of all captures on one day, is dealt to as many tasks.

Captures without host or day match nothing and keep a row; repeated captures keep a row each. Entries with
nulls are left out; of several entries of a list and domain on one day an add wins. Without captures there are
no rows, without entries nothing is blocked. Hosts of any length and number of labels are matched. Captures
may have columns of any name: an output column whose name is taken gets underscores in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stonecrop.llm.common import free_name, materialize

SPAN, SALTS = 32, 16


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, null if it has none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)), r"\.+$", "")
    return F.when(host == "", None).otherwise(host)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, domain, first, last): inclusive days on which an entry holds; one still open has no last day."""
    rows = entries.select("list", F.lower("domain").alias("domain"), (F.col("action") == "add").alias("on"), F.col("day").cast("date").alias("day")).dropna()
    rows = rows.groupBy("list", "domain", "day").agg(F.max("on").alias("on"))
    after = F.lead("day").over(Window.partitionBy("list", "domain").orderBy("day"))
    return rows.withColumn("next", after).filter("on").select("list", "domain", F.col("day").alias("first"), F.date_sub("next", 1).alias("last"))


def parents(host: Column, sizes: list[int]) -> Column:
    """Of the host and its parent domains those with so many labels as ``sizes`` has."""
    labels = F.split(host, r"\.")
    return F.transform(F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))


def _salted(df: DataFrame, *by: str) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))


def _repeated(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))


def _plain(kind: T.DataType) -> bool:
    """Whether values can be hashed."""
    if isinstance(kind, T.StructType):
        return all(_plain(f.dataType) for f in kind)
    return _plain(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def evaluate(captures: DataFrame, entries: DataFrame, host_col: str = "host", day_col: str = "day") -> DataFrame:
    """``captures`` with blocked boolean, lists (sorted, comma-joined; null if none) and matched_domain (the most specific; null if none)."""
    span = lambda day: F.floor(F.unix_date(day) / SPAN)
    # the captures' own columns stay within a struct, so their names meet no others
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in captures.columns]).alias("row"))
    rows = rows.select("row", F.col(f"row.`{host_col}`").alias("h"), F.col(f"row.`{day_col}`").cast("date").alias("d"))
    seen = rows.select("h", "d").dropna().distinct()
    held = materialize(intervals(entries), "url-intervals")
    # few numbers: a list with n sizes of domains has n * n bytes at least
    sizes = sorted(held.agg(F.collect_set(F.size(F.split("domain", r"\.")))).first()[0])
    until = seen.agg(F.max("d")).first()[0]
    listed = seen.select("h").distinct().select("h", F.explode(parents(F.col("h"), sizes)).alias("domain"))
    listed = _salted(listed, "h").join(_repeated(held.select("domain").distinct()), ["domain", "salt"], "left_semi").select("h", "domain")
    # open intervals end at the last capture; least() skips nulls
    ends = held.withColumn("last", F.least("last", F.lit(until).cast("date"))).filter("first <= last")
    valid = ends.withColumn("span", F.explode(F.sequence(span(F.col("first")), span(F.col("last")))))
    named = seen.join(listed, "h").withColumn("span", span(F.col("d")))
    met = _salted(named, "h", "d").join(_repeated(valid), ["domain", "span", "salt"]).filter("d between first and last")
    found = met.groupBy("h", "d").agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.max_by("domain", F.length("domain")).alias("matched"))
    hashable = [F.col(f"row.`{f.name}`") for f in captures.schema if _plain(f.dataType)]
    out = _salted(rows, *hashable).join(_repeated(found), ["h", "d", "salt"], "left")
    names = []
    for name in ("blocked", "lists", "matched_domain"):
        names.append(free_name(captures, name))
    return out.select(*[F.col(f"row.`{c}`") for c in captures.columns], F.col("lists").isNotNull().alias(names[0]), F.col("lists").alias(names[1]), F.col("matched").alias(names[2]))
