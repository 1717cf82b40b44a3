"""Merkle fixity audit of record archives.

A record has a digest and stands at an offset of an archive. Leaf ranges are the aligned
ranges of 2**``LEAF`` bytes of (archive, offset); a range's hash is SHA-256 over its records' offsets and
digests in order. Higher ranges join 2**``FAN`` ranges each, up to one root. Ranges are aligned
to offsets, not counts, so a missing record leaves all other ranges as they are.

Two replicas are compared from the root: only the children of ranges that differ are read at the
next level, and only records of leaf ranges that differ at the end. What differs is written at each
level, so a plan has one level in it. Groups are bounded by what a leaf range holds, or 2**``FAN`` children.

Null payloads count as empty. Null offsets aren't addressable and are left out; an offset or archive under 0, an
offset of 2**``ARCHIVE`` or an archive of 2**27 and over are an error, as they have no address. Rows that repeat
an offset are compared as a multiset: by their number and the sums of their digests' words, in bounded memory.
An empty replica differs in every range of the other; two empty ones in none. Other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stonecrop.llm.common import materialize

LEAF, FAN, ARCHIVE = 20, 8, 36
#: Levels above the leaves; 2**(20 + 5 * 8) bytes of address space meet in the root.
LEVELS = 5


def laid_out(pages: DataFrame, id_col: str, payload: Column, per_archive: int = 1024) -> DataFrame:
    """Records (archive, offset, size, record_id, digest) of a table: ids are dealt to archives in ranges and written in the order of ids.

    Only sizes and digests are sorted, not payloads.
    """
    rows = pages.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("record_id"), F.octet_length(payload).cast("long").alias("size"), F.unhex(F.sha2(payload, 256)).alias("digest"))
    rows = rows.withColumn("archive", F.floor(F.col("record_id") / per_archive))
    before = Window.partitionBy("archive").orderBy("record_id", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))).select("archive", "offset", "size", "record_id", "digest")


def _address() -> Column:
    archive, offset = F.col("archive").cast("long"), F.col("offset").cast("long")
    fits = (archive >= 0) & (archive < 2 ** (63 - ARCHIVE)) & (offset >= 0) & (offset < 2**ARCHIVE)
    what = F.concat(F.lit("no address for archive "), archive.cast("string"), F.lit(", offset "), offset.cast("string"))
    return F.when(fits, F.shiftleft(archive, ARCHIVE) + offset).otherwise(F.raise_error(what).cast("long"))


def leaves(records: DataFrame, by: list[str] = ()) -> DataFrame:
    """A row per offset: (*by, address, node, h, record_id)."""
    rows = records.filter("archive is not null and offset is not null").select(*by, _address().alias("address"), F.coalesce("digest", F.lit(b"")).alias("digest"), F.col("record_id").cast("long").alias("record_id"))
    word = lambda i: F.coalesce(F.conv(F.hex(F.substring("digest", 1 + 8 * i, 8)), 16, 10).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    sums = [F.sum(word(i)).cast("string").alias(f"w{i}") for i in range(4)]
    rows = rows.groupBy(*by, "address").agg(F.count("*").alias("n"), F.min("digest").alias("one"), *sums, F.min("record_id").alias("record_id"))
    many = F.unhex(F.sha2(F.concat_ws(",", F.col("n").cast("string"), *[f"w{i}" for i in range(4)]), 256))
    return rows.select(*by, "address", F.shiftright("address", LEAF).alias("node"), F.when(F.col("n") == 1, F.col("one")).otherwise(many).alias("h"), "record_id")


def tree(rows: DataFrame, by: list[str] = ()) -> list[DataFrame]:
    """Levels (*by, node, h) from the leaf ranges to the root, each written; a tree for each value of ``by``."""
    def up(children: DataFrame, key: str, of: Column) -> DataFrame:
        parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), "h"))), lambda x: F.concat_ws(":", x["k"].cast("string"), F.hex(x["h"]))), ",")
        return children.groupBy(*by, of.alias("node")).agg(F.unhex(F.sha2(parts, 256)).alias("h"))

    levels = [materialize(up(rows, "address", F.col("node")), "fixity-level")]
    for _ in range(LEVELS):
        levels.append(materialize(up(levels[-1], "node", F.shiftright("node", FAN)), "fixity-level"))
    return levels


def differing(rows: DataFrame, key: str, *more: Column) -> DataFrame:
    """Keys of (replica, key, h) whose hashes differ or that one side lacks: (key, h_a, h_b) and ``more`` aggregates."""
    side = lambda n: F.max(F.when(F.col("replica") == n, F.col("h"))).alias(f"h_{'ab'[n]}")
    return rows.groupBy(key).agg(side(0), side(1), *more).filter(~F.col("h_a").eqNullSafe(F.col("h_b")))


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records in which replicas differ: (archive, offset, record_id, status, digest_a, digest_b).

    ``a`` and ``b`` have (archive, offset, record_id, digest). Status: altered, missing (from b) or extra (in b).
    """
    columns = ["archive", "offset", "record_id", "digest"]
    both = a.select(F.lit(0).alias("replica"), *columns).unionByName(b.select(F.lit(1).alias("replica"), *columns))
    rows = materialize(leaves(both, ["replica"]), "fixity-leaves")
    levels = tree(rows, ["replica"])
    bad = materialize(differing(levels[-1], "node").select("node"), "fixity-ranges")
    for level in levels[-2::-1]:
        above = bad.withColumnRenamed("node", "up")
        below = level.join(above, F.shiftright("node", FAN) == F.col("up"), "left_semi")
        bad = materialize(differing(below, "node").select("node"), "fixity-ranges")
    id_of = lambda n: F.max(F.when(F.col("replica") == n, F.col("record_id"))).alias(f"id_{'ab'[n]}")
    return differing(rows.join(bad, "node", "left_semi"), "address", id_of(0), id_of(1)).select(
        F.shiftright("address", ARCHIVE).alias("archive"),
        F.col("address").bitwiseAND(F.lit(2**ARCHIVE - 1)).alias("offset"),
        F.coalesce("id_a", "id_b").alias("record_id"),
        F.when(F.col("h_b").isNull(), "missing").when(F.col("h_a").isNull(), "extra").otherwise("altered").alias("status"),
        F.lower(F.hex("h_a")).alias("digest_a"),
        F.lower(F.hex("h_b")).alias("digest_b"),
    )
