"""Duplicates: by content hash, by text, by image hash; and the directories that share them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stonecrop.functions import kinds
from stonecrop.operators import similarity

MODES = ("exact", "text", "image", "auto", "mixed")


def exact_groups(df: DataFrame, hash_col: str = "sha256", path_col: str = "path") -> DataFrame:
    """(group_id, path) of the groups of two or more. Null hashes, as of unreadable files, form no group."""
    rows = df.filter(F.col(hash_col).isNotNull()).select(F.col(hash_col).alias("group_id"), F.col(path_col).alias("path"))
    counts = rows.groupBy("group_id").agg(F.count("*").alias("n")).filter("n > 1").select("group_id")
    return rows.join(counts, "group_id", "left_semi")


def with_duplicate_flags(df: DataFrame, hash_col: str = "sha256") -> DataFrame:
    """Add is_exact_duplicate and exact_dup_group_id; a null hash is never a duplicate."""
    counts = df.filter(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("__h")).agg(F.count("*").alias("__n")).filter("__n > 1")
    out = df.drop("is_exact_duplicate", "exact_dup_group_id").join(counts, F.col(hash_col) == F.col("__h"), "left")
    return out.withColumn("is_exact_duplicate", F.col("__n").isNotNull()).withColumn("exact_dup_group_id", F.col("__h")).drop("__h", "__n")


def near_text_groups(df: DataFrame, path_col: str = "path", text_col: str = "text", k: int = 3, threshold: float = 0.8) -> DataFrame:
    """(group_id, path): leader groups by Jaccard similarity of shingles, of two or more members. Exact duplicates group too, texts without tokens among them."""
    members, pairs = similarity.near_text(df, path_col, text_col, k, threshold)
    return _groups(members, pairs)


def near_image_groups(df: DataFrame, hash_col: str = "image_hash", path_col: str = "path", max_distance: int = 5) -> DataFrame:
    """(group_id, path): leader groups by Hamming distance of image hashes."""
    rows = df.filter(F.col(hash_col).isNotNull()).select(F.col(path_col).alias("id"), F.col(hash_col).alias("hash"))
    reps = rows.groupBy("hash").agg(F.min("id").alias("rep"))
    pairs = similarity.hamming_pairs(reps, max_distance, "rep", "hash")
    return _groups(rows.join(reps, "hash").select("id", "rep"), pairs)


def _groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    lead = similarity.leaders(pairs)
    rows = members.join(lead, members["rep"] == lead["node"], "left").select("id", F.coalesce("leader", "rep").alias("group_id"))
    many = rows.groupBy("group_id").agg(F.count("*").alias("n")).filter("n > 1").select("group_id")
    return rows.join(many, "group_id", "left_semi").select("group_id", F.col("id").alias("path"))


def find_duplicates(df: DataFrame, mode: str = "auto", path_col: str = "path", hash_col: str = "sha256", text_col: str = "text", image_hash_col: str = "image_hash", text_k: int = 3, text_threshold: float = 0.8, image_max_distance: int = 5) -> DataFrame:
    """(category, group_id, path). Exact groups always; text and image groups as ``mode`` says and columns allow. An unknown mode gives exact ones only."""
    out = exact_groups(df, hash_col, path_col).select(F.lit("exact").alias("category"), "group_id", "path")
    image = kinds.is_image(F.col(path_col))
    if mode in ("text", "auto", "mixed") and text_col in df.columns:
        found = near_text_groups(df.filter(~image & F.col(text_col).isNotNull()), path_col, text_col, text_k, text_threshold)
        out = out.unionByName(found.select(F.lit("text").alias("category"), F.col("group_id").cast("string").alias("group_id"), "path"))
    if mode in ("image", "auto", "mixed") and image_hash_col in df.columns:
        found = near_image_groups(df.filter(image), image_hash_col, path_col, image_max_distance)
        out = out.unionByName(found.select(F.lit("image").alias("category"), F.col("group_id").cast("string").alias("group_id"), "path"))
    return out


def across_directories(groups: DataFrame, prefixes: list[str]) -> DataFrame:
    """Groups whose members start with two or more of ``prefixes``, as strings."""
    each = groups.select("group_id", F.explode(F.array(*[F.when(F.col("path").startswith(p), p) for p in prefixes])).alias("prefix"))
    many = each.groupBy("group_id").agg(F.countDistinct("prefix").alias("n")).filter("n > 1").select("group_id")
    return groups.join(many, "group_id", "left_semi")


def directory_overlap(groups: DataFrame, directory: Column, all_files: DataFrame | None = None, all_directory: Column | None = None, min_shared: int = 1) -> DataFrame:
    """(dir_a, dir_b, shared_files, dir_a_total_files, dir_b_total_files, overlap_pct) for directories that share groups.

    A group counts once for each pair of directories that it is in. Groups in the same directories are one to the join, which
    counts them: mirrored trees make a pair of directories once, not once a file. Totals and percentage are null without ``all_files``.
    """
    each = groups.select("group_id", directory.alias("dir")).distinct()
    # a set of directories is known by its size and two sums of hashes, so none is gathered
    sums = [F.sum(F.xxhash64(F.lit(i), "dir").cast("decimal(20,0)")).alias(f"h{i}") for i in range(2)]
    sets = each.groupBy("group_id").agg(F.count("*").alias("n"), *sums).filter("n > 1")
    kinds_ = sets.groupBy("n", "h0", "h1").agg(F.min("group_id").alias("group_id"), F.count("*").alias("times")).select("group_id", "times")
    weighed = each.join(kinds_, "group_id")
    a, b = weighed.alias("a"), weighed.alias("b")
    pairs = a.join(b, (F.col("a.group_id") == F.col("b.group_id")) & (F.col("a.dir") < F.col("b.dir"))).groupBy(F.col("a.dir").alias("dir_a"), F.col("b.dir").alias("dir_b")).agg(F.sum("a.times").alias("shared_files")).filter(F.col("shared_files") >= min_shared)
    if all_files is None:
        none = F.lit(None)
        return pairs.select("dir_a", "dir_b", "shared_files", none.cast("long").alias("dir_a_total_files"), none.cast("long").alias("dir_b_total_files"), none.cast("double").alias("overlap_pct"))
    totals = all_files.groupBy((all_directory if all_directory is not None else directory).alias("dir")).agg(F.count("*").alias("n"))
    rich = pairs.join(totals.select(F.col("dir").alias("dir_a"), F.col("n").alias("dir_a_total_files")), "dir_a", "left").join(totals.select(F.col("dir").alias("dir_b"), F.col("n").alias("dir_b_total_files")), "dir_b", "left")
    return rich.select("dir_a", "dir_b", "shared_files", "dir_a_total_files", "dir_b_total_files", F.bround(F.col("shared_files") * 100.0 / F.least("dir_a_total_files", "dir_b_total_files"), 1).alias("overlap_pct"))


def space_waste(df: DataFrame, hash_col: str = "sha256", size_col: str = "size_bytes") -> DataFrame:
    """(group_id, n_files, wasted_bytes) of duplicate groups: all but one of their files, at the greatest size."""
    rows = df.filter(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("group_id")).agg(F.count("*").alias("n_files"), F.max(size_col).alias("size"))
    return rows.filter("n_files > 1").select("group_id", "n_files", ((F.col("n_files") - 1) * F.coalesce("size", F.lit(0))).alias("wasted_bytes"))


def first_of_each(df: DataFrame, subset: list[str], order_col: str) -> DataFrame:
    """One row for each value of ``subset``: the first by ``order_col``."""
    w = Window.partitionBy(*subset).orderBy(order_col)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
