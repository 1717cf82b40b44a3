"""Aggregates over a table of paths or of tree entries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stonecrop.functions import paths
from stonecrop.sources.files import materialize


def extension(path_col: str = "path") -> Column:
    s = F.lower(paths.suffix(F.col(path_col)))
    return F.when(s == "", "<no extension>").otherwise(s)


def extension_counts(df: DataFrame, path_col: str = "path", top: int | None = None) -> DataFrame:
    """(extension, len), the most frequent first; ties by name."""
    out = df.groupBy(extension(path_col).alias("extension")).agg(F.count("*").alias("len")).orderBy(F.desc("len"), "extension")
    return out.limit(top) if top else out


def directory_counts(df: DataFrame, path_col: str = "path", top: int | None = None) -> DataFrame:
    """(parent_dir, len), the most frequent first."""
    out = df.groupBy(paths.parent(F.col(path_col)).alias("parent_dir")).agg(F.count("*").alias("len")).orderBy(F.desc("len"), "parent_dir")
    return out.limit(top) if top else out


def tree_of(files: DataFrame, path_col: str = "path", size_col: str | None = None) -> DataFrame:
    """Entries (path, is_dir, depth, size_bytes) of the tree that absolute file paths span, its root included."""
    clean = paths.normalized(F.col(path_col))
    size = F.col(size_col).cast("long") if size_col else F.lit(0).cast("long")
    rows = files.filter(F.col(path_col).isNotNull()).select(clean.alias("path"), size.alias("size_bytes")).dropDuplicates(["path"])
    leaf = rows.select("path", F.lit(False).alias("is_dir"), F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("long").alias("depth"), "size_bytes")
    steps = F.filter(F.split("path", "/"), lambda x: x != "")
    above = rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda n: F.struct(n.cast("long").alias("depth"), F.concat(F.lit("/"), F.array_join(F.slice(steps, F.lit(1), n), "/")).alias("path")))).alias("x"))
    folders = above.select("x.path", F.lit(True).alias("is_dir"), "x.depth", F.lit(0).cast("long").alias("size_bytes")).distinct()
    return leaf.unionByName(folders)


def summary(entries: DataFrame) -> DataFrame:
    """One row: total_files, total_folders (the root counts), total_size_bytes, total_size_mb, avg_files_per_folder, max_depth, empty_folder_count.

    One pass where folders know how many entries they have (``n_entries``).
    """
    files, folders = F.sum((~F.col("is_dir")).cast("long")), F.sum(F.col("is_dir").cast("long"))
    size = F.sum(F.when(~F.col("is_dir"), F.col("size_bytes")).otherwise(0))
    totals = [
        F.coalesce(files, F.lit(0)).alias("total_files"),
        F.coalesce(folders, F.lit(0)).alias("total_folders"),
        F.coalesce(size, F.lit(0)).alias("total_size_bytes"),
        F.bround(F.coalesce(size, F.lit(0)) / 1048576, 2).alias("total_size_mb"),
        F.bround(F.when(folders > 0, files / folders).otherwise(0.0), 2).alias("avg_files_per_folder"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
    ]
    if "n_entries" in entries.columns:
        return entries.agg(*totals, F.count(F.when(F.col("is_dir") & (F.col("n_entries") == 0), 1)).alias("empty_folder_count"))
    return entries.agg(*totals).join(F.broadcast(empty_folders(entries).agg(F.count("*").alias("empty_folder_count"))))


def empty_folders(entries: DataFrame) -> DataFrame:
    """Folders without any entry in them, hidden ones counted: by ``n_entries``, else those that are no entry's parent."""
    if "n_entries" in entries.columns:
        return entries.filter("is_dir and n_entries = 0").select("path")
    parents = entries.filter("depth > 0").select(paths.parent(F.col("path")).alias("path")).distinct()
    return entries.filter("is_dir").select("path").join(parents, "path", "left_anti")


def top_folders(entries: DataFrame, top: int = 10) -> DataFrame:
    """(folder, n_files): the folders with most files of their own."""
    files = entries.filter("not is_dir").groupBy(paths.parent(F.col("path")).alias("folder")).agg(F.count("*").alias("n_files"))
    return files.orderBy(F.desc("n_files"), "folder").limit(top)


def common_folder_names(entries: DataFrame, top: int = 20) -> DataFrame:
    """(folder_name, n): the root doesn't count."""
    rows = entries.filter("is_dir and depth > 0").groupBy(paths.name(F.col("path")).alias("folder_name")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "folder_name").limit(top)


def depth_distribution(entries: DataFrame) -> DataFrame:
    """(depth, n_folders)."""
    return entries.filter("is_dir").groupBy("depth").agg(F.count("*").alias("n_folders"))


@dataclass
class Profile:
    """The reports over one tree; each is a DataFrame, computed when it is asked for."""

    entries: DataFrame

    @property
    def summary(self) -> DataFrame:
        return summary(self.entries)

    @property
    def file_extensions(self) -> DataFrame:
        return extension_counts(self.entries.filter("not is_dir"), top=20)

    @property
    def common_folder_names(self) -> DataFrame:
        return common_folder_names(self.entries)

    @property
    def empty_folders(self) -> DataFrame:
        return empty_folders(self.entries)

    @property
    def top_folders_by_file_count(self) -> DataFrame:
        return top_folders(self.entries)

    @property
    def depth_distribution(self) -> DataFrame:
        return depth_distribution(self.entries)

    def to_dict(self, most: int = 1000) -> dict:
        """All reports on the driver, from one scan, which is written; at most ``most`` empty folders by name, their number is in the summary."""
        once = Profile(materialize(self.entries, "profile"))
        pairs = lambda df: {r[0]: r[1] for r in df.collect()}
        return {
            "summary": once.summary.first().asDict(),
            "file_extensions": pairs(once.file_extensions),
            "common_folder_names": pairs(once.common_folder_names),
            "top_folders_by_file_count": pairs(once.top_folders_by_file_count),
            "depth_distribution": pairs(once.depth_distribution),
            "empty_folders": [r["path"] for r in once.empty_folders.orderBy("path").limit(most).collect()],
        }
