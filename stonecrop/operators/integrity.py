"""Snapshots, manifests and corruption checks."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stonecrop.functions import hashing, paths
from stonecrop.sources import images

MODES = ("fast", "deep", "full")
MATCH = {"fast": ["hash_fast"], "deep": ["hash_fast", "hash_deep"], "full": ["hash_full"]}


def entries(df: DataFrame, mode: str = "fast", path_col: str = "path", size_col: str = "size_bytes", mtime_col: str = "mtime", content_col: str | None = None, pattern: str | None = None, include_hidden: bool = True, hash_col: str | None = None) -> DataFrame:
    """Snapshot entries (path, size, mtime, hash_fast, hash_deep, hash_full) of a table of files.

    ``deep`` and ``full`` need the content, or the hash of that mode in ``hash_col``. ``pattern`` is a glob on the last segments of the path, as many as it has.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode != "fast" and not (content_col or hash_col):
        raise ValueError(f"mode {mode} needs the content")
    rows = df
    if not include_hidden:
        rows = rows.filter(~paths.hidden(F.col(path_col)))
    if pattern:
        rows = rows.filter(paths.normalized(F.col(path_col)).rlike(paths.match_regex(pattern)))
    none = F.lit(None).cast("string")
    return rows.select(
        F.col(path_col).alias("path"),
        F.col(size_col).cast("long").alias("size"),
        F.col(mtime_col).cast("double").alias("mtime"),
        hashing.fast_hash(paths.name(F.col(path_col)), F.col(size_col), F.col(mtime_col)).alias("hash_fast"),
        (none if mode != "deep" else F.col(hash_col) if hash_col else hashing.deep_hash(F.col(content_col))).alias("hash_deep"),
        (none if mode != "full" else F.col(hash_col) if hash_col else hashing.full_hash(F.col(content_col))).alias("hash_full"),
    )


@dataclass
class Snapshot:
    """Entries with how they were made, so that a later one is made alike."""

    entries: DataFrame
    mode: str = "fast"
    options: dict = field(default_factory=dict)
    created_at: str = field(default_factory=lambda: time.strftime("%Y-%m-%dT%H:%M:%S"))

    def save(self, path: str) -> None:
        """A folder with the entries as Parquet and the header as JSON."""
        self.entries.write.mode("overwrite").parquet(f"{path}/entries")
        header = json.dumps({"version": "1.0", "mode": self.mode, "options": self.options, "created_at": self.created_at})
        self.entries.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Snapshot:
        header = json.loads(spark.read.text(f"{path}/header").first()[0])
        return cls(spark.read.parquet(f"{path}/entries"), header["mode"], header["options"], header["created_at"])

    def verify(self, later: Snapshot) -> DataFrame:
        if later.mode != self.mode:
            raise ValueError(f"a {self.mode} snapshot can't be verified against a {later.mode} one")
        return diff(self.entries, later.entries, self.mode)


def diff(old: DataFrame, new: DataFrame, mode: str = "fast") -> DataFrame:
    """(path, status, old_size, new_size, old_mtime, new_mtime); status is matched, modified, missing or added.

    By mode: fast compares the fast hash, deep that and the deep one, full the full one only.
    """
    hashes = MATCH[mode]
    columns = ["path", "size", "mtime", *hashes]
    a, b = old.select(*columns).alias("a"), new.select(*columns).alias("b")
    same = F.lit(True)
    for h in hashes:
        same = same & F.col(f"a.{h}").eqNullSafe(F.col(f"b.{h}"))
    status = F.when(F.col("b.path").isNull(), "missing").when(F.col("a.path").isNull(), "added").when(same, "matched").otherwise("modified")
    both = a.join(b, F.col("a.path") == F.col("b.path"), "full")
    return both.select(F.coalesce("a.path", "b.path").alias("path"), status.alias("status"), F.col("a.size").alias("old_size"), F.col("b.size").alias("new_size"), F.col("a.mtime").alias("old_mtime"), F.col("b.mtime").alias("new_mtime"))


def drift(changes: DataFrame) -> DataFrame:
    """One row: matched, modified, missing, added."""
    return changes.agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("matched", "modified", "missing", "added")])


def verify_manifest(manifest: DataFrame, live: DataFrame) -> DataFrame:
    """(path, status) of manifest rows (path, size_bytes, sha256): the first test that fails, or ok.

    ``live`` has (path, is_dir, size_bytes, sha256). Tests in order: missing, size, hash; a directory that exists is ok.
    Hashes are compared only where sizes agree and the manifest has one.
    """
    a, b = manifest.alias("m"), live.alias("l")
    status = (
        F.when(F.col("l.path").isNull(), "missing")
        .when(F.col("l.is_dir"), "ok")
        .when(F.col("m.size_bytes").isNotNull() & ~F.col("m.size_bytes").eqNullSafe(F.col("l.size_bytes")), "size_mismatch")
        .when(F.col("m.sha256").isNotNull() & ~F.col("m.sha256").eqNullSafe(F.col("l.sha256")), "hash_mismatch")
        .otherwise("ok")
    )
    return a.join(b, F.col("m.path") == F.col("l.path"), "left").select(F.col("m.path").alias("path"), status.alias("status"))


def manifest_summary(files: DataFrame) -> DataFrame:
    """One row: total_files, total_size_bytes."""
    return files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"))


def load_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The files of a saved manifest and its header."""
    return spark.read.parquet(f"{path}/files"), json.loads(spark.read.text(f"{path}/header").first()[0])


def save_manifest(files: DataFrame, path: str, lineage: list[dict] | None = None) -> None:
    """A folder with the files (path, size_bytes, modified_time, sha256) as Parquet and a JSON header."""
    total = manifest_summary(files).first().asDict()
    files.write.mode("overwrite").parquet(f"{path}/files")
    header = json.dumps({"version": "1.0", "created_at": time.strftime("%Y-%m-%dT%H:%M:%S"), "lineage": lineage or [], "summary": total})
    files.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


#: Suffixes of images that are checked.
CHECKED = (".jpg", ".jpeg", ".png", ".bmp")


def with_corruption(df: DataFrame, path_col: str = "path", size_col: str = "size_bytes", content_col: str | None = None, is_file_col: str | None = None) -> DataFrame:
    """Add corruption_reason and is_corrupt: zero_byte, or corrupt_or_unsupported for images that are cut short or are none. What isn't a file is not corrupt.

    With the content, PNG are checked by their chunks' checksums up to the last one, JPEG by their segments up to the end mark, BMP by their header and size.
    """
    reason = F.when(F.col(size_col) == 0, "zero_byte")
    if content_col:
        suffix = F.lower(paths.suffix(F.col(path_col)))

        @F.pandas_udf("boolean")
        def sound(content: pd.Series, kind: pd.Series) -> pd.Series:
            return pd.Series([c is not None and images.is_sound(bytes(c), k) for c, k in zip(content, kind, strict=True)])

        # only images are sent to Python
        checked = F.when(suffix.isin(*CHECKED), F.col(content_col).cast("binary"))
        reason = reason.when(suffix.isin(*CHECKED) & ~sound(checked, suffix), "corrupt_or_unsupported")
    if is_file_col:
        reason = F.when(F.col(is_file_col), reason)
    return df.withColumn("corruption_reason", reason).withColumn("is_corrupt", F.col("corruption_reason").isNotNull())
