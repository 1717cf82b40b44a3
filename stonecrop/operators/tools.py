"""The registered tools: what a program or a person can call by name, with texts as arguments, for plain results of bounded size.

``register_functions`` makes the library's text functions known to Spark SQL.
"""

from __future__ import annotations

import inspect
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stonecrop.functions import kinds, paths
from stonecrop.functions import text as text_functions
from stonecrop.operators import dedup, integrity, profile, quality, relational, report
from stonecrop.operators.frame import FileFrame
from stonecrop.operators.registry import Registry
from stonecrop.sources import files as file_formats
from stonecrop.sources import tree

tools = Registry()
#: Rows that a tool shows at most, and unless it is told otherwise.
MOST, SHOWN = 200, 20


def call(spark: SparkSession, name: str, **given: Any) -> Any:
    """Run a tool; texts are turned into the numbers and flags that it takes."""
    one = tools.get(name)
    kinds = {k: p.annotation for k, p in inspect.signature(one.run).parameters.items()}
    if unknown := set(given) - set(kinds):
        raise ValueError(f"{name} takes no {sorted(unknown)}")
    made = {}
    for k, v in given.items():
        kind = str(kinds[k])
        made[k] = int(v) if kind.startswith("int") else float(v) if kind.startswith("float") else str(v).lower() in ("1", "true", "yes") if kind == "bool" else v
    return one.run(spark, **made)


def shown(df: DataFrame, n: int = SHOWN) -> list[dict]:
    return [r.asDict() for r in df.limit(max(1, min(MOST, n))).collect()]


def _files(spark: SparkSession, path: str, hidden: bool = True, hashes: bool = False) -> DataFrame:
    return tree.scan(spark, path, hidden=hidden, compute_hash=hashes).filter("is_file")


@tools.register
def count_files(spark: SparkSession, path: str, include_hidden: bool = True) -> dict:
    """Files, directories and both below a directory."""
    return tree.counts(tree.scan(spark, path, hidden=include_hidden, with_stats=False)).first().asDict()


@tools.register
def probe_directory(spark: SparkSession, path: str) -> dict:
    """All reports of a directory's profile."""
    return profile.Profile(tree.with_root(tree.scan(spark, path, lean=True), path)).to_dict()


@tools.register
def get_file_info(spark: SparkSession, path: str, compute_hash: bool = False) -> dict:
    """The metadata of a file."""
    return vars(tree.probe_file(path, compute_hash))


@tools.register
def read_file(spark: SparkSession, path: str, start_line: int = 1, end_line: int = 0, max_chars: int = 0) -> str | None:
    """Lines of a text file of up to 10 MB."""
    from stonecrop import api

    one = spark.createDataFrame([(path,)], "path string")
    return api.read_lines(one, start_line, end_line or None, max_chars or None).first()["lines"]


@tools.register
def list_directory(spark: SparkSession, path: str, n: int = SHOWN) -> list[dict]:
    """One level of a directory, directories first."""
    return shown(tree.listing(tree.scan(spark, path, max_depth=1)).select("name", "is_dir", "size_bytes"), n)


@tools.register
def get_directory_tree(spark: SparkSession, path: str, max_depth: int = 3, n: int = MOST) -> list[str]:
    """Lines of a directory's tree, indented by depth."""
    rows = tree.whole_listing(tree.scan(spark, path, max_depth=max_depth, with_stats=False))
    return ["  " * (r["depth"] - 1) + r["name"] + "/" * r["is_dir"] for r in shown(rows.select("path", "name", "depth", "is_dir"), n)]


@tools.register
def search_files(spark: SparkSession, path: str, pattern: str = "", extension: str = "", min_size: str = "", max_depth: int = -1, include_hidden: bool = True, ignore_git_files: bool = False, n: int = SHOWN) -> list[str]:
    """Files by extension, else by least size, else by a pattern of the name."""
    rows = tree.scan(spark, path, max_depth if max_depth >= 0 else None, hidden=include_hidden, ignore=ignore_git_files)
    return [r["path"] for r in shown(tree.search(rows, pattern or None, extension or None, min_size or None).select("path").orderBy("path"), n)]


@tools.register
def find_recent_files(spark: SparkSession, path: str, within: str = "1d", extension: str = "", n: int = SHOWN) -> list[str]:
    """Files changed within a duration."""
    return [r["path"] for r in shown(tree.find_recent(_files(spark, path), within, extension=extension or None).orderBy(F.desc("mtime"), "path"), n)]


@tools.register
def find_empty_directories(spark: SparkSession, path: str, n: int = SHOWN) -> list[str]:
    """Directories without any entry."""
    return [r["path"] for r in shown(profile.empty_folders(tree.scan(spark, path, lean=True)).orderBy("path"), n)]


@tools.register
def sort_by_size(spark: SparkSession, path: str, ascending: bool = False, top_n: int = 10) -> list[dict]:
    """The largest or smallest files."""
    return shown(FileFrame(_files(spark, path)).largest(top_n, ascending).df.select("path", "size_bytes"), top_n)


@tools.register
def summarize(spark: SparkSession, path: str) -> dict:
    """Rows, the ten most frequent extensions and directories."""
    return FileFrame(_files(spark, path)).summarize()


@tools.register
def find_duplicates(spark: SparkSession, path: str, n: int = SHOWN) -> dict:
    """Numbers of groups and files of equal content, and some of the paths."""
    files = file_formats.materialize(_files(spark, path, hashes=True), "hashed-files")
    counts = quality.equal_hashes(files, "sha256").first().asDict()
    return counts | {"examples": shown(dedup.exact_groups(files).orderBy("group_id", "path"), n)}


@tools.register
def duplicate_directories(spark: SparkSession, path: str, min_shared: int = 1, n: int = SHOWN) -> list[dict]:
    """Pairs of directories that share files, those that share most first."""
    files = file_formats.materialize(_files(spark, path, hashes=True), "hashed-files")
    found = dedup.directory_overlap(dedup.exact_groups(files), paths.parent(F.col("path")), files, min_shared=min_shared)
    return shown(found.orderBy(F.desc("shared_files"), "dir_a", "dir_b"), n)


@tools.register
def audit_corrupted_files(spark: SparkSession, path: str, include_hidden: bool = True, n: int = SHOWN) -> dict:
    """Empty and damaged files: how many of each, and some of the paths."""
    rows = integrity.with_corruption(tree.with_content(_files(spark, path, include_hidden), kinds.is_image(F.col("path"))), content_col="content").select("path", "corruption_reason")
    rows = file_formats.materialize(rows, "checked-files")
    counts = {r[0]: r[1] for r in rows.filter("corruption_reason is not null").groupBy("corruption_reason").count().collect()}
    return {"checked": rows.count(), "failed": sum(counts.values()), "reasons": counts, "examples": shown(rows.filter("corruption_reason is not null").orderBy("path"), n)}


@tools.register
def generate_hygiene_report(spark: SparkSession, path: str) -> dict:
    """The hygiene score and its metrics; classes by folder."""
    files = file_formats.materialize(_files(spark, path, hashes=True), "hashed-files")
    groups = quality.equal_hashes(files, "sha256").first()["duplicate_count"]
    cv = quality.class_variation(quality.class_balance(quality.folder_labels(files), "label")).first()["cv_pct"]
    return quality.hygiene(None, groups, cv)


@tools.register
def assess_migration_readiness(spark: SparkSession, path: str) -> dict:
    """Readiness, blockers, effort and time."""
    one = _files(spark, path).agg(F.count("*").alias("n"), F.count(F.when(F.col("size_bytes") == 0, 1)).alias("failed"), F.countDistinct(profile.extension()).alias("kinds")).first()
    return quality.migration_readiness(one["n"], one["failed"], one["kinds"])


@tools.register
def audit_dataset(spark: SparkSession, path: str, gates: str = "", show_evidence: bool = False) -> dict:
    """The consolidated report."""
    files = integrity.with_corruption(tree.with_content(_files(spark, path, hashes=True), kinds.is_image(F.col("path"))), content_col="content").drop("content")
    return report.full(files, quality.gate_policy(gates) if gates else None, show_evidence=show_evidence)


@tools.register
def dataframe_head(spark: SparkSession, path: str, n: int = 5) -> list[dict]:
    """The first rows of a saved table, by its columns."""
    return shown(FileFrame.load(spark, path).head(max(1, min(MOST, n))).df, n)


@tools.register
def describe_table(spark: SparkSession, path: str) -> list[dict]:
    """Counts, means, deviations and percentiles of the numbers of a saved table."""
    return shown(FileFrame.load(spark, path).describe().df, MOST)


@tools.register
def column_profile(spark: SparkSession, path: str, column: str) -> dict:
    """Counts and numbers of a column of a saved table, and its most frequent values."""
    df = file_formats.load(spark, path)
    return relational.column_profile(df, column).first().asDict() | {"values": shown(relational.value_counts(df, column, SHOWN))}


@tools.register
def export_table(spark: SparkSession, path: str, output: str, format: str = "parquet") -> str:
    """Save the table of a directory's files."""
    file_formats.save(_files(spark, path), output, format)
    return output


def register_functions(spark: SparkSession, prefix: str = "stonecrop_") -> list[str]:
    """Functions for Spark SQL by name: chunks of texts, and a table function of a text's sentences."""
    chunk = F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else text_functions.chunked(t)), "array<string>")
    spark.udf.register(f"{prefix}chunks", chunk)

    @F.udtf(returnType="place int, sentence string")
    class Sentences:
        def eval(self, text: str):
            for i, s in enumerate(text_functions.sentence_list(text or "")):
                yield i, s

    spark.udtf.register(f"{prefix}sentences", Sentences)
    return [f"{prefix}chunks", f"{prefix}sentences"]
