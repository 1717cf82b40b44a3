"""The short way in: probe paths, make frames, snapshot, verify and audit."""

from __future__ import annotations

import json
import os
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stonecrop.functions import kinds
from stonecrop.functions.text import line_slice
from stonecrop.operators import integrity, profile, quality, report
from stonecrop.operators.frame import FileFrame
from stonecrop.operators.pipeline import Dataset
from stonecrop.sources import images, tree


def probe(spark: SparkSession, path: str, max_depth: int | None = None) -> profile.Profile | tree.FileRecord:
    """The record of a file, or the profile of a directory."""
    if os.path.isfile(path):
        return tree.probe_file(path)
    return profile.Profile(tree.with_root(tree.scan(spark, path, max_depth, lean=True), path))


def probe_to_frame(spark: SparkSession, path: str, max_depth: int | None = None, enrich: bool = True, compute_hash: bool = False) -> FileFrame:
    """The entries below a directory; with path components if ``enrich``."""
    frame = FileFrame(tree.scan(spark, path, max_depth, with_stats=enrich, compute_hash=compute_hash))
    return frame.enrich() if enrich else FileFrame(frame.df.select("path"))


def probe_image(image: str | bytes | np.ndarray) -> dict:
    """Statistics of an array, of PNG bytes, or of the file at a path."""
    if isinstance(image, np.ndarray):
        return images.array_report(image) | {"status": "ok"}
    if isinstance(image, str):
        if image.lower().endswith(images.NOT_IMPLEMENTED):
            return {"status": "not implemented"}
        image = open(image, "rb").read()
    try:
        return images.array_report(images.decode_png(image)) | {"status": "ok"}
    except ValueError as e:
        return {"status": f"error: {e}"}


def sample_paths(spark: SparkSession, path: str, sample_size: int = 20) -> list[str]:
    """The first paths below a directory, by name."""
    return [r["path"] for r in tree.scan(spark, path, with_stats=False).select("path").orderBy("path").limit(sample_size).collect()]


#: Bytes of a file that is read as text at most, unless a caller says otherwise.
READ_LIMIT = 10 * 2**20


def read_lines(files: DataFrame, first: int = 1, last: int | None = None, max_chars: int | None = None, limit: int = READ_LIMIT) -> DataFrame:
    """``files`` (path) with lines ``first`` to ``last`` of each, read by the tasks; null for a file that isn't there, isn't text or is over ``limit`` bytes."""
    @F.pandas_udf("string")
    def text(given: pd.Series) -> pd.Series:
        def one(path: str | None) -> str | None:
            try:
                if path is None or os.path.getsize(path) > limit:
                    return None
                with open(path, "rb") as f:
                    return f.read().decode()
            except (OSError, UnicodeDecodeError):
                return None

        return given.map(one)

    return files.withColumn("lines", line_slice(text("path"), first, last, max_chars))


def snapshot(spark: SparkSession, path: str, mode: str = "fast", save_to: str | None = None, **options: object) -> integrity.Snapshot:
    made = Dataset(spark, path).snap(mode, **options)
    if save_to:
        made.save(save_to)
    return made


def snapshot_json(made: integrity.Snapshot, path: str) -> None:
    """One JSON file with header and entries, a row at a time."""
    head = {"version": "1.0", "created_at": made.created_at, "mode": made.mode, "options": made.options}
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(head)[:-1] + ', "entries": [')
        for i, row in enumerate(made.entries.orderBy("path").toLocalIterator()):
            f.write((", " if i else "") + json.dumps(row.asDict()))
        f.write("]}")


def read_snapshot_json(spark: SparkSession, path: str) -> integrity.Snapshot:
    schema = "version string, created_at string, mode string, options struct<pattern:string,include_hidden:boolean>, entries array<struct<path:string,size:long,mtime:double,hash_fast:string,hash_deep:string,hash_full:string>>"
    whole = spark.read.schema(schema).json(path, multiLine=True)
    head = whole.select("created_at", "mode", "options").first()
    return integrity.Snapshot(whole.selectExpr("inline(entries)"), head["mode"], head["options"].asDict() if head["options"] else {}, head["created_at"])


def manifest(spark: SparkSession, path: str, lineage: list[dict] | None = None, include_hidden: bool = True) -> tuple[DataFrame, dict]:
    """(path, size_bytes, modified_time, sha256) of a directory's files, and the header of a manifest of them."""
    files = tree.scan(spark, path, hidden=include_hidden, compute_hash=True).filter("is_file").select("path", "size_bytes", "modified_time", "sha256")
    return files, {"version": "1.0", "created_at": time.strftime("%Y-%m-%dT%H:%M:%S"), "lineage": lineage or [], "summary": integrity.manifest_summary(files).first().asDict()}


def manifest_json(made: tuple[DataFrame, dict], path: str) -> None:
    """One JSON file with header and files, a row at a time."""
    files, head = made
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(head)[:-1] + ', "files": [')
        for i, row in enumerate(files.orderBy("path").toLocalIterator()):
            f.write((", " if i else "") + json.dumps(row.asDict()))
        f.write("]}")


def read_manifest_json(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    schema = "version string, created_at string, lineage string, summary struct<total_files:long,total_size_bytes:long>, files array<struct<path:string,size_bytes:long,modified_time:string,sha256:string>>"
    whole = spark.read.schema(schema).json(path, multiLine=True)
    head = whole.select("version", "created_at", "lineage", "summary").first()
    return whole.selectExpr("inline(files)"), head.asDict(True) | {"lineage": json.loads(head["lineage"] or "[]")}


def verify_file(spark: SparkSession, path: str, reference: str) -> DataFrame:
    """A directory against a JSON file: a manifest if it has a lineage, else a snapshot."""
    keys = spark.read.json(reference, multiLine=True).columns
    if "lineage" in keys:
        return verify(spark, path, read_manifest_json(spark, reference)[0].select("path", "size_bytes", "sha256"))
    return verify(spark, path, read_snapshot_json(spark, reference))


def verify(spark: SparkSession, path: str, reference: integrity.Snapshot | DataFrame) -> DataFrame:
    """Changes against a snapshot, or the state of each file of a manifest (path, size_bytes, sha256)."""
    if isinstance(reference, integrity.Snapshot):
        return Dataset(spark, path).verify(reference)
    return integrity.verify_manifest(reference, tree.scan(spark, path, compute_hash=True).select("path", "is_dir", "size_bytes", "sha256"))


def audit(spark: SparkSession, path: str, policy: str | None = None, format: str = "json", include_hidden: bool = True, show_evidence: bool = False) -> tuple[str, int]:
    """The rendered report of a directory and an exit code."""
    files = tree.with_content(tree.scan(spark, path, hidden=include_hidden, compute_hash=True).filter("is_file"), kinds.is_image(F.col("path")))
    made = report.full(integrity.with_corruption(files, content_col="content").drop("content"), policy and quality.gate_policy(policy), show_evidence=show_evidence)
    return report.rendered(made, format), report.exit_code(made)


def watch(spark: SparkSession, path: str, before: integrity.Snapshot, gates: dict[str, float] | None = None, export: str | None = None) -> tuple[dict, int]:
    """The counts of changes since a snapshot, the changed paths by status, the gates' results; and an exit code. ``export`` is a JSON file for it."""
    changes = Dataset(spark, path).verify(before).filter("status <> 'matched'")
    counts = {r["status"]: r["n"] for r in changes.groupBy("status").agg(F.count("*").alias("n")).collect()}
    counts = {s: counts.get(s, 0) for s in ("modified", "missing", "added")}
    passed = {g: counts[g] <= most for g, most in (gates or {}).items() if g in counts}
    made = {"path": path, "mode": before.mode, "summary": counts, "gates": passed, "passed": all(passed.values())}
    if export:
        lists = {s: [] for s in counts}
        for r in changes.orderBy("path").toLocalIterator():
            lists[r["status"]].append(r["path"])
        with open(export, "w", encoding="utf-8") as f:
            json.dump(made | {"changes": lists}, f, indent=2)
    return made, 0 if made["passed"] else 1
