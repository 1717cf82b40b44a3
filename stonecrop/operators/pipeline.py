"""Scan, enrich, verify, deduplicate and report as one chain, and a dataset that keeps its parts."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stonecrop.operators import dedup, integrity, profile, quality
from stonecrop.operators.frame import FileFrame
from stonecrop.sources import tree
from stonecrop.sources.files import materialize


@dataclass
class State:
    root: str
    frame: FileFrame | None = None
    snapshot: integrity.Snapshot | None = None
    duplicates: DataFrame | None = None
    report: DataFrame | None = None


@dataclass
class Pipeline:
    """Each step returns the pipeline with one more part. A scan is written, so that a tree is read and hashed once; what follows runs when a part is collected."""

    spark: SparkSession
    state: State
    steps: tuple[str, ...] = ()
    cache: dict = field(default_factory=dict)

    @classmethod
    def of(cls, spark: SparkSession, root: str) -> Pipeline:
        return cls(spark, State(root))

    def _with(self, step: str, **parts: object) -> Pipeline:
        return replace(self, state=replace(self.state, **parts), steps=(*self.steps, step))

    def scan(self, max_depth: int | None = None) -> Pipeline:
        key = (self.state.root, max_depth)
        if key not in self.cache:
            self.cache[key] = materialize(tree.scan(self.spark, self.state.root, max_depth, compute_hash=True), "scan")
        return self._with("scan", frame=FileFrame(self.cache[key]))

    def enrich(self) -> Pipeline:
        return self._with("enrich", frame=self._frame().enrich())

    def verify(self) -> Pipeline:
        return self._with("verify", frame=self._frame().add_corruption())

    def dedup(self) -> Pipeline:
        return self._with("dedup", duplicates=dedup.exact_groups(self._frame().df.filter("is_file")))

    def report(self) -> Pipeline:
        return self._with("report", report=quality.audit(self._frame().df.filter("is_file")))

    def invalidate_cache(self) -> Pipeline:
        self.cache.clear()
        return self

    def _frame(self) -> FileFrame:
        if self.state.frame is None:
            raise ValueError("scan first")
        return self.state.frame


class Dataset:
    """A directory with its frame, profile and snapshots."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self._frame = spark, root, None

    def frame(self, compute_hash: bool = False) -> FileFrame:
        if self._frame is None or (compute_hash and not self._frame[0]):
            found = tree.scan(self.spark, self.root, compute_hash=compute_hash)
            self._frame = (compute_hash, FileFrame(materialize(found, "scan") if compute_hash else found).enrich())
        return self._frame[1]

    to_dataframe = frame

    def invalidate_cache(self) -> Dataset:
        self._frame = None
        return self

    def probe(self) -> profile.Profile:
        return profile.Profile(tree.with_root(tree.scan(self.spark, self.root, lean=True), self.root))

    def snap(self, mode: str = "fast", pattern: str | None = None, include_hidden: bool = True) -> integrity.Snapshot:
        # the tasks hash what they scan, hidden files too, which the built-in file source doesn't see
        files = tree.scan(self.spark, self.root, compute_hash=mode == "full").filter("is_file")
        if mode == "deep":
            files = files.withColumn("deep", tree.deep_hash(F.col("path")))
        hash_col = {"full": "sha256", "deep": "deep"}.get(mode)
        options = {"pattern": pattern, "include_hidden": include_hidden}
        return integrity.Snapshot(integrity.entries(files, mode, hash_col=hash_col, **options), mode, options)

    def verify(self, before: integrity.Snapshot) -> DataFrame:
        """Changes since ``before``, scanned as that was."""
        return before.verify(self.snap(before.mode, **before.options))

    def quality_scan(self, gates: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame | None]:
        report = quality.audit(self.frame(True).df.filter("is_file"))
        return report, quality.check_gates(report, gates) if gates else None

    run_quality_scan = quality_scan

    def dedup(self, mode: str = "exact", **options: object) -> DataFrame:
        """(group_id, path) of equal files; (category, group_id, path) by another mode."""
        files = self.frame(True).df.filter("is_file")
        return dedup.exact_groups(files) if mode == "exact" else dedup.find_duplicates(files, mode, **options)
