"""Dataset quality: balance, dimensions, leakage, hygiene, readiness, audits and gates."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stonecrop.functions import paths
from stonecrop.operators import profile

#: Score of a metric's status.
POINTS = {"pass": 100.0, "warn": 70.0, "fail": 30.0}
#: Gates where less is better; for the others more is.
LOWER_IS_BETTER = ("duplicate_ratio_pct", "corrupted_files", "zero_byte_files", "migration_blockers")
GATES = (*LOWER_IS_BETTER, "hygiene_score", "migration_readiness", "class_min_samples")
SPLITS = ("train", "valid", "test")


def class_balance(df: DataFrame, label_col: str) -> DataFrame:
    """(label, n) of labels that aren't null."""
    return df.filter(F.col(label_col).isNotNull()).groupBy(F.col(label_col).cast("string").alias("label")).agg(F.count("*").alias("n"))


def folder_labels(files: DataFrame, path_col: str = "path") -> DataFrame:
    """``files`` with label, the name of the folder a file is in."""
    return files.withColumn("label", paths.name(paths.parent(F.col(path_col))))


def table_labels(rows: DataFrame) -> DataFrame:
    """(label) of a table of annotations: its first column that isn't called filename; none without such a column."""
    names = [c for c in rows.columns if c.lower() != "filename"]
    return rows.select(F.col(f"`{names[0]}`").cast("string").alias("label") if names else F.lit(None).cast("string").alias("label"))


def labels_of(files: DataFrame, annotations: DataFrame | None = None, source: str = "auto") -> DataFrame:
    """(label): from the annotations (``csv``), the folders (``folder``), or the folders only where annotations give none (``auto``)."""
    if source != "folder" and annotations is not None:
        found = table_labels(annotations).filter("label is not null")
        if source == "csv" or not found.isEmpty():
            return found
    return folder_labels(files).select("label")


def extension_shares(files: DataFrame, path_col: str = "path") -> DataFrame:
    """(extension, n, share_pct) of all files."""
    counts = files.groupBy(profile.extension(path_col).alias("extension")).agg(F.count("*").alias("n"))
    # the total of a table of one row an extension
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("extension", "n", F.bround(F.col("n") * 100.0 / F.col("total"), 2).alias("share_pct"))


def reconciliation(profiled: DataFrame, checked: DataFrame, basis: DataFrame) -> DataFrame:
    """One row: the numbers of files that three stages saw, how they differ, and status ok or warn."""
    parts = [t.select(F.lit(k).alias("stage")) for k, t in (("profiled", profiled), ("checked", checked), ("basis", basis))]
    n = lambda k: F.count(F.when(F.col("stage") == k, 1))
    one = functools.reduce(DataFrame.unionByName, parts).agg(n("profiled").alias("profiled"), n("checked").alias("checked"), n("basis").alias("basis"))
    one = one.withColumn("profiled_not_checked", F.col("profiled") - F.col("checked")).withColumn("profiled_not_basis", F.col("profiled") - F.col("basis"))
    fine = F.col("profiled").isin(0) | (F.col("profiled") == F.col("checked"))
    fine = fine & (F.col("basis").isin(0) | (F.col("basis") == F.col("profiled")))
    return one.withColumn("status", F.when(fine, "ok").otherwise("warn"))


def equal_hashes(files: DataFrame, hash_col: str = "dhash") -> DataFrame:
    """One row: duplicate_count, the groups of two or more files of one hash, and duplicate_file_count, the files in them."""
    groups = files.filter(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.count("*").alias("n")).filter("n > 1")
    return groups.agg(F.count("*").alias("duplicate_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_file_count"))


#: What is to be done about a metric that isn't zero: severity, what to do, and the metric with the number of things.
ADVICE = [
    ("critical", "set damaged and empty files aside", "failed_files"),
    ("high", "keep one file of each duplicate group", "duplicate_groups"),
    ("medium", "find out why stages saw different files", "unreconciled"),
]


def findings(metrics: dict[str, float]) -> list[dict]:
    """(severity, action, count), the most severe first; one of low severity if there is nothing to do."""
    out = [{"severity": s, "action": a, "count": int(metrics[m])} for s, a, m in ADVICE if metrics.get(m)]
    return out or [{"severity": "low", "action": "keep this report to compare later ones with", "count": 0}]


def class_variation(balance: DataFrame) -> DataFrame:
    """One row: n_classes, cv_pct (sample deviation over mean, in percent) and status: pass to 30, warn to 50, else fail; null for fewer than two classes."""
    cv = F.stddev_samp("n") / F.avg("n") * 100
    one = balance.agg(F.count("*").alias("n_classes"), F.when(F.count("*") > 1, cv).alias("cv_pct"))
    return one.withColumn("status", F.when(F.col("cv_pct") <= 30, "pass").when(F.col("cv_pct") <= 50, "warn").when(F.col("cv_pct").isNotNull(), "fail"))


def dimension_outliers(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """One row: width, height (the modal size, ties to the least), total, outliers, outlier_pct."""
    sizes = df.select(width.alias("width"), height.alias("height")).dropna().groupBy("width", "height").agg(F.count("*").alias("n"))
    key = F.struct("n", (-F.col("width")).alias("w"), (-F.col("height")).alias("h"))
    one = sizes.agg(F.max_by(F.struct("width", "height"), key).alias("mode"), F.max("n").alias("most"), F.sum("n").alias("total"))
    return one.select("mode.width", "mode.height", "total", (F.col("total") - F.col("most")).alias("outliers"), F.bround((F.col("total") - F.col("most")) * 100.0 / F.col("total"), 2).alias("outlier_pct"))


def flat_pixels(df: DataFrame, id_col: str, pixels_col: str, least: float = 0.1) -> DataFrame:
    """(id, std) of arrays whose population deviation is under ``least``."""
    v = F.transform(F.col(pixels_col), lambda x: x.cast("double"))
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
    rows = df.filter(F.size(pixels_col) > 0).withColumn("__m", mean)
    std = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - F.col("__m")) * (x - F.col("__m"))) / n)
    return rows.select(F.col(id_col), std.alias("std")).filter(F.col("std") < least)


def split_of(path: Column) -> Column:
    """The first path segment that is train, valid or test."""
    return F.get(F.filter(paths.parts(path), lambda x: x.isin(*SPLITS)), F.lit(0))


def leakage(df: DataFrame, split_col: str, name_col: str) -> DataFrame:
    """(split_a, split_b, n_shared): names, or any key, that two splits share."""
    each = df.select(F.col(split_col).alias("split"), F.col(name_col).alias("name")).dropna().distinct()
    a, b = each.alias("a"), each.alias("b")
    met = a.join(b, (F.col("a.name") == F.col("b.name")) & (F.col("a.split") < F.col("b.split")))
    return met.groupBy(F.col("a.split").alias("split_a"), F.col("b.split").alias("split_b")).agg(F.count("*").alias("n_shared"))


def split_counts(df: DataFrame, split_col: str) -> DataFrame:
    """(split, n)."""
    return df.filter(F.col(split_col).isNotNull()).groupBy(F.col(split_col).alias("split")).agg(F.count("*").alias("n"))


def hygiene(outlier_pct: float | None, duplicate_groups: int, cv_pct: float | None) -> dict:
    """Metrics with their status, and the mean of their points."""
    metrics = {}
    if outlier_pct is not None:
        good = 100 - outlier_pct
        metrics["dimension_consistency"] = (good, "pass" if good >= 95 else "warn" if good >= 90 else "fail")
    metrics["duplicate_files"] = (float(duplicate_groups), "fail" if duplicate_groups else "pass")
    if cv_pct is not None:
        metrics["class_balance"] = (cv_pct, "pass" if cv_pct <= 30 else "warn" if cv_pct <= 50 else "fail")
    return {"score": sum(POINTS[s] for _, s in metrics.values()) / len(metrics), "metrics": metrics}


def migration_readiness(n_files: int, n_failed: int, n_extensions: int) -> dict:
    """Readiness 0 if blocked, 50 with a warning, else 100; blockers, effort and time in hours."""
    blockers = int(n_failed > 0) + int(n_files == 0)
    warning = n_files > 0 and n_extensions <= 1
    return {"readiness": 0.0 if blockers else 50.0 if warning else 100.0, "blockers": blockers, "effort_hours": n_failed * 0.1, "migration_hours": max(0.1, n_files * 1e-4)}


def audit(files: DataFrame, hash_col: str = "sha256", size_col: str = "size_bytes", path_col: str = "path", label_col: str | None = None) -> DataFrame:
    """(metric, value): the consolidated report of a table of files; two passes over it, and one for labels."""
    extension = F.lower(paths.suffix(F.col(path_col)))
    groups = files.filter(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.count("*").alias("n"), F.max(size_col).alias("size"))
    dup = groups.filter("n > 1").agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_files"), F.coalesce(F.sum((F.col("n") - 1) * F.col("size")), F.lit(0)).alias("wasted_bytes"))
    one = files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum(size_col), F.lit(0)).alias("total_size_bytes"), F.count(F.when(F.col(size_col) == 0, 1)).alias("zero_byte_files"), F.countDistinct(extension).alias("n_extensions"))
    row = one.join(F.broadcast(dup))
    if label_col:
        balance = class_balance(files, label_col)
        row = row.join(F.broadcast(class_variation(balance).select("cv_pct"))).join(F.broadcast(balance.agg(F.min("n").alias("class_min_samples"))))
    else:
        row = row.withColumn("cv_pct", F.lit(None).cast("double")).withColumn("class_min_samples", F.lit(None).cast("long"))
    cv = F.col("cv_pct")
    points = lambda s: F.when(s == "pass", 100.0).when(s == "warn", 70.0).otherwise(30.0)
    dup_points = F.when(F.col("duplicate_groups") > 0, 30.0).otherwise(100.0)
    cv_points = points(F.when(cv <= 30, "pass").when(cv <= 50, "warn").otherwise("fail"))
    row = row.withColumn("duplicate_ratio_pct", F.bround(F.when(F.col("total_files") > 0, F.col("duplicate_files") * 100.0 / F.col("total_files")).otherwise(0.0), 2))
    row = row.withColumn("hygiene_score", F.when(cv.isNull(), dup_points).otherwise((dup_points + cv_points) / 2))
    row = row.withColumn("migration_blockers", (F.col("zero_byte_files") > 0).cast("int") + (F.col("total_files") == 0).cast("int"))
    row = row.withColumn("migration_readiness", F.when(F.col("migration_blockers") > 0, 0.0).when(F.col("n_extensions") <= 1, 50.0).otherwise(100.0))
    names = ["total_files", "total_size_bytes", "zero_byte_files", "n_extensions", "duplicate_groups", "duplicate_files", "wasted_bytes", "duplicate_ratio_pct", "hygiene_score", "migration_blockers", "migration_readiness", "class_min_samples"]
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("x")).select("x.metric", "x.value").filter("value is not null")


@dataclass(frozen=True)
class GateResult:
    name: str
    threshold: float
    actual: float
    passed: bool


def drilled(report: dict, name: str) -> float | None:
    """The first number called ``name`` in a nested report, level by level."""
    level = [report]
    while level:
        for d in level:
            value = d.get(name)
            if isinstance(value, (int, float)) and not isinstance(value, bool):
                return float(value)
        level = [v for d in level for v in d.values() if isinstance(v, dict)]
    return None


def gates_on(report: dict, gates: dict[str, float]) -> list[GateResult]:
    """Gates on a nested report, as ``check_gates``."""
    found = [(g, float(t), drilled(report, g)) for g, t in gates.items() if g in GATES]
    return [GateResult(g, t, v, v <= t if g in LOWER_IS_BETTER else v >= t) for g, t, v in found if v is not None]


def gate_policy(path_or_text: str) -> dict[str, float]:
    """Thresholds by gate of a policy in YAML; values that aren't numbers are skipped."""
    import os

    import yaml

    text = open(path_or_text, encoding="utf-8").read() if os.path.exists(path_or_text) else path_or_text
    raw = yaml.safe_load(text)
    out = {}
    for k, v in ((raw or {}).get("gates") or {}).items() if isinstance(raw, dict) else ():
        try:
            out[str(k)] = float(v)
        except (TypeError, ValueError):
            continue
    return out


def check_gates(report: DataFrame, gates: dict[str, float]) -> DataFrame:
    """(gate, threshold, actual, passed) from (metric, value); unknown gates and gates without a metric have no row."""
    spark = report.sparkSession
    known = [(g, float(t), g in LOWER_IS_BETTER) for g, t in gates.items() if g in GATES]
    table = spark.createDataFrame(known, "gate string, threshold double, lower boolean")
    both = table.join(report, table["gate"] == report["metric"])
    passed = F.when(F.col("lower"), F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return both.select("gate", "threshold", F.col("value").alias("actual"), passed.alias("passed"))


def gate_results(report: DataFrame, gates: dict[str, float]) -> list[GateResult]:
    return [GateResult(*r) for r in check_gates(report, gates).collect()]
