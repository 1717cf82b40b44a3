"""Audit reports as JSON, Markdown or HTML text."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonecrop.operators import dedup, quality
from stonecrop.sources.files import materialize


def as_dict(report: DataFrame, gates: list[quality.GateResult] = ()) -> dict:
    """A report (metric, value), of a few rows, and the results of gates."""
    summary = {r["metric"]: r["value"] for r in report.collect()}
    return {"summary": summary, "gates": [vars(g) for g in gates], "passed": all(g.passed for g in gates)}


def full(files: DataFrame, policy: dict[str, float] | None = None, label_col: str | None = None, width_col: str | None = None, height_col: str | None = None, show_evidence: bool = False, examples: int = 5) -> dict:
    """The consolidated report of a table of files with is_corrupt and corruption_reason: summary, profile, hygiene, readiness, reconciliation, findings, limits.

    All of it is of bounded size: counts, at most 20 extensions, ``examples`` paths. The table is written first, so files are
    read and hashed once, not once a number.
    """
    files = materialize(files, "audit-files")
    summary = {r["metric"]: r["value"] for r in quality.audit(files, label_col=label_col).collect()}
    damage = files.agg(F.count("*").alias("checked"), F.count(F.when(F.col("is_corrupt"), 1)).alias("failed"), F.count(F.when(F.col("corruption_reason") == "corrupt_or_unsupported", 1)).alias("corrupted")).first()
    groups = dedup.space_waste(files).agg(F.max("n_files")).first()[0] or 0
    summary |= {"total_files_checked": damage["checked"], "failed_files": damage["failed"], "corrupted_files": damage["corrupted"], "largest_duplicate_group_size": groups}
    outliers = quality.dimension_outliers(files, F.col(width_col), F.col(height_col)).first() if width_col and height_col else None
    cv = quality.class_variation(quality.class_balance(files, label_col)).first()["cv_pct"] if label_col else None
    hygiene = quality.hygiene(outliers["outlier_pct"] if outliers else None, int(summary["duplicate_groups"]), cv)
    ready = quality.migration_readiness(int(summary["total_files"]), damage["failed"], int(summary["n_extensions"]))
    summary |= {"hygiene_score": hygiene["score"], "migration_readiness": ready["readiness"], "migration_blockers": ready["blockers"]}
    shares = {r["extension"]: r for r in quality.extension_shares(files).orderBy(F.desc("n"), "extension").limit(20).collect()}
    splits = {r["split"]: r["n"] for r in quality.split_counts(files.withColumn("__split", quality.split_of(F.col("path"))), "__split").collect()}
    counted = quality.reconciliation(files, files, files).first().asDict()
    summary["unreconciled"] = float(counted["status"] == "warn")
    report = {
        "summary": {k: float(v) for k, v in summary.items()},
        "profile": {"extension_counts": {k: r["n"] for k, r in shares.items()}, "extension_share_pct": {k: r["share_pct"] for k, r in shares.items()}, "split_counts": splits},
        "hygiene": {"score": hygiene["score"], "metrics": {k: {"value": v, "status": s} for k, (v, s) in hygiene["metrics"].items()}},
        "readiness": ready,
        "reconciliation": counted,
        "findings": quality.findings(summary),
        "limits": [text for text, missing in (("no train, valid or test folders", not splits), ("no labels", label_col is None), ("no image sizes", outliers is None)) if missing],
    }
    if show_evidence:
        report["evidence"] = {"damaged": [r["path"] for r in files.filter("is_corrupt").orderBy("path").limit(examples).collect()], "duplicates": [r["path"] for r in dedup.exact_groups(files).orderBy("group_id", "path").limit(examples).collect()]}
    gates = quality.gates_on(report, policy) if policy else []
    return report | {"gates": [vars(g) for g in gates], "passed": all(g.passed for g in gates)}


def verifier(files: DataFrame, labels: DataFrame | None = None, width_col: str | None = None, height_col: str | None = None, hash_col: str | None = None, split_col: str | None = None, name_col: str | None = None) -> dict:
    """The checks of a dataset one by one: integrity, dimensions, duplicates, class balance and leakage, those that the columns allow. The table is written first."""
    files = materialize(files, "verified-files")
    made: dict = {"integrity": {"checked": files.count(), "failed": files.filter("is_corrupt").count()}}
    if width_col and height_col:
        found = quality.dimension_outliers(files, F.col(width_col), F.col(height_col)).first()
        made["dimensions"] = found.asDict() if found["total"] else {"status": "no images"}
    if hash_col:
        made["duplicates"] = quality.equal_hashes(files, hash_col).first().asDict()
    balance = quality.class_balance(quality.labels_of(files, labels), "label")
    made["class_balance"] = {"counts": {r["label"]: r["n"] for r in balance.orderBy(F.desc("n"), "label").limit(1000).collect()}, **quality.class_variation(balance).first().asDict()}
    if split_col and name_col:
        made["leakage"] = [r.asDict() for r in quality.leakage(files, split_col, name_col).orderBy("split_a", "split_b").collect()]
    return made


def export_json(report: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, sort_keys=True)


def rendered(report: dict, format: str = "json") -> str:
    if format == "json":
        return json.dumps(report, indent=2, sort_keys=True)
    rows = [(k, f"{v:g}") for k, v in sorted(report["summary"].items())]
    gates = [(g["name"], f"{g['actual']:g}", f"{g['threshold']:g}", "pass" if g["passed"] else "fail") for g in report["gates"]]
    shares = [(k, f"{report['profile']['extension_counts'][k]}", f"{v:g}") for k, v in report["profile"]["extension_share_pct"].items()] if "profile" in report else []
    found = [(x["severity"], x["action"], str(x["count"])) for x in report.get("findings", [])]
    if format == "md":
        lines = ["# Audit", "", "| metric | value |", "| --- | --- |", *[f"| {a} | {b} |" for a, b in rows]]
        if shares:
            lines += ["", "| extension | files | % |", "| --- | --- | --- |", *["| " + " | ".join(x) + " |" for x in shares]]
        if found:
            lines += ["", "| severity | to do | count |", "| --- | --- | --- |", *["| " + " | ".join(x) + " |" for x in found]]
        if gates:
            lines += ["", "| gate | actual | threshold | result |", "| --- | --- | --- | --- |", *["| " + " | ".join(g) + " |" for g in gates]]
        return "\n".join(lines) + "\n"
    if format == "html":
        cell = lambda x: f"<td>{html.escape(x)}</td>"
        table = lambda r: "<table>" + "".join(f"<tr>{''.join(map(cell, x))}</tr>" for x in r) + "</table>"
        return f"<!DOCTYPE html><title>Audit</title><h1>Audit</h1>{''.join(table(x) for x in (rows, shares, found, gates) if x)}"
    raise ValueError(f"unknown format: {format}")


def exit_code(report: dict) -> int:
    """0 if all gates passed, 1 if not, 2 without any files."""
    if not report["summary"].get("total_files"):
        return 2
    return 0 if report["passed"] else 1
