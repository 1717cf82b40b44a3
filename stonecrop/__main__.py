"""The command line: python -m stonecrop COMMAND ...

Exit codes: 0 fine, 1 a gate failed or something changed, 2 there is nothing to look at or the call is wrong.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stonecrop import api
from stonecrop.functions import kinds
from stonecrop.operators import dedup, integrity, quality, report, tools
from stonecrop.session import session
from stonecrop.sources import tree


def _snapshot(spark: SparkSession, path: str) -> integrity.Snapshot:
    """Of a JSON file or of a saved folder."""
    return integrity.Snapshot.load(spark, path) if os.path.isdir(path) else api.read_snapshot_json(spark, path)


def audit(spark: SparkSession, a: argparse.Namespace) -> int:
    text, code = api.audit(spark, a.path, a.gates, a.format, not a.no_hidden, a.evidence)
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)
    return code


def verify(spark: SparkSession, a: argparse.Namespace) -> int:
    if os.path.isdir(a.reference):
        rows = api.verify(spark, a.path, integrity.Snapshot.load(spark, a.reference))
    else:
        rows = api.verify_file(spark, a.path, a.reference)
    counts = {r["status"]: r["n"] for r in rows.groupBy("status").agg(F.count("*").alias("n")).collect()}
    print(json.dumps(counts, sort_keys=True))
    return int(any(n for s, n in counts.items() if s not in ("ok", "matched")))


def manifest(spark: SparkSession, a: argparse.Namespace) -> int:
    api.manifest_json(api.manifest(spark, a.path, include_hidden=not a.no_hidden), a.output)
    return 0


def snapshot(spark: SparkSession, a: argparse.Namespace) -> int:
    made = api.snapshot(spark, a.path, a.mode, pattern=a.pattern, include_hidden=not a.no_hidden)
    api.snapshot_json(made, a.output)
    return 0


def check(spark: SparkSession, a: argparse.Namespace) -> int:
    files = tree.with_content(tree.scan(spark, a.path, hidden=not a.no_hidden).filter("is_file"), kinds.is_image(F.col("path")))
    made = report.verifier(integrity.with_corruption(files, content_col="content").drop("content"))
    if a.output:
        report.export_json(made, a.output)
    print(json.dumps(made, indent=2, sort_keys=True))
    return 2 if not made["integrity"]["checked"] else int(made["integrity"]["failed"] > 0)


def duplicates(spark: SparkSession, a: argparse.Namespace) -> int:
    """Over all paths together; with ``--across`` only groups in two or more of them."""
    parts = [tree.scan(spark, os.path.abspath(p), compute_hash=True).filter("is_file") for p in a.paths]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    groups = dedup.exact_groups(rows)
    if a.across:
        groups = dedup.across_directories(groups, [os.path.abspath(p) for p in a.paths])
    for r in groups.orderBy("group_id", "path").toLocalIterator():
        print(r["group_id"][:12], r["path"])
    return 0


def watch(spark: SparkSession, a: argparse.Namespace) -> int:
    made, code = api.watch(spark, a.path, _snapshot(spark, a.reference), quality.gate_policy(a.gates) if a.gates else None, a.output)
    print(json.dumps(made["summary"]))
    return code


def tool(spark: SparkSession, a: argparse.Namespace) -> int:
    if not a.name:
        for t in sorted(tools.tools.tools.values(), key=lambda t: t.name):
            print(f"{t.name}: {t.description.splitlines()[0] if t.description else ''}")
        return 0
    given = dict(x.split("=", 1) for x in a.arguments)
    print(json.dumps(tools.call(spark, a.name, **given), default=str, indent=2))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stonecrop", description="Profile, verify and audit trees of files.")
    top.add_argument("--master", default="local[*]", help="the Spark master")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, text: str, path: bool = True) -> argparse.ArgumentParser:
        one = commands.add_parser(name, help=text)
        if path:
            one.add_argument("path")
        one.set_defaults(run=run)
        return one

    one = add("audit", audit, "the whole report of a directory")
    one.add_argument("--gates", help="a policy file or its text")
    one.add_argument("--format", choices=["json", "md", "html"], default="json")
    one.add_argument("--output")
    one.add_argument("--no-hidden", action="store_true")
    one.add_argument("--evidence", action="store_true")
    one = add("snapshot", snapshot, "a snapshot as one JSON file")
    one.add_argument("output")
    one.add_argument("--mode", choices=integrity.MODES, default="fast")
    one.add_argument("--pattern")
    one.add_argument("--no-hidden", action="store_true")
    one = add("verify", verify, "what changed since a snapshot, or against a manifest")
    one.add_argument("reference")
    one = add("manifest", manifest, "a manifest as one JSON file")
    one.add_argument("output")
    one.add_argument("--no-hidden", action="store_true")
    one = add("quality", check, "integrity and class balance")
    one.add_argument("--output")
    one.add_argument("--no-hidden", action="store_true")
    one = add("dedup", duplicates, "groups of equal files", path=False)
    one.add_argument("paths", nargs="+")
    one.add_argument("--across", action="store_true")
    one = add("watch", watch, "counts of changes since a snapshot, with gates on them")
    one.add_argument("reference")
    one.add_argument("--gates")
    one.add_argument("--output")
    one = add("tool", tool, "call a registered tool, or list them", path=False)
    one.add_argument("name", nargs="?")
    one.add_argument("arguments", nargs="*", metavar="name=value")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        given = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    made = spark or session(given.master, "stonecrop", **{"spark.ui.showConsoleProgress": "false"})
    try:
        return given.run(made, given)
    except (ValueError, KeyError, OSError, AnalysisException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    finally:
        if spark is None:
            made.stop()


if __name__ == "__main__":
    sys.exit(main())
