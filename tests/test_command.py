"""The command line, the tools and the reports behind them."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stonecrop import api
from stonecrop.__main__ import main
from stonecrop.functions import paths
from stonecrop.operators import quality, relational, report, tools
from stonecrop.operators.frame import FileFrame
from stonecrop.sources import files as file_formats
from stonecrop.sources import tree
from tests.test_operators import png


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "data"
    image = png(np.zeros((2, 3, 3), np.uint8))
    for name, data in {"train/cat/a.png": image, "train/dog/b.png": image[:-5], "valid/cat/c.txt": b"one\ntwo\nthree", "valid/cat/d.txt": b"one\ntwo\nthree", "zero.log": b"", ".hidden/e.txt": b"x"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "empty").mkdir()
    return root


def test_audit_command(spark, folder, tmp_path, capsys):
    assert main(["audit", str(folder), "--gates", "gates: {corrupted_files: 0, hygiene_score: 10}", "--evidence"], spark) == 1
    made = json.loads(capsys.readouterr().out)
    assert (made["summary"]["total_files"], made["summary"]["failed_files"], made["summary"]["corrupted_files"], made["summary"]["duplicate_groups"], made["summary"]["largest_duplicate_group_size"]) == (6, 2, 1, 1, 2)
    assert made["profile"]["split_counts"] == {"train": 2, "valid": 2} and made["profile"]["extension_share_pct"][".txt"] == 50.0
    assert made["reconciliation"]["status"] == "ok" and [x["severity"] for x in made["findings"]] == ["critical", "high"]
    assert {g["name"]: g["passed"] for g in made["gates"]} == {"corrupted_files": False, "hygiene_score": True}
    assert [p.rsplit("/", 1)[1] for p in made["evidence"]["damaged"]] == ["b.png", "zero.log"]
    for kind, mark in (("md", "| .txt | 3 | 50 |"), ("html", "<td>.txt</td>")):
        assert main(["audit", str(folder), "--format", kind, "--output", str(tmp_path / kind)], spark) == 0
        assert mark in (tmp_path / kind).read_text()
    (tmp_path / "bare").mkdir()
    assert main(["audit", str(tmp_path / "bare")], spark) == 2
    assert main(["audit", str(tmp_path / "none")], spark) == 2 and main(["nonsense"], spark) == 2


def test_snapshot_and_watch_commands(spark, folder, tmp_path, capsys):
    shot, out = str(tmp_path / "shot.json"), str(tmp_path / "changes.json")
    assert main(["snapshot", str(folder), shot, "--mode", "full"], spark) == 0
    assert main(["verify", str(folder), shot], spark) == 0 and json.loads(capsys.readouterr().out) == {"matched": 6}
    (folder / "zero.log").write_text("now")
    (folder / "new.txt").write_text("new")
    (folder / ".hidden/e.txt").unlink()
    assert main(["verify", str(folder), shot], spark) == 1
    capsys.readouterr()
    assert main(["watch", str(folder), shot, "--gates", "gates: {modified: 1, missing: 0}", "--output", out], spark) == 1
    assert json.loads(capsys.readouterr().out) == {"modified": 1, "missing": 1, "added": 1}
    made = json.load(open(out))
    assert made["gates"] == {"modified": True, "missing": False} and [p.rsplit("/", 1)[1] for p in made["changes"]["added"]] == ["new.txt"]
    assert main(["watch", str(folder), shot], spark) == 0


def test_manifest_command(spark, folder, tmp_path, capsys):
    out = str(tmp_path / "manifest.json")
    assert main(["manifest", str(folder), out], spark) == 0
    files, head = api.read_manifest_json(spark, out)
    assert files.count() == 6 and head["lineage"] == [] and head["summary"]["total_files"] == 6
    assert main(["verify", str(folder), out], spark) == 0 and json.loads(capsys.readouterr().out) == {"ok": 6}
    (folder / "valid/cat/c.txt").write_text("one\ntwo\nthred")
    (folder / "zero.log").unlink()
    assert main(["verify", str(folder), out], spark) == 1 and json.loads(capsys.readouterr().out) == {"ok": 4, "hash_mismatch": 1, "missing": 1}


def test_groups_stay_frames(spark):
    frame = FileFrame(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, n long"))
    out = frame.groupBy("k").agg(F.sum("n").alias("n"))
    assert isinstance(out, FileFrame) and {tuple(r) for r in out.df.collect()} == {("a", 3), ("b", 3)} and out.lineage[-1]["operation"] == "groupBy.agg"
    assert isinstance(frame.groupBy("k").pivot("n", [1, 2]).count(), FileFrame) and frame.estimated_bytes() > 0


def test_quality_and_dedup_commands(spark, folder, tmp_path, capsys):
    out = str(tmp_path / "report.json")
    assert main(["quality", str(folder), "--output", out, "--no-hidden"], spark) == 1
    made = json.load(open(out))
    assert made["integrity"] == {"checked": 5, "failed": 2} and made["class_balance"]["counts"] == {"cat": 3, "data": 1, "dog": 1}
    capsys.readouterr()
    assert main(["dedup", str(folder / "valid"), str(folder / "train")], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 2
    assert main(["dedup", str(folder / "valid"), str(folder / "train"), "--across"], spark) == 0
    assert capsys.readouterr().out == ""


def test_tools(spark, folder, tmp_path, capsys):
    run = lambda name, **given: tools.call(spark, name, path=str(folder), **given)
    assert run("count_files") == {"files": 6, "directories": 7, "total": 13}
    assert run("probe_directory")["empty_folders"] == [str(folder / "empty")]
    assert tools.call(spark, "get_file_info", path=str(folder / "zero.log"))["size"] == 0
    assert tools.call(spark, "read_file", path=str(folder / "valid/cat/c.txt"), start_line="2", end_line="3") == "two\nthree"
    assert [r["name"] for r in run("list_directory")] == [".hidden", "empty", "train", "valid", "zero.log"]
    assert run("get_directory_tree")[:4] == [".hidden/", "  e.txt", "empty/", "train/"]
    assert run("search_files", extension="log") == [str(folder / "zero.log")] and len(run("search_files", pattern="^[a-d]", n="3")) == 3
    assert len(run("find_recent_files", within="1d", extension="txt")) == 3 and run("find_empty_directories") == [str(folder / "empty")]
    assert run("sort_by_size", ascending="true", top_n="1")[0]["path"].endswith("zero.log")
    assert run("summarize")["rows"] == 6 and run("find_duplicates")["duplicate_file_count"] == 2
    assert run("duplicate_directories") == []
    assert run("audit_corrupted_files")["reasons"] == {"zero_byte": 1, "corrupt_or_unsupported": 1}
    assert run("generate_hygiene_report")["metrics"]["duplicate_files"] == (1.0, "fail") and run("assess_migration_readiness")["blockers"] == 1
    assert run("audit_dataset", gates="gates: {zero_byte_files: 0}")["passed"] is False
    saved = str(tmp_path / "files.parquet")
    assert run("export_table", output=saved) == saved
    assert len(tools.call(spark, "dataframe_head", path=saved, n="2")) == 2 and tools.call(spark, "column_profile", path=saved, column="size_bytes")["n"] == 6
    assert {r["column"] for r in tools.call(spark, "describe_table", path=saved)} >= {"size_bytes", "depth"}
    with pytest.raises(ValueError):
        run("count_files", colour="red")
    with pytest.raises(KeyError):
        run("no_such_tool")
    assert main(["tool"], spark) == 0 and "count_files: " in capsys.readouterr().out
    assert main(["tool", "count_files", f"path={folder}"], spark) == 0 and '"files": 6' in capsys.readouterr().out


def test_functions_for_sql(spark):
    tools.register_functions(spark)
    assert spark.sql("select stonecrop_chunks('One here. Two here.') x").first()[0] == ["One here. Two here."]
    assert [tuple(r) for r in spark.sql("select * from stonecrop_sentences('One here.  Two! ')").collect()] == [(0, "One here."), (1, "Two!")]


def test_verifier_report(spark):
    rows = [("train/a/x.png", False, 10, 10, "h1", "train", "x"), ("valid/b/x.png", False, 10, 10, "h1", "valid", "x"), ("valid/b/y.png", True, 5, 5, None, "valid", "y")]
    files = spark.createDataFrame(rows, "path string, is_corrupt boolean, w int, h int, dhash string, split string, name string")
    made = report.verifier(files, width_col="w", height_col="h", hash_col="dhash", split_col="split", name_col="name")
    assert made["integrity"] == {"checked": 3, "failed": 1} and made["dimensions"]["outliers"] == 1 and made["duplicates"] == {"duplicate_count": 1, "duplicate_file_count": 2}
    assert made["class_balance"]["counts"] == {"b": 2, "a": 1} and made["leakage"] == [{"split_a": "train", "split_b": "valid", "n_shared": 1}]
    table = spark.createDataFrame([("x.png", "cat"), ("y.png", "cat")], "filename string, class string")
    assert [r["label"] for r in quality.labels_of(files, table).collect()] == ["cat", "cat"] and quality.labels_of(files, table.limit(0)).count() == 3
    assert quality.labels_of(files, table.limit(0), "csv").count() == 0 and quality.labels_of(files, table, "folder").count() == 3


def test_full_report_of_images(spark):
    files = spark.createDataFrame([(f"train/{i % 2}/{i}.png", 5, f"h{i}", False, None, 10, 10 + (i == 9), str(i % 2)) for i in range(10)], "path string, size_bytes long, sha256 string, is_corrupt boolean, corruption_reason string, w int, h int, label string")
    made = report.full(files, {"duplicate_ratio_pct": 1, "class_min_samples": 6}, "label", "w", "h")
    assert made["hygiene"]["metrics"]["dimension_consistency"] == {"value": 90.0, "status": "warn"} and made["hygiene"]["score"] == 90.0
    assert made["findings"][0]["severity"] == "low" and made["passed"] is False and made["limits"] == [] and report.exit_code(made) == 1
    assert quality.drilled({"a": {"b": {"x": 3}}, "c": {"x": 2}}, "x") == 2.0 and quality.drilled({"a": True}, "a") is None


def test_match_regex(spark):
    import pathlib

    paths_ = ["a/b/c.txt", "c.txt", "b/c.txt", "a/b/c.txtx", "a/bb/c.txt", "/a/b/c.txt", "b/[c].txt", "b/é.txt", "b/x/c.txt"]
    for pattern in ("*.txt", "b/*.txt", "b/?.txt", "a/*/c.txt", "b/[!c].txt", "b/[a-d].txt", "/a/b/c.txt", "b/[[]c].txt", "*/b/*", "b*/c.*", "c.txt", "b/[c.txt"):
        df = spark.createDataFrame([(p,) for p in paths_], "p string").filter(F.col("p").rlike(paths.match_regex(pattern)))
        assert {r["p"] for r in df.collect()} == {p for p in paths_ if pathlib.PurePosixPath(p).match(pattern)}, pattern


def test_file_systems_and_patience(tmp_path, monkeypatch):
    mounts = tmp_path / "mounts"
    mounts.write_text("/dev/sda / ext4 rw 0 0\nhost:/x /mnt/share nfs4 rw 0 0\nhost:/y /mnt/with\\040space cifs rw 0 0\n")
    kind = lambda p: tree.file_system(p, str(mounts))
    assert (kind("/home"), kind("/mnt/share/a"), kind("/mnt/shared"), kind("/mnt/with space/b")) == ("ext4", "nfs4", "ext4", "cifs")
    assert tree.file_system("/", str(tmp_path / "none")) is None and not tree.on_network(str(tmp_path))
    import time

    monkeypatch.setattr(tree, "_patience", 0.05)
    calls = []
    assert tree.attempted(lambda: (calls.append(1), time.sleep(0.3))) is None and len(calls) == tree.RETRIES
    assert tree.attempted(lambda: 7) == 7


def test_scan_with_a_bound_on_calls(spark, folder):
    assert tree.scan(spark, str(folder), timeout=5).count() == 13 and tree.scan(spark, str(folder), lean=True, timeout=5).count() == 13
    lines = [r["name"] for r in tree.whole_listing(tree.scan(spark, str(folder), with_stats=False)).collect()]
    assert lines == [".hidden", "e.txt", "empty", "train", "cat", "a.png", "dog", "b.png", "valid", "cat", "c.txt", "d.txt", "zero.log"]


def test_frame_rows(spark, tmp_path):
    frame = FileFrame(spark.createDataFrame([(i * 7 % 50, "x") for i in range(50)], "k long, v string").repartition(5))
    assert sorted((r["k"], r["index"]) for r in frame.with_row_index("k").df.collect()) == [(i, i) for i in range(50)]
    assert sorted((r["k"], r["at"]) for r in frame.with_row_index("k", "at", 5).df.collect())[0] == (0, 5)
    given = frame.with_value("given", [str(i) for i in range(50)], order="k")
    assert all(str(r["k"]) == r["given"] for r in given.df.collect())
    with pytest.raises(ValueError):
        frame.with_value("given", [1], order="k")
    with pytest.raises(TypeError):
        frame.with_value("given", [1])
    assert sorted(frame.iter_rows()) == sorted((r["k"], r["v"]) for r in frame.to_dicts()) and frame.to_arrow().num_rows == 50
    assert next(iter(frame.iter_rows(named=True)))["v"] == "x"
    path = str(tmp_path / "rows.json")
    frame.head(3, ["k"]).save_array(path)
    assert json.load(open(path)) == [{"k": i, "v": "x"} for i in range(3)]
    file_formats.save_array(frame.df.limit(0), path)
    assert json.load(open(path)) == []


def test_relations(spark):
    left = spark.createDataFrame([(i, float(i)) for i in range(20)], "id int, x double")
    right = spark.createDataFrame([("a", 2.0, 5.0), ("b", 4.5, 30.0), ("c", 5.0, 5.0), ("d", -3.0, 0.5)], "name string, low double, high double")
    got = {(r["id"], r["name"]) for r in relational.within(left, right, "x", "low", "high", 3.0).collect()}
    assert got == {(i, n) for i in range(20) for n, low, high in (("a", 2, 5), ("b", 4.5, 30), ("c", 5, 5), ("d", -3, 0.5)) if low <= i < high}
    wide = relational.transpose(right.limit(2), "name")
    assert {r["column"]: (r["a"], r["b"]) for r in wide.collect()} == {"low": ("2.0", "4.5"), "high": ("5.0", "30.0")}
    assert relational.unnest(left.select("id", F.struct("x", F.lit(1).alias("y")).alias("s")), "s").columns == ["id", "x", "y"]


def test_read_lines_limits(spark, folder):
    rows = spark.createDataFrame([(str(folder / "valid/cat/c.txt"),), (str(folder / "train/cat/a.png"),), ("/none",), (None,)], "path string")
    got = [r["lines"] for r in api.read_lines(rows, 1, 1).collect()]
    assert got == ["one", None, None, None] and api.read_lines(rows, limit=3).first()["lines"] is None and api.read_lines(rows, max_chars=2).first()["lines"] == "on"


def test_scratch_tables_go(spark):
    import os

    with file_formats.scratch(spark) as keep:
        inner = file_formats.materialize(spark.range(3), "inner")
        out = keep(inner.withColumn("x", F.lit(1)), "kept")
        at = inner.inputFiles()[0].removeprefix("file://")
    assert out.count() == 3 and not os.path.exists(at)
    file_formats.clean(spark)
    assert not os.path.exists(out.inputFiles()[0].removeprefix("file://"))
