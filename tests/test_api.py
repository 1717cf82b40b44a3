from __future__ import annotations

import json

import numpy as np
import pytest

from stonecrop import api
from stonecrop.operators import report


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "data"
    root.mkdir()
    for name, text in {"a.txt": "x", "b.txt": "x", "c.md": "y"}.items():
        (root / name).write_text(text)
    return root


def test_probe(spark, folder):
    assert api.probe(spark, str(folder / "a.txt")).size == 1
    assert api.probe(spark, str(folder)).summary.first()["total_files"] == 3
    assert set(api.probe_to_frame(spark, str(folder)).df.columns) >= {"path", "parent", "name", "stem", "suffix", "size_bytes", "depth"}
    assert api.probe_to_frame(spark, str(folder), enrich=False).columns == ["path"]
    assert api.sample_paths(spark, str(folder), 2) == [str(folder / "a.txt"), str(folder / "b.txt")]


def test_probe_image(tmp_path):
    assert api.probe_image(np.array([1.0, np.nan, np.inf]))["nans"] == 1
    assert api.probe_image("x.tif")["status"] == "not implemented" and api.probe_image(b"no")["status"].startswith("error")


def test_snapshot_json(spark, folder, tmp_path):
    made = api.snapshot(spark, str(folder), "full")
    api.snapshot_json(made, str(tmp_path / "s.json"))
    assert json.load(open(tmp_path / "s.json"))["version"] == "1.0"
    (folder / "c.md").write_text("z")
    got = api.verify(spark, str(folder), api.read_snapshot_json(spark, str(tmp_path / "s.json"))).collect()
    assert {r["path"].rsplit("/", 1)[1]: r["status"] for r in got} == {"a.txt": "matched", "b.txt": "matched", "c.md": "modified"}


def test_manifest(spark, folder):
    rows = spark.createDataFrame([(str(folder / "a.txt"), 9, None), (str(folder / "q"), 1, None)], "path string, size_bytes long, sha256 string")
    assert {r["status"] for r in api.verify(spark, str(folder), rows).collect()} == {"size_mismatch", "missing"}


def test_audit(spark, folder):
    text, code = api.audit(spark, str(folder), "gates: {duplicate_ratio_pct: 10}")
    made = json.loads(text)
    assert code == 1 and made["summary"]["duplicate_files"] == 2
    assert "| duplicate_files | 2 |" in report.rendered(made, "md") and "<td>duplicate_files</td>" in report.rendered(made, "html")
    with pytest.raises(ValueError):
        report.rendered(made, "pdf")
