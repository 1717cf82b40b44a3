"""Joins against loops, also where one item or hash is in all rows."""

from __future__ import annotations

import pathlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stonecrop.functions import hashing
from stonecrop.functions import text as text_functions
from stonecrop.operators import dedup, similarity
from stonecrop.operators.frame import FileFrame
from stonecrop.plans.queries import QUERIES
from stonecrop.sources import files
from stonecrop.sources.files import materialize


def plain_pairs(sets, t):
    out = {}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a | b and len(a & b) / len(a | b) >= t:
                out[i, j] = len(a & b) / len(a | b)
    return out


@pytest.mark.parametrize("threshold,bucket,kind", [(0.8, 1000, "long"), (0.8, 3, "long"), (0.5, 2, "string"), (0.3, 2, "long"), (0.34, 1, "string"), (1.0, 2, "long")])
def test_set_pairs_are_complete(spark, monkeypatch, threshold, bucket, kind):
    """Whatever is in one bucket: items joined directly, by a second item, or in parts."""
    monkeypatch.setattr(similarity, "PART", 4)
    r = random.Random(bucket)
    base = [frozenset(r.sample(range(12), r.randint(1, 9))) for _ in range(60)]
    base += [frozenset([99, *r.sample(range(100, 104), r.randint(0, 3))]) for _ in range(20)]
    sets = dict(enumerate(sorted(set(base), key=sorted)))
    rows = [(i, sorted(x) if kind == "long" else [f"item {v}" for v in sorted(x)]) for i, x in sets.items()]
    df = spark.createDataFrame(rows, f"id long, items array<{kind}>")
    got = {(x["a"], x["b"]): x["similarity"] for x in similarity.set_pairs(df, threshold, bucket=bucket).collect()}
    assert got == pytest.approx(plain_pairs(sets, threshold))
    assert similarity.set_pairs(df.limit(0), threshold).count() == 0


def test_an_item_in_all_sets(spark):
    """Ten thousand sets that share one item but are not similar: what is joined stays in proportion to the rows."""
    rows = spark.range(10_000).select("id", F.array(F.lit(-1).cast("long"), *[F.xxhash64("id", F.lit(i)) for i in range(9)]).alias("items"))
    order = np.array([-1], np.int64)
    assert similarity.prefixes(rows, 0.8, order).filter("item = -1").count() == 0
    assert similarity.set_pairs(rows, 0.8).count() == 0
    few = spark.range(3_000).select("id", F.array(F.lit(7).cast("long"), F.col("id") + 100).alias("items"))
    assert similarity.set_pairs(few, 0.6).count() == 0


def test_sketches_never_tell_similar_sets_apart():
    g = np.random.default_rng(3)
    for _ in range(300):
        x = g.integers(-(2**63), 2**63 - 1, int(g.integers(1, 700)))
        y = np.unique(np.r_[x[g.random(len(x)) < g.random()], g.integers(-(2**63), 2**63 - 1, int(g.integers(0, 700)))])
        apart = similarity.sketched_apart(similarity.sketch(x), similarity.sketch(y))
        assert apart <= len(np.setxor1d(x, y)) and apart % 2 == len(np.setxor1d(x, y)) % 2
    assert similarity.sketched_apart(similarity.sketch(np.arange(5000)), similarity.sketch(np.arange(5000, 10_000))) > 2500


def test_near_text_keeps_no_sets(spark, tmp_path, monkeypatch):
    """What near texts write stays below 8 bytes a shingle, which each written copy of the sets took."""
    r = random.Random(9)
    texts = [" ".join(str(r.getrandbits(30)) for _ in range(4000)) for _ in range(40)]
    texts += [x + " more" for x in texts[:3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    written: list[str] = []
    monkeypatch.setattr(similarity, "materialize", lambda df, name: (written.append(name), materialize(df, name))[1])
    before = set(files._written)
    members, pairs = similarity.near_text(docs)
    assert {(x["a"], x["b"]) for x in pairs.collect()} == {(0, 40), (1, 41), (2, 42)} and members.count() == 43
    made = [p for path in files._written - before for p in pathlib.Path(path.removeprefix("file:")).glob("*.parquet")]
    assert written and sum(p.stat().st_size for p in made) < 8 * 4000 * 43 / 2


def test_near_text_of_repeated_ids(spark):
    rows = [(1, "a b c d"), (5, "a b c d"), (5, "e f g h i"), (7, "e f g h i"), (None, "q r s t")]
    members, pairs = similarity.near_text(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((x["id"] or 0, x["rep"] or 0) for x in members.collect()) == [(0, 0), (1, 1), (5, 1), (5, 5), (7, 5)] and pairs.count() == 0


def test_shingle_hashes_are_those_of_the_shingles(spark):
    r = random.Random(5)
    texts = [" ".join(r.choices(["Word", "words", "worded", "été", "a", "b_1", "x-y", "²", "jumping"], k=r.randint(0, 12))) for _ in range(200)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    hashes = {x["id"]: x["items"] for x in text_functions.shingle_hashes(df, "id", "text").collect()}
    words = {x["id"]: x["s"] for x in df.select("id", text_functions.shingles(F.col("text")).alias("s")).collect()}
    known = {}
    for i, items in hashes.items():
        assert len(items) == len(words[i]) == len(set(items))
    for i in range(0, 200, 7):
        for j in range(200):
            assert len(set(hashes[i]) & set(hashes[j])) == len(set(words[i]) & set(words[j]))
    assert not known


@pytest.mark.parametrize("most", [0, 3, 5, 12])
def test_hamming_pairs_are_complete(spark, most):
    r = random.Random(most)
    centre = r.getrandbits(64)
    values = sorted({centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 8))) for _ in range(100)} | {r.getrandbits(64) for _ in range(30)})
    df = spark.createDataFrame([(i, f"{v:016x}") for i, v in enumerate(values)], "id long, hash string")
    got = {(x["a"], x["b"]): x["distance"] for x in similarity.hamming_pairs(df, most).collect()}
    assert got == {(i, j): (a ^ b).bit_count() for i, a in enumerate(values) for j, b in enumerate(values) if i < j and (a ^ b).bit_count() <= most}
    assert len(hashing.covering_masks(3)) == 15


def test_hamming_join_is_not_broadcast(spark):
    """The rows of all masks are many times what Spark takes them for: at 120,000 vectors the driver had to hold 13,800,000 of them."""
    df = QUERIES["j7_hamming_pairs_of_two_hashes"](spark, "/root/testdata/sf0.001")
    assert df.count() > 100
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


@pytest.mark.parametrize("most", [0, 1, 2, 5, 7, 12, 64])
def test_joining_masks_lose_no_pair(most):
    r = random.Random(most)
    for masks in hashing.joining_masks(most):
        for _ in range(300):
            differing = sum(1 << i for i in r.sample(range(64), r.choice([most, r.randint(0, most)])))
            assert any(differing & m == 0 for m in masks)


def test_covering_masks_keep_about_as_many_bits():
    for radius, bits, least in ((4, 42, 20), (5, 64, 32), (7, 64, 28)):  # 16, 32 and 16 if vectors go round
        assert min(m.bit_count() for m in hashing.covering_masks(radius, bits)) >= least


def test_hamming_pairs_are_complete_by_each_list_of_masks(spark, monkeypatch):
    r = random.Random(5)
    centre = r.getrandbits(64)
    values = sorted({centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(40)} | {r.getrandbits(64) for _ in range(10)})
    df = spark.createDataFrame([*[(i, f"{v:016x}") for i, v in enumerate(values)], (-1, None)], "id long, hash string")
    want = sorted((i, j, (a ^ b).bit_count()) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and (a ^ b).bit_count() <= 5)
    lists = hashing.joining_masks(5)
    assert len(want) > 100 and {len(x) for x in lists} >= {6, 14, 63}
    for masks in lists:
        monkeypatch.setattr(hashing, "joining_masks", lambda *_, x=masks: [x])
        assert sorted(map(tuple, similarity.hamming_pairs(df, 5).collect())) == want
    assert similarity.hamming_pairs(df.limit(0), 5).count() == 0


def test_masks_go_by_rows_and_by_how_often_they_meet(spark):
    spread = F.xxhash64("id")
    alike = spread.bitwiseAND(F.xxhash64("id", F.lit(1))).bitwiseAND(F.xxhash64("id", F.lit(2)))  # a bit is the same in two rows at 0.78
    few, many, dense = (len(similarity._masks(spark.range(n).select(h.alias("h")), 5)) for n, h in ((100, spread), (400_000, spread), (400_000, alike)))
    assert few == 6 < many < dense


@pytest.mark.parametrize("block", [2048, 7])
def test_nearest_by_broadcast_and_grid(spark, block):
    g = np.random.default_rng(1)
    m = g.normal(size=(50, 4)).round(1)
    m[3] = 0
    m[4] = m[5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(50, None)], "id long, vector array<double>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(x["query"], x["rank"]): (x["neighbour"], round(x["similarity"], 9)) for x in similarity.nearest(df, df.filter("id % 2 = 0"), 3, block=block).collect()}
    unit = m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    s = unit @ unit.T
    for q in range(0, 50, 2):
        order = sorted((j for j in range(50) if j != q), key=lambda j: (-round(s[q, j], 9), j))[:3]
        assert [round(s[q, got[q, n + 1][0]], 6) for n in range(3)] == [round(s[q, j], 6) for j in order]
    assert len(got) == 75 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert similarity.nearest(df, df.limit(0), block=block).count() == 0


def test_overlap_of_mirrored_trees(spark):
    """A thousand files in the same three directories are three rows of the join, and count a thousand times."""
    rows = [(f"g{i}", f"{d}/{i}") for i in range(1000) for d in "xyz"] + [("lone", "x/a"), ("pair", "x/b"), ("pair", "w/b"), ("same", "x/c"), ("same", "x/d")]
    groups = spark.createDataFrame(rows, "group_id string, path string")
    got = {(r["dir_a"], r["dir_b"]): r["shared_files"] for r in dedup.directory_overlap(groups, F.split("path", "/")[0]).collect()}
    assert got == {("x", "y"): 1000, ("x", "z"): 1000, ("y", "z"): 1000, ("w", "x"): 1}


@pytest.mark.parametrize("weight", [0.0, 0.3, 1.0])
def test_neighbours_by_content_and_metadata(spark, weight):
    """Weighted where both have metadata, by content alone where one or both have none."""
    g = np.random.default_rng(4)
    rows = []
    for i in range(24):
        rows.append((f"p{i:02d}", g.normal(size=3).tolist() if i % 6 else None, g.normal(size=2).tolist() if i % 4 else None))
    rows[3] = ("p03", [0.0, 0.0, 0.0], [1.0, 0.0])
    frame = FileFrame(spark.createDataFrame(rows, "path string, embedding array<double>, meta array<double>"))
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) or 1) / (np.linalg.norm(b) or 1))
    got = {r["path"]: r for r in frame.add_semantic_similarity("embedding", 4, "meta", weight).df.collect()}
    for path, v, m in rows:
        if v is None:
            assert got[path]["nearest_neighbor_paths"] is None
            continue
        scores = sorted((-round(weight * cos(v, w) + (1 - weight) * cos(m, n) if m and n else cos(v, w), 9) for p, w, n in rows if p != path and w is not None))[:4]
        assert [-round(x, 6) for x in got[path]["nearest_neighbor_similarities"]] == pytest.approx(scores, abs=2e-6)
    with pytest.raises(ValueError):
        frame.add_semantic_similarity_cols("none")
    assert frame.shape == (24, 3) and FileFrame.from_pandas(frame.to_pandas()[["path"]], spark).lineage[-1]["operation"] == "from_pandas"
