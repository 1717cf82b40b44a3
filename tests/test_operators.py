from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stonecrop.operators import chunk_store, dedup, embed, integrity, profile, quality, relational, similarity
from stonecrop.operators.frame import FileFrame
from stonecrop.operators.pipeline import Dataset, Pipeline
from stonecrop.operators.registry import Registry
from stonecrop.sources import images, tree
from stonecrop.streaming import drift
from tests.test_functions import plain_shingles


@pytest.fixture
def project(tmp_path):
    for p, content in {"a/one.txt": "same", "a/two.txt": "same", "b/three.bin": "\x00\x01", "b/.secret": "s", "b/deep/er/x.TXT": "x", "zero.log": ""}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(content)
    (tmp_path / "empty").mkdir()
    (tmp_path / "link").symlink_to("a")
    return tmp_path


def test_scan(spark, project):
    rows = {r["path"].removeprefix(str(project) + "/"): r for r in tree.scan(spark, str(project), compute_hash=True).collect()}
    assert set(rows) == {"a", "a/one.txt", "a/two.txt", "b", "b/three.bin", "b/.secret", "b/deep", "b/deep/er", "b/deep/er/x.TXT", "zero.log", "empty"}
    assert rows["b/deep/er/x.TXT"]["depth"] == 4 and rows["a"]["is_dir"] and rows["a/one.txt"]["sha256"] == rows["a/two.txt"]["sha256"]
    assert {r["path"].rsplit("/", 1)[1] for r in tree.scan(spark, str(project), max_depth=1, hidden=False).collect()} == {"a", "b", "empty", "zero.log", "one.txt", "two.txt", "three.bin"}


def test_profile(spark, project):
    p = Dataset(spark, str(project)).probe()
    s = p.summary.first()
    assert (s["total_files"], s["total_folders"], s["max_depth"], s["empty_folder_count"]) == (6, 6, 4, 1)
    assert {r["extension"]: r["len"] for r in p.file_extensions.collect()} == {".txt": 3, ".bin": 1, ".log": 1, "<no extension>": 1}
    assert p.to_dict()["depth_distribution"] == {0: 1, 1: 3, 2: 1, 3: 1}


def test_lean_scan_equals_the_full_one(spark, project):
    (project / "b/only").mkdir()
    (project / "b/only/.hidden").write_text("")
    (project / "linked").mkdir()
    (project / "linked/to").symlink_to(project)
    columns = ["path", "is_file", "is_dir", "depth", "size_bytes"]
    for options in ({}, {"max_depth": 1}, {"hidden": False}):
        want = {tuple(r) for r in tree.scan(spark, str(project), **options).select(*columns).collect()}
        lean = tree.scan(spark, str(project), lean=True, **options)
        assert {tuple(r) for r in lean.select(*columns).collect()} == want
        # a folder with hidden entries, links or entries beyond the depth isn't empty
        assert [r["path"] for r in profile.empty_folders(tree.with_root(lean, str(project))).collect()] == [str(project / "empty")]
    bare = project / "bare"
    bare.mkdir()
    row = profile.summary(tree.with_root(tree.scan(spark, str(bare), lean=True), str(bare))).first()
    assert (row["total_files"], row["total_folders"], row["empty_folder_count"]) == (0, 1, 1)


def test_search(spark, project):
    rows = tree.scan(spark, str(project))
    assert tree.find_by_extension(rows, "txt").count() == 3
    assert tree.find_files(rows, "^t").count() == 2
    assert tree.find_large(rows.filter("is_file"), "1").count() == 5
    assert [r["name"] for r in tree.listing(rows).collect()] == ["a", "b", "empty", "zero.log"]
    assert tree.search(rows, pattern="nothing", extension="[\"log\"]").count() == 1
    assert tree.probe_file(str(project / "link")).is_symlink


def test_frame_chain(spark, project):
    f = FileFrame([str(project / "a/one.txt"), str(project / "gone.md")], spark).enrich().add_corruption()
    rows = {r["name"]: r for r in f.df.collect()}
    assert rows["one.txt"]["size_bytes"] == 4 and rows["gone.md"]["size_bytes"] is None and rows["gone.md"]["xattrs"] == "{}"
    assert [x["operation"] for x in f.lineage] == ["enrich", "add_corruption"]
    g = f.filter("size_bytes > 0")
    assert isinstance(g, FileFrame) and len(g) == 1 and len(f.filter_by_extension(["TXT"])) == 1
    with pytest.raises(ValueError):
        FileFrame(3, spark)
    assert len(FileFrame(None, spark)) == 0


def test_save_and_load(spark, tmp_path):
    f = FileFrame([{"path": "a.txt", "size_bytes": 3}], spark)
    for kind in ("csv", "json", "parquet"):
        f.save(str(tmp_path / f"x.{kind}"))
        assert FileFrame.load(spark, str(tmp_path / f"x.{kind}")).to_dict() == {"path": ["a.txt"], "size_bytes": [3]}


def test_duplicates(spark):
    rows = [("a", "h1", "The quick brown fox jumps over the lazy dog"), ("b", "h1", "The quick brown fox jumps over the lazy dog"), ("c", "h2", "The quick brown fox jumped over the lazy dog"), ("d", None, None), ("e", None, None)]
    df = spark.createDataFrame(rows, "path string, sha256 string, text string")
    flags = {r["path"]: r["is_exact_duplicate"] for r in dedup.with_duplicate_flags(df).collect()}
    assert flags == {"a": True, "b": True, "c": False, "d": False, "e": False}
    found = dedup.find_duplicates(df, "text", text_threshold=0.4)
    assert {(r["category"], r["path"]) for r in found.collect()} == {("exact", "a"), ("exact", "b"), ("text", "a"), ("text", "b"), ("text", "c")}
    assert dedup.find_duplicates(df, "nonsense").select("category").distinct().collect()[0][0] == "exact"


def test_directory_overlap(spark):
    groups = spark.createDataFrame([(1, "x/1"), (1, "y/1"), (2, "x/2"), (2, "y/2"), (2, "z/2")], "group_id int, path string")
    rows = dedup.directory_overlap(groups, F.split("path", "/")[0], groups).collect()
    assert {(r["dir_a"], r["dir_b"]): (r["shared_files"], r["overlap_pct"]) for r in rows} == {("x", "y"): (2, 100.0), ("x", "z"): (1, 100.0), ("y", "z"): (1, 100.0)}


def greedy(n, pairs):
    near = {(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}
    lead = {}
    for i in range(n):
        if i not in lead:
            lead[i] = i
            for j in range(n):
                if j not in lead and (i, j) in near:
                    lead[j] = i
    return lead


@pytest.mark.parametrize("seed", range(4))
def test_leaders_are_greedy(spark, seed):
    r = random.Random(seed)
    n = 14
    pairs = [(a, b) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.2] or [(0, 1)]
    got = {x["node"]: x["leader"] for x in similarity.leaders(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in greedy(n, pairs).items() if any(k in p for p in pairs)}


def test_chain_is_not_a_component(spark):
    got = similarity.leaders(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).collect()
    assert {(r["node"], r["leader"]) for r in got} == {(1, 1), (2, 1), (3, 3)}


def test_near_text_is_exact(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(0, 12))] for _ in range(8)]
    docs = [" ".join(b if r.random() < 0.9 else r.choice(vocabulary) for b in r.choice(base)) for _ in range(40)]
    members, pairs = similarity.near_text(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), threshold=0.6)
    rep = {x["id"]: x["rep"] for x in members.collect()}
    sets = [plain_shingles(d) for d in docs]
    assert all(rep[i] == min(j for j in range(40) if sets[j] == sets[i]) for i in range(40))
    want = {(i, j) for i, j in itertools.combinations(sorted(set(rep.values())), 2) if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    assert {(x["a"], x["b"]) for x in pairs.collect()} == want


def test_hamming_pairs_are_exact(spark):
    r = random.Random(2)
    base = r.getrandbits(64)
    values = sorted({base ^ sum(1 << r.randrange(64) for _ in range(k)) & (2**64 - 1) for k in range(8) for _ in range(6)} | {r.getrandbits(64) for _ in range(10)})
    df = spark.createDataFrame([(i, f"{v:016x}") for i, v in enumerate(values)], "id long, hash string")
    want = {(i, j) for i, j in itertools.combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= 5}
    assert {(x["a"], x["b"]) for x in similarity.hamming_pairs(df, 5).collect()} == want


def test_nearest(spark):
    g = np.random.default_rng(1)
    v = g.normal(size=(60, 8))
    v[3] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>").repartition(3)
    u = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) == 0, 1, np.linalg.norm(v, axis=1, keepdims=True))
    s = u @ u.T
    for r in similarity.nearest(df, df.filter("id < 5"), 4).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))).alias("n")).collect():
        row = sorted((-s[r["query"], j], j) for j in range(60) if j != r["query"])[:4]
        assert [x["neighbour"] for x in r["n"]] == [j for _, j in row] or r["query"] == 3
    one = spark.createDataFrame([(1, [1.0, 0.0], "p")], "id long, embedding array<double>, path string")
    assert embed.with_neighbours(one).first()["nearest_neighbor_paths"] is None


def test_metadata_embedding(spark):
    df = spark.createDataFrame([(0, "x", 1), (10, None, 1), (None, "x", 1)], "size_bytes long, owner string, depth int")
    rows = embed.metadata_embedding(df, ["size_bytes", "depth"], categorical=["owner"], max_categories=1).collect()
    assert [list(r["metadata_embedding"]) for r in rows] == [[0, 0.5, 1, 0], [1, 0.5, 0, 1], [0, 0.5, 1, 0]]


def test_text_embedding(spark):
    df = spark.createDataFrame([("a.txt", "hello"), ("a.png", "hello"), ("b.md", "  ")], "path string, text string")
    rows = embed.text_embedding(df, path_col="path", embedder=lambda texts: [[float(len(t))] for t in texts]).collect()
    assert [r["embedding"] for r in rows] == [[5.0], None, None]


def test_text_embedding_of_whole_texts(spark, tmp_path):
    long = "word " * 2000
    length = lambda texts: [[float(len(t)), 1.0] for t in texts]
    df = spark.createDataFrame([("a.txt", long, "1")], "path string, text string, mtime string")
    got = lambda **options: embed.text_embedding(df, embedder=length, **options).first()["embedding"][0]
    assert (got(), got(max_chars=None)) == (4000.0, 10000.0)
    store = chunk_store.ChunkStore(spark, str(tmp_path / "chunks"), embedder=length)
    store.index(df)
    assert all(r["vector"][0] == len(r["text"]) for r in store.table.collect()) and max(len(r["text"]) for r in store.table.collect()) > 4000


def test_snapshot(spark, project):
    d = Dataset(spark, str(project))
    before = d.snap("full")
    before.save(str(project.parent / "snap"))
    (project / "a/one.txt").write_text("other")
    (project / "new.txt").write_text("n")
    (project / "zero.log").unlink()
    loaded = integrity.Snapshot.load(spark, str(project.parent / "snap"))
    got = {r["path"].rsplit("/", 1)[1]: r["status"] for r in Dataset(spark, str(project)).verify(loaded).collect()}
    assert (got["one.txt"], got["new.txt"], got["zero.log"], got["two.txt"]) == ("modified", "added", "missing", "matched")
    with pytest.raises(ValueError):
        loaded.verify(d.snap("fast"))


def test_manifest_order_of_tests(spark):
    m = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", 9, "x"), ("e", 1, "x")], "path string, size_bytes long, sha256 string")
    live = spark.createDataFrame([("a", False, 1, "x"), ("b", False, 2, "y"), ("c", False, 1, "y"), ("d", True, 1, "q")], "path string, is_dir boolean, size_bytes long, sha256 string")
    got = {r["path"]: r["status"] for r in integrity.verify_manifest(m, live).collect()}
    assert got == {"a": "ok", "b": "size_mismatch", "c": "hash_mismatch", "d": "ok", "e": "missing"}


def test_corruption(spark):
    """An image that is cut short is corrupt, though its first bytes are right."""
    whole, jpeg, bmp = png(np.zeros((2, 2, 3), np.uint8)), b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02data\xff\xd9", bmp24(np.zeros((2, 2, 3), np.uint8))
    broken = bytearray(whole)
    broken[30] ^= 1
    files = [("a.txt", b""), ("b.jpg", b"text"), ("c.png", whole), ("d.txt", b"text"), ("e.png", whole[:-9]), ("f.png", whole[:8]), ("g.PNG", bytes(broken)), ("h.jpeg", jpeg), ("i.jpg", jpeg[:-2]), ("j.bmp", bmp), ("k.bmp", bmp[:-1])]
    df = spark.createDataFrame([(n, len(c), bytearray(c)) for n, c in files], "path string, size_bytes long, content binary")
    got = {r["path"]: r["corruption_reason"] for r in integrity.with_corruption(df, content_col="content").collect()}
    bad = "corrupt_or_unsupported"
    assert got == {"a.txt": "zero_byte", "b.jpg": bad, "c.png": None, "d.txt": None, "e.png": bad, "f.png": bad, "g.PNG": bad, "h.jpeg": None, "i.jpg": bad, "j.bmp": None, "k.bmp": bad}


def bmp24(pixels):
    import struct

    h, w, _ = pixels.shape
    rows = b"".join(row[:, ::-1].tobytes().ljust(-(-w * 3 // 4) * 4, b"\0") for row in pixels[::-1])
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(rows), 0, 0, 54, 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def png(values, depth=8, colour=2, woven=False, kinds=(0,), palette=None):
    """A PNG of (rows, columns, channels); the rows take the filters ``kinds`` in turn."""
    import struct
    import zlib

    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w, c = values.shape
    step, raw = max(1, c * depth // 8), b""
    for x0, y0, dx, dy in images.PASSES if woven else [(0, 0, 1, 1)]:
        some = values[y0::dy, x0::dx]
        if not some.size:
            continue
        before = None
        for y, row in enumerate(some):
            if depth == 16:
                line = row.astype(">u2").tobytes()
            elif depth == 8:
                line = row.astype(np.uint8).tobytes()
            else:
                line = np.packbits((row.reshape(-1, 1) >> np.arange(depth)[::-1]) & 1).tobytes()
            before, kind = before or bytes(len(line)), kinds[y % len(kinds)]
            out = bytearray()
            for i, v in enumerate(line):
                a, b, e = line[i - step] if i >= step else 0, before[i], before[i - step] if i >= step else 0
                p = a + b - e
                paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - e), 2, e))[2]
                out.append((v - [0, a, b, (a + b) // 2, paeth][kind]) & 255)
            raw, before = raw + bytes([kind]) + bytes(out), line
    extra = part(b"PLTE", palette.tobytes()) if palette is not None else b""
    return images.PNG + part(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, int(woven))) + extra + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


@pytest.mark.parametrize("woven", [False, True])
@pytest.mark.parametrize("depth,colour,channels", [(8, 2, 3), (8, 6, 4), (8, 0, 1), (16, 2, 3), (16, 0, 1), (1, 0, 1), (2, 0, 1), (4, 0, 1)])
def test_png_of_all_kinds(depth, colour, channels, woven):
    g = np.random.default_rng(depth + colour)
    for h, w in ((9, 13), (1, 1), (3, 2)):
        values = g.integers(0, 2**depth, (h, w, channels))
        got = images.decode(png(values, depth, colour, woven, (0, 1, 2, 3, 4)))
        assert (got == (values * (255 // (2**depth - 1)) if depth < 8 else values)).all() and got.shape == values.shape


def test_other_images():
    palette = np.arange(30, dtype=np.uint8).reshape(10, 3)
    values = np.random.default_rng(0).integers(0, 10, (4, 5, 1))
    assert (images.decode(png(values, 8, 3, palette=palette)) == palette[values[:, :, 0]]).all()
    pixels = np.random.default_rng(1).integers(0, 255, (5, 7, 3), dtype=np.uint8)
    assert (images.decode(bmp24(pixels)) == pixels).all()
    for bad in (b"", b"BM", images.PNG, png(pixels)[:40], bmp24(pixels)[:70], png(pixels)[:-30]):
        with pytest.raises(ValueError):
            images.decode(bad)
    report = images.array_report(np.array([np.nan, np.inf]))
    assert (report["min"], report["max"], report["mean"], report["std"], report["nans"]) == (float("inf"), float("inf"), None, None, 1)
    assert images.array_report(np.empty((0, 3)))["min"] is None


def test_quality_rules(spark):
    assert quality.hygiene(12.0, 0, 40.0)["score"] == (30 + 100 + 70) / 3
    assert quality.hygiene(None, 2, None)["score"] == 30
    assert quality.migration_readiness(100, 0, 1)["readiness"] == 50 and quality.migration_readiness(0, 0, 0)["blockers"] == 1
    df = spark.createDataFrame([("train/cat/x.jpg",), ("valid/dog/x.jpg",), ("test/y.jpg",)], "path string").select(quality.split_of(F.col("path")).alias("split"), F.element_at(F.split("path", "/"), -1).alias("name"))
    assert [tuple(r) for r in quality.leakage(df, "split", "name").collect()] == [("train", "valid", 1)]
    one = quality.class_variation(spark.createDataFrame([("a", 5)], "label string, n long")).first()
    assert one["cv_pct"] is None and one["status"] is None


def test_gates(spark):
    report = spark.createDataFrame([("duplicate_ratio_pct", 6.0), ("hygiene_score", 80.0)], "metric string, value double")
    gates = quality.gate_policy("version: 1\ngates:\n  duplicate_ratio_pct: 5\n  hygiene_score: 70\n  corrupted_files: 0\n  bad: [1]\n")
    assert {g.name: g.passed for g in quality.gate_results(report, gates)} == {"duplicate_ratio_pct": False, "hygiene_score": True}


def test_pipeline(spark, project):
    p = Pipeline.of(spark, str(project)).scan().enrich().verify().dedup().report()
    assert p.state.duplicates.count() == 2
    assert {r["metric"]: r["value"] for r in p.state.report.collect()}["zero_byte_files"] == 1
    assert p.steps == ("scan", "enrich", "verify", "dedup", "report")


def test_chunk_store(spark, tmp_path):
    store = chunk_store.ChunkStore(spark, str(tmp_path / "chunks"))
    files = lambda rows: spark.createDataFrame(rows, "path string, text string, mtime string")
    store.index(files([("a.txt", "Cats purr.", "1"), ("b.txt", "Dogs bark.", "1"), ("c.bin", "no", "1")]))
    store.index(files([("a.txt", "Cats purr.", "1"), ("b.txt", "Birds sing.", "2")]))
    assert {(r["path"], r["text"]) for r in store.table.collect()} == {("a.txt", "Cats purr."), ("b.txt", "Birds sing.")}
    assert store.search("birds sing", 1).first()["path"] == "b.txt"


def test_as_of_and_order(spark):
    left = spark.createDataFrame([(1, 5), (1, 0), (2, 5)], "k int, t int")
    right = spark.createDataFrame([(1, 1, "a"), (1, 5, "b")], "k int, t int, v string")
    assert {tuple(r) for r in relational.as_of(left, right, "t", ["k"], ["v"]).collect()} == {(1, 5, "b"), (1, 0, None), (2, 5, None)}
    r = random.Random(0)
    many = spark.createDataFrame([(r.randrange(2), r.randrange(60), i) for i in range(80)], "k int, t int, i int")
    marks = spark.createDataFrame([(r.randrange(2), r.randrange(60), str(i)) for i in range(12)], "k int, t int, v string")
    plain, spans = (relational.as_of(many, marks, "t", ["k"], ["v"], span=s).orderBy("i").collect() for s in (None, lambda t: F.floor(t / 7)))
    assert plain == spans and len(plain) == 80
    assert [x["p50"] for x in relational.describe(many, ["i"], exact=False).collect()] == [39.0]
    assert [r["t"] for r in relational.tail(left.filter("k = 1"), 1, ["t"]).collect()] == [5]
    assert relational.info(left).collect()[0]["null_count"] == 0


def test_images(spark, tmp_path):
    import struct
    import zlib

    pixels = np.random.default_rng(0).integers(0, 255, (9, 12, 3), dtype=np.uint8)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    png = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 12, 9, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
    assert (images.decode_png(png) == pixels).all()
    df = spark.createDataFrame([("a.png", bytearray(png)), ("b.png", bytearray(b"x")), ("c.npy", bytearray(b"x"))], "path string, content binary")
    rows = {r["path"]: r for r in images.profiles(df).collect()}
    assert (rows["a.png"]["width"], rows["a.png"]["status"], len(rows["a.png"]["dhash"])) == (12, "ok", 16)
    assert rows["b.png"]["status"].startswith("error") and rows["c.npy"]["status"] == "not implemented"


def test_watch(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1.0, "h", None, None), ("b", 1, 1.0, "h2", None, None)], "path string, size long, mtime double, hash_fast string, hash_deep string, hash_full string")
    rows.withColumn("hash_fast", F.when(F.col("path") == "b", "new").otherwise(F.col("hash_fast"))).write.parquet(str(tmp_path / "in"))
    seen = []
    q = drift.watch(spark, str(tmp_path / "in"), rows, str(tmp_path / "cp"), lambda c, g, n: seen.append(({r["path"]: r["status"] for r in c.collect()}, g.first()["passed"])), gates={"modified": 0})
    q.awaitTermination(60)
    assert seen == [({"a": "matched", "b": "modified"}, False)]


def test_registry():
    r = Registry()

    @r.register
    def count(path: str) -> int:
        """Count."""
        return 1

    assert r.get("count").description == "Count."
    with pytest.raises(KeyError):
        r.get("other")


def test_space_waste_and_top(spark):
    df = spark.createDataFrame([("h", 5), ("h", 5), ("g", 1)], "sha256 string, size_bytes long")
    assert [tuple(r) for r in dedup.space_waste(df).collect()] == [("h", 2, 5)]
    entries = profile.tree_of(spark.createDataFrame([("/a/b.txt",), ("/a/c.txt",)], "path string"))
    assert [tuple(r) for r in profile.top_folders(entries).collect()] == [("/a", 2)]
