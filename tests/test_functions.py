from __future__ import annotations

import hashlib
import re
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from stonecrop.functions import hashing, paths, text, units

PATHS = ["/a/b.txt", "a.tar.gz", ".bashrc", "/x/.hidden/y", "b.", "..a.b", "/a//b/", "a/./b.c", "./q.w", "/", "/dir.d/file", "ä/ö.ü", "/a/b.c.d"]


def test_components_match_pathlib(spark):
    rows = paths.with_components(spark.createDataFrame([(p,) for p in PATHS], "path string")).collect()
    for r in rows:
        p = PurePosixPath(r["path"])
        assert (r["name"], r["suffix"], r["stem"], r["parent"]) == (p.name, p.suffix, p.stem, str(p.parent)), r


def test_components_keep_columns_and_nulls(spark):
    r = paths.with_components(spark.createDataFrame([(None, "mine")], "path string, name string")).first()
    assert r["name"] == "mine" and r["suffix"] is None


def test_depth_below_common_root(spark):
    df = spark.createDataFrame([("/d/a/x",), ("/d/b/c/y",)], "path string")
    assert {r["path"]: r["depth"] for r in paths.with_depth(df).collect()} == {"/d/a/x": 2, "/d/b/c/y": 3}
    assert [r["depth"] for r in paths.with_depth(df, root="/other").collect()] == [4, 5]


def test_filename_features(spark):
    df = spark.createDataFrame([("/p/a_b_c.txt",), ("/q/d.txt",)], "path string")
    rows = {r["feat1"]: r for r in paths.with_filename_features(df, include_parent=True).collect()}
    assert (rows["a"]["feat2"], rows["a"]["feat3"], rows["d"]["feat2"], rows["a"]["parent"]) == ("b", "c", "", "p")
    assert "token1" in paths.with_filename_features(df, prefix=None, max_tokens=1).columns


def test_glob_and_patterns(spark):
    df = spark.createDataFrame([("x1.TXT",), ("y.txt",)], "n string")
    hit = lambda p, **k: [r["n"] for r in df.filter(F.col("n").rlike(paths.pattern_regex(p, **k))).collect()]
    assert hit("*.txt", glob=True) == ["x1.TXT", "y.txt"]
    assert hit("*.txt", glob=True, case_sensitive=True) == ["y.txt"]
    assert hit("[0-9]") == ["x1.TXT"]
    assert paths.pattern_regex("[") is None


def plain_tokens(t):
    out = []
    for w in re.findall(r"[^\W]+", t.lower()):
        out.append(re.sub("(ed|ing|s)$", "", w) if len(w) > 4 else re.sub("s$", "", w) if len(w) == 4 else w)
    return out


def plain_shingles(t, k=3):
    w = plain_tokens(t)
    return {" ".join(w)} if len(w) < k else {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_shingles(spark):
    texts = ["", "one", "The fox jumped over dogs cats", "été über_1 aéb c d", "a b c a b c a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.shingles(F.col("t")).alias("s"))
    for r in df.collect():
        assert set(r["s"]) == plain_shingles(r["t"]) and len(r["s"]) == len(set(r["s"]))
    assert df.limit(0).collect() == []


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], [])], "a array<string>, b array<string>")
    assert [round(r[0], 3) for r in df.select(text.jaccard(F.col("a"), F.col("b"))).collect()] == [0.333, 1.0, 0.0]


def plain_chunks(t, most):
    done, now, n = [], [], 0
    for s in re.split(r"(?<=[.!?])\s+", t):
        s = s.strip()
        if not s:
            continue
        k = len(s.split())
        if now and n + k > most:
            done.append(" ".join(now))
            now, n = [s], k
        else:
            now.append(s)
            n += k
    return done + ([" ".join(now)] if now else [])


@pytest.mark.parametrize("tokens", [2, 64, 512])
def test_chunks(spark, tokens):
    t = " ".join(f"Sentence number {i} here." for i in range(60)) + " What! No? Yes"
    got = spark.createDataFrame([(t,)], "t string").select(text.chunks(F.col("t"), tokens)).first()[0]
    assert got == plain_chunks(t, int(tokens * 0.75))


def test_line_slice(spark):
    r = spark.createDataFrame([("a\nb\nc\n",)], "t string").select(text.line_slice(F.col("t"), 2, 3).alias("x"), text.line_slice(F.col("t"), 3).alias("y")).first()
    assert (r["x"], r["y"]) == ("b\nc", "c\n")


@pytest.mark.parametrize("n", [0, 10, 4096, 8192, 9000])
def test_hashes(spark, n):
    data = bytes(i % 251 for i in range(n))
    deep, full = spark.createDataFrame([(bytearray(data),)], "b binary").select(hashing.deep_hash(F.col("b")), hashing.full_hash(F.col("b"))).first()
    want = data[:4096] + data[-4096:] if n > 8192 else data[:4096]
    assert deep == hashlib.sha256(want).hexdigest()[:32] and full == hashlib.sha256(data).hexdigest()


def test_hamming_of_all_bits(spark):
    df = spark.createDataFrame([("ffffffffffffffff", "0" * 16), ("8000000000000000", "0" * 16), ("f", "e")], "a string, b string")
    assert [r[0] for r in df.select(hashing.hamming_hex(F.col("a"), F.col("b"))).collect()] == [64, 1, 1]


def test_array_hashes(spark):
    gray = [float(i) for i in range(64)]
    r = spark.createDataFrame([(gray, [float(72 - i) for i in range(72)])], "g array<double>, d array<double>").select(hashing.average_hash(F.col("g")), hashing.difference_hash(F.col("d"))).first()
    assert list(r) == ["00000000ffffffff", "f" * 16]


def test_minhash_is_stable(spark):
    a, b = spark.createDataFrame([(["x", "y"],), (["y", "x"],)], "i array<string>").select(text.minhash(F.col("i"), 8)).collect()
    assert a == b and len(a[0]) == 8


def test_units():
    assert [units.size(x) for x in ("1k", "+1.5M", "7", "2g")] == [1024, 1572864, 7, 2 * 1024**3]
    assert [units.duration(x) for x in ("90", "2h", "30min", "1 week", "2days")] == [90, 7200, 1800, 604800, 172800]
    for bad in ("", "x", "1q"):
        with pytest.raises(ValueError):
            units.size(bad)
