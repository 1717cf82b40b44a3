"""Whole operators against plain restatements, on small tables; and their settings, samples and odd tables."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import regex
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import corpus_pipeline
from stonecrop.llm import common, compression, decision_list, decontaminate, fixity, licenses, packing, pii, simhash, toxicity, url_lists
from tests.llm.test_kernels import plain_align, plain_ftrl
from tests.llm.test_operators import DATA, ODD, SCHEMA, clashing, plain_spans, table


def plain_added(texts):
    """The bootstrapping of the module's docstring, by loops."""
    word, candidate = regex.compile(r"[\p{L}\p{N}=:#]+"), regex.compile(pii.CANDIDATE)
    found = []
    for i, text in enumerate(texts):
        base = [tuple(map(int, x.split(":")[1:])) for x in plain_spans(text).split(",") if x]
        for m in candidate.finditer(text):
            before, after = word.findall(text[: m.start()].lower()), word.findall(text[m.end() :].lower())
            pats = [f"1 {x}" for x in before[-1:]] + [f"2 {' '.join(before[-2:])}" for _ in before[1:2]] + [f"3 {x} _ {y}" for x in before[-1:] for y in after[:1]]
            found.append((i, m.start(), m.end(), m[0], pats, any(a < m.end() and b > m.start() for a, b in base), not regex.search("[0-9]", m[0])))
    edges = {(p, x[3]) for x in found if not x[6] for p in x[4]}
    known = {x[3] for x in found if x[5] and not x[6] and x[4]}
    while True:
        of = {}
        for p, inst in edges:
            of.setdefault(p, set()).add(inst)
        trusted = {p for p, insts in of.items() if len(insts & known) >= 3 and len(insts & known) >= 0.8 * len(insts)}
        fresh = {inst for p, inst in edges if p in trusted} - known
        if not fresh:
            break
        known |= fresh
    return [(i, a, b) for i, a, b, inst, pats, seed, weak in found if not seed and (sum(p in trusted for p in pats) >= 2 if weak else inst in known or any(p in trusted for p in pats))]


@pytest.mark.parametrize("seed", range(3))
def test_pii_bootstrapping(spark, seed, monkeypatch):
    """By broadcast and by salted joins."""
    monkeypatch.setattr(pii, "BROADCAST", 0 if seed else pii.BROADCAST)
    r = random.Random(seed)
    ids = [f"{a}{n}" for a in ("AB-", "x", "id_", "9") for n in range(1000, 1012)] + [f"SomeLongToken{chr(65 + i)}abcDef" for i in range(4)]
    people = [f"p{i}@mail.example" for i in range(12)] + ["+49 (30) 1234567", "10.0.0.1"]
    lead = ["write to", "call", "name", "the number", "see page", "mail: address", ""]
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(r.randint(0, 5)):
            start = r.choice(lead)
            parts += [start, r.choice(people if start in ("write to", "mail: address") and r.random() < 0.85 else ids), r.choice(["now", "and", ", then", "\n"])]
        texts.append(" ".join(parts))
    rows = {x["doc_id"]: x["added"] for x in pii.find(table(spark, list(enumerate(texts)))).collect()}
    got = sorted((i, x["s"], x["e"]) for i, found in rows.items() for x in found)
    assert got == sorted(plain_added(texts)) and got


def test_pii_of_many_spans(spark):
    """Forty thousand addresses of one text, with code points of several bytes between them."""
    text = "\U0001f600é ".join(f"jo{i}@mail.example" for i in range(40_000))
    df = table(spark, [(1, text), (2, "é 1.2.3.4"), (3, None)])
    got = {r["doc_id"]: r["n"] for r in pii.find(df).select("doc_id", F.size("base").alias("n")).collect()}
    assert got == {1: 40_000, 2: 1, 3: 0}
    red = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert red == {1: "\U0001f600é ".join(["[EMAIL]"] * 40_000), 2: "é [IP]", 3: None}


def test_redaction_of_overlapping_spans(spark):
    text = "aé😀bcdefghij"
    spans = [(1, 0, 4), (3, 1, 5), (5, 2, 6), (8, 3, 9), (8, 4, 10)]
    of = lambda n: len(text[:n].encode())
    df = spark.createDataFrame([(text, [(s, k, e, of(s), of(e)) for s, k, e in spans]), ("none", [])], f"t string, spans {pii.SPAN}")
    got = [r[0] for r in df.select(pii.redacted(F.col("t"), F.col("spans"))).collect()]
    assert got == ["a[EMAIL][CARD]" + text[6:8] + "[PHONE]" + text[10:], "none"]


def test_contaminated_is_whole_alignment(spark):
    """All pairs that reach the threshold when whole texts are aligned, with their scores, and no others; copies edited at several rates."""
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(120)]
    items = [r.choices(vocabulary, k=n) for n in (4, 8, 15, 24, 33)]
    docs = []
    for _ in range(50):
        body = []
        for w in r.choice(items):
            draw = r.random()
            rate = r.choice([0, 0.1, 0.25, 0.4])
            body += [] if draw < rate / 3 else ["y", w] if draw < 2 * rate / 3 else ["z"] if draw < rate else [w]
        docs.append(" ".join(r.choices(vocabulary, k=r.randint(0, 30)) + body + r.choices(vocabulary, k=r.randint(0, 30))))
    rows = decontaminate.contaminated(table(spark, list(enumerate(docs))), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")).collect()
    want = {}
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            score = plain_align(text.split(), item) / (2 * len(item))
            if score >= 0.6:
                want[d, i] = score
    assert {(x["doc_id"], x["item_id"]): x["score"] for x in rows} == pytest.approx(want) and len(rows) == len(want) > 20


def test_toxicity_is_plain_ftrl(spark):
    """Fit and score of small tables: the plain update over the plain features."""
    r = random.Random(1)
    texts = [" ".join(r.choices(["kind", "words", "here", "there", "tree"], k=8) + ["nasty"] * (i % 3 == 0)) for i in range(90)] + ["", "kind"]
    docs = table(spark, list(enumerate(texts)))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    order = sorted(range(90), key=lambda i: (__import__("zlib").crc32(str(i).encode()), i))
    weights, bias = plain_ftrl([(toxicity.hashed(texts[i]).tolist(), int(i % 3 == 0)) for i in order])
    want = {i: 1 / (1 + np.exp(-(bias + sum(weights.get(f, 0.0) for f in toxicity.hashed(t).tolist())))) for i, t in enumerate(texts)}
    assert got == pytest.approx(want, abs=1e-5) and got[0] > 0.5 > got[1]


def test_toxicity_sample_is_bounded_by_features(spark):
    docs = table(spark, [(i, f"word{chr(97 + i % 26)} nice" + " bad" * (i % 2)) for i in range(40)])
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert toxicity.fit(docs, labels, features=100) is not None and toxicity.fit(docs, labels, features=3) is None


def test_compression_is_plain(spark):
    """Scores against single differences; the dictionaries hold the least blocks by hash, no more than asked for."""
    r = random.Random(3)
    texts = [" ".join(r.choices(["alpha", "beta", "gamma"] if i % 2 else ["x**", "y$$", "z##"], k=r.randint(1, 120))) for i in range(120)] + [""]
    docs = table(spark, list(enumerate(texts)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    model = compression.fit(docs, labels)
    differ = compression.Differ(model.good, model.bad)
    for x in compression.score(docs, model).collect():
        raw = texts[x["doc_id"]].encode()
        d, log = differ(raw), np.log2(1 + len(raw))
        margin = np.dot(model.weights, [d, d * log, log, 1])
        assert x["difference"] == pytest.approx(d) and x["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(margin, -35, 35))))
    few = compression.fit(docs, labels, blocks=3)
    assert len(few.good) <= 3 * compression.BLOCK and len(few.bad) <= 3 * compression.BLOCK
    whole = compression.cut(docs.select("doc_id", "text")).groupBy("doc_id").agg(F.sum(F.octet_length("block")).alias("n"), F.max(F.octet_length("block")).alias("most")).collect()
    assert {x["doc_id"]: x["n"] for x in whole} == {i: len(t.encode()) for i, t in enumerate(texts) if t} and max(x["most"] for x in whole) <= compression.BLOCK


def test_a_row_an_id_teaches(spark):
    docs = table(spark, [(7, f"text {i % 50}") for i in range(5000)] + [(8, "other"), (9, None), (None, "x")])
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 1), (9, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    rows = common.labelled_sample(docs, labels, "toxic", 10).collect()
    assert sorted((x["doc_id"], x["label"]) for x in rows) == [(7, 0), (8, 1)]
    assert rows == common.labelled_sample(docs.repartition(7), labels, "toxic", 10).collect() or {x["text"] for x in rows} == {x["text"] for x in common.labelled_sample(docs.repartition(7), labels, "toxic", 10).collect()}


def test_fixity_of_odd_records(spark):
    schema = "archive long, offset long, record_id long, digest binary, h string"
    d = lambda x: bytearray(hashlib.sha256(x.encode()).digest())
    a = [(0, 0, 1, d("a"), "q"), (0, 0, 1, d("b"), "q"), (0, 9, 2, d("c"), "q"), (0, 9, 2, d("c"), "q"), (None, 1, 3, d("x"), "q"), (0, None, 3, d("x"), "q"), (0, 20, 4, None, "q"), (3, 2**36 - 1, 5, d("e"), "q"), (2**27 - 1, 0, 6, d("f"), "q")]
    b = [(0, 0, 1, d("b"), "r"), (0, 0, 1, d("a"), "r"), (0, 9, 2, d("c"), "r"), (0, 20, 4, d(""), "r"), (3, 2**36 - 1, 5, d("e"), "r"), (4, 0, 7, d("g"), "r")]
    rows = fixity.audit(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()
    assert sorted((x["archive"], x["offset"], x["record_id"], x["status"]) for x in rows) == [(0, 9, 2, "altered"), (0, 20, 4, "altered"), (4, 0, 7, "extra"), (2**27 - 1, 0, 6, "missing")]
    for bad in ((0, 2**36), (0, -1), (2**27, 0), (-1, 0)):
        with pytest.raises(PySparkException, match="no address"):
            fixity.audit(spark.createDataFrame([(*bad, 1, d("x"), "q")], schema), spark.createDataFrame(b, schema)).collect()


def test_fixity_of_one_hot_offset(spark):
    """All records at one offset: their multiset is compared."""
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("archive"), F.lit(5).cast("long").alias("offset"), F.col("id").alias("record_id"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    assert fixity.audit(rows, rows.orderBy(F.rand(3))).count() == 0
    found = fixity.audit(rows, rows.filter("record_id <> 77")).collect()
    assert [(x["offset"], x["status"]) for x in found] == [(5, "altered")]


def test_url_lists_of_odd_captures(spark):
    long = ".".join(["a"] * 130)
    entries = spark.createDataFrame(
        [("deep", long, "add", "2024-01-01"), ("top", "com", "add", "2024-01-02"), ("day", "x.org", "add", "2024-01-05"), ("day", "x.org", "remove", "2024-01-05"), ("day", "x.org", "remove", "2024-01-06"), ("gone", "y.org", "remove", "2024-01-01"), (None, "y.org", "add", "2024-01-01"), ("top", "com", "add", "2024-01-02")],
        "list string, domain string, action string, day string",
    )
    rows = [(1, long, "2024-01-03"), (2, "b." + long, "2024-01-03"), (3, "a." * 128 + "a", "2024-01-03"), (4, "shop.com", "2024-01-01"), (5, "shop.com", "2024-01-02"), (6, "x.org", "2024-01-05"), (7, "x.org", "2024-01-06"), (8, "y.org", "2024-01-06"), (9, None, "2024-01-06"), (10, "com", None), (5, "shop.com", "2024-01-02")]
    df = spark.createDataFrame([(i, h, d, "own", False, "salt", {"k": "v"}) for i, h, d in rows], "id long, host string, day string, lists string, blocked boolean, salt string, tags map<string,string>")
    out = url_lists.evaluate(df.withColumn("day", F.col("day").cast("date")).withColumn("domain", F.lit(1)).withColumn("row", F.lit(2)), entries)
    assert out.columns == [*df.columns, "domain", "row", "_blocked", "_lists", "matched_domain"]
    got = sorted((x["id"], x["_lists"], x["matched_domain"]) for x in out.collect())
    want = [(1, "deep", long), (2, "deep", long), (3, None, None), (4, None, None), (5, "top", "com"), (5, "top", "com"), (6, "day", "x.org"), (7, None, None), (8, None, None), (9, None, None), (10, None, None)]
    assert got == want and all(x["lists"] == "own" and x["_blocked"] == (x["_lists"] is not None) for x in out.collect())
    assert url_lists.evaluate(out, entries).columns[-3:] == ["__blocked", "__lists", "_matched_domain"]


def test_deduplicate_has_a_defined_winner(spark):
    """Of rows with one id and fingerprint one stays, the same however the table is dealt; by a broadcast or a shuffle."""
    rows = [(1, "a b c d e", "x"), (1, "A b c d e", "x"), (1, "a b c d e", "y"), (2, "a b c d e", "x"), (None, "a b c d e", "x"), (3, "other words stand here now", "x"), (None, "nobody knows the id of this", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, simhash_uid string")
    once = {tuple(x) for x in simhash.deduplicate(df.coalesce(1)).collect()}
    assert len(once) == 3 and {x[0] for x in once} == {1, 3, None} and df.columns == simhash.deduplicate(df).columns
    for n in (2, 5):
        assert {tuple(x[:2]) for x in simhash.deduplicate(df.repartition(n, "text"), broadcast_ids=0).collect()} == {tuple(x[:2]) for x in once}


def test_settings_stay(spark):
    """No operator changes the session's settings."""
    docs = table(spark, ODD)
    labels = spark.createDataFrame([(4, 1), (6, 0)], "doc_id long, toxic int")
    before = {k: v for k, v in spark.conf.getAll.items()} if not callable(spark.conf.getAll) else dict(spark.conf.getAll())
    simhash.deduplicate(docs).count()
    simhash.near_duplicates(docs).count()
    packing.pack(docs).count()
    pii.redact(docs).count()
    licenses.scan_licenses(docs).count()
    toxicity.score(docs, toxicity.fit(docs, labels)).count()
    compression.score(docs, compression.fit(docs, labels, "toxic")).count()
    decision_list.judge(docs, decision_list.fit(docs, labels, "toxic")).count()
    decontaminate.contaminated(docs, spark.createDataFrame([(1, "a b c d")], "item_id long, text string")).count()
    after = {k: v for k, v in spark.conf.getAll.items()} if not callable(spark.conf.getAll) else dict(spark.conf.getAll())
    assert after == before


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Stages on nulls, repeats, clashing columns and empty tables; extra columns last to the packing."""
    base = common.read(spark, DATA, "documents").filter("doc_id < 60")
    for name in ("labels", "benchmark"):
        common.read(spark, DATA, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    odd = clashing(base.unionByName(table(spark, ODD)).unionByName(base.filter("doc_id < 20")))
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            docs = common.materialize(out, "test-stage")
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).columns == [x.split()[0] for x in packing.SCHEMA.split(", ")]
    assert [x for x, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    assert SCHEMA.split(",")[0] == "doc_id long"


def test_pipeline_leaves_one_table(spark, tmp_path):
    """Of all that the stages write only the last stage's input is left."""
    import os

    before = set(os.listdir(common.shared_dir(spark)))
    out = corpus_pipeline.run(spark, DATA)
    left = set(os.listdir(common.shared_dir(spark))) - before
    assert len(left) == 1 and next(iter(left)).startswith("pipeline-personal_data-") and out.count() > 0


def test_batches_are_cut_by_rows_and_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(common, "PART_ROWS", 4)
    monkeypatch.setattr(common, "PART_BYTES", 10)
    texts = ["abc", None, "é" * 9, "", "x" * 10, "y", "12345", "12345", "1", "", "", "", "", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "t"])
    got = list(common.parts([batch.slice(0, 0), batch]))
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(len(texts)))
    sizes = [sum(len((t or "").encode()) for t in b.column(1).to_pylist()) for b in got]
    assert all(b.num_rows <= 4 and (n <= 10 or b.num_rows == 1) for b, n in zip(got, sizes, strict=True)) and len(got) < len(texts)
