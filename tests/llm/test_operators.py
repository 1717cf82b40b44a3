"""Operators on small tables: nulls, empty tables, ties, repeated rows, clashing columns, and brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stonecrop.llm import compression, decision_list, decontaminate, fixity, licenses, packing, pii, queries, simhash, toxicity, url_lists
from tests.llm.test_kernels import plain_fingerprint

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (None, "no id at all here"), (3, " \n\t"), (4, "same text twice"), (4, "same text twice"), (5, "word " * 30_000), (6, "ünï¢ødé \U0001f600 text")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def clashing(df):
    """With columns named as the operators' own."""
    for c in ("fp", "score", "label", "uid", "base", "added", "cands", "s", "key", "taken", "leaked", "simhash_fp", "quality_stats", "pii_uid", "pii_text"):
        df = df.withColumn(c, F.lit(7))
    return df


@pytest.fixture(scope="module")
def odd(spark):
    return clashing(table(spark, ODD))


def components(prints, radius=3):
    left, out = set(range(len(prints))), {}
    while left:
        stack, group = [left.pop()], []
        while stack:
            i = stack.pop()
            group.append(i)
            near = {j for j in left if (prints[i] ^ prints[j]).bit_count() <= radius}
            left -= near
            stack += near
        for i in group:
            out[i] = group
    return out


@pytest.mark.parametrize("bucket", [4096, 3])
def test_links_are_complete(spark, bucket):
    """Also where every bucket of some size is dealt anew."""
    r = random.Random(bucket)
    centre = r.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for _ in range(120)} | {r.getrandbits(64) for _ in range(40)}
    prints = sorted(prints)
    df = spark.createDataFrame([(i, simhash.signed(p)) for i, p in enumerate(prints)], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.classes(df, bucket=bucket).collect()}
    want = components(prints)
    assert got == {simhash.signed(p): min(want[i]) for i, p in enumerate(prints)}


def test_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {(r["node"], r["root"]) for r in simhash.components(df).collect()} == {(i, 0) for i in range(1, 61)}


def test_near_duplicates(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    prints = [plain_fingerprint(t or "") for _, t in ODD]
    assert sorted(simhash.signed(p) for p in prints) == sorted(r["fp"] for r in rows)
    groups = components(prints)
    want = sorted((ODD[i][0] or 0, min((ODD[j][0] for j in groups[i] if ODD[j][0] is not None), default=None) or 0) for i in range(len(ODD)))
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in rows) == want


def test_deduplicate(spark, odd):
    rows = simhash.deduplicate(odd)
    assert rows.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in rows.collect()) == [0, 1, 4, 5, 6]
    assert simhash.deduplicate(odd.limit(0)).count() == 0


def test_pack(spark, odd):
    rows = packing.pack(odd.repartition(3)).collect()
    totals = {}
    for r in rows:
        totals.setdefault((r["doc_id"], r["doc_tokens"]), 0)
        totals[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert totals[1, 1] == 1 and totals[2, 1] == 1 and sum(v for (d, _), v in totals.items() if d == 4) == 2 * next(n for d, n in totals if d == 4)
    assert all(v % n == 0 for (_, n), v in totals.items())
    assert packing.pack(odd.limit(0)).count() == 0


@pytest.mark.parametrize("source", ["table", "special"])
def test_pack_equals_plain_calls(spark, source):
    """Each piece of all documents of the larger test table, and of texts with added tokens, against the library's own ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = queries.read(spark, DATA.replace("0.001", "0.01"), "documents")
    if source == "special":
        docs = docs.filter("doc_id % 20 = 0").withColumn("text", F.concat(F.lit("<|endoftext|>"), F.substring("text", 1, 700), F.lit("a<|endoftext|>b"), F.col("text")))
    rows = packing.pack(docs.repartition(3, "doc_id")).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4") for r in docs.select("doc_id", "text").collect()}
    pieces, windows = {}, {}
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    ends = lambda parts: [b for a, b in sorted(parts)] and all(x[0] + x[1] == y[0] for x, y in zip(sorted(parts), sorted(parts)[1:], strict=False)) and min(parts)[0] == 0
    assert set(pieces) == set(ids) and all(ends(x) and sum(n for _, n in x) == len(ids[d]) for d, x in pieces.items())
    sizes = [sum(n for _, n in x) for x in windows.values()]
    assert all(map(ends, windows.values())) and max(sizes) <= 1024
    assert sum(1024 - n for n in sizes if n & (n - 1)) <= 0.01 * sum(sizes)
    if source == "special":
        assert any(50256 in x.tolist() for x in ids.values())


def test_quality(spark, odd):
    labels = spark.createDataFrame([(4, 1), (6, 0), (None, 1), (5, None)], "doc_id long, quality int")
    rules = decision_list.fit(odd, labels)
    rows = decision_list.judge(odd, rules).collect()
    assert len(rows) == len(ODD) and not any(r["kept"] for r in rows)
    assert decision_list.keep_good(odd, rules).columns == odd.columns
    assert decision_list.fit(odd, labels.limit(0)).rules == () and decision_list.judge(odd.limit(0), rules).count() == 0


def test_quality_expression_equals_rules(spark):
    g = random.Random(0)
    texts = [" ".join(("bad!" if b else "good") + str(g.randrange(300)) for _ in range(60)) for b in (g.random() < 0.4 for _ in range(120))]
    docs = table(spark, list(enumerate(texts)))
    labels = spark.createDataFrame([(i, int("bad!" not in t)) for i, t in enumerate(texts)], "doc_id long, quality int")
    rules = decision_list.fit(docs, labels)
    assert rules.rules
    assert {r["doc_id"] for r in decision_list.judge(docs, rules).filter("kept").collect()} == {i for i, t in enumerate(texts) if "bad!" not in t}


def test_scores(spark, odd):
    labels = spark.createDataFrame([(4, 1), (6, 0), (5, 0)], "doc_id long, toxic int")
    for fit, score in ((toxicity.fit, toxicity.score), (compression.fit, compression.score)):
        rows = score(odd, fit(odd, labels, "toxic")).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
        assert score(odd, fit(odd, labels.limit(0), "toxic")).count() == len(ODD) and score(odd.limit(0), None).count() == 0


def test_licenses(spark, odd):
    rows = licenses.scan_licenses(odd).collect()
    assert len(rows) == len(ODD) and all(r["labels"] == "" and r["score"] == 0 for r in rows)
    r = licenses.scan_licenses(table(spark, [(1, "x MIT License. General Public\nLicense, MIT license")])).first()
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (3, 1, 6, "gpl,mit")
    assert [(p["label"], p["start"]) for p in r["places"]] == [("mit", 1), ("gpl", 3), ("mit", 6)]


def test_contaminated(spark, odd):
    item = "the seven quick foxes jumped across nine lazy sleeping dogs near old river banks"
    bench = spark.createDataFrame([(9, item), (8, None), (7, "too short")], "item_id long, text string")
    docs = table(spark, [(1, f"noise before it {item} noise after"), (2, item.upper().replace("NINE", "ten")), (3, "the seven quick foxes"), (4, None)])
    rows = {r["doc_id"]: r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(rows) == {1, 2} and rows[1]["score"] == 1.0 and (rows[1]["start_word"], rows[1]["end_word"]) == (3, 17) and rows[2]["score"] < 1
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()) == [3, 4]
    assert decontaminate.decontaminate(odd, bench).columns == odd.columns
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), bench).count() == 0
    decontaminate.BLOCK_WORDS, before = 5, decontaminate.BLOCK_WORDS
    try:
        assert decontaminate.contaminated(docs, bench).count() == 2
    finally:
        decontaminate.BLOCK_WORDS = before


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


def test_pii_base(spark):
    r = random.Random(4)
    parts = ["a@b.c", ".@x.y", "me+1%@ex-a.co.uk", "1.2.3.4", "256.1.1.1", "001.2.3.0004", "1.2.3.4.5.6.7.8", "4111 1111-1111 1111", "4111111111111112", "+1 (555) 010-9999", "+49.30.123", "+1 2", "😀", " ", "x", "@", "12  34", "\n", "0" * 25, ".", "-"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(300)] + ["", "9" * 20_000, "a" * 20_000 + "@", "1 " * 5000, "a@b.c " * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", pii.listed(pii.base_spans(F.col("t"))).alias("x"))
    for row in df.collect():
        assert row["x"] == plain_spans(texts[row["id"]]), texts[row["id"]][:80]


def test_pii_learns_contexts(spark):
    texts = [f"please contact jo{i}@mail.example or wait" for i in range(12)] + ["please contact AB-12345-X or wait", "the year 2024abc was fine", "again AB-12345-X there", None]
    docs = table(spark, list(enumerate(texts)))
    rows = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert len(rows) == len(texts)
    cut = lambda i: [texts[i][x["s"] : x["e"]] for x in rows[i]["added"]]
    assert cut(12) == ["AB-12345-X"] and cut(13) == [] and cut(14) == ["AB-12345-X"] and rows[15]["base"] == []
    red = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(clashing(docs), length_col="n_chars").collect()}
    assert red[0][0] == "please contact [EMAIL] or wait" and red[0][1] == len(red[0][0]) and red[12][0] == "please contact [ID] or wait" and red[15][0] is None


def test_pii_marks_the_text_of_seeds_elsewhere(spark):
    texts = ["call +49 (30) 12345678 now", "stock item 12345678 left", "stock item 87654321 left"]
    rows = {r["doc_id"]: r["added"] for r in pii.find(table(spark, list(enumerate(texts)))).collect()}
    assert rows[0] == [] and [texts[1][x["s"] : x["e"]] for x in rows[1]] == ["12345678"] and rows[2] == []


def test_pii_learns_chains_of_any_length(spark):
    """Each link's instances stand in its own context and in the next one; only the first context holds seeds."""
    texts = [f"x alpha jo{i}@mail.example y" for i in range(208)] + ["x alpha " + "b" * 80 + "-5 y"]
    for k, (here, after, n) in enumerate((("alpha", "beta", 48), ("beta", "gamma", 12), ("gamma", "delta", 3))):
        for i in range(n):
            texts += [f"x {here} L{k}-{i}-77 y", f"x {after} L{k}-{i}-77 y"]
    texts.append("plain L2-1-77 words")
    rows = {r["doc_id"]: r["added"] for r in pii.find(table(spark, list(enumerate(texts)))).collect()}
    cut = lambda i: [texts[i][x["s"] : x["e"]] for x in rows[i]]
    assert cut(len(texts) - 1) == ["L2-1-77"] and cut(208) == ["b" * 80 + "-5"]


def test_pii_edges(spark, odd):
    assert pii.find(odd).count() == len(ODD) and pii.find(odd.limit(0)).count() == 0
    assert pii.redact(odd).columns == odd.columns


def test_fixity(spark):
    rows = [(i // 40, (i % 40) * 60_000, i, bytearray(hashlib.sha256(str(i).encode()).digest())) for i in range(200)]
    schema = "archive long, offset long, record_id long, digest binary"
    a = spark.createDataFrame(rows, schema)
    changed = [r for r in rows if r[2] != 77]
    changed[5] = (*changed[5][:3], bytearray(b"x" * 32))
    changed.append((9, 0, 999, bytearray(b"y" * 32)))
    got = {(r["record_id"], r["status"]) for r in fixity.audit(a, spark.createDataFrame(changed, schema)).collect()}
    assert got == {(77, "missing"), (5, "altered"), (999, "extra")}
    assert fixity.audit(a, a).count() == 0 and fixity.audit(a, a.limit(0)).count() == 200 and fixity.audit(a.limit(0), a.limit(0)).count() == 0


def test_url_lists(spark):
    entries = spark.createDataFrame([("ads", "X.com", "add", "2024-01-10"), ("ads", "x.com", "remove", "2024-03-01"), ("bad", "sub.x.com", "add", "2024-02-01"), ("bad", None, "add", "2024-01-01")], "list string, domain string, action string, day string")
    caps = [(1, "http://x.com/a", "2024-01-09"), (2, "http://x.com/a", "2024-01-10"), (3, "http://sub.x.com:80/", "2024-02-29"), (4, "http://sub.x.com", "2024-03-01"), (5, "http://notx.com", "2024-02-01"), (6, None, "2024-02-01"), (7, "http://u@x.com.", None), (2, "http://x.com/a", "2024-01-10")]
    df = spark.createDataFrame(caps, "id long, url string, day string").select("id", "url", F.col("day").cast("date"), url_lists.host_of(F.col("url")).alias("host"), F.lit(1).alias("h"), F.lit(2).alias("d"), F.lit("q").alias("lists2"))
    got = sorted((r["id"], r["lists"], r["matched_domain"]) for r in url_lists.evaluate(df, entries).collect())
    assert got == sorted([(1, None, None), (2, "ads", "x.com"), (2, "ads", "x.com"), (3, "ads,bad", "sub.x.com"), (4, "bad", "sub.x.com"), (5, None, None), (6, None, None), (7, None, None)], key=lambda x: (x[0],))
    assert url_lists.evaluate(df.limit(0), entries).count() == 0 and url_lists.evaluate(df, entries.limit(0)).count() == 8


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, DATA).toPandas()

    def cell(v):
        """Columns of integers with nulls are floats in one of the two."""
        return "-" if pd.isna(v) else f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    plain = lambda df: sorted("\t".join(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))
    assert plain(got) == plain(want)


def test_pipeline(spark):
    """Each stage against a plain restatement on what its predecessor kept."""
    docs = corpus_pipeline.read(spark, DATA, "documents")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = corpus_pipeline.quality(spark, docs, DATA)
    kept = {r["doc_id"] for r in good.collect()}
    assert kept and all(len(text[i].split()) >= 50 for i in kept)
    one = corpus_pipeline.deduplicate(spark, good, DATA)
    ids = sorted(kept)
    groups = components([plain_fingerprint(text[i]) for i in ids])
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({ids[min(g)] for g in groups.values()})
    clean = corpus_pipeline.decontaminated(spark, one, DATA)
    items = [r["text"].lower() for r in corpus_pipeline.read(spark, DATA, "benchmark").collect()]
    left = {r["doc_id"] for r in clean.collect()}
    leaked = {r["doc_id"] for r in one.collect() if any(t in r["text"].lower() for t in items)}
    assert not left & leaked
    private = {r["doc_id"]: r for r in corpus_pipeline.private(spark, clean, DATA).collect()}
    assert set(private) == left and not any("@" in r["text"] and re.search(BASE["email"], r["text"]) for r in private.values())
    assert all(r["n_chars"] == len(r["text"]) for r in private.values())
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()} == left
