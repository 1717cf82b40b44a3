"""Kernels against brute force and plain restatements of the contracts."""

from __future__ import annotations

import itertools
import math
import operator
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from stonecrop.llm import compression, decision_list, decontaminate, licenses, packing, simhash, toxicity

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text: str) -> int:
    words = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="aB\x1c\x85 é \n\t\x0b", max_size=40))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_masks_cover_the_radius():
    masks = simhash.covering_masks(2**64 - 1)
    assert len(masks) == 15
    for bits in itertools.chain.from_iterable(itertools.combinations(range(64), k) for k in (1, 2, 3)):
        d = sum(1 << b for b in bits)
        assert any(not d & m for m in masks)
    free = 0xF0F0F00000000000
    for bits in itertools.combinations([i for i in range(64) if free >> i & 1], 3):
        assert any(not sum(1 << b for b in bits) & m for m in simhash.covering_masks(free))


@pytest.mark.parametrize("radius", [1, 2, 3, 4, 5, 6, 7])
def test_masks_of_other_radii(radius):
    """No pair within the radius is lost, and each mask keeps enough positions to tell fingerprints apart."""
    masks, r = simhash.covering_masks(2**64 - 1, radius), random.Random(radius)
    assert len(masks) == 2 ** (radius + 1) - 1 and min(m.bit_count() for m in masks) >= 16
    for _ in range(2000):
        d = sum(1 << b for b in r.sample(range(64), radius))
        assert any(not d & m for m in masks)


def test_stars_connect():
    values = np.array([0, 1, 3, 7, 2**40, 2**40 | 1, 2**63 | 2**50], np.uint64)
    assert dict(simhash.stars(np.sort(values), 1)) == {1: 0, 3: 0, 7: 0, 2**40: 0, 2**40 | 1: 0}


def plain_stats(text: str) -> tuple:
    words = SPACE.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@given(st.lists(st.sampled_from(["a", "b", "é", "#x", " ", "\n", "\n\n", "\x1c", "\t", "ab"]), max_size=40).map(" ".join))
@settings(max_examples=300, deadline=None)
def test_stats(text):
    assert decision_list.stats(text.encode())[:5] == plain_stats(text)


def test_learned_rules_find_thresholds():
    g = np.random.default_rng(0)
    x = g.random((2000, 3))
    bad = (x[:, 0] > 0.8) | ((x[:, 1] < 0.2) & (x[:, 2] > 0.5))
    rules = decision_list.learn(["a", "b", "c"], x, bad, np.arange(2000) % 3 != 0)
    rejected = np.zeros(2000, bool)
    for r in rules.rules:
        met = np.ones(2000, bool)
        for c in r:
            met &= c.holds(x[:, "abc".index(c.feature)])
        rejected |= met
    assert (rejected == bad).mean() > 0.97
    assert decision_list.learn(["a"], x[:, :1], np.zeros(2000, bool), np.ones(2000, bool)).rules == ()
    assert decision_list.learn(["a"], np.empty((0, 1)), np.zeros(0, bool), np.ones(0, bool)).rules == ()


@pytest.fixture(scope="module")
def encoder():
    p = public_tokenizers.path
    return packing.Tokenizer(p("byte_bpe_50k.json"), p("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@given(st.text(max_size=60) | st.text(alphabet="aA'sd1 \n\té.!", max_size=80))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_library(encoder, text):
    assert encoder.encode(text).tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_encoder_gives_added_tokens_as_the_library_does(encoder):
    """The plain call turns the string of an added token into that token."""
    assert encoder.encode("a<|endoftext|>b").tolist() == [64, 50256, 65]
    for text in ("<|endoftext|>", "ж<|endoftext|> x", "a <|endoftext|><|endoftext|>\n", "<|endoftext|", "é<|endoftext|>é " * 50):
        assert encoder.encode(text).tolist() == encoder.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed,most,window,limit", [(0, 3000, 1024, 4096), (1, 40, 16, 5), (2, 16, 16, 1), (3, 700, 1024, 20), (4, 1, 8, 4096)])
def test_packing_round_trip(seed, most, window, limit):
    r = random.Random(seed)
    docs = [np.array([r.randrange(50000) for _ in range(r.randint(1, most))], "<u4") for _ in range(300)]
    p = packing.Packer(window, 7, limit)
    for i, d in enumerate(docs):
        p.add(i, d)
    p.close()
    pieces, windows = {}, {}
    for doc, start, length, crc, total, sequence, offset in p.out:
        assert total == len(docs[doc]) and zlib.crc32(docs[doc][start : start + length].tobytes()) == crc and length > 0
        pieces.setdefault(doc, []).append((start, length))
        windows.setdefault(sequence, []).append((offset, length))
    for i, d in enumerate(docs):
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(d)
    padding = 0
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0


def test_packing_minimises_the_sum_of_squares():
    """Each placement is at a level where the sum of squared counts grows least."""
    p, r = packing.Packer(10, 0), random.Random(1)
    for _ in range(200):
        s = r.randint(1, 9)
        before = p.count.copy()

        def after(h, s=s, before=before):
            c = before.copy()
            if h:
                c[h] -= 1
            if h + s < 10:
                c[h + s] += 1
            return int((c[1:10] ** 2).sum())

        best = min(after(h) for h in range(0, 11 - s) if not h or before[h])
        p.add(1, np.zeros(s, "<u4"))
        assert int((p.count[1:10] ** 2).sum()) == best


def plain_align(a, b):
    best, h = 0, np.zeros((len(a) + 1, len(b) + 1), int)
    for i, j in itertools.product(range(len(a)), range(len(b))):
        h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        best = max(best, h[i + 1, j + 1])
    return best


@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), min_size=1, max_size=10))
@settings(max_examples=200, deadline=None)
def test_alignment_score(window, item):
    got, first, end = decontaminate.align(np.array(window, np.int64), np.array(item, np.int64))
    assert got == plain_align(window, item) and 0 <= first <= end <= len(window)
    if got:
        assert plain_align(window[first:end], item) == got


def test_edited_copies_are_found():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choices(vocabulary, k=n))) for i, n in enumerate((13, 25, 40, 58))]
    own = decontaminate.Items(items)
    own.choose(np.zeros(len(own.codes), np.int64))
    for i, t in items:
        w = t.split()
        edited = [x for k, x in enumerate(w) if k % 11 != 5]
        edited[len(edited) // 2] = "changed"
        for body in (w, edited):
            text = " ".join(r.choices(vocabulary, k=50) + body + r.choices(vocabulary, k=50))
            assert list(own.matches(own.encode(text), 0.6)) == [i]
    assert own.matches(own.encode(" ".join(r.choices(vocabulary, k=3000))), 0.6) == {}
    short = decontaminate.Items([(0, "two words"), (1, "")])
    short.choose(np.zeros(0, np.int64))
    assert short.matches(short.encode("two words"), 0.6) == {}


@pytest.mark.parametrize("corpus_counts", [False, True])
def test_no_alignment_is_lost(corpus_counts):
    """Every copy whose whole text aligns at the threshold is found, however its edits are spread, also by real counts."""
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(r.choices(vocabulary, k=n))) for i, n in enumerate((3, 4, 5, 6, 13, 25, 40, 58))]
    own = decontaminate.Items(items)
    copies = []
    for i, t in items:
        w = t.split()
        for every in (2, 3, 4, 5, 6):
            for kind in ("replace", "drop", "insert"):
                for offset in range(every):
                    body = []
                    for k, x in enumerate(w):
                        edit = k % every == offset
                        body += {"replace": ["x"], "drop": [], "insert": [x, "x"]}[kind] if edit else [x]
                    copies.append((i, r.choices(["y", "z"], k=30) + body + r.choices(["y", "z"], k=30)))
        copies.append((i, ["y", *" x ".join(w).split(), "y"]))
    counts = np.zeros(len(own.codes), np.int64)
    if corpus_counts:
        for _, c in copies:
            np.add.at(counts, own.found(own.encode(" ".join(c)))[1], 1)
    own.choose(counts)
    found = 0
    for i, c in copies:
        ids = own.encode(" ".join(c))
        score = decontaminate.align(ids, own.words[i])[0] / (2 * len(own.words[i]))
        got = own.matches(ids, 0.6)
        assert (i in got) == (score >= 0.6) and (i not in got or got[i][0] == score), (items[i], c)
        found += i in got
    assert found > 100


def test_ftrl_is_sparse_and_learns():
    r = random.Random(0)
    rows = []
    for _ in range(1500):
        y = r.random() < 0.2
        rows.append((np.unique([r.randrange(100, 5000) for _ in range(60)] + ([r.randrange(5)] if y else [])), int(y)))
    m = toxicity.ftrl(rows)
    w = m.dense()
    assert np.mean([(w[x].sum() + m.bias >= 0) == y for x, y in rows]) > 0.97 and len(m.index) < 500
    assert len(toxicity.hashed("")) == 0 and len(toxicity.hashed("A a")) == len(toxicity.hashed("a a"))


def plain_ftrl(rows, alpha=0.5, beta=1.0, l1=8.0, l2=1.0, epochs=5):
    """The published update, a coordinate at a time."""
    z, n, bias, rate = {}, {}, 0.0, 0.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - y
            for i in x:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
            rate += g * g
            bias -= 0.1 * g / (1 + math.sqrt(rate))
    return {i: weight(i) for i in z if weight(i)}, bias


def test_ftrl_equals_the_plain_update():
    r = random.Random(2)
    rows = [(sorted(r.sample(range(300), 20) + [400 + y] * (r.random() < 0.9)), y) for y in (int(r.random() < 0.4) for _ in range(300))]
    model = toxicity.ftrl([(np.array(x, np.int64), y) for x, y in rows], bits=10)
    weights, bias = plain_ftrl(rows)
    assert weights and sorted(weights) == model.index.tolist() and model.bias == pytest.approx(bias)
    assert model.weight.tolist() == pytest.approx([weights[i] for i in model.index.tolist()], rel=1e-5)


@given(st.lists(st.sampled_from(["Bad", "bad", "badly", "ünï", "x", "a1b", "-", "WORD", "words"]), max_size=12).map(" ".join))
@settings(max_examples=200, deadline=None)
def test_features_are_those_of_the_text(text):
    """As many distinct features as there are distinct n-grams, by 40 bits; the same with and without a memory."""
    w = re.findall(r"[^\W\d_]+", text.lower())
    grams = {("1", x) for x in w} | {("4", x[:4]) for x in w} | {("5", x[:5]) for x in w} | {("2", *x) for x in zip(w, w[1:], strict=False)} | {("3", *x) for x in zip(w, w[1:], w[2:], strict=False)} | {("skip", *x) for x in zip(w, w[2:], strict=False)}
    memory = toxicity.Memory()
    got = toxicity.hashed(text, 20, memory)
    assert len(toxicity.hashed(text, 40)) == len(grams) and got.tolist() == toxicity.hashed(text).tolist() == toxicity.hashed(text, 20, memory).tolist()
    model = toxicity.Model(20, got[::2], np.arange(1, len(got[::2]) + 1, dtype=np.float32), 0.25)
    assert toxicity.margin(text, model, model.dense(), memory) == pytest.approx(0.25 + sum(range(1, len(got[::2]) + 1)))


def test_a_small_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(toxicity, "REMEMBERED", 3)
    memory, texts = toxicity.Memory(), [f"word{chr(97 + i)} is here and other{chr(98 + i)}" for i in range(20)]
    assert all(toxicity.hashed(t, 20, memory).tolist() == toxicity.hashed(t).tolist() for t in texts * 2)


def plain_places(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


@given(st.lists(st.sampled_from(["MIT", "license", "apache", "License,", "general", "public", "é", "mitlicense", "-", "x\n"]), max_size=30))
@settings(max_examples=300, deadline=None)
def test_license_places(words):
    text = " ".join(words)
    assert licenses.scan(text.encode(), licenses.automaton())[:5] == plain_places(text)


def choices(postfix):
    """The sets of licences that satisfy an expression: AND needs both, OR either; an exception qualifies its licence."""
    qualified = lambda a, b: frozenset({frozenset({f"{next(iter(next(iter(a))))} with {next(iter(next(iter(b))))}"})})
    return licenses.evaluated(postfix, lambda x: frozenset({frozenset({x})}), {"or": operator.or_, "and": lambda a, b: frozenset(x | y for x in a for y in b), "with": qualified})


@pytest.mark.parametrize(
    "text,want",
    [
        ("MIT", {frozenset({"mit"})}),
        ("MIT OR Apache-2.0 AND BSD-3-Clause", {frozenset({"mit"}), frozenset({"apache-2.0", "bsd-3-clause"})}),
        ("(MIT OR Apache-2.0) AND ISC", {frozenset({"mit", "isc"}), frozenset({"apache-2.0", "isc"})}),
        ("GPL-2.0-only WITH Classpath-exception-2.0 or MIT", {frozenset({"gpl-2.0-only with classpath-exception-2.0"}), frozenset({"mit"})}),
    ],
)
def test_license_expressions(text, want):
    assert choices(licenses.parse(text)) == want


@pytest.mark.parametrize("text", ["", "MIT MIT", "(MIT", "MIT)", "AND MIT", "MIT OR", "()", "MIT OR (AND)", "M$T"])
def test_malformed_expressions(text):
    assert licenses.parse(text) is None


def test_license_tag():
    row = licenses.scan(b"// SPDX-License-Identifier: (MIT OR Apache-2.0)\n/* SPDX-License-Identifier: GPL-2.0 AND */", licenses.automaton())
    assert row[5] == "apache-2.0,mit,unparsed" and row[6] == 1.0 and row[8] == ["(MIT OR Apache-2.0)", "GPL-2.0 AND"]


@pytest.mark.parametrize(
    "rest,labels,expressions",
    [
        ("MIT */ int main() { return 0; }", "mit", ["MIT"]),
        ("MIT.", "mit", ["MIT"]),
        ("MIT. More text", "mit", ["MIT"]),
        ("(MIT OR Apache-2.0) AND ISC --> <p>(x", "apache-2.0,isc,mit", ["(MIT OR Apache-2.0) AND ISC"]),
        ("MIT--> SPDX-License-Identifier: Apache-2.0", "apache-2.0,mit", ["MIT", "Apache-2.0"]),
        ("MIT OR SPDX-License-Identifier: GPL-2.0+\nSPDX-License-Identifier: ISC", "gpl-2.0+,isc,unparsed", ["MIT OR", "GPL-2.0+", "ISC"]),
        ("GPL-2.0-only WITH Classpath-exception-2.0; int x", "gpl-2.0-only with classpath-exception-2.0", ["GPL-2.0-only WITH Classpath-exception-2.0"]),
        ("MIT MIT", "mit", ["MIT"]),
        ("MIT AND (ISC", "unparsed", ["MIT AND (ISC"]),
        ("(MIT", "unparsed", ["(MIT"]),
        ("M$T */", "unparsed", ["M$T"]),
        ("hello", "unknown", ["hello"]),
        ("MIT OR hello WITH x", "mit,unknown", ["MIT OR hello WITH x"]),
        ("LicenseRef-Own AND GPL-2.0+ WITH Linux-syscall-note", "gpl-2.0+ with linux-syscall-note,licenseref-own", ["LicenseRef-Own AND GPL-2.0+ WITH Linux-syscall-note"]),
        ("", "unparsed", [""]),
    ],
)
def test_license_tag_in_running_text(rest, labels, expressions):
    row = licenses.scan(b"/* SPDX-License-Identifier: " + rest.encode(), licenses.automaton())
    assert (row[5], row[8]) == (labels, expressions)


def test_license_scores():
    score = lambda x: licenses.scan(x.encode(), licenses.automaton())[6]
    tag = "SPDX-License-Identifier: "
    assert [score(tag + x) for x in ("MIT", "hello", "MIT OR hello", "M$T", "GPL-3.0-only WITH hello")] == [1.0, 0.0, 0.5, 0.0, 0.0]
    assert licenses.scan((tag + "hello").encode(), licenses.automaton(), identifiers=frozenset({"hello"}))[5:7] == ("hello", 1.0)


def test_compression_tells_apart():
    r = random.Random(1)
    good = [" ".join(r.choices(["alpha", "beta", "gamma", "delta"], k=80)).encode() for _ in range(200)]
    bad = [" ".join(r.choices(["x**", "y$$", "z##", "q%%"], k=80)).encode() for _ in range(200)]
    blocks = lambda texts: [t[a : a + compression.BLOCK] for t in texts for a in range(0, len(t), compression.BLOCK)]
    d = compression.Differ(compression.dictionary(blocks(good[:100])), compression.dictionary(blocks(bad[:100])))
    x = np.array([d(t) for t in good[100:] + bad[100:]])
    a, y = compression.terms(x, np.array([len(t) for t in good[100:] + bad[100:]], float)), np.r_[np.ones(100), np.zeros(100)]
    assert ((a @ compression.logistic(a, y) > 0) == y).mean() > 0.98
    # where bytes alone tell, the curve follows them
    n = np.r_[np.full(50, 10.0), np.full(50, 1000.0)]
    a, y = compression.terms(np.zeros(100), n), (n > 100).astype(float)
    assert ((a @ compression.logistic(a, y) > 0) == y).all()
    assert d(b"") == 0.0 and compression.dictionary([b"a"])


def test_difference_is_that_of_single_blocks():
    """Against a compressor made anew for each block."""
    import zstandard

    good, bad = b"alpha beta gamma delta " * 50, b"x** y$$ z## q%% " * 50
    d = compression.Differ(good, bad)
    for raw in (b"alpha beta", b"alpha z## " * 99, bytes(range(256)) * 3 + b"tail"):
        size = lambda x, block: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(x), level=compression.LEVEL, write_content_size=False, write_dict_id=False).compress(block))
        blocks = [raw[a : a + compression.BLOCK] for a in range(0, len(raw), compression.BLOCK)]
        want = sum((size(bad, x) - size(good, x)) / (size(bad, x) + size(good, x)) * len(x) for x in blocks) / len(raw)
        assert d(raw) == pytest.approx(want)


def test_license_expressions_of_any_length():
    long = licenses.parse(" AND ".join(["MIT"] * 20_000))
    assert licenses.named(long) == {"mit"} and licenses.satisfied(long, licenses.PERMITTED)
    deep = licenses.parse("(" * 20_000 + "GPL-2.0" + ")" * 20_000)
    assert licenses.named(deep) == {"gpl-2.0"} and not licenses.satisfied(deep, licenses.PERMITTED)
    assert licenses.parse("(") is None and licenses.parse("") is None and licenses.parse("(MIT OR ISC) WITH x") is None and licenses.parse("MIT WITH (x)") is None


def test_license_permission_is_that_of_choices():
    r = random.Random(5)
    for _ in range(300):
        n = r.randint(1, 6)
        parts = [r.choice(["MIT", "ISC", "GPL-2.0", "GPL-2.0 WITH x", "MIT WITH y"]) for _ in range(n)]
        text = parts[0]
        for p in parts[1:]:
            text = f"{text} {r.choice(['AND', 'OR'])} {p}"
            if r.random() < 0.4:
                text = f"({text})"
        postfix = licenses.parse(text)
        allowed = any(all(x.split()[0] in licenses.PERMITTED for x in c) for c in choices(postfix))
        assert licenses.satisfied(postfix, licenses.PERMITTED) == allowed, text
        assert set().union(*choices(postfix)) <= licenses.named(postfix)


@pytest.mark.parametrize("seed", range(6))
def test_rules_grow_by_the_best_condition(seed):
    """The first condition of the first rule has the largest FOIL gain of all thresholds, and the rules are those of plain covering."""
    g = np.random.default_rng(seed)
    x = g.integers(0, 8, (400, 3)).astype(float)
    bad = (x[:, 0] >= 6) & (x[:, 1] < 5) | (g.random(400) < 0.05)
    grow = np.arange(400) % 3 != 0

    def gain(met, part):
        p, n = (met & part & bad).sum(), (met & part & ~bad).sum()
        p0, n0 = (part & bad).sum(), (part & ~bad).sum()
        return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p >= 3 else 0.0

    best = max(gain(x[:, j] >= t if above else x[:, j] < t, grow) for j in range(3) for t in range(8) for above in (True, False))
    rules = decision_list.learn(["a", "b", "c"], x, bad, grow).rules
    assert rules
    first = rules[0][0]
    assert gain(first.holds(x[:, "abc".index(first.feature)]), grow) == pytest.approx(best)
    # each rule is precise on the rows that those before it leave
    left = np.ones(400, bool)
    for rule in rules:
        met = left.copy()
        for c in rule:
            met &= c.holds(x[:, "abc".index(c.feature)])
        assert (met & bad).sum() >= 0.9 * met.sum() and met.sum() >= 3
        left &= ~met


@given(st.lists(st.sampled_from([*" ".join(licenses.NOTICES).split(), *licenses.NOTICES, *licenses.BASE, "GNU", "Lesser", "x", "-", "\n"]), max_size=25))
@settings(max_examples=200, deadline=None)
def test_all_phrases_are_found(words):
    """Labels, places and score against a search for each phrase alone."""
    text = " ".join(words)
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    every = {**licenses.NOTICES, **licenses.BASE}
    want = sorted((i, len(p.split()), label) for p, label in every.items() for i in range(len(found)) if found[i : i + len(p.split())] == p.split())
    row = licenses.scan(text.encode(), licenses.automaton())
    assert sorted((x["start"], x["words"], x["label"]) for x in row[7]) == want
    labels = {x for _, _, x in want}
    assert row[5] == ",".join(sorted(labels))
    notice = any(found[i : i + len(p.split())] == p.split() for p in licenses.NOTICES for i in range(len(found)))
    assert row[6] == pytest.approx(max(1 - 0.5 ** len(labels), 0.8 if notice else 0) if labels else 0)
