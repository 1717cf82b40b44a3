"""Personal data: base patterns and bootstrapped contextual extraction. Native.

1. Base spans: e-mail, IP, card and phone patterns with their tests.
2. Candidates are tokens of five or more letters of ASCII, digits and ``_ @ . + / -`` with a digit in them; and, as weak
   ones, those of 16 or more without a digit that have a capital after a small letter. Each has up to three
   lexical patterns: the word before it, the two words before it, and the words on either side, however far they
   are; looked for from the second candidate before it to the text behind the next one.
3. Candidates that overlap base spans are the seed instances. A pattern's score is the share of its distinct
   instances that are known; one with ``SUPPORT`` known instances and a score of
   ``CONFIDENCE`` is trusted. An instance that ``AGREE`` trusted patterns extract becomes known, and
   the patterns are scored again, until no instance is new. Weak candidates neither teach nor become known.
4. All candidates in a trusted pattern, or whose text is a known instance, are spans of kind ``id``; weak
   candidates only where ``WEAK_AGREE`` of their patterns are trusted.

The graph is a table of distinct (pattern, instance) pairs in the shared folder, counted before it is
joined, so a frequent pattern isn't gathered in a task; joins on patterns and instances are broadcast
where these are few, and salted where they aren't.
Positions are code points, ends exclusive.

The patterns are possessive and start where a match can start. Positions are prefix sums by doubling, overlaps are
found by bisection, and texts are cut at byte positions: a text of n characters and m matches takes time in proportion to
n + m log m. Null texts count as empty and stay null when redacted; an empty table gives no rows. Repeated
rows keep a row each. Columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stonecrop.llm.common import free_name, let, materialize

KINDS = ["email", "ip", "card", "phone", "id"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
#: Token of five or more characters with a digit, or of 16 or more with a capital after a small letter; not within a longer one.
CANDIDATE = r"(?<![A-Za-z0-9_@.+/-])(?=[A-Za-z_@.+/-]*+[0-9]|[A-Za-z_@.+/-]{15}[A-Za-z_])(?=[A-Za-z_@.+/-]*+[0-9]|[A-Za-z_@.+/-]*?[a-z][A-Z])[A-Za-z0-9_@+/-][A-Za-z0-9_@.+/-]{3,}[A-Za-z0-9_]"
SUPPORT, CONFIDENCE, AGREE, WEAK_AGREE = 3, 0.8, 1, 2
#: Patterns or instances that are broadcast at most, some 10 MB; how often they are repeated in a salted join beyond.
BROADCAST, SALTS = 100_000, 8
#: A word of a context.
WORD = r"\p{L}\p{N}=:#"
SPAN = "array<struct<s:int,k:int,e:int,b:int,f:int>>"


def running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array ``both`` over all up to there, as sum or greatest: by doubling, in n log n steps. ``values`` must be bound."""
    steps = F.filter(F.array(*[F.lit(2**p) for p in range(30)]), lambda p: p < F.size(values))
    return F.aggregate(steps, values, lambda now, p: F.transform(now, lambda x, i: F.when(i < p, x).otherwise(both(F.get(now, i - p), x))))


def below(sorted_: Column, x: Column) -> Column:
    """How many values of a sorted array are less than ``x``, by bisection."""
    steps = F.filter(F.array(*[F.lit(2**p) for p in range(29, -1, -1)]), lambda p: p <= F.size(sorted_))
    return F.aggregate(steps, F.lit(0), lambda n, p: F.when(F.get(sorted_, n + p - 1) < x, n + p).otherwise(n))


def positions(text: Column, pattern: str, more: Callable[[Column, Column, Column], list[Column]] = lambda f, g, i: []) -> Column:
    """array<struct<s, e, b, f, m, ...>> of a pattern's matches: code points, bytes, the match, and what ``more`` makes of all matches, the texts between them and the place."""
    plus = lambda x, y: x + y

    def of(f: Column, g: Column) -> Column:
        chars = F.transform(f, lambda m, i: F.length(m) + F.length(F.get(g, i)))
        octets = F.transform(f, lambda m, i: F.octet_length(m) + F.octet_length(F.get(g, i)))

        def row(m: Column, i: Column, e: Column, b: Column) -> Column:
            at, byte = F.get(e, i), F.get(b, i)
            return F.struct((at - F.length(m)).alias("s"), at.alias("e"), (byte - F.octet_length(m)).alias("b"), byte.alias("f"), m.alias("m"), *more(f, g, i))

        return let(chars, lambda c: let(running(c, plus), lambda e: let(octets, lambda o: let(running(o, plus), lambda b: F.transform(f, lambda m, i: row(m, i, e, b))))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: let(F.split(text, pattern, -1), lambda g: of(f, g)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes."""
    def value(d: Column, i: Column) -> Column:
        n = d.cast("int")
        twice = n * 2
        return F.when(i % 2 == 0, n).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), value)
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        def small(part: Column) -> Column:
            short = F.regexp_replace(part, "^0+", "")
            return F.when(F.length(short) > 3, False).otherwise(F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)

        return F.forall(F.split(m, r"\."), small)
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(m))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _spans(text: Column, kind: str, k: int, pattern: str) -> Column:
    good = F.filter(positions(text, pattern), lambda x: _holds(kind, x["m"]))
    return F.transform(good, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["b"].alias("b"), x["f"].alias("f")))


def base_spans(text: Column) -> Column:
    """``SPAN`` of the base kinds, by start, then kind; ``k`` is the kind's place in ``KINDS``, ``b`` to ``f`` are bytes."""
    empty = F.array().cast(SPAN)
    parts = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        parts.append(F.when(text.rlike(HINTS[kind]), _spans(text, kind, k, pattern)).otherwise(empty))
    return F.array_sort(F.concat(*parts))


def candidates(text: Column, base: Column) -> Column:
    """array<struct<s, e, b, f, inst, pats, seed, weak>> of the identifier-like tokens of a text and their patterns."""
    def around(f: Column, g: Column, i: Column) -> list[Column]:
        # a candidate has a word in it, so two of them hold the two words before, and one the word after
        part = lambda a, n: F.coalesce(F.get(a, n), F.lit(""))
        before = F.concat(part(f, i - 2), part(g, i - 1), part(f, i - 1), part(g, i))
        after = F.concat(part(g, i + 1), part(f, i + 1), part(g, i + 2))
        backward = rf"^[^{WORD}]*+([{WORD}]++)(?:[^{WORD}]++([{WORD}]++))?"
        word = lambda x, n: F.nullif(F.lower(F.regexp_extract(x, backward, n)), F.lit(""))
        back = let(F.reverse(before), lambda r: F.struct(F.reverse(word(r, 1)).alias("one"), F.reverse(word(r, 2)).alias("two")))
        return [back.alias("before"), word(after, 1).alias("next")]

    def made(x: Column, starts: Column, reach: Column) -> Column:
        one, two, next_ = x["before"]["one"], x["before"]["two"], x["next"]
        pats = F.array(F.concat(F.lit("1 "), one), F.concat(F.lit("2 "), two, F.lit(" "), one), F.concat(F.lit("3 "), one, F.lit(" _ "), next_))
        pats = F.filter(pats, lambda p: p.isNotNull())
        seed = let(below(starts, x["e"]), lambda n: F.coalesce(F.get(reach, n - 1) > x["s"], F.lit(False)))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["b"].alias("b"), x["f"].alias("f"), x["m"].alias("inst"), pats.alias("pats"), seed.alias("seed"), (~x["m"].rlike("[0-9]")).alias("weak"))

    def all_(starts: Column, ends: Column) -> Column:
        return let(running(ends, F.greatest), lambda reach: F.transform(positions(text, CANDIDATE, around), lambda x: made(x, starts, reach)))

    empty = F.array().cast("array<struct<s:int,e:int,b:int,f:int,inst:string,pats:array<string>,seed:boolean,weak:boolean>>")
    found = let(F.transform(base, lambda x: x["s"]), lambda starts: let(F.transform(base, lambda x: x["e"]), lambda ends: all_(starts, ends)))
    return F.when(text.rlike(CANDIDATE), found).otherwise(empty)


def _met(rows: DataFrame, few: DataFrame, key: str, by: str, how: str) -> DataFrame:
    """A join with a written table of distinct keys: broadcast up to ``BROADCAST`` of them, else salted by ``by``, so that a frequent key isn't one task."""
    if few.count() <= BROADCAST:
        return rows.join(F.broadcast(few), key, how)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return salted.join(few.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))).hint("merge"), [key, "salt"], how).drop("salt")


def learned(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern) that are trusted and (inst) that are known, seeds too, from candidates in column ``c``."""
    each = found.select("c.inst", "c.seed", F.explode("c.pats").alias("pattern"))
    edges = materialize(each.groupBy("pattern", "inst").agg(F.max("seed").alias("seed")), "pii-edges")
    known = materialize(edges.filter("seed").select("inst").distinct(), "pii-instances")
    # a pattern stays trusted as more instances are known, so each round but the last adds some
    while True:
        flagged = _met(edges, known.withColumn("known", F.lit(1)), "inst", "pattern", "left")
        scored = flagged.groupBy("pattern").agg(F.count("*").alias("n"), F.count("known").alias("f"))
        trusted = materialize(scored.filter((F.col("f") >= SUPPORT) & (F.col("f") >= CONFIDENCE * F.col("n"))).select("pattern"), "pii-patterns")
        drawn = _met(edges, trusted, "pattern", "inst", "left_semi").groupBy("inst").agg(F.count("*").alias("n")).filter(F.col("n") >= AGREE)
        fresh = materialize(drawn.select("inst").join(known, "inst", "left_anti"), "pii-fresh")
        if fresh.isEmpty():
            return trusted, known
        known = materialize(known.unionByName(fresh), "pii-instances")


def marked(docs: DataFrame, text_col: str, carry: list[str], uid: str, base: str, added: str) -> DataFrame:
    """``carry`` columns of ``docs`` with a row id, the base spans and the added spans (none overlaps a base span)."""
    whole, cands = free_name(docs, "pii_text"), free_name(docs, "pii_cands")
    rows = docs.select(*carry, F.coalesce(F.col(text_col), F.lit("")).alias(whole), F.monotonically_increasing_id().alias(uid))
    rows = rows.withColumn(base, base_spans(F.col(whole))).withColumn(cands, candidates(F.col(whole), F.col(base)))
    # once written, row ids are data: a task that runs again reads the same ones
    found = materialize(rows.select(*carry, uid, base, cands), "pii-rows")
    each = found.filter(F.size(cands) > 0).select(F.col(uid).alias("uid"), F.explode(cands).alias("c"))
    trusted, known = learned(each.filter("not c.weak"))
    each = each.filter("not c.seed").select("uid", "c.s", "c.e", "c.b", "c.f", "c.inst", "c.pats", "c.weak")
    place = ["uid", "s", "e", "b", "f"]
    by_name = _met(each.filter("not weak"), known, "inst", "uid", "left_semi").select(*place)
    there = _met(each.select(*place, "weak", F.explode("pats").alias("pattern")), trusted, "pattern", "uid", "left_semi")
    by_pattern = there.groupBy(*place, "weak").agg(F.count("*").alias("n")).filter(f"n >= {WEAK_AGREE} or not weak").select(*place)
    span = F.struct("s", F.lit(KINDS.index("id")).alias("k"), "e", "b", "f")
    more = by_name.unionByName(by_pattern).distinct().groupBy(F.col("uid").alias(uid)).agg(F.array_sort(F.collect_list(span)).alias(added))
    rich = found.filter(F.size(cands) > 0).drop(cands).join(more, uid, "left").withColumn(added, F.coalesce(F.col(added).cast(SPAN), F.array().cast(SPAN)))
    plain = found.filter(F.size(cands) == 0).drop(cands).withColumn(added, F.array().cast(SPAN))
    return plain.unionByName(rich)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added): arrays of spans (s, k, e), a row per document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return marked(rows, "text", ["doc_id"], "uid", "base", "added").select("doc_id", "base", "added")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each run of overlapping spans replaced by the kind of its first, as in [EMAIL]."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def of(raw: Column, all_: Column, reach: Column, first: Column) -> Column:
        cut = lambda a, n: F.substring(raw, a + 1, n).cast("string")
        end = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))
        kept = F.transform(first, lambda i: F.concat(cut(end(i), F.get(all_, i)["b"] - end(i)), F.element_at(names, F.get(all_, i)["k"] + 1)))
        last = F.get(reach, F.size(all_) - 1)
        return F.array_join(F.concat(kept, F.array(cut(last, F.octet_length(raw)))), "")

    def runs(raw: Column, all_: Column, reach: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda i: (i == 0) | (F.get(all_, i)["b"] >= F.get(reach, i - 1)))
        return let(starts, lambda first: of(raw, all_, reach, first))

    made = let(text.cast("binary"), lambda raw: let(spans, lambda all_: let(F.transform(all_, lambda x: x["f"]), lambda ends: let(running(ends, F.greatest), lambda reach: runs(raw, all_, reach)))))
    return F.when(F.size(spans) == 0, text).otherwise(made)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with personal data replaced in the text, and ``length_col`` set to the new number of characters. Null texts stay null."""
    uid, base, added = (free_name(docs, x) for x in ("pii_uid", "pii_base", "pii_added"))
    rows = marked(docs, text_col, docs.columns, uid, base, added)
    text = redacted(F.col(text_col), F.array_sort(F.concat(base, added)))
    rows = rows.withColumn(text_col, text)
    if length_col:
        rows = rows.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return rows.select(*docs.columns)
