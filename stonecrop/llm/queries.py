"""The queries ``opN_<name>`` over whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stonecrop.llm import compression, decision_list, decontaminate, fixity, licenses, packing, pii, simhash, toxicity, url_lists
from stonecrop.llm.common import id_crc32, read


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def replicas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Archives of ``pages``, and a copy in which every 97th page is altered and every 89th is missing."""
    pages = read(spark, sf_dir, "pages")
    payload = F.concat(F.coalesce("url", F.lit("")), F.lit("\r\n\r\n"), F.coalesce("html", F.lit("")))
    rows = pages.filter("page_id is not null").select("page_id", payload.alias("payload"))
    a = fixity.laid_out(rows, "page_id", F.col("payload"))
    # the copy stands at the original's offsets
    b = fixity.laid_out(rows.withColumn("payload", F.when(F.col("page_id") % 97 == 0, F.translate("payload", "<", "(")).otherwise(F.col("payload"))), "page_id", F.col("payload"))
    return a, b.filter("record_id % 89 <> 0")


def op2_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.audit(*replicas(spark, sf_dir)).select("archive", "offset", F.col("record_id").alias("page_id"), "status", "digest_a", "digest_b")


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(url, '') || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS payload FROM pages WHERE page_id IS NOT NULL
), q AS (
  SELECT page_id, page_id // 1024 AS archive, strlen(payload) AS size, sha256(payload) AS digest_a,
         CASE WHEN page_id % 89 = 0 THEN NULL WHEN page_id % 97 = 0 THEN sha256(replace(payload, '<', '(')) ELSE sha256(payload) END AS digest_b
  FROM p
), r AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM q
)
SELECT archive, "offset", page_id, CASE WHEN digest_b IS NULL THEN 'missing' ELSE 'altered' END AS status, digest_a, digest_b
FROM r WHERE digest_a IS DISTINCT FROM digest_b
"""


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rules = decision_list.fit(docs, read(spark, sf_dir, "labels"))
    return decision_list.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda x: x["k"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, ("email", "ip", "card", "phone")), F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.array_sort(F.concat("base", "added"))).alias("spans"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = id_crc32("doc_id") % 5 == 0
    scored = toxicity.score(docs, toxicity.fit(docs, labels.filter(~held_out)))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with host and fetch day; the tables have no fetch time, so page n counts as fetched on day n * 7919 mod 366 of 2024."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select("page_id", "url", url_lists.host_of(F.col("url")).alias("host"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7919 % 366).cast("int")).alias("day"))


def entries(rows: DataFrame) -> DataFrame:
    """Two lists made from the hosts: with m the host's least page id, `ads` has hosts with m mod 3 = 0, `spam` the parent domain of those with m mod 5 = 0; added, removed and, for even m, added again."""
    first = rows.filter("host is not null").groupBy("host").agg(F.min("page_id").alias("m"))
    start = F.lit("2024-01-01").cast("date")
    day = lambda n: F.date_add(start, n.cast("int"))
    m = F.col("m")
    steps = F.array(F.struct(F.lit("add").alias("action"), day(m * 31 % 120).alias("day")), F.struct(F.lit("remove").alias("action"), day(m * 31 % 120 + 30 + m * 17 % 60).alias("day")), F.struct(F.when(m % 2 == 0, "add").otherwise("remove").alias("action"), day(m * 13 % 90 + 250).alias("day")))
    ads = first.filter(m % 3 == 0).select(F.lit("ads").alias("list"), F.col("host").alias("domain"), "m")
    spam = first.filter(m % 5 == 0).select(F.lit("spam").alias("list"), F.regexp_replace("host", r"^[^.]*\.", "").alias("domain"), "m")
    spam = spam.groupBy("list", "domain").agg(F.min("m").alias("m"))
    return ads.unionByName(spam).select("list", "domain", F.explode(steps).alias("x")).select("list", "domain", "x.action", "x.day")


def op9_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = captures(spark, sf_dir)
    return url_lists.evaluate(rows, entries(rows)).select("page_id", "url", F.col("day").cast("string").alias("fetch_day"), "blocked", "lists", "matched_domain")


OP9_SQL = r"""
WITH c AS (
  SELECT page_id, url, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1)), '.'), '') AS host,
         DATE '2024-01-01' + (page_id * 7919 % 366)::INT AS day
  FROM pages
), f AS (SELECT host, min(page_id) AS m FROM c WHERE host IS NOT NULL GROUP BY host),
t AS (
  SELECT 'ads' AS list, host AS domain, m FROM f WHERE m % 3 = 0
  UNION ALL
  SELECT 'spam', regexp_replace(host, '^[^.]*\.', ''), min(m) FROM f WHERE m % 5 = 0 GROUP BY 2
), e AS (
  SELECT list, domain, 'add' AS action, DATE '2024-01-01' + (m * 31 % 120)::INT AS day FROM t
  UNION ALL SELECT list, domain, 'remove', DATE '2024-01-01' + (m * 31 % 120 + 30 + m * 17 % 60)::INT FROM t
  UNION ALL SELECT list, domain, CASE WHEN m % 2 = 0 THEN 'add' ELSE 'remove' END, DATE '2024-01-01' + (m * 13 % 90 + 250)::INT FROM t
), g AS (SELECT list, domain, day, bool_or(action = 'add') AS held FROM e GROUP BY ALL),
v AS (SELECT *, lead(day) OVER (PARTITION BY list, domain ORDER BY day) AS until FROM g),
h AS (
  SELECT c.page_id, string_agg(DISTINCT v.list, ',' ORDER BY v.list) AS lists, max_by(v.domain, length(v.domain)) AS matched_domain
  FROM c JOIN v ON v.held AND c.day >= v.day AND (v.until IS NULL OR c.day < v.until) AND (c.host = v.domain OR ends_with(c.host, '.' || v.domain))
  GROUP BY c.page_id
)
SELECT c.page_id, c.url, c.day::VARCHAR AS fetch_day, h.page_id IS NOT NULL AS blocked, h.lists, h.matched_domain FROM c LEFT JOIN h USING (page_id)
"""


def op10_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = id_crc32("doc_id") % 4 == 2
    scored = compression.score(docs, compression.fit(docs, labels.filter(~held_out)))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "difference")


def base5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of ``op5_quality_rules``, which SQL can express; the learned list is left out."""
    found = decision_list.judge(read(spark, sf_dir, "documents"), decision_list.DecisionList())
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


BASE5_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS gram FROM t),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(3) s(k) GROUP BY 1)
SELECT l.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
       (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(w) AS base_failed
FROM l LEFT JOIN c USING (doc_id)
"""


def base6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of ``op6_pii``; the added spans are left out."""
    spans = pii.base_spans(F.coalesce("text", F.lit("")))
    found = read(spark, sf_dir, "documents").select("doc_id", spans.alias("base"))
    return found.select("doc_id", F.size("base").cast("long").alias("n_spans"), F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"))


_FOUND = r"""SELECT doc_id, {k} AS k, unnest(m) AS m, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)))::BIGINT AS s
FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS g FROM t)"""
BASE6_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (""" + "\nUNION ALL ".join(
    _FOUND.format(k=k, p=p)
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))
) + r"""),
d AS (SELECT *, string_split(reverse(regexp_replace(m, '[^0-9]', '', 'g')), '') AS d FROM f),
v AS (
  SELECT *, CASE k WHEN 0 THEN TRUE WHEN 1 THEN list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(x AS INT), 0) <= 255))
    WHEN 2 THEN len(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN d[i]::INT WHEN d[i]::INT > 4 THEN d[i]::INT * 2 - 9 ELSE d[i]::INT * 2 END)) % 10 = 0
    ELSE len(d) BETWEEN 9 AND 15 END AS good
  FROM d
), x AS (SELECT doc_id, count(*) AS n, string_agg(['email', 'ip', 'card', 'phone'][k + 1] || ':' || s || ':' || (s + length(m)), ',' ORDER BY s, k) AS spans FROM v WHERE good GROUP BY 1)
SELECT t.doc_id, coalesce(n, 0) AS n_spans, sha256(coalesce(spans, '')) AS base_sha256 FROM t LEFT JOIN x USING (doc_id)
"""


def base8_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of ``op8_licenses``; labels of tags and notices are left out."""
    return licenses.scan_licenses(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


BASE8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (
  SELECT *, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'mit' AND w[i + 1] = 'license') AS mit, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'apache' AND w[i + 1] = 'license') AS apache,
         list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS gpl
  FROM w
), a AS (SELECT *, list_concat(list_concat(mit, apache), gpl) AS places FROM p)
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
       concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels
FROM a
"""


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_fixity, op3_pack, op4_simhash, op5_quality_rules, op6_pii, op7_toxicity, op8_licenses, op9_url_lists, op10_compression, base5_counts, base6_spans, base8_places)}
SQL = {"op2_fixity": OP2_SQL, "op9_url_lists": OP9_SQL, "base5_counts": BASE5_SQL, "base6_spans": BASE6_SQL, "base8_places": BASE8_SQL}
