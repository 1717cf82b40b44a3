"""The registered queries of the library, and DuckDB SQL for the same rows.

Tables stand in for trees: a document is a file of its UTF-8 text under source and language, a page's
path is that of its URL. Keys start with the operator's id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stonecrop.functions import hashing, kinds, paths
from stonecrop.functions import text as text_functions
from stonecrop.operators import chunk_store, dedup, embed, integrity, profile, quality, relational, similarity
from stonecrop.sources import tree
from stonecrop.streaming import drift

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: path, size_bytes, mtime, text and the table's columns."""
    end = F.when(F.col("doc_id") % 5 == 0, ".txt").when(F.col("doc_id") % 5 == 1, ".md").when(F.col("doc_id") % 5 == 2, ".TXT").when(F.col("doc_id") % 5 == 3, ".tar.gz").otherwise("")
    path = F.concat(F.lit("/data/"), "source", F.lit("/"), "lang", F.lit("/"), "lang", F.lit("_"), F.col("doc_id").cast("string"), end)
    return read(spark, sf_dir, "documents").withColumns({"path": path, "size_bytes": F.octet_length("text").cast("long"), "mtime": F.col("doc_id") * 60})


#: ``files`` in SQL.
FILES = """f AS (
  SELECT *, '/data/' || source || '/' || lang || '/' || lang || '_' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.TXT' WHEN 3 THEN '.tar.gz' ELSE '' END AS path,
         strlen(text)::BIGINT AS size_bytes, doc_id * 60 AS mtime
  FROM documents
), n AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_replace(path, '/[^/]*$', '') AS parent FROM f),
p AS (SELECT *, regexp_extract(name, '^.+?(\\.[^.]+)$', 1) AS suffix FROM n)""".replace("\\\\", "\\")
#: The entries of the tree of ``files``.
TREE = FILES + """, leaf AS (SELECT path, FALSE AS is_dir, 4 AS depth, size_bytes FROM f),
folder AS (
  SELECT '/' AS path, 0 AS depth UNION SELECT '/data', 1 UNION SELECT '/data/' || source, 2 FROM f UNION SELECT '/data/' || source || '/' || lang, 3 FROM f
), e AS (SELECT * FROM leaf UNION ALL SELECT path, TRUE, depth, 0 FROM folder)"""
TOKENS = r"""list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: CASE WHEN length(w) > 4 THEN regexp_replace(w, '(ed|ing|s)$', '') WHEN length(w) = 4 THEN regexp_replace(w, 's$', '') ELSE w END)"""
#: Distinct shingles of three tokens of each document.
SHINGLES = f"""t AS (SELECT doc_id, {TOKENS} AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN len(t) < 3 THEN [array_to_string(t, ' ')] ELSE list_distinct(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' '))) END AS items FROM t)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.tree_of(files(spark, sf_dir), size_col="size_bytes")


# paths and enrichment


@query(f"WITH {FILES} SELECT doc_id, path, parent, name, left(name, length(name) - length(suffix)) AS stem, suffix FROM p")
def p1_path_components(spark, sf_dir):
    return paths.with_components(files(spark, sf_dir).select("doc_id", "path")).select("doc_id", "path", "parent", "name", "stem", "suffix")


@query(r"""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[A-Za-z]+://[^/?#]*', ''), '[?#].*$', '') AS raw FROM pages),
c AS (SELECT page_id, CASE WHEN regexp_matches(raw, '^/+$') THEN '/' ELSE regexp_replace(raw, '/$', '') END AS path FROM u)
SELECT page_id, path, regexp_extract(path, '([^/]*)$', 1) AS name, CASE WHEN regexp_replace(path, '/?[^/]*$', '') <> '' THEN regexp_replace(path, '/?[^/]*$', '') WHEN path LIKE '/%' THEN '/' ELSE '.' END AS parent FROM c""")
def p1_url_paths(spark, sf_dir):
    raw = paths.strip_url(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", paths.normalized(raw).alias("path"), paths.name(raw).alias("name"), paths.parent(raw).alias("parent"))


@query(f"WITH {FILES} SELECT doc_id, path, 3::BIGINT AS depth FROM f")
def p4_depth_common_root(spark, sf_dir):
    return paths.with_depth(files(spark, sf_dir).select("doc_id", "path"))


@query(f"WITH {FILES} SELECT doc_id, split_part(stem, '_', 1) AS feat1, split_part(stem, '_', 2) AS feat2, parent_name FROM (SELECT doc_id, left(name, length(name) - length(suffix)) AS stem, lang AS parent_name FROM p)")
def p5_filename_features(spark, sf_dir):
    return paths.with_filename_features(files(spark, sf_dir).select("doc_id", "path"), include_parent=True).select("doc_id", "feat1", "feat2", F.col("parent").alias("parent_name"))


@query(f"WITH {FILES} SELECT doc_id, substr(sha256(name || ':' || size_bytes || ':' || mtime), 1, 16) AS hash_fast, sha256(text) AS hash_full FROM n")
def p3_hashes(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", hashing.fast_hash(paths.name(F.col("path")), F.col("size_bytes"), F.col("mtime")).alias("hash_fast"), hashing.full_hash(F.col("text")).alias("hash_full"))


@query("""SELECT doc_id, substr(sha256(CASE WHEN octet_length(b) > 8192 THEN b[1:4096] || b[octet_length(b) - 4095:octet_length(b)] ELSE b[1:4096] END), 1, 32) AS hash_deep FROM (SELECT doc_id, encode(text) AS b FROM documents)""")
def p3_deep_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", hashing.deep_hash(F.col("text")).alias("hash_deep"))


@query(f"WITH {FILES} SELECT doc_id, CASE WHEN size_bytes = 0 THEN 'zero_byte' END AS corruption_reason, size_bytes = 0 AS is_corrupt FROM f")
def p7_corruption(spark, sf_dir):
    return integrity.with_corruption(files(spark, sf_dir)).select("doc_id", "corruption_reason", "is_corrupt")


@query("""WITH b AS (SELECT min(ln(1 + n_chars::DOUBLE)) AS lo, max(ln(1 + n_chars::DOUBLE)) AS hi FROM documents),
r AS (SELECT lang, row_number() OVER (ORDER BY count(*) DESC, lang) AS k FROM documents GROUP BY lang)
SELECT doc_id, round((ln(1 + n_chars::DOUBLE) - lo) / (hi - lo), 6) AS e1, (k = 1)::INT::DOUBLE AS e2, (k = 2)::INT::DOUBLE AS e3, (k > 2)::INT::DOUBLE AS e4 FROM documents JOIN r USING (lang), b""")
def p10_metadata_embedding(spark, sf_dir):
    rows = embed.metadata_embedding(read(spark, sf_dir, "documents"), ["n_chars"], categorical=["lang"], log_columns=("n_chars",), max_categories=2, out="e")
    return rows.select("doc_id", F.round(F.get("e", F.lit(0)), 6).alias("e1"), *[F.get("e", F.lit(i)).alias(f"e{i + 1}") for i in (1, 2, 3)])


@query(f"WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents) SELECT doc_id, len(t)::BIGINT AS n_tokens, array_to_string(t[1:5], ' ') AS first_tokens FROM t")
def p13_tokens(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", text_functions.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join(F.slice("t", 1, 5), " ").alias("first_tokens"))


@query(f"WITH {SHINGLES} SELECT doc_id, len(items)::BIGINT AS n_shingles, list_min(items) AS least FROM s")
def p14_shingles(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text_functions.shingles(F.col("text")).alias("shingles")).select("doc_id", F.size("shingles").cast("long").alias("n_shingles"), F.array_min("shingles").alias("least"))


@query("""WITH t AS (SELECT doc_id, string_split(' ' || lower(text) || ' ', '') AS c FROM documents WHERE regexp_matches(text, '\\S')),
h AS (SELECT doc_id, unnest(list_transform(range(1, len(c) - 1), lambda i: unicode(c[i])::BIGINT * 7919 + unicode(c[i + 1])::BIGINT * 104729 + unicode(c[i + 2])::BIGINT * 1299709)) AS h FROM t),
v AS (SELECT doc_id, h % 64 AS place, sum(h // 64 % 2 * 2 - 1)::DOUBLE AS x FROM h GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm, max(abs(x)) AS greatest, coalesce(max(x) FILTER (place = 7), 0) AS seventh FROM v GROUP BY 1)
SELECT doc_id, CASE WHEN norm IS NULL THEN NULL ELSE 64 END AS dimensions, round(CASE WHEN norm = 0 THEN 0 ELSE 1 END, 6)::DOUBLE AS norm, round(greatest / CASE WHEN norm = 0 THEN 1 ELSE norm END, 6) AS greatest, round(seventh / CASE WHEN norm = 0 THEN 1 ELSE norm END, 6) AS seventh FROM documents LEFT JOIN n USING (doc_id)""".replace("\\\\S", "\\S"))
def p8_text_embedding(spark, sf_dir):
    """Of the stand-in embedding of each whole text: the size, the norm, the greatest value by amount and the seventh."""
    rows = embed.text_embedding(read(spark, sf_dir, "documents"), max_chars=None)
    e = F.col("embedding")
    return rows.select("doc_id", F.when(e.isNotNull(), F.size(e)).alias("dimensions"), F.round(similarity.dot(e, e), 6).alias("norm"), F.round(F.array_max(F.transform(e, F.abs)), 6).alias("greatest"), F.round(F.get(e, F.lit(7)), 6).alias("seventh"))


#: Sentences and the chunk of each, for at most ``MOST`` words a chunk.
CHUNKS = r"""q AS (SELECT path, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM f WHERE trim(text) <> ''),
w AS (SELECT path, s, list_transform(s, lambda x: len(regexp_split_to_array(x, '\s+'))) AS n FROM q),
g AS (SELECT path, s, list_reduce(list_transform(n, lambda x: {{'n': x, 'c': [0::BIGINT]}}), lambda a, x: CASE WHEN a.n + x.n > {most} THEN {{'n': x.n, 'c': list_append(a.c, a.c[-1] + 1)}} ELSE {{'n': a.n + x.n, 'c': list_append(a.c, a.c[-1])}} END).c AS c FROM w WHERE len(s) > 0),
u AS (SELECT path, unnest(c) AS chunk_idx, unnest(s) AS sentence, unnest(range(len(s))) AS i FROM g)"""


@query(f"WITH {FILES}, {CHUNKS.format(most=96)} SELECT path, chunk_idx, string_agg(sentence, ' ' ORDER BY i) AS text FROM u GROUP BY 1, 2")
def p20_chunks(spark, sf_dir):
    """Greedy sentence chunks of whole texts."""
    rows = files(spark, sf_dir)
    return chunk_store.chunk_rows(rows, max_tokens=128).select("path", "chunk_idx", "text")


@query("""WITH t AS (SELECT turn, text FROM conversations) SELECT turn, count(*) AS n, sum(length(text))::BIGINT AS chars, max(length(text))::BIGINT AS longest FROM t GROUP BY turn""")
def a28_turn_lengths(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy("turn").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).cast("long").alias("longest"))


# searches and filters


@query(f"WITH {FILES} SELECT doc_id, path FROM p WHERE lower(suffix) IN ('.txt', '.gz')")
def f1_filter_extension(spark, sf_dir):
    return files(spark, sf_dir).filter(kinds.has_extension(F.col("path"), ["txt", ".GZ"])).select("doc_id", "path")


@query(f"WITH {FILES} SELECT doc_id, path FROM f WHERE regexp_matches(path, 'src1[0-9]/(en|fr)/.*7')")
def f2_filter_pattern(spark, sf_dir):
    return files(spark, sf_dir).filter(F.col("path").rlike("src1[0-9]/(en|fr)/.*7")).select("doc_id", "path")


@query(f"WITH {FILES} SELECT doc_id, path FROM p WHERE lower(suffix) IN ('.md', '.txt')")
def f5_search_files(spark, sf_dir):
    """By priority the extension counts, not the size."""
    return tree.search(files(spark, sf_dir).withColumn("is_file", F.lit(True)), extension='["md", "txt"]', min_size="1M").select("doc_id", "path")


@query(f"WITH {FILES}, d AS (SELECT sha256(text) AS g, path, CASE WHEN path LIKE '/data/src1%' THEN 1 WHEN path LIKE '/data/src2%' THEN 2 END AS k FROM f), m AS (SELECT g FROM d GROUP BY g HAVING count(DISTINCT k) > 1) SELECT g AS group_id, path FROM d WHERE g IN (SELECT g FROM m)")
def f6_cross_directories(spark, sf_dir):
    groups = dedup.exact_groups(files(spark, sf_dir).withColumn("sha256", F.sha2("text", 256)))
    return dedup.across_directories(groups, ["/data/src1", "/data/src2"])


@query(f"WITH {FILES} SELECT doc_id, name FROM n WHERE regexp_matches(lower(name), '^de_.*5.*\\.txt$')".replace("\\\\", "\\"))
def s21_find_glob(spark, sf_dir):
    rows = files(spark, sf_dir).withColumn("is_file", F.lit(True))
    return tree.find_files(rows, "de_*5*.txt", glob=True).select("doc_id", paths.name(F.col("path")).alias("name"))


@query(f"WITH {FILES} SELECT doc_id, mtime FROM f WHERE mtime >= (SELECT max(mtime) FROM f) - 7200")
def s24_recent_files(spark, sf_dir):
    rows = files(spark, sf_dir)
    last = rows.agg(F.max("mtime")).first()[0] or 0
    return tree.find_recent(rows, "2h", now=last).select("doc_id", "mtime")


@query(f"WITH {FILES} SELECT doc_id, size_bytes FROM f WHERE size_bytes >= 5120")
def s25_large_files(spark, sf_dir):
    return tree.find_large(files(spark, sf_dir), "5k").select("doc_id", "size_bytes")


@query(f"WITH {TREE} SELECT count(*) FILTER (NOT is_dir) AS files, count(*) FILTER (is_dir) AS directories, count(*) AS total FROM e")
def s27_counts(spark, sf_dir):
    return tree.counts(entries(spark, sf_dir).withColumn("is_file", ~F.col("is_dir")))


@query(f"WITH {FILES} SELECT doc_id, size_bytes FROM f ORDER BY size_bytes DESC, doc_id LIMIT 20")
def o3_largest(spark, sf_dir):
    return files(spark, sf_dir).orderBy(F.desc("size_bytes"), "doc_id").limit(20).select("doc_id", "size_bytes")


# profiles


@query(f"WITH {FILES} SELECT CASE WHEN suffix = '' THEN '<no extension>' ELSE lower(suffix) END AS extension, count(*) AS len FROM p GROUP BY 1")
def a1_extension_counts(spark, sf_dir):
    return profile.extension_counts(files(spark, sf_dir))


@query(f"WITH {FILES} SELECT parent AS parent_dir, count(*) AS len FROM p GROUP BY 1")
def a2_directory_counts(spark, sf_dir):
    return profile.directory_counts(files(spark, sf_dir))


@query(f"""WITH {TREE} SELECT (SELECT count(*) FROM leaf) AS total_files, (SELECT count(*) FROM folder) AS total_folders, sum(size_bytes)::BIGINT AS total_size_bytes,
round_even(sum(size_bytes) / 1048576, 2) AS total_size_mb, round_even((SELECT count(*) FROM leaf) / (SELECT count(*) FROM folder), 2) AS avg_files_per_folder, 4::BIGINT AS max_depth, 0::BIGINT AS empty_folder_count FROM e""")
def a3_tree_summary(spark, sf_dir):
    return profile.summary(entries(spark, sf_dir))


@query(f"WITH {TREE} SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(*) AS n_files FROM leaf GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def a4_top_folders(spark, sf_dir):
    return profile.top_folders(entries(spark, sf_dir))


@query(f"WITH {TREE} SELECT regexp_extract(path, '([^/]*)$', 1) AS folder_name, count(*) AS n FROM folder WHERE depth > 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def a4_common_folder_names(spark, sf_dir):
    return profile.common_folder_names(entries(spark, sf_dir))


@query(f"WITH {TREE} SELECT depth::BIGINT AS depth, count(*) AS n_folders FROM folder GROUP BY 1")
def a5_depth_distribution(spark, sf_dir):
    return profile.depth_distribution(entries(spark, sf_dir))


@query(f"WITH {TREE} SELECT path FROM folder WHERE depth = 3 AND path NOT IN (SELECT regexp_replace(path, '/[^/]*$', '') FROM leaf WHERE size_bytes >= 20000)")
def a6_empty_folders(spark, sf_dir):
    """Folders left empty if small files go."""
    return profile.empty_folders(entries(spark, sf_dir).filter("is_dir or size_bytes >= 20000"))


# duplicates and similarity


def hashed(spark, sf_dir):
    return files(spark, sf_dir).withColumn("sha256", F.sha2("text", 256))


@query(f"WITH {FILES} SELECT sha256(text) AS group_id, path FROM f QUALIFY count(*) OVER (PARTITION BY text) > 1")
def a7_exact_groups(spark, sf_dir):
    return dedup.exact_groups(hashed(spark, sf_dir))


@query("SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS is_exact_duplicate, CASE WHEN count(*) OVER (PARTITION BY text) > 1 THEN sha256(text) END AS exact_dup_group_id FROM documents")
def a8_duplicate_flags(spark, sf_dir):
    return dedup.with_duplicate_flags(hashed(spark, sf_dir)).select("doc_id", "is_exact_duplicate", "exact_dup_group_id")


@query("""WITH d AS (SELECT DISTINCT sha256(text) AS g, source AS dir FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1),
t AS (SELECT source AS dir, count(*) AS n FROM documents GROUP BY 1),
x AS (SELECT a.dir AS dir_a, b.dir AS dir_b, count(*) AS shared_files FROM d a JOIN d b ON a.g = b.g AND a.dir < b.dir GROUP BY 1, 2)
SELECT dir_a, dir_b, shared_files, ta.n AS dir_a_total_files, tb.n AS dir_b_total_files, round_even(shared_files * 100.0::DOUBLE / least(ta.n, tb.n), 1) AS overlap_pct FROM x JOIN t ta ON ta.dir = dir_a JOIN t tb ON tb.dir = dir_b""")
def a9_directory_overlap(spark, sf_dir):
    source = F.element_at(F.split("path", "/"), 3)
    return dedup.directory_overlap(dedup.exact_groups(hashed(spark, sf_dir)), source, files(spark, sf_dir))


@query("SELECT sha256(text) AS group_id, count(*) AS n_files, ((count(*) - 1) * max(strlen(text)))::BIGINT AS wasted_bytes FROM documents GROUP BY text HAVING count(*) > 1")
def a20_space_waste(spark, sf_dir):
    return dedup.space_waste(hashed(spark, sf_dir))


@query(f"""WITH {SHINGLES}, r AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(items)) AS rep FROM s) SELECT doc_id, rep FROM r""")
def j6_shingle_classes(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", text_functions.shingles(F.col("text")).alias("items"))
    return similarity.classes_of_sets(rows, "doc_id", "items").select("doc_id", "rep")


#: Pairs of similar texts, between the first documents of equal shingle sets.
NEAR = SHINGLES + """, r AS (SELECT * FROM s QUALIFY doc_id = min(doc_id) OVER (PARTITION BY list_sort(items))),
x AS (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM r),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM x a JOIN x b ON a.item = b.item AND a.doc_id < b.doc_id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) GROUP BY ALL),
pairs AS (SELECT a, b, k / (na + nb - k) AS similarity FROM c WHERE k / (na + nb - k) >= 0.8)"""
#: Leaders among the nodes of ``pairs``: in the order of nodes, one without a lesser neighbour that leads.
LEADERS = """nodes AS (SELECT v, list(u) FILTER (u IS NOT NULL) AS less FROM (SELECT b AS v, a AS u FROM pairs UNION ALL SELECT a, NULL FROM pairs) GROUP BY 1),
chosen AS (SELECT list_reduce(list({'less': coalesce(less, [-1]), 'lead': [v]} ORDER BY v), lambda s, x: CASE WHEN list_has_any(s.lead, x.less) THEN s ELSE {'less': x.less, 'lead': list_concat(s.lead, x.lead)} END).lead AS lead FROM nodes),
leads AS (SELECT v AS node, CASE WHEN list_contains(lead, v) THEN v ELSE list_min(list_intersect(lead, less)) END AS leader FROM nodes, chosen),
grouped AS (SELECT doc_id, coalesce(leader, rep) AS leader FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(items)) AS rep FROM s) LEFT JOIN leads ON node = rep)"""


@query(f"WITH {NEAR} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def j6_near_text_pairs(spark, sf_dir):
    """Pairs between the first documents of equal shingle sets."""
    pairs = similarity.near_text(read(spark, sf_dir, "documents"))[1]
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {NEAR}, {LEADERS} SELECT doc_id, leader FROM grouped")
def j6_leader_groups(spark, sf_dir):
    """A row per document with its greedy leader."""
    members, pairs = similarity.near_text(read(spark, sf_dir, "documents"))
    lead = similarity.leaders(pairs)
    return members.join(lead, members["rep"] == lead["node"], "left").select(F.col("id").alias("doc_id"), F.coalesce("leader", "rep").alias("leader"))


def sign_hashes(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", hashing.sign_hash(F.col("embedding")).alias("hash"))


@query("""WITH h AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '') AS bits FROM embeddings),
r AS (SELECT bits, min(vec_id) AS id FROM h GROUP BY bits)
SELECT a.id AS a, b.id AS b, hamming(a.bits, b.bits)::BIGINT AS distance FROM r a JOIN r b ON a.id < b.id WHERE hamming(a.bits, b.bits) <= 5""")
def j7_hamming_pairs(spark, sf_dir):
    reps = sign_hashes(spark, sf_dir).groupBy("hash").agg(F.min("vec_id").alias("id"))
    return similarity.hamming_pairs(reps, 5)


@query("""WITH o AS (SELECT vec_id * 2 + k AS id, CASE WHEN k = 0 THEN array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '') ELSE array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= 0.01 THEN '1' ELSE '0' END), '') END AS bits FROM embeddings, range(2) t(k)),
r AS (SELECT bits, min(id) AS id FROM o GROUP BY bits)
SELECT a.id AS a, b.id AS b, hamming(a.bits, b.bits)::BIGINT AS distance FROM r a JOIN r b ON a.id < b.id WHERE hamming(a.bits, b.bits) <= 5""")
def j7_hamming_pairs_of_two_hashes(spark, sf_dir):
    """Each vector has two hashes here, by the sign and by a threshold of 0.01, some of which differ in few bits."""
    rows = read(spark, sf_dir, "embeddings")
    second = hashing.sign_hash(F.transform("embedding", lambda x: x - F.lit(0.01).cast("float")))
    both = rows.select(F.explode(F.array(*[F.struct((F.col("vec_id") * 2 + k).alias("id"), h.alias("hash")) for k, h in enumerate((hashing.sign_hash(F.col("embedding")), second))])).alias("x")).select("x.*")
    return similarity.hamming_pairs(both.groupBy("hash").agg(F.min("id").alias("id")), 5)


@query("""WITH h AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '') AS bits FROM embeddings),
z AS (SELECT bits FROM h WHERE vec_id = 0) SELECT vec_id, hamming(h.bits, z.bits)::BIGINT AS distance FROM h, z""")
def p18_hamming_distance(spark, sf_dir):
    rows = sign_hashes(spark, sf_dir)
    one = rows.filter("vec_id = 0").select(F.col("hash").alias("first"))  # a single row
    return rows.join(F.broadcast(one)).select("vec_id", hashing.hamming_hex(F.col("hash"), F.col("first")).cast("long").alias("distance"))


KNN = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
x AS (SELECT q.vec_id AS query, r.vec_id AS neighbour, {score} AS s FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) AS rank FROM x)
SELECT query, rank::INT AS rank, neighbour, round(s, 6) AS similarity FROM k WHERE rank <= 5"""


@query(KNN.format(score="list_cosine_similarity(q.e, r.e)"))
def j8_nearest(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = similarity.nearest(rows, rows.filter("id % 50 = 0"))
    return found.withColumn("similarity", F.round("similarity", 6))


@query(KNN.format(score="0.7::DOUBLE * list_cosine_similarity(q.e, r.e) + 0.3::DOUBLE * (q.label = r.label)::INT"))
def j8_nearest_blended(spark, sf_dir):
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("label")).cast("double"))
    rows = read(spark, sf_dir, "embeddings").withColumn("meta", one_hot)
    rows = rows.select(F.col("vec_id").alias("id"), similarity.blended({"embedding": 0.7, "meta": 0.3}).alias("vector"))
    return similarity.nearest(rows, rows.filter("id % 50 = 0")).withColumn("similarity", F.round("similarity", 6))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(1 - list_cosine_similarity(v.embedding::DOUBLE[], q.e), 6) AS distance FROM embeddings v, q ORDER BY 1 - list_cosine_similarity(v.embedding::DOUBLE[], q.e), vec_id LIMIT 10""")
def j9_search(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = similarity.nearest(rows, rows.filter("id = 7"), 10, skip_self=False)
    return found.select(F.col("neighbour").alias("vec_id"), F.round(1 - F.col("similarity"), 6).alias("distance"))


# snapshots and quality


def changed(rows: DataFrame) -> DataFrame:
    """The files later: some gone, some longer, some renamed."""
    rows = rows.filter("doc_id % 11 <> 0")
    rows = rows.withColumn("text", F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return rows.withColumn("path", F.when(F.col("doc_id") % 17 == 0, F.concat("path", F.lit(".new"))).otherwise(F.col("path"))).withColumn("size_bytes", F.octet_length("text").cast("long"))


CHANGED = FILES + """, g AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN path || '.new' ELSE path END AS path, CASE WHEN doc_id % 13 = 0 THEN text || '.' ELSE text END AS text, mtime FROM f WHERE doc_id % 11 <> 0)"""


@query(f"""WITH {CHANGED} SELECT coalesce(f.path, g.path) AS path, CASE WHEN g.path IS NULL THEN 'missing' WHEN f.path IS NULL THEN 'added' WHEN f.text = g.text THEN 'matched' ELSE 'modified' END AS status,
f.size_bytes AS old_size, strlen(g.text)::BIGINT AS new_size, f.mtime::DOUBLE AS old_mtime, g.mtime::DOUBLE AS new_mtime FROM f FULL JOIN g ON f.path = g.path""")
def a17_snapshot_diff(spark, sf_dir):
    now = files(spark, sf_dir)
    old, new = (integrity.entries(x, "full", content_col="text") for x in (now, changed(now)))
    return integrity.diff(old, new, "full")


@query(f"""WITH {CHANGED} SELECT f.path, CASE WHEN g.path IS NULL THEN 'missing' WHEN strlen(f.text) <> strlen(g.text) THEN 'size_mismatch' WHEN f.text <> g.text THEN 'hash_mismatch' ELSE 'ok' END AS status FROM f LEFT JOIN g ON f.path = g.path""")
def j4_manifest_verify(spark, sf_dir):
    now = files(spark, sf_dir)
    kept = lambda x: x.select("path", "size_bytes", F.sha2("text", 256).alias("sha256"))
    return integrity.verify_manifest(kept(now), kept(changed(now)).withColumn("is_dir", F.lit(False)))


@query("SELECT count(*) AS total_files, sum(strlen(text))::BIGINT AS total_size_bytes FROM documents")
def a27_manifest_summary(spark, sf_dir):
    return integrity.manifest_summary(files(spark, sf_dir))


@query(f"WITH {FILES} SELECT doc_id, path FROM f WHERE strlen(text) < 20")
def a12_tiny_files(spark, sf_dir):
    """Files that a check for emptiness takes as empty if their first 19 bytes are padding."""
    rows = files(spark, sf_dir).withColumn("size_bytes", F.greatest(F.col("size_bytes") - 19, F.lit(0)))
    return integrity.with_corruption(rows).filter("is_corrupt").select("doc_id", "path")


@query("""WITH s AS (SELECT length(lang) AS width, length(source) AS height, count(*) AS n FROM documents GROUP BY 1, 2), m AS (SELECT * FROM s ORDER BY n DESC, width, height LIMIT 1)
SELECT m.width::INT AS width, m.height::INT AS height, (SELECT sum(n) FROM s)::BIGINT AS total, ((SELECT sum(n) FROM s) - m.n)::BIGINT AS outliers, round_even(((SELECT sum(n) FROM s) - m.n) * 100.0::DOUBLE / (SELECT sum(n) FROM s), 2) AS outlier_pct FROM m""")
def a13_dimension_outliers(spark, sf_dir):
    return quality.dimension_outliers(read(spark, sf_dir, "documents"), F.length("lang"), F.length("source"))


@query("SELECT quality::VARCHAR AS label, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1")
def a15_class_balance(spark, sf_dir):
    return quality.class_balance(read(spark, sf_dir, "labels"), "quality")


@query("""WITH b AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), c AS (SELECT count(*) AS n_classes, stddev_samp(n) / avg(n) * 100 AS cv FROM b) SELECT n_classes, round(cv, 6) AS cv_pct, CASE WHEN cv <= 30 THEN 'pass' WHEN cv <= 50 THEN 'warn' ELSE 'fail' END AS status FROM c""")
def a18_class_variation(spark, sf_dir):
    return quality.class_variation(quality.class_balance(read(spark, sf_dir, "embeddings"), "label")).withColumn("cv_pct", F.round("cv_pct", 6))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: (x - m) * (x - m))) / len(e)), 6) AS std FROM (SELECT vec_id, embedding::DOUBLE[] AS e, list_avg(embedding::DOUBLE[]) AS m FROM embeddings) WHERE sqrt(list_sum(list_transform(e, lambda x: (x - m) * (x - m))) / len(e)) < 0.125""")
def a16_flat_vectors(spark, sf_dir):
    return quality.flat_pixels(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.125).withColumn("std", F.round("std", 6))


def with_split(rows: DataFrame) -> DataFrame:
    return rows.withColumn("split", F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 9, "valid").otherwise("test"))


SPLIT = "SELECT *, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'valid' ELSE 'test' END AS split FROM documents"


@query(f"WITH s AS (SELECT DISTINCT split, sha256(text) AS k FROM ({SPLIT})) SELECT a.split AS split_a, b.split AS split_b, count(*) AS n_shared FROM s a JOIN s b ON a.k = b.k AND a.split < b.split GROUP BY 1, 2")
def j10_leakage(spark, sf_dir):
    return quality.leakage(with_split(read(spark, sf_dir, "documents")).withColumn("k", F.sha2("text", 256)), "split", "k")


@query(f"SELECT split, count(*) AS n FROM ({SPLIT}) GROUP BY 1")
def a22_split_counts(spark, sf_dir):
    return quality.split_counts(with_split(read(spark, sf_dir, "documents")), "split")


AUDIT = f"""{FILES}, d AS (SELECT count(*) AS n, max(size_bytes) AS size FROM f GROUP BY sha256(text) HAVING count(*) > 1), l AS (SELECT count(*) AS n FROM f GROUP BY lang),
r AS (SELECT (SELECT count(*) FROM f) AS total, (SELECT coalesce(sum(n), 0) FROM d) AS dup, (SELECT count(*) FROM d) AS g, (SELECT count(*) FROM f WHERE size_bytes = 0) AS z, (SELECT count(DISTINCT lower(suffix)) FROM p) AS x, (SELECT stddev_samp(n) / avg(n) * 100 FROM l) AS cv),
a AS (
  SELECT 'total_files' AS metric, total::DOUBLE AS value FROM r UNION ALL SELECT 'total_size_bytes', sum(size_bytes)::DOUBLE FROM f UNION ALL SELECT 'zero_byte_files', z FROM r UNION ALL SELECT 'n_extensions', x FROM r
  UNION ALL SELECT 'duplicate_groups', g FROM r UNION ALL SELECT 'duplicate_files', dup FROM r UNION ALL SELECT 'wasted_bytes', (SELECT coalesce(sum((n - 1) * size), 0) FROM d)
  UNION ALL SELECT 'duplicate_ratio_pct', round_even(dup * 100.0::DOUBLE / total, 2) FROM r
  UNION ALL SELECT 'hygiene_score', (CASE WHEN g > 0 THEN 30 ELSE 100 END + CASE WHEN cv <= 30 THEN 100 WHEN cv <= 50 THEN 70 ELSE 30 END) / 2 FROM r
  UNION ALL SELECT 'migration_blockers', (z > 0)::INT + (total = 0)::INT FROM r
  UNION ALL SELECT 'migration_readiness', CASE WHEN z > 0 OR total = 0 THEN 0 WHEN x <= 1 THEN 50 ELSE 100 END FROM r
  UNION ALL SELECT 'class_min_samples', min(n) FROM l
)"""


@query(f"WITH {AUDIT} SELECT metric, value::DOUBLE AS value FROM a")
def a22_audit(spark, sf_dir):
    return quality.audit(hashed(spark, sf_dir), label_col="lang")


@query(f"""WITH {AUDIT}, g AS (SELECT * FROM (VALUES ('duplicate_ratio_pct', 5.0, TRUE), ('zero_byte_files', 0.0, TRUE), ('hygiene_score', 70.0, FALSE), ('class_min_samples', 10.0, FALSE)) v(gate, threshold, lower))
SELECT gate, threshold::DOUBLE AS threshold, value::DOUBLE AS actual, CASE WHEN lower THEN value <= threshold ELSE value >= threshold END AS passed FROM g JOIN a ON metric = gate""")
def x4_gates(spark, sf_dir):
    report = quality.audit(hashed(spark, sf_dir), label_col="lang")
    policy = quality.gate_policy("version: 1\ngates: {duplicate_ratio_pct: 5, zero_byte_files: 0, hygiene_score: 70, class_min_samples: 10, unheard_of: 1}")
    return quality.check_gates(report, policy)


# relational verbs


@query("""SELECT 'l_quantity' AS "column", count(*) AS n, 0::BIGINT AS null_count, round(avg(l_quantity), 4) AS mean, round(stddev_samp(l_quantity), 4) AS std, min(l_quantity) AS "min", quantile_disc(l_quantity, 0.25) AS p25, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.75) AS p75, max(l_quantity) AS "max" FROM lineitem
UNION ALL SELECT 'l_extendedprice', count(*), 0, round(avg(l_extendedprice), 4), round(stddev_samp(l_extendedprice), 4), min(l_extendedprice), quantile_disc(l_extendedprice, 0.25), quantile_disc(l_extendedprice, 0.5), quantile_disc(l_extendedprice, 0.75), max(l_extendedprice) FROM lineitem""")
def a23_describe(spark, sf_dir):
    rows = relational.describe(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return rows.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("SELECT count(*) AS n, count(DISTINCT o_totalprice) AS n_unique, 0::BIGINT AS null_count, 0.0::DOUBLE AS null_pct, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS \"min\", max(o_totalprice) AS \"max\" FROM orders")
def a25_column_profile(spark, sf_dir):
    return relational.column_profile(read(spark, sf_dir, "orders"), "o_totalprice").withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def a25_value_counts(spark, sf_dir):
    return relational.value_counts(read(spark, sf_dir, "orders"), "o_orderpriority")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def a28_pricing_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ROLLUP (c_mktsegment, o_orderpriority)")
def a29_rollup(spark, sf_dir):
    both = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return both.rollup("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def a29_cube(spark, sf_dir):
    return read(spark, sf_dir, "documents").cube("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def j12_inner(spark, sf_dir):
    return read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def j12_left(spark, sf_dir):
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def j12_semi(spark, sf_dir):
    big = read(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j12_anti(spark, sf_dir):
    any_order = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").join(any_order, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def j12_anti_big_orders(spark, sf_dir):
    """Customers without a big order: some at any size of the tables."""
    big = read(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").join(big, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS n_customers, b.n AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def j12_full(spark, sf_dir):
    a = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_customers"))
    b = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_suppliers"))
    return a.join(b, "k", "full")


@query("SELECT r_name, o.p AS priority FROM region, (SELECT DISTINCT o_orderpriority AS p FROM orders) o")
def j12_cross(spark, sf_dir):
    """Two dimension tables of a few rows; Spark broadcasts one if its measured size allows."""
    return read(spark, sf_dir, "region").crossJoin(read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority")).distinct()).select("r_name", "priority")


@query("""WITH p AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL), e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')
SELECT event_id, p.value AS last_value FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def j12_as_of(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    found = relational.as_of(events.filter("event_type = 'click'").select("event_id", "user_id", "ts"), events.filter("event_type = 'purchase'").select("user_id", "ts", "value"), "ts", ["user_id"], ["value"], span=F.to_date)
    return found.select("event_id", F.col("value").alias("last_value"))


@query("SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) = 1")
def u1_unique(spark, sf_dir):
    return relational.unique(read(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["source", "lang"], ["doc_id"])


@query("SELECT 'customer' AS kind, c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def u2_union(spark, sf_dir):
    a = read(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return a.unionByName(read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")))


@query("SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def u3_set_operations(spark, sf_dir):
    a, b = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).select(F.lit("both").alias("kind"), "k").unionByName(a.subtract(b).select(F.lit("only").alias("kind"), "k"))


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('0:' || doc_id), doc_id) <= 3")
def u4_sample_per_source(spark, sf_dir):
    return relational.sample_per_group(read(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 3)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey DESC LIMIT 15")
def o1_sort_head(spark, sf_dir):
    return relational.sort(read(spark, sf_dir, "customer"), ["c_acctbal", "c_custkey"], descending=True).limit(15).select("c_custkey", "c_acctbal")


@query("SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def w1_top_per_group(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return read(spark, sf_dir, "customer").withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 3").select("c_nationkey", "c_custkey", "rank")


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders")
def w2_running_sum(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), F.lag("o_orderkey").over(w).alias("before"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS key, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def t1_windowed_counts(spark, sf_dir):
    return drift.windowed_counts(read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang IS NULL OR lang NOT IN ('de', 'en', 'es', 'fr')) AS other FROM documents GROUP BY 1")
def r1_pivot(spark, sf_dir):
    """All documents, by the languages of the tables; any other is counted as such."""
    kind = F.when(F.col("lang").isin("de", "en", "es", "fr"), F.col("lang")).otherwise("other")
    return read(spark, sf_dir, "documents").withColumn("kind", kind).groupBy("source").pivot("kind", ["de", "en", "es", "fr", "other"]).agg(F.count(F.lit(1))).fillna(0)


@query("SELECT s_suppkey, 'nation' AS field, s_nationkey::DOUBLE AS value FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier")
def r2_unpivot(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    return rows.unpivot(["s_suppkey"], ["nation", "balance"], "field", "value")


@query("SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS position, round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings")
def r3_explode(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("position", "x")).select("vec_id", F.col("position").cast("long"), F.round(F.col("x").cast("double"), 6).alias("x"))


# the queries over trees and the further ones over tables register themselves
from stonecrop.plans import table_queries, tree_queries  # noqa: E402, F401
