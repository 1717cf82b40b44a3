"""Further queries over the tables: joins, aggregates, windows, reshaping, frames, hashes and duplicates."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from stonecrop.functions import hashing, paths
from stonecrop.functions import text as text_functions
from stonecrop.operators import chunk_store, dedup, embed, integrity, profile, quality, relational, similarity
from stonecrop.operators.frame import FileFrame
from stonecrop.plans.queries import CHANGED, FILES, LEADERS, NEAR, SHINGLES, changed, files, hashed, query, read, sign_hashes
from stonecrop.sources import files as file_formats
from stonecrop.sources import images
from stonecrop.streaming import drift

# joins


@query("SELECT n_name, c_custkey FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 9000")
def j12_right(spark, sf_dir):
    rich = read(spark, sf_dir, "customer").filter("c_acctbal > 9000")
    return rich.join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "right").select("n_name", "c_custkey")


@query("""WITH b AS (SELECT b::BIGINT AS band, b * 25000.0::DOUBLE AS low, b * 25000.0::DOUBLE + 40000 AS high FROM range(20) t(b))
SELECT o_orderkey, band FROM orders JOIN b ON o_totalprice >= low AND o_totalprice < high""")
def j12_inequality(spark, sf_dir):
    """Orders with the price bands they are in; bands overlap."""
    bands = spark.range(20).select(F.col("id").alias("band"), (F.col("id") * 25000.0).alias("low"), (F.col("id") * 25000.0 + 40000).alias("high"))
    return relational.within(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), bands, "o_totalprice", "low", "high", 25000.0).select("o_orderkey", "band")


@query(f"WITH {CHANGED} SELECT g.path, g.mtime::VARCHAR AS mtime FROM g LEFT JOIN f ON f.path = g.path AND f.mtime = g.mtime WHERE f.path IS NULL")
def j5_changed_files(spark, sf_dir):
    """Files that a chunk store would have to take in again: those whose path and time it doesn't have."""
    now = files(spark, sf_dir)
    return chunk_store.changed_files(changed(now), now).select("path", F.col("mtime").cast("string").alias("mtime"))


@query(f"WITH {CHANGED}, t AS (SELECT path, text FROM g WHERE regexp_matches(path, '\\.(txt|TXT|md)$') AND trim(text) <> '') SELECT path, count(*) AS rows FROM t GROUP BY 1".replace("\\\\", "\\"))
def s33_chunk_store_files(spark, sf_dir):
    """The files of a chunk store after it has taken in the files and then the changed ones."""
    store = chunk_store.ChunkStore(spark, f"{file_formats.shared_dir(spark)}/chunks-{uuid.uuid4().hex}", max_tokens=4096)
    now = files(spark, sf_dir).select("path", "text", "mtime")
    store.index(now)
    store.index(changed(files(spark, sf_dir)).select("path", "text", "mtime"))
    return store.table.select("path").distinct().withColumn("rows", F.lit(1).cast("long"))


# aggregates


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
def a29_grouping_sets(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    sets = [[rows["l_returnflag"], rows["l_linestatus"]], [rows["l_linestatus"]], []]
    return rows.groupingSets(sets, "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) > 0 AS near FROM lineitem GROUP BY 1")
def a29_approximate_distinct(spark, sf_dir):
    """Whether the sketch is within a tenth of the exact count."""
    both = read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("exact"), F.approx_count_distinct("l_orderkey", 0.02).alias("sketch"))
    return both.select("l_returnflag", (F.abs(F.col("sketch") - F.col("exact")) <= 0.1 * F.col("exact")).alias("near"))


@query("""SELECT 'o_orderkey' AS "column", count(*) FILTER (o_orderkey IS NULL) AS null_count FROM orders UNION ALL SELECT 'o_custkey', count(*) FILTER (o_custkey IS NULL) FROM orders UNION ALL SELECT 'o_totalprice', count(*) FILTER (o_totalprice IS NULL) FROM orders
UNION ALL SELECT 'quality', count(*) FILTER (quality IS NULL) FROM documents LEFT JOIN labels USING (doc_id)""")
def a24_info(spark, sf_dir):
    labelled = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left").select("quality")
    both = relational.info(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")).unionByName(relational.info(labelled))
    return both.select("column", "null_count")


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, round(quantile_disc(l_quantity, 0.9), 4) AS p90 FROM lineitem")
def b1_correlation_and_quantile(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(F.expr("percentile_disc(0.9) within group (order by l_quantity)"), 4).alias("p90"))


@query(f"WITH {FILES} SELECT count(*) FILTER (n > 1) AS duplicate_count, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_file_count FROM (SELECT count(*) AS n FROM f GROUP BY text)")
def a14_equal_hashes(spark, sf_dir):
    return quality.equal_hashes(hashed(spark, sf_dir), "sha256")


@query("SELECT toxic::VARCHAR AS label, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY 1")
def a15_table_labels(spark, sf_dir):
    """Labels of a table of annotations: its first column but the file names."""
    given = read(spark, sf_dir, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), "toxic", "quality")
    return quality.class_balance(quality.labels_of(files(spark, sf_dir), given), "label")


# windows


@query("SELECT o_orderkey, sum(round(o_totalprice * 100)::BIGINT) OVER w AS cents, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate::DATE - DATE '1970-01-01' RANGE BETWEEN 90 PRECEDING AND CURRENT ROW)")
def w3_rolling_range(spark, sf_dir):
    """Sums over the ninety days up to each order of a customer."""
    w = Window.partitionBy("o_custkey").orderBy(F.unix_date(F.to_date("o_orderdate"))).rangeBetween(-90, 0)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).over(w).alias("cents"), F.count("*").over(w).alias("n"))


@query("SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1)::BIGINT AS index FROM events")
def b2_row_index(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "ts")
    return FileFrame(rows).with_row_index(["ts", "event_id"]).df.select("event_id", "index")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_custkey DESC LIMIT 7")
def o2_tail(spark, sf_dir):
    return FileFrame(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")).tail(7, ["c_custkey"]).df


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_custkey LIMIT 9")
def o4_head(spark, sf_dir):
    return FileFrame(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")).head(9).df


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS key, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def t2_streamed_counts(spark, sf_dir):
    """As ``t1_windowed_counts``, by a stream over all events that are there: what its last updates left of each window."""
    path = f"{file_formats.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = drift.windowed_counts(stream, late="3650 days")

    def keep(df, number):
        df.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{path}/rows")

    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/rows")
    last = rows.groupBy("window_start", "key").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return last.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "key", "x.n", F.round("x.total", 4).alias("total"))


# reshaping and frames


@query(
    "SELECT 'r_name' AS \"column\", " + ", ".join(f'max(r_name) FILTER (r_regionkey = {i}) AS "{i}"' for i in range(5)) + " FROM region UNION ALL SELECT 'twice', " + ", ".join(f"max(r_regionkey * 2) FILTER (r_regionkey = {i})::VARCHAR" for i in range(5)) + " FROM region"
)
def r4_transpose(spark, sf_dir):
    """A row a column, and a column for each of the five regions."""
    rows = read(spark, sf_dir, "region").select("r_regionkey", "r_name", (F.col("r_regionkey") * 2).alias("twice"))
    return relational.transpose(rows, "r_regionkey").select("column", *map(str, range(5)))


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def r5_unnest(spark, sf_dir):
    packed = read(spark, sf_dir, "supplier").select("s_suppkey", F.struct("s_name", "s_nationkey").alias("x"))
    return relational.unnest(packed, "x")


@query("SELECT lang, count(*) AS n, max(n_chars) AS longest FROM documents GROUP BY 1")
def b3_frame_sql(spark, sf_dir):
    return FileFrame(read(spark, sf_dir, "documents")).sql("select lang, count(*) as n, max(n_chars) as longest from {self} group by lang").df


@query("SELECT r_regionkey, r_name, 'x' AS kind, r_regionkey * 2 AS twice, (100 + row_number() OVER (ORDER BY r_name) - 1)::BIGINT AS given FROM region")
def p11_assign(spark, sf_dir):
    """A constant, an expression, and a list by the order of names."""
    frame = FileFrame(read(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    frame = frame.with_value("kind", "x").with_value("twice", F.col("r_regionkey") * 2)
    return frame.with_value("given", [100 + i for i in range(len(frame))], order="r_name").df.select("r_regionkey", "r_name", "kind", "twice", "given")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS valid FROM events")
def b4_json(spark, sf_dir):
    """A key of JSON texts, and whether they are any."""
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$").isNotNull().alias("valid"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, epoch(date_trunc('second', ts))::BIGINT AS seconds, isodow(ts) AS weekday FROM events")
def b5_times(spark, sf_dir):
    """A time as ISO text, back to seconds, and its day of the week."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    read_again = F.to_timestamp_ntz(iso)
    seconds = F.unix_date(F.to_date(read_again)).cast("long") * 86400 + F.hour(read_again) * 3600 + F.minute(read_again) * 60 + F.second(read_again)
    return read(spark, sf_dir, "events").select("event_id", iso.alias("iso"), seconds.alias("seconds"), (F.weekday("ts") + 1).cast("long").alias("weekday"))


@query(f"WITH {FILES} SELECT path, parent, name, left(name, length(name) - length(suffix)) AS stem, suffix, 3::BIGINT AS depth, size_bytes FROM p")
def p6_enrich(spark, sf_dir):
    """Components and depth of a frame that has its stats."""
    frame = FileFrame(files(spark, sf_dir).select("path", "size_bytes")).enrich()
    return frame.df.select("path", "parent", "name", "stem", "suffix", "depth", "size_bytes")


# texts, hashes, duplicates


@query(f"WITH {SHINGLES} SELECT a.doc_id AS a, b.doc_id AS b, round(CASE WHEN len(a.items) + len(b.items) = 0 THEN 1 ELSE len(list_intersect(a.items, b.items)) / (len(a.items) + len(b.items) - len(list_intersect(a.items, b.items))) END, 6) AS similarity FROM s a JOIN s b ON b.doc_id = a.doc_id + 1")
def p15_jaccard(spark, sf_dir):
    """Similarity of each document to the next one."""
    rows = read(spark, sf_dir, "documents").select("doc_id", text_functions.shingles(F.col("text")).alias("items"))
    rows = file_formats.materialize(rows, "shingles")
    a, b = rows.alias("a"), rows.alias("b")
    both = a.join(b, F.col("b.doc_id") == F.col("a.doc_id") + 1)
    return both.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), F.round(text_functions.jaccard(F.col("a.items"), F.col("b.items")), 6).alias("similarity"))


@query(f"WITH {SHINGLES} SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(items)) AS first, TRUE AS equal FROM s")
def p16_equal_signatures(spark, sf_dir):
    """Whether a document has the signature of the first one with an equal set of shingles."""
    rows = read(spark, sf_dir, "documents").select("doc_id", text_functions.shingles(F.col("text")).alias("items"))
    made = similarity.classes_of_sets(rows, "doc_id", "items").select("doc_id", "rep", text_functions.minhash(F.col("items"), 8).alias("m"))
    first = made.select(F.col("doc_id").alias("rep"), F.col("m").alias("of_first"))
    return made.join(first, "rep").select("doc_id", F.col("rep").alias("first"), (F.col("m") == F.col("of_first")).alias("equal"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_avg(embedding::DOUBLE[]) AS m FROM embeddings)
SELECT vec_id, lpad(lower(to_hex(array_to_string(list_transform(e, lambda x: CASE WHEN x >= m THEN '1' ELSE '0' END), '')::BIT::UBIGINT)), 16, '0') AS ahash FROM v""")
def p17_average_hash(spark, sf_dir):
    """Of 64 values as if they were gray."""
    gray = F.transform("embedding", lambda x: x.cast("double"))
    return read(spark, sf_dir, "embeddings").select("vec_id", hashing.average_hash(gray).alias("ahash"))


@query(f"""WITH {NEAR}, {LEADERS}, d AS (SELECT doc_id, '/data/' || source || '/' || lang || '/' || lang || '_' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.TXT' WHEN 3 THEN '.tar.gz' ELSE '' END AS path, text FROM documents)
SELECT 'exact' AS category, path FROM d QUALIFY count(*) OVER (PARTITION BY text) > 1
UNION ALL SELECT 'text', path FROM d JOIN (SELECT doc_id FROM grouped QUALIFY count(*) OVER (PARTITION BY leader) > 1) USING (doc_id)""")
def a11_find_duplicates(spark, sf_dir):
    """Exact and text groups of all documents, by number, as mode auto does; ids lead in the order of numbers."""
    rows = hashed(spark, sf_dir)
    found = dedup.find_duplicates(rows.select("doc_id", "sha256", "text", F.concat("path").alias("path")).withColumn("path", F.format_string("%020d", "doc_id")), "auto")
    return found.join(rows.select(F.format_string("%020d", "doc_id").alias("path"), F.col("path").alias("real")), "path").select("category", F.col("real").alias("path"))


@query("""WITH v AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '') AS bits FROM embeddings) SELECT count(DISTINCT bits) AS hashes, count(*) AS rows FROM v""")
def a11_image_groups(spark, sf_dir):
    """Distinct perceptual hashes and rows of image groups and of what is in none, with hashes of vectors as those of images."""
    rows = sign_hashes(spark, sf_dir).select(F.concat(F.col("vec_id").cast("string"), F.lit(".png")).alias("path"), F.col("hash").alias("image_hash"))
    grouped = dedup.near_image_groups(rows, max_distance=0)
    per = rows.join(grouped, "path", "left").groupBy("image_hash").agg(F.count("*").alias("n"), F.countDistinct("group_id").alias("groups"))
    return per.agg(F.count("*").alias("hashes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


@query(f"WITH {FILES} SELECT parent AS folder, count(*) AS n_files, sum(size_bytes)::BIGINT AS bytes FROM p GROUP BY 1")
def s4_path_aggregates(spark, sf_dir):
    """Aggregates over a given list of paths, without a scan."""
    entries = profile.tree_of(files(spark, sf_dir), size_col="size_bytes").filter("not is_dir")
    return entries.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("bytes"))


@query("SELECT vec_id AS id, len(embedding)::INT AS n, TRUE AS found FROM embeddings")
def p9_image_embedding(spark, sf_dir):
    """Vectors of image bytes by a caller's embedder, here the bytes' own values; none for what is no image."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.col("vec_id").cast("string"), F.lit(".PNG")).alias("path"), F.array_join(F.transform("embedding", lambda x: F.when(x >= 0, "b").otherwise("a")), "").cast("binary").alias("content"))
    made = embed.image_embedding(rows, embedder=lambda images: [[float(b) for b in x] for x in images])
    return made.select("id", F.size("image_embedding").alias("n"), F.forall("image_embedding", lambda x: x.isin(97.0, 98.0)).alias("found"))


@query(f"WITH {CHANGED}, j AS (SELECT f.path AS a, g.path AS b, f.text = g.text AS same FROM f FULL JOIN g ON f.path = g.path) SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND same) AS matched, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND NOT same) AS modified, count(*) FILTER (b IS NULL) AS missing, count(*) FILTER (a IS NULL) AS added FROM j")
def a17_drift_by_deep_hash(spark, sf_dir):
    """Counts of changes by the hashes of a deep snapshot, here without times, which don't change."""
    now = files(spark, sf_dir)
    old, new = (integrity.entries(x, "deep", content_col="text") for x in (now, changed(now)))
    return integrity.drift(integrity.diff(old, new, "deep"))


@query("SELECT event_id, value FROM events WHERE value IS NOT NULL ORDER BY value DESC, event_id LIMIT 12")
def o3_frame_largest(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "value", F.format_string("%020d", "event_id").alias("path"))
    return FileFrame(rows).largest(12, column="value").df.select("event_id", "value")




@query("SELECT event_id, len(json_keys(props))::INT AS n_keys, list_sort(json_keys(props)) AS keys FROM events")
def b6_map(spark, sf_dir):
    """JSON objects as maps: how many keys, and which."""
    m = F.from_json("props", "map<string,string>")
    return read(spark, sf_dir, "events").select("event_id", F.size(m).alias("n_keys"), F.array_sort(F.map_keys(m)).alias("keys"))


@query("SELECT * FROM (VALUES (0, 'enrich'), (1, 'filter_by_extension'), (2, 'filter'), (3, 'noted'), (4, 'groupBy.count')) t(step, operation)")
def p12_lineage(spark, sf_dir):
    """The steps that a frame has been through."""
    frame = FileFrame(files(spark, sf_dir).select("path", "size_bytes")).enrich().filter_by_extension("txt").filter("size_bytes > 0").add_lineage_entry("noted", why="test").groupBy("parent").count()
    return spark.createDataFrame([(i, x["operation"]) for i, x in enumerate(frame.lineage)], "step int, operation string")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(255, floor((x::DOUBLE + 1) * 100)::INT))) AS p FROM embeddings),
m AS (SELECT vec_id, p, list_sum(p) / 64.0::DOUBLE AS mean FROM v)
SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN NULL ELSE 8 END AS width, CASE WHEN vec_id % 10 = 0 THEN NULL ELSE list_min(p)::DOUBLE END AS least, CASE WHEN vec_id % 10 = 0 THEN NULL ELSE list_max(p)::DOUBLE END AS greatest,
       CASE WHEN vec_id % 10 = 0 THEN NULL ELSE round(mean, 6) END AS mean, CASE WHEN vec_id % 10 = 0 THEN NULL ELSE len(list_distinct(p)) END AS distinct_values,
       CASE WHEN vec_id % 10 = 0 THEN NULL ELSE round(sqrt(list_sum(list_transform(p, lambda x: (x - mean) * (x - mean))) / 64), 6) END AS std, CASE WHEN vec_id % 10 = 0 THEN 'not implemented' ELSE 'ok' END AS status FROM m""")
def s16_image_profiles(spark, sf_dir):
    """Vectors as gray PNG of eight rows, decoded and profiled; each tenth is called an array file, which has no profile."""
    @F.pandas_udf("binary")
    def drawn(vectors):
        return vectors.map(lambda v: images.encode_png(np.clip(np.floor((np.asarray(v, float) + 1) * 100), 0, 255).astype(np.uint8).reshape(8, 8)))

    name = F.concat(F.col("vec_id").cast("string"), F.when(F.col("vec_id") % 10 == 0, ".npy").otherwise(".png"))
    rows = read(spark, sf_dir, "embeddings").select(name.alias("path"), drawn("embedding").alias("content"))
    made = images.profiles(rows)
    return made.select(F.split("path", r"\.")[0].cast("long").alias("vec_id"), "width", F.col("min").alias("least"), F.col("max").alias("greatest"), F.round("mean", 6).alias("mean"), F.col("unique").alias("distinct_values"), F.round("std", 6).alias("std"), "status")


def drawings(spark, sf_dir):
    """Vectors as gray PNG: (vec_id, path, content, size_bytes). Each seventh is 16 by 4 pixels, the others 8 by 8; of each eleventh the end is cut off, and each thirteenth is empty."""
    @F.pandas_udf("binary")
    def drawn(vectors, ids):
        def one(v, i):
            pixels = np.clip(np.floor((np.asarray(v, float) + 1) * 100), 0, 255).astype(np.uint8)
            whole = images.encode_png(pixels.reshape(*((4, 16) if i % 7 == 0 else (8, 8))))
            return b"" if i % 13 == 0 else whole[:-15] if i % 11 == 0 else whole

        return vectors.combine(ids, one)

    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("img/"), F.col("vec_id").cast("string"), F.lit(".png")).alias("path"), drawn("embedding", "vec_id").alias("content"))
    return rows.withColumn("size_bytes", F.octet_length("content").cast("long"))


@query("SELECT vec_id, CASE WHEN vec_id % 13 = 0 THEN 'zero_byte' WHEN vec_id % 11 = 0 THEN 'corrupt_or_unsupported' END AS corruption_reason FROM embeddings")
def a12_damaged_images(spark, sf_dir):
    return integrity.with_corruption(drawings(spark, sf_dir), content_col="content").select("vec_id", "corruption_reason")


#: Sizes of the drawings that are whole.
_SIZES = "s AS (SELECT CASE WHEN vec_id % 7 = 0 THEN 16 ELSE 8 END AS width, CASE WHEN vec_id % 7 = 0 THEN 4 ELSE 8 END AS height, count(*) AS n FROM embeddings WHERE vec_id % 13 <> 0 AND vec_id % 11 <> 0 GROUP BY 1, 2), m AS (SELECT * FROM s ORDER BY n DESC, width, height LIMIT 1), o AS (SELECT m.width, m.height, (SELECT sum(n) FROM s)::BIGINT AS total, ((SELECT sum(n) FROM s) - m.n)::BIGINT AS outliers FROM m)"


def _sizes(spark, sf_dir):
    found = images.profiles(drawings(spark, sf_dir)).filter("status = 'ok'")
    return quality.dimension_outliers(found, F.col("width"), F.col("height"))


@query(f"WITH {_SIZES} SELECT width, height, total, outliers, round_even(outliers * 100.0::DOUBLE / total, 2) AS outlier_pct FROM o")
def a13_image_dimensions(spark, sf_dir):
    return _sizes(spark, sf_dir)


@query(f"""WITH {_SIZES}, p AS (SELECT 100 - round_even(outliers * 100.0::DOUBLE / total, 2) AS good FROM o), g AS (SELECT count(*) AS n FROM (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1)),
c AS (SELECT stddev_samp(n) / avg(n) * 100 AS cv FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)),
x AS (SELECT 'dimension_consistency' AS metric, good AS value, CASE WHEN good >= 95 THEN 100 WHEN good >= 90 THEN 70 ELSE 30 END AS points FROM p UNION ALL SELECT 'duplicate_files', n, CASE WHEN n > 0 THEN 30 ELSE 100 END FROM g UNION ALL SELECT 'class_balance', cv, CASE WHEN cv <= 30 THEN 100 WHEN cv <= 50 THEN 70 ELSE 30 END FROM c)
SELECT metric, round(value::DOUBLE, 6) AS value FROM x UNION ALL SELECT 'score', round(avg(points), 6) FROM x""")
def a19_hygiene(spark, sf_dir):
    """Consistency of the drawings' sizes, duplicates of the documents and balance of the vectors' labels, and the score of the three."""
    groups = quality.equal_hashes(hashed(spark, sf_dir), "sha256").first()["duplicate_count"]
    cv = quality.class_variation(quality.class_balance(read(spark, sf_dir, "embeddings"), "label")).first()["cv_pct"]
    made = quality.hygiene(_sizes(spark, sf_dir).first()["outlier_pct"], groups, cv)
    rows = [(k, round(float(v), 6)) for k, (v, _) in made["metrics"].items()] + [("score", round(made["score"], 6))]
    return spark.createDataFrame(rows, "metric string, value double")


@query(f"""WITH {FILES}, s AS (SELECT count(*) AS n, count(*) FILTER (size_bytes = 0) AS failed, count(DISTINCT lower(suffix)) AS kinds FROM p)
SELECT CASE WHEN failed > 0 OR n = 0 THEN 0.0 WHEN kinds <= 1 THEN 50.0 ELSE 100.0 END::DOUBLE AS readiness, (failed > 0)::BIGINT + (n = 0)::BIGINT AS blockers, failed * 0.1::DOUBLE AS effort_hours, greatest(0.1::DOUBLE, n * 0.0001::DOUBLE) AS migration_hours FROM s""")
def a21_readiness(spark, sf_dir):
    one = files(spark, sf_dir).agg(F.count("*").alias("n"), F.count(F.when(F.col("size_bytes") == 0, 1)).alias("failed"), F.countDistinct(profile.extension()).alias("kinds")).first()
    made = quality.migration_readiness(one["n"], one["failed"], one["kinds"])
    return spark.createDataFrame([tuple(made.values())], "readiness double, blockers long, effort_hours double, migration_hours double")


@query(f"""WITH {FILES}, d AS (SELECT DISTINCT path, 3::BIGINT AS depth FROM f UNION SELECT '/data', 0 UNION SELECT '/data/' || source, 1 FROM f UNION SELECT '/data/' || source || '/' || lang, 2 FROM f) SELECT * FROM d""")
def p4_depths(spark, sf_dir):
    """Depths of files and folders below their common root."""
    entries = profile.tree_of(files(spark, sf_dir)).filter("path <> '/'").select("path")
    return paths.with_depth(entries)
