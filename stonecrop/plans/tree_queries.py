"""Queries over a real directory tree: the documents written as files into the shared folder, once a session and table.

Paths in results are relative to that tree's root. Some files and a folder are hidden, and each source has an empty folder.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stonecrop import api
from stonecrop.functions import kinds
from stonecrop.operators import integrity, profile, quality, report, tools
from stonecrop.operators.frame import FileFrame
from stonecrop.operators.pipeline import Dataset, Pipeline
from stonecrop.plans.queries import query, read
from stonecrop.sources import files as file_formats
from stonecrop.sources import tree

#: Roots by session and table.
_roots: dict[tuple[str, str], str] = {}


def planted_path() -> Column:
    end = F.when(F.col("doc_id") % 5 == 0, ".txt").when(F.col("doc_id") % 5 == 1, ".md").when(F.col("doc_id") % 5 == 2, ".TXT").when(F.col("doc_id") % 5 == 3, ".tar.gz").otherwise("")
    folder = F.when(F.col("doc_id") % 7 == 0, "data/.cache/").otherwise(F.concat(F.lit("data/"), "source", F.lit("/"), "lang", F.lit("/")))
    return F.concat(folder, F.when(F.col("doc_id") % 9 == 0, ".").otherwise(""), "lang", F.lit("_"), F.col("doc_id").cast("string"), end)


#: The files and folders of the tree in SQL.
PLANTED = r"""pf AS (
  SELECT doc_id, text, source, lang, strlen(text)::BIGINT AS size_bytes, doc_id * 60 AS mtime,
         CASE WHEN doc_id % 7 = 0 THEN 'data/.cache/' ELSE 'data/' || source || '/' || lang || '/' END || CASE WHEN doc_id % 9 = 0 THEN '.' ELSE '' END || lang || '_' || doc_id
         || CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.TXT' WHEN 3 THEN '.tar.gz' ELSE '' END AS path
  FROM documents
), pd AS (
  SELECT 'data' AS path UNION SELECT 'data/.cache' FROM pf WHERE doc_id % 7 = 0 UNION SELECT 'data/' || source FROM pf UNION SELECT 'data/' || source || '/empty' FROM pf
  UNION SELECT 'data/' || source || '/' || lang FROM pf WHERE doc_id % 7 <> 0
), pe AS (
  SELECT *, len(string_split(path, '/'))::BIGINT AS depth, regexp_extract(path, '([^/]*)$', 1) AS name, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS parent
  FROM (SELECT path, FALSE AS is_dir, size_bytes, doc_id, mtime, text FROM pf UNION ALL SELECT path, TRUE, NULL, NULL, NULL, NULL FROM pd)
), px AS (SELECT *, regexp_extract(name, '^.+?(\.[^.]+)$', 1) AS suffix FROM pe)"""


def planted(spark: SparkSession, sf_dir: str) -> str:
    """The root of the tree; files are written by the tasks."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _roots:
        # a scanned tree is one that the machines have mounted
        root = f"{file_formats.shared_dir(spark).removeprefix('file://').removeprefix('file:')}/planted-{uuid.uuid4().hex}"
        docs = read(spark, sf_dir, "documents")

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, source, text, doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for folder in (os.path.dirname(f"{root}/{path}"), f"{root}/data/{source}/empty"):
                        os.makedirs(folder, exist_ok=True)
                    with open(f"{root}/{path}", "wb") as out:
                        out.write((text or "").encode())
                    os.utime(f"{root}/{path}", (doc * 60, doc * 60))
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

        docs.select(planted_path().alias("path"), "source", "text", "doc_id").mapInArrow(write, "n long").agg(F.sum("n")).collect()
        _roots[key] = root
    return _roots[key]


def relative(df: DataFrame, root: str, *columns: str) -> DataFrame:
    """``df`` with the columns' paths below ``root``."""
    return df.withColumns({c: F.when(F.col(c) == root, ".").otherwise(F.regexp_replace(c, "^" + root.replace(".", r"\.") + "/", "")) for c in columns or ("path",)})


# scans


@query(f"WITH {PLANTED} SELECT count(*) FILTER (NOT is_dir) AS total_files, count(*) FILTER (is_dir) + 1 AS total_folders, sum(size_bytes)::BIGINT AS total_size_bytes, max(depth) AS max_depth, count(*) FILTER (is_dir AND path NOT IN (SELECT parent FROM pe)) AS empty_folder_count FROM pe")
def s1_probe(spark, sf_dir):
    return api.probe(spark, planted(spark, sf_dir)).summary.select("total_files", "total_folders", "total_size_bytes", "max_depth", "empty_folder_count")


@query(f"""WITH {PLANTED}, a AS (
  SELECT 'depth ' || depth AS what, count(*) AS n FROM pe WHERE is_dir GROUP BY depth UNION ALL SELECT 'depth 0', 1
  UNION ALL SELECT 'empty ' || path, 1 FROM pe WHERE is_dir AND path NOT IN (SELECT parent FROM pe)
  UNION ALL SELECT 'extension ' || CASE WHEN suffix = '' THEN '<no extension>' ELSE lower(suffix) END, count(*) FROM px WHERE NOT is_dir GROUP BY 1
) SELECT * FROM a""")
def s2_profile_reports(spark, sf_dir):
    root = planted(spark, sf_dir)
    p = Dataset(spark, root).probe()
    label = lambda kind, c: F.concat(F.lit(kind + " "), F.col(c).cast("string")).alias("what")
    empty = relative(p.empty_folders, root).select(label("empty", "path"), F.lit(1).cast("long").alias("n"))
    return p.depth_distribution.select(label("depth", "depth"), F.col("n_folders").alias("n")).unionByName(empty).unionByName(p.file_extensions.select(label("extension", "extension"), F.col("len").alias("n")))


@query(f"WITH {PLANTED} SELECT path, NOT is_dir AS is_file, is_dir, depth, size_bytes, mtime::DOUBLE AS mtime FROM pe")
def s3_scan(spark, sf_dir):
    root = planted(spark, sf_dir)
    rows = relative(tree.scan(spark, root), root)
    on_file = lambda c: F.when(F.col("is_file"), F.col(c)).alias(c)
    return rows.select("path", "is_file", "is_dir", "depth", on_file("size_bytes"), on_file("mtime"))


@query(f"WITH {PLANTED} SELECT path, is_dir, depth, size_bytes FROM pe")
def s6_lean_scan(spark, sf_dir):
    root = planted(spark, sf_dir)
    rows = relative(tree.scan(spark, root, lean=True), root)
    return rows.select("path", "is_dir", "depth", F.when(~F.col("is_dir"), F.col("size_bytes")).alias("size_bytes"))


@query(f"WITH {PLANTED} SELECT path, is_dir FROM pe WHERE depth <= CASE WHEN is_dir THEN 2 ELSE 3 END")
def s5_max_depth(spark, sf_dir):
    root = planted(spark, sf_dir)
    return relative(tree.scan(spark, root, max_depth=2), root).select("path", "is_dir")


@query(f"WITH {PLANTED} SELECT path, is_dir FROM pe WHERE NOT regexp_matches(path, '(^|/)\\.')".replace("\\\\", "\\"))
def s31_without_hidden(spark, sf_dir):
    root = planted(spark, sf_dir)
    return relative(tree.scan(spark, root, hidden=False, with_stats=False), root).select("path", "is_dir")


@query(f"WITH {PLANTED} SELECT path FROM pe WHERE is_dir AND path NOT IN (SELECT parent FROM pe)")
def s8_empty_by_anti_join(spark, sf_dir):
    """Folders that are no entry's parent, by a join, as no entry counts are read."""
    root = planted(spark, sf_dir)
    return relative(profile.empty_folders(tree.scan(spark, root, with_stats=False)), root).select("path")


@query(f"""WITH {PLANTED}, l AS (SELECT path, doc_id FROM pf UNION ALL SELECT path || '.gone', -1 FROM pf WHERE doc_id % 10 = 0)
SELECT l.path, pf.path IS NOT NULL AS there, pf.size_bytes, pf.mtime = l.doc_id * 60 AS same_time, sha256(pf.text) AS sha256, '{{}}' AS xattrs FROM l LEFT JOIN pf ON pf.path = l.path""")
def s4_path_list(spark, sf_dir):
    """Stats and hashes of a list of paths, of which some don't exist."""
    docs = read(spark, sf_dir, "documents").select("doc_id", planted_path().alias("path"))
    listed = docs.unionByName(docs.filter("doc_id % 10 = 0").select(F.lit(-1).cast("long").alias("doc_id"), F.concat("path", F.lit(".gone")).alias("path")))
    rows = tree.stat_paths(listed, base=planted(spark, sf_dir), compute_hash=True)
    time = F.unix_timestamp(F.to_timestamp("modified_time", "yyyy-MM-dd HH:mm:ss"))
    # times are those of the machine's zone; all of them differ by the same hours
    return rows.select("path", F.coalesce("is_file", F.lit(False)).alias("there"), "size_bytes", ((time - F.col("doc_id") * 60) % 900 == 0).alias("same_time"), "sha256", "xattrs")


@query(f"WITH {PLANTED} SELECT path, parent, name, left(name, length(name) - length(suffix)) AS stem, suffix, depth, size_bytes FROM px WHERE NOT is_dir")
def s11_probe_to_frame(spark, sf_dir):
    root = planted(spark, sf_dir)
    frame = api.probe_to_frame(spark, root)
    return relative(frame.df.filter("is_file"), root, "path", "parent").select("path", "parent", "name", "stem", "suffix", "depth", "size_bytes")


@query(f"WITH {PLANTED} SELECT path FROM pe WHERE is_dir AND regexp_matches(name, '(?i)^e')")
def s22_find_directories(spark, sf_dir):
    root = planted(spark, sf_dir)
    return relative(tree.find_directories(tree.scan(spark, root, with_stats=False), "^E"), root).select("path")


@query(f"WITH {PLANTED} SELECT path FROM px WHERE NOT is_dir AND lower(suffix) IN ('.txt', '.md') AND mtime >= (SELECT max(mtime) FROM pf) - 7200")
def s24_recent_of_extension(spark, sf_dir):
    root = planted(spark, sf_dir)
    rows = tree.scan(spark, root).filter("is_file")
    return relative(tree.find_recent(rows, "2h", now=rows.agg(F.max("mtime")).first()[0] or 0, extension="txt, md"), root).select("path")


@query(f"WITH {PLANTED} SELECT count(*) FILTER (NOT is_dir) AS files, count(*) FILTER (is_dir) AS directories, count(*) AS total FROM pe WHERE NOT regexp_matches(path, '(^|/)\\.')".replace("\\\\", "\\"))
def x7_count_files(spark, sf_dir):
    return tree.counts(tree.scan(spark, planted(spark, sf_dir), hidden=False, with_stats=False))


@query(f"WITH {PLANTED} SELECT path FROM pe ORDER BY path LIMIT 20")
def s32_sample_paths(spark, sf_dir):
    root = planted(spark, sf_dir)
    return relative(spark.createDataFrame([(p,) for p in api.sample_paths(spark, root)], "path string"), root)


@query(f"WITH {PLANTED}, o AS (SELECT name, is_dir, (row_number() OVER (ORDER BY NOT is_dir, lower(name), name))::INT AS place FROM pe WHERE parent = 'data') SELECT * FROM o")
def s35_listing(spark, sf_dir):
    rows = tree.listing(tree.scan(spark, planted(spark, sf_dir) + "/data")).select("name", "is_dir").collect()
    return spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], "name string, is_dir boolean, place int")


@query(f"WITH {PLANTED} SELECT path, array_to_string(string_split(text, chr(10))[1:2], chr(10)) AS lines FROM pf")
def s34_read_lines(spark, sf_dir):
    """The first two lines of all files, read from the tree."""
    root = planted(spark, sf_dir)
    docs = read(spark, sf_dir, "documents").select(planted_path().alias("path"))
    return api.read_lines(docs.withColumn("path", F.concat(F.lit(root + "/"), "path")), 1, 2).transform(lambda df: relative(df, root)).select("path", "lines")


@query(f"WITH {PLANTED} SELECT path FROM px WHERE NOT is_dir AND lower(name) LIKE 'en%.txt'")
def s30_search_stream(spark, sf_dir):
    root = planted(spark, sf_dir)
    found = tree.search_stream(tree.scan(spark, root, with_stats=False), "en*.txt", glob=True)
    return relative(spark.createDataFrame([(p,) for p in found], "path string"), root)


# files in and out


ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def _there_and_back(spark: SparkSession, df: DataFrame, suffix: str, **options: str) -> DataFrame:
    path = f"{file_formats.shared_dir(spark)}/saved-{uuid.uuid4().hex}.{suffix}"
    FileFrame(df).save(path, **options)
    return FileFrame.load(spark, path, **options).df.select(*df.columns)


@query(ORDERS)
def k1_csv(spark, sf_dir):
    return _there_and_back(spark, _orders(spark, sf_dir), "csv")


@query(ORDERS)
def k2_parquet(spark, sf_dir):
    return _there_and_back(spark, _orders(spark, sf_dir), "pq")


@query(ORDERS)
def k3_json(spark, sf_dir):
    return _there_and_back(spark, _orders(spark, sf_dir), "jsonl")


@query("SELECT item_id, text FROM benchmark")
def k4_json_array(spark, sf_dir):
    """One file that holds an array, written a row at a time, and read as rows."""
    path = f"{file_formats.shared_dir(spark)}/saved-{uuid.uuid4().hex}.json"
    rows = read(spark, sf_dir, "benchmark").select("item_id", "text")
    file_formats.save_array(rows, path)
    return file_formats.load(spark, path, schema=rows.schema)


@query("SELECT r_regionkey, r_name FROM region")
def k5_exports(spark, sf_dir):
    """Through Arrow, pandas, rows and columns, one after another; of a table of a few rows."""
    frame = FileFrame(read(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    schema = frame.df.schema
    for made in (frame.to_arrow().to_pylist(), frame.to_pandas().to_dict("records"), [dict(zip(frame.columns, r, strict=True)) for r in frame.iter_rows()], [dict(zip(frame.to_dict(), x, strict=True)) for x in zip(*frame.to_dict().values(), strict=True)]):
        frame = FileFrame(spark.createDataFrame([tuple(r[c] for c in schema.names) for r in made], schema))
    return frame.df


# integrity


@query(f"WITH {PLANTED} SELECT path, size_bytes AS size, mtime::DOUBLE AS mtime, sha256(text) AS hash_full FROM pf")
def k6_saved_snapshot(spark, sf_dir):
    """A full snapshot of the tree, saved and read again."""
    root = planted(spark, sf_dir)
    path = f"{file_formats.shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    api.snapshot(spark, root, "full", path)
    return relative(integrity.Snapshot.load(spark, path).entries, root).select("path", "size", "mtime", "hash_full")


@query(f"WITH {PLANTED} SELECT path, size_bytes, sha256(text) AS sha256 FROM pf")
def k7_saved_manifest(spark, sf_dir):
    root = planted(spark, sf_dir)
    path = f"{file_formats.shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    found = tree.scan(spark, root, compute_hash=True).filter("is_file").select("path", "size_bytes", "modified_time", "sha256")
    integrity.save_manifest(found, path)
    return relative(integrity.load_manifest(spark, path)[0], root).select("path", "size_bytes", "sha256")


@query(f"WITH {PLANTED} SELECT path, CASE WHEN regexp_matches(path, '(^|/)\\.') THEN 'missing' ELSE 'matched' END AS status FROM pf".replace("\\\\", "\\"))
def x3_verify_snapshot(spark, sf_dir):
    """A snapshot with hidden files against one without."""
    root = planted(spark, sf_dir)
    before, later = (Dataset(spark, root).snap("fast", include_hidden=h) for h in (True, False))
    return relative(before.verify(later), root).select("path", "status")


@query(f"WITH {PLANTED} SELECT path, CASE WHEN doc_id % 11 = 0 THEN 'size_mismatch' WHEN doc_id % 13 = 0 THEN 'hash_mismatch' ELSE 'ok' END AS status FROM pf UNION ALL SELECT path || '.gone', 'missing' FROM pf WHERE doc_id % 10 = 0")
def j4_manifest_against_tree(spark, sf_dir):
    """A manifest with some wrong sizes and hashes, and files that aren't there, against the tree."""
    root = planted(spark, sf_dir)
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(root + "/"), planted_path()).alias("path"), F.octet_length("text").cast("long").alias("size_bytes"), F.sha2("text", 256).alias("sha256"))
    wrong = docs.withColumns({"size_bytes": F.when(F.col("doc_id") % 11 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")), "sha256": F.when(F.col("doc_id") % 13 == 0, "0").otherwise(F.col("sha256"))})
    gone = docs.filter("doc_id % 10 = 0").withColumn("path", F.concat("path", F.lit(".gone")))
    return relative(api.verify(spark, root, wrong.unionByName(gone).select("path", "size_bytes", "sha256")), root)


@query(f"WITH {PLANTED} SELECT path FROM pf WHERE regexp_matches(path, '^(.*/)?en/[^/]*7[^/]*\\.txt$')".replace("\\\\", "\\"))
def f8_snapshot_pattern(spark, sf_dir):
    """A glob of two segments on the ends of paths."""
    root = planted(spark, sf_dir)
    return relative(Dataset(spark, root).snap("fast", pattern="en/*7*.txt").entries, root).select("path")


@query(f"WITH {PLANTED} SELECT path, size_bytes = 0 AS is_corrupt FROM pf")
def x5_corrupted(spark, sf_dir):
    root = planted(spark, sf_dir)
    rows = FileFrame(tree.scan(spark, root)).add_corruption().df.filter("is_file")
    return relative(rows, root).select("path", "is_corrupt")


@query(f"WITH {PLANTED} SELECT sha256(text) AS group_id, path FROM pf QUALIFY count(*) OVER (PARTITION BY text) > 1")
def x1_pipeline_duplicates(spark, sf_dir):
    root = planted(spark, sf_dir)
    return relative(Pipeline.of(spark, root).scan().enrich().verify().dedup().state.duplicates, root)


@query(f"WITH {PLANTED} SELECT path, substr(sha256(CASE WHEN octet_length(encode(text)) > 8192 THEN encode(text)[1:4096] || encode(text)[octet_length(encode(text)) - 4095:octet_length(encode(text))] ELSE encode(text)[1:4096] END), 1, 32) AS hash_deep FROM pf")
def a17_deep_snapshot(spark, sf_dir):
    """Hashes of the first and last bytes of the tree's files, hidden ones too."""
    root = planted(spark, sf_dir)
    return relative(api.snapshot(spark, root, "deep").entries, root).select("path", "hash_deep")


@query(f"WITH {PLANTED}, d AS (SELECT count(*) AS n FROM pf GROUP BY text HAVING count(*) > 1) SELECT (SELECT count(*) FROM pf)::DOUBLE AS total_files, (SELECT sum(size_bytes) FROM pf)::DOUBLE AS total_size_bytes, (SELECT count(*) FROM d)::DOUBLE AS duplicate_groups, (SELECT sum(n) FROM d)::DOUBLE AS duplicate_files")
def x2_dataset_quality(spark, sf_dir):
    report, _ = Dataset(spark, planted(spark, sf_dir)).quality_scan()
    wanted = ["total_files", "total_size_bytes", "duplicate_groups", "duplicate_files"]
    return report.groupBy().pivot("metric", wanted).agg(F.first("value"))


@query(f"WITH {PLANTED} SELECT CASE WHEN suffix = '' THEN '<no extension>' ELSE lower(suffix) END AS extension, count(*) AS n, round_even(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM pf), 2) AS share_pct FROM px WHERE NOT is_dir GROUP BY 1")
def a22_extension_shares(spark, sf_dir):
    return quality.extension_shares(tree.scan(spark, planted(spark, sf_dir)).filter("is_file"))


@query(f"WITH {PLANTED}, t AS (SELECT (SELECT count(*) FROM pf) AS n) SELECT n AS profiled, n AS checked, n AS basis, 0::BIGINT AS profiled_not_checked, 0::BIGINT AS profiled_not_basis, 'ok' AS status FROM t")
def a22_reconciliation(spark, sf_dir):
    root = planted(spark, sf_dir)
    found = tree.scan(spark, root).filter("is_file")
    return quality.reconciliation(tree.scan(spark, root, lean=True).filter("is_file"), integrity.with_corruption(found), found)


@query(f"WITH {PLANTED} SELECT CASE WHEN doc_id % 7 = 0 THEN '.cache' ELSE lang END AS label, count(*) AS n FROM pf GROUP BY 1")
def a15_folder_labels(spark, sf_dir):
    """Labels by the name of the folder that a file is in."""
    return quality.class_balance(quality.folder_labels(tree.scan(spark, planted(spark, sf_dir)).filter("is_file")), "label")


@query(f"WITH {PLANTED} SELECT path FROM px WHERE NOT is_dir AND lower(suffix) IN ('.txt', '.md') AND size_bytes >= 1024 AND contains(path, 'src1')")
def f4_delegated_filters(spark, sf_dir):
    root = planted(spark, sf_dir)
    frame = FileFrame(tree.scan(spark, root)).filter("is_file").filter_by_extension(["txt", ".MD"]).filter(F.col("size_bytes") >= 1024).filter_by_pattern("src1")
    return relative(frame.df, root).select("path")


@query(f"WITH {PLANTED} SELECT path, lower(suffix) IN ('.txt', '.md') AS is_text, FALSE AS is_image FROM px WHERE NOT is_dir")
def p19_kinds(spark, sf_dir):
    root = planted(spark, sf_dir)
    return relative(tree.scan(spark, root, with_stats=False).filter("is_file"), root).select("path", kinds.is_text(F.col("path")).alias("is_text"), kinds.is_image(F.col("path")).alias("is_image"))


@query(f"WITH {PLANTED} SELECT a.n AS rows, a.k AS extensions, b.k AS directories FROM (SELECT count(*) AS n, least(count(DISTINCT lower(suffix)), 10) AS k FROM px WHERE NOT is_dir) a, (SELECT least(count(DISTINCT parent), 10) AS k FROM px WHERE NOT is_dir) b")
def a26_summary_sizes(spark, sf_dir):
    """Sizes of the parts of a frame's summary."""
    made = FileFrame(tree.scan(spark, planted(spark, sf_dir)).filter("is_file")).summarize()
    return spark.createDataFrame([(made["rows"], len(made["extensions"]), len(made["directories"]))], "rows long, extensions long, directories long")


@query(f"WITH {PLANTED} SELECT path, sha256(text) AS sha256 FROM pf QUALIFY count(*) OVER (PARTITION BY text) > 1 AND count(*) FILTER (path LIKE 'data/.cache%') OVER (PARTITION BY text) > 0 AND count(*) FILTER (path LIKE 'data/src%') OVER (PARTITION BY text) > 0")
def a10_cross_directory_duplicates(spark, sf_dir):
    """Exact duplicates that are both in the hidden folder and in a source's, by a frame's evaluation."""
    root = planted(spark, sf_dir)
    frame = FileFrame(tree.scan(spark, root, compute_hash=True))
    found = frame.evaluate_duplicates("exact", cross_dir_paths=[f"{root}/data/.cache", f"{root}/data/src"]).df
    return relative(found.join(frame.df.select("path", "sha256"), "path"), root).select("path", "sha256")




@query(f"""WITH {PLANTED}, s AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'modified' WHEN doc_id % 3 = 1 THEN 'added' ELSE 'matched' END AS status FROM pf UNION ALL SELECT 'missing' FROM pf WHERE doc_id % 10 = 0)
SELECT status, count(*) AS n FROM s WHERE status <> 'matched' GROUP BY 1""")
def k10_change_report(spark, sf_dir):
    """The report of changes since a snapshot in which a third of the hashes differ, a third of the files and some that don't exist are."""
    root = planted(spark, sf_dir)
    number = F.regexp_extract("path", r"_(\d+)[^/]*$", 1).cast("long")
    now = Dataset(spark, root).snap("fast").entries
    old = now.filter(number % 3 != 1).withColumn("hash_fast", F.when(number % 3 == 0, "0").otherwise(F.col("hash_fast")))
    gone = now.filter(number % 10 == 0).withColumn("path", F.concat("path", F.lit(".gone")))
    made, _ = api.watch(spark, root, integrity.Snapshot(old.unionByName(gone), "fast", {"pattern": None, "include_hidden": True}))
    return spark.createDataFrame([(s, n) for s, n in made["summary"].items() if n], "status string, n long")


@query(f"""WITH {PLANTED}, l AS (SELECT CASE WHEN doc_id % 7 = 0 THEN '.cache' ELSE lang END AS label, count(*) AS n FROM pf GROUP BY 1)
SELECT 'checked' AS what, count(*)::DOUBLE AS value FROM pf UNION ALL SELECT 'failed', count(*) FILTER (size_bytes = 0) FROM pf UNION ALL SELECT 'class ' || label, n FROM l UNION ALL SELECT 'cv', round(stddev_samp(n) / avg(n) * 100, 6) FROM l""")
def k8_verifier_report(spark, sf_dir):
    files = integrity.with_corruption(tree.scan(spark, planted(spark, sf_dir)).filter("is_file"))
    made = report.verifier(files)
    rows = [("checked", made["integrity"]["checked"]), ("failed", made["integrity"]["failed"]), ("cv", round(made["class_balance"]["cv_pct"], 6)), *((f"class {k}", n) for k, n in made["class_balance"]["counts"].items())]
    return spark.createDataFrame([(k, float(v)) for k, v in rows], "what string, value double")


@query(f"""WITH {PLANTED}, d AS (SELECT count(*) AS n FROM pf GROUP BY text HAVING count(*) > 1)
SELECT 'files' AS what, count(*) AS n FROM pf UNION ALL SELECT 'directories', count(*) FROM pd UNION ALL SELECT 'groups', count(*) FROM d UNION ALL SELECT 'in groups', sum(n)::BIGINT FROM d UNION ALL SELECT 'empty', count(*) FROM pe WHERE is_dir AND path NOT IN (SELECT parent FROM pe)""")
def x6_registered_tools(spark, sf_dir):
    """What some of the registered tools say of the tree."""
    root = planted(spark, sf_dir)
    counts, twins = tools.call(spark, "count_files", path=root), tools.call(spark, "find_duplicates", path=root)
    empty = len(tools.call(spark, "find_empty_directories", path=root, n=200))
    rows = [("files", counts["files"]), ("directories", counts["directories"]), ("groups", twins["duplicate_count"]), ("in groups", twins["duplicate_file_count"]), ("empty", empty)]
    return spark.createDataFrame(rows, "what string, n long")
