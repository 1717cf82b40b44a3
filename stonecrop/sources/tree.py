"""Directory trees as a Spark data source.

The built-in file source shows neither hidden entries nor empty folders, so trees have a source of their own.
The driver lists the root, and deeper levels while subtrees are few; tasks walk the subtrees.

Symbolic links are neither counted nor followed. With ``maxDepth`` d, folders to depth d and files to
depth d + 1 are returned. Entries that can't be read are left out.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import stat
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stonecrop.functions import paths, units

SCHEMA = "path string, name string, is_file boolean, is_dir boolean, depth long, size_bytes long, modified_time string, created_time string, mtime double, owner string, `group` string, mode_str string, inode long, nlink long, sha256 string, xattrs string"
#: Folders that version control and tools make, left out if ``ignore`` is set.
IGNORED = frozenset(".git .hg .svn __pycache__ .mypy_cache .pytest_cache .ruff_cache .tox .nox .venv venv env node_modules target dist build .next .nuxt .cache .idea .vscode".split())
#: What a profile needs: one call an entry, in Arrow batches. ``n_entries`` counts all that is in a folder, hidden entries and links too; null if it can't be read.
LEAN = "path string, is_file boolean, is_dir boolean, depth long, size_bytes long, n_entries long"
BATCH = 20_000
RETRIES = 3


@functools.lru_cache(1024)
def _name(kind: str, number: int) -> str:
    import grp
    import pwd

    try:
        return pwd.getpwuid(number).pw_name if kind == "u" else grp.getgrgid(number).gr_name
    except KeyError:
        return str(number)


@functools.lru_cache(4096)
def _time(t: int) -> str:
    return time.strftime("%Y-%m-%d %H:%M:%S", time.localtime(t))


def file_hash(path: str) -> str | None:
    import hashlib

    try:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()
    except OSError:
        return None


def attributes(path: str) -> str:
    """Extended attributes as JSON text."""
    found = {}
    try:
        for k in os.listxattr(path, follow_symlinks=False):
            found[k] = os.getxattr(path, k, follow_symlinks=False).decode("utf-8", "replace")
    except (OSError, AttributeError):
        pass
    return json.dumps(found)


#: File systems on a network, by the start of their names in the list of mounts.
NETWORK = ("nfs", "cifs", "smb", "ceph", "gluster", "fuse.sshfs", "sshfs")
#: Seconds that a call on a network file system may take.
PATIENCE = 30.0
#: Seconds that calls of this process may take; null without a bound.
_patience: float | None = None


def file_system(path: str, mounts: str = "/proc/mounts") -> str | None:
    """The kind of file system that a path is on: that of the longest mount point above it; null if there is no list."""
    try:
        with open(mounts, encoding="utf-8") as f:
            rows = [line.split()[1:3] for line in f if len(line.split()) > 2]
    except OSError:
        return None
    at = os.path.realpath(path)
    above = [(len(point), kind) for point, kind in ((p.replace("\\040", " "), k) for p, k in rows) if at == point or at.startswith(point.rstrip("/") + "/")]
    return max(above)[1] if above else None


def on_network(path: str) -> bool:
    return (file_system(path) or "").startswith(NETWORK)


@functools.cache
def _callers() -> Any:
    from concurrent.futures import ThreadPoolExecutor

    return ThreadPoolExecutor(8)


def attempted(call: Callable, *args: Any, **kwargs: Any) -> Any:
    """What a file system call gives; null once it fails for good. With a bound on its time, one that takes longer fails."""
    for attempt in range(RETRIES):
        try:
            return _callers().submit(call, *args, **kwargs).result(_patience) if _patience else call(*args, **kwargs)
        except (FileNotFoundError, PermissionError):
            return None
        except (OSError, TimeoutError):
            if attempt < RETRIES - 1:
                time.sleep(0.01 * 2**attempt)
    return None


def _listed(path: str) -> Iterator[os.DirEntry] | None:
    """The entries of a folder, up to one that can't be read; null if the folder can't."""
    def each(found: Any) -> Iterator[os.DirEntry]:
        with found:
            while True:
                try:
                    yield next(found)
                except (StopIteration, OSError):
                    return

    found = attempted(os.scandir, path)
    return None if found is None else each(found)


def row(path: str, depth: int, stats: bool, hashes: bool, entry: os.DirEntry | None = None) -> tuple | None:
    """A row of ``SCHEMA``; null for links and what can't be read. Without ``stats`` the kind of a listed entry costs no call."""
    if entry is not None and not stats:
        try:
            if entry.is_symlink():
                return None
            return (path, entry.name, entry.is_file(follow_symlinks=False), entry.is_dir(follow_symlinks=False), depth, *[None] * 11)
        except OSError:
            return None
    s = attempted(os.lstat, path)
    if s is None or stat.S_ISLNK(s.st_mode):
        return None
    is_dir, is_file = stat.S_ISDIR(s.st_mode), stat.S_ISREG(s.st_mode)
    head = (path, os.path.basename(path), is_file, is_dir, depth, s.st_size)
    if not stats:
        return (*head, *[None] * 10)
    return (*head, _time(int(s.st_mtime)), _time(int(s.st_ctime)), s.st_mtime, _name("u", s.st_uid), _name("g", s.st_gid), stat.filemode(s.st_mode), s.st_ino, s.st_nlink, file_hash(path) if hashes and is_file else None, attributes(path))


#: Tasks a core of a scan at most, and entries of a folder that the driver lists at most to find as many subtrees.
TASKS_A_CORE, LISTED = 4, 10_000


class Subtrees(InputPartition):
    """Paths with their depth, and whether to walk what is below."""

    def __init__(self, tops: list[tuple[str, int, bool]]) -> None:
        super().__init__(tops)
        self.tops = tops


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        options = {k.lower(): v for k, v in options.items()}
        flag = lambda k, d: str(options.get(k, d)).lower() == "true"
        self.root = os.path.abspath(os.path.expanduser(options["path"]))
        depth = options.get("maxdepth", "")
        self.max_depth = int(depth) if str(depth).isdigit() else None
        self.hidden, self.ignore = flag("hidden", "true"), flag("ignore", "false")
        self.stats, self.hashes = flag("withstats", "true"), flag("computehash", "false")
        self.lean = flag("lean", "false")
        self.tasks = int(options.get("tasks", "64"))
        self.timeout = float(options["timeout"]) if options.get("timeout") else None

    def partitions(self) -> list[InputPartition]:
        """Subtrees, one level deeper as long as they are few; a folder of many entries is left to a task."""
        if not os.path.isdir(self.root):
            raise ValueError(f"not a directory: {self.root}")
        alone: list[tuple[str, int, bool]] = []
        whole = [(e.path, 1, True) for e in sorted(os.scandir(self.root), key=lambda e: e.name)]
        for _ in range(3):
            folders = [t for t in whole if os.path.isdir(t[0]) and not os.path.islink(t[0])] if len(whole) < self.tasks else []
            if not folders:
                break
            for t in folders:
                if not self.wanted(os.path.basename(t[0]), True, t[1]):
                    continue
                try:
                    below = [(e.path, t[1] + 1, True) for e in itertools.islice(os.scandir(t[0]), LISTED + 1)]
                except OSError:
                    continue
                if len(below) <= LISTED:
                    whole.remove(t)
                    alone.append((*t[:2], False))
                    whole += below
        tops = alone + whole
        step = max(1, -(-len(tops) // self.tasks))
        return [Subtrees(tops[i::-(-len(tops) // step)]) for i in range(-(-len(tops) // step))] or [Subtrees([])]

    def wanted(self, name: str, is_dir: bool, depth: int) -> bool:
        if name.startswith(".") and not self.hidden:
            return False
        if is_dir and self.ignore and name in IGNORED:
            return False
        return self.max_depth is None or depth <= self.max_depth + (not is_dir)

    def read(self, partition: Subtrees) -> Iterator[pa.RecordBatch]:
        global _patience
        _patience = self.timeout
        kinds = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64()}
        fields = [x.replace("`", "").split() for x in (LEAN if self.lean else SCHEMA).split(", ")]
        rows = self.read_lean(partition) if self.lean else self.read_rows(partition)
        while some := list(itertools.islice(rows, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*some, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    def read_lean(self, partition: Subtrees) -> Iterator[tuple]:
        rows: list[tuple] = []
        folders: list[tuple[str, int, bool, int]] = []

        def take(path: str, name: str, depth: int, walk: bool, s: os.stat_result) -> None:
            is_dir = stat.S_ISDIR(s.st_mode)
            if stat.S_ISLNK(s.st_mode) or not self.wanted(name, is_dir, depth):
                return
            if is_dir:
                folders.append((path, depth, walk, s.st_size))
            else:
                rows.append((path, stat.S_ISREG(s.st_mode), False, depth, s.st_size, None))

        for path, depth, walk in partition.tops:
            if (s := attempted(os.lstat, path)) is not None:
                take(path, os.path.basename(path), depth, walk, s)
        while folders:
            path, depth, walk, size = folders.pop()
            entries = _listed(path)
            n = None if entries is None else 0
            for e in entries or ():
                n += 1
                if walk and (s := attempted(e.stat, follow_symlinks=False)) is not None:
                    take(e.path, e.name, depth + 1, True, s)
                if len(rows) >= BATCH:
                    yield from rows
                    rows.clear()
            rows.append((path, False, True, depth, size, n))
            yield from rows
            rows.clear()
        yield from rows

    def read_rows(self, partition: Subtrees) -> Iterator[tuple]:
        waiting: list[tuple] = [(*t, None) for t in partition.tops]
        while waiting:
            path, depth, walk, entry = waiting.pop()
            found = row(path, depth, self.stats, self.hashes, entry)
            if found is None or not self.wanted(found[1], found[3], depth):
                continue
            yield found
            if found[3] and walk:
                waiting += [(e.path, depth + 1, True, e) for e in _listed(path) or ()]


class TreeSource(DataSource):
    """Format ``tree``; options path, maxDepth, hidden, ignore, withStats, computeHash, lean, tasks, timeout (seconds of a call)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return LEAN if dict(self.options).get("lean", "false").lower() == "true" else SCHEMA

    def reader(self, schema: object) -> TreeReader:
        return TreeReader(dict(self.options))


def scan(spark: SparkSession, path: str, max_depth: int | None = None, hidden: bool = True, ignore: bool = False, with_stats: bool = True, compute_hash: bool = False, lean: bool = False, timeout: float | None = None) -> DataFrame:
    """All entries below ``path``, not the root itself; with the columns of ``LEAN`` if ``lean``.

    ``timeout`` bounds the seconds of a call; on a network file system it is ``PATIENCE`` unless given, as calls may hang there.
    """
    if not os.path.isdir(os.path.expanduser(path)):
        raise ValueError(f"not a directory: {path}")
    spark.dataSource.register(TreeSource)
    timeout = timeout or (PATIENCE if on_network(path) else None)
    reader = spark.read.format("tree").option("path", path).option("hidden", hidden).option("ignore", ignore).option("withStats", with_stats).option("computeHash", compute_hash).option("lean", lean).option("tasks", TASKS_A_CORE * spark.sparkContext.defaultParallelism).option("timeout", timeout or "")
    return (reader.option("maxDepth", max_depth) if max_depth is not None else reader).load()


def with_root(entries: DataFrame, path: str) -> DataFrame:
    """Entries (path, is_dir, depth, size_bytes, and n_entries if it is there) with the root at depth 0, for profiles."""
    columns = {"path": "string", "is_dir": "boolean", "depth": "long", "size_bytes": "long", "n_entries": "long"}
    names = [c for c in columns if c in entries.columns]
    found = attempted(os.listdir, path)
    one = {"path": os.path.abspath(path), "is_dir": True, "depth": 0, "size_bytes": 0, "n_entries": None if found is None else len(found)}
    root = entries.sparkSession.range(1).select(*[F.lit(one[c]).cast(columns[c]).alias(c) for c in names])
    return root.unionByName(entries.filter("is_dir or is_file").select(*names))


def stat_paths(df: DataFrame, path_col: str = "path", base: str | None = None, compute_hash: bool = False) -> DataFrame:
    """``df`` with the file-stat columns of each path, replacing any it has; null, and ``{}`` for xattrs, where it isn't there."""
    wanted = ["size_bytes", "modified_time", "created_time", "is_file", "is_dir", "owner", "group", "mode_str", "inode", "nlink", "sha256", "xattrs"]
    names = [x.split()[0].strip("`") for x in SCHEMA.split(", ")]
    kind = "struct<" + ",".join(f"`{n}`:{dict(x.replace('`', '').split() for x in SCHEMA.split(', '))[n]}" for n in wanted) + ">"

    @F.pandas_udf(kind)
    def stats(given: pd.Series) -> pd.DataFrame:
        rows = []
        for p in given:
            found = row(os.path.join(base or "", p), 0, True, compute_hash) if p is not None else None
            one = dict(zip(names, found, strict=True)) if found else {"xattrs": "{}"}
            rows.append([one.get(c) for c in wanted])
        return pd.DataFrame(rows, columns=wanted, dtype=object)

    out = df.drop(*[c for c in wanted if c in df.columns and c != path_col]).withColumn("__s", stats(F.col(path_col)))
    return out.select(*[F.col(f"`{c}`") for c in out.columns if c != "__s"], *[F.col(f"__s.`{c}`").alias(c) for c in wanted])


def with_content(files: DataFrame, wanted: Column) -> DataFrame:
    """``files`` (path) with the content of those that are ``wanted``, read by the tasks; null for the others and for what can't be read."""
    @F.pandas_udf("binary")
    def content(given: pd.Series) -> pd.Series:
        def one(name: str | None) -> bytes | None:
            try:
                with open(name, "rb") as f:
                    return f.read()
            except (OSError, TypeError):
                return None

        return given.map(one)

    return files.withColumn("content", content(F.when(wanted, F.col("path"))))


def deep_hash(path: Column, head: int = 4096) -> Column:
    """32 hex digits over a file's first ``head`` bytes, and the last as many too if it has over twice as many; null if it can't be read."""
    @F.pandas_udf("string")
    def hashed(given: pd.Series) -> pd.Series:
        import hashlib

        def one(name: str | None) -> str | None:
            try:
                with open(name, "rb") as f:
                    data, size = f.read(head), os.fstat(f.fileno()).st_size
                    if size > 2 * head:
                        f.seek(-head, os.SEEK_END)
                        data += f.read(head)
            except (OSError, TypeError):
                return None
            return hashlib.sha256(data).hexdigest()[:32]

        return given.map(one)

    return hashed(path)


@dataclass(frozen=True)
class FileRecord:
    """One file's metadata by lstat; of a link the kind of its target is told apart."""

    path: str
    size: int
    mode: str
    mode_str: str
    owner: str
    group: str
    created: str
    modified: str
    accessed: str
    is_symlink: bool
    is_file: bool | None
    is_dir: bool | None
    target_is_file: bool | None
    target_is_dir: bool | None
    rights: dict
    inode: int
    nlink: int
    sha256: str | None
    xattrs: dict


def probe_file(path: str, compute_hash: bool = False) -> FileRecord:
    s = os.lstat(path)
    link = stat.S_ISLNK(s.st_mode)
    rights = {k: os.access(path, m) for k, m in (("read", os.R_OK), ("write", os.W_OK), ("execute", os.X_OK))}
    return FileRecord(
        os.path.abspath(path), s.st_size, oct(s.st_mode), stat.filemode(s.st_mode), _name("u", s.st_uid), _name("g", s.st_gid), _time(int(s.st_ctime)), _time(int(s.st_mtime)), _time(int(s.st_atime)), link,
        None if link else stat.S_ISREG(s.st_mode), None if link else stat.S_ISDIR(s.st_mode), os.path.isfile(path) if link else None, os.path.isdir(path) if link else None,
        rights, s.st_ino, s.st_nlink, file_hash(path) if compute_hash and os.path.isfile(path) else None, json.loads(attributes(path)),
    )


def find_files(entries: DataFrame, pattern: str = ".", glob: bool = False, case_sensitive: bool = False) -> DataFrame:
    return _named(entries.filter("is_file"), pattern, glob, case_sensitive)


def find_directories(entries: DataFrame, pattern: str = ".", glob: bool = False, case_sensitive: bool = False) -> DataFrame:
    return _named(entries.filter("is_dir"), pattern, glob, case_sensitive)


def _named(rows: DataFrame, pattern: str, glob: bool, case_sensitive: bool) -> DataFrame:
    regex = paths.pattern_regex(pattern, glob, case_sensitive)
    return rows.filter(F.lit(False)) if regex is None else rows.filter(paths.name(F.col("path")).rlike(regex))


def find_by_extension(entries: DataFrame, extensions: list[str] | str) -> DataFrame:
    from stonecrop.functions import kinds

    return entries.filter("is_file").filter(kinds.has_extension(F.col("path"), extensions))


def find_recent(entries: DataFrame, within: str = "1d", now: float | None = None, mtime_col: str = "mtime", extension: str | list[str] | None = None) -> DataFrame:
    """Files changed within a duration before ``now``, epoch seconds; of some extensions if given."""
    if extension:
        entries = find_by_extension(entries, extension_list(extension))
    return entries.filter(F.col(mtime_col) >= (now if now is not None else time.time()) - units.duration(within))


def find_large(entries: DataFrame, least: str = "1M", size_col: str = "size_bytes") -> DataFrame:
    return entries.filter(F.col(size_col) >= units.size(least))


def search(entries: DataFrame, pattern: str | None = None, extension: str | list[str] | None = None, min_size: str | None = None) -> DataFrame:
    """One criterion by priority: extension, then size, then pattern."""
    if extension:
        return find_by_extension(entries, extension_list(extension))
    if min_size:
        return find_large(entries.filter("is_file"), min_size)
    return find_files(entries, pattern or ".")


def extension_list(given: str | list[str]) -> list[str]:
    """Extensions from a list, a JSON array as text, or text with commas or spaces."""
    if isinstance(given, str):
        try:
            read = json.loads(given)
            given = read if isinstance(read, list) else [given]
        except ValueError:
            given = re.split(r"[,\s]+", given)
    return [str(x).strip().strip("\"'") for x in given if str(x).strip()]


def counts(entries: DataFrame) -> DataFrame:
    """One row: files, directories, total."""
    return entries.agg(F.count(F.when(F.col("is_file"), 1)).alias("files"), F.count(F.when(F.col("is_dir"), 1)).alias("directories"), F.count("*").alias("total"))


def search_stream(entries: DataFrame, pattern: str = ".", glob: bool = False) -> Iterator[str]:
    """The paths of files by name, one partition at a time."""
    return (r["path"] for r in find_files(entries, pattern, glob).select("path").toLocalIterator())


def whole_listing(entries: DataFrame) -> DataFrame:
    """All levels: a folder's content after it, in each folder directories first, then by name in lower case."""
    segment = F.split(F.lower("path"), "/")
    n = F.size(segment)
    # a segment that isn't the last is a directory's, and so is a directory's last one
    key = F.transform(segment, lambda x, i: F.concat(F.when((i < n - 1) | F.col("is_dir"), "0").otherwise("1"), x))
    return entries.withColumn("__key", key).orderBy("__key", "path").drop("__key")


def listing(entries: DataFrame) -> DataFrame:
    """One level: directories first, then by name in lower case."""
    return entries.filter("depth = 1").orderBy(~F.col("is_dir"), F.lower("name"), "name")
