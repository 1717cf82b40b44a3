"""Files in and out: Parquet, CSV and JSON by suffix, and tables in the shared folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes and the format of each.
FORMATS = {".parquet": "parquet", ".pq": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json"}


def format_of(path: str, given: str | None = None) -> str:
    found = given or FORMATS.get(PurePosixPath(path).suffix.lower())
    if found == "pq":
        found = "parquet"
    if found not in ("parquet", "csv", "json"):
        raise ValueError(f"unknown format of {path!r}")
    return found


def load(spark: SparkSession, path: str, format: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """Read a file or folder. Without ``schema`` the types of CSV and JSON are inferred; a JSON array is read as rows."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    kind = format_of(path, format)
    if kind == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None)
    if kind == "json":
        return reader.json(path, multiLine=not path.endswith(".jsonl"))
    return reader.parquet(path)


def save(df: DataFrame, path: str, format: str | None = None, mode: str = "overwrite") -> None:
    """Write a folder of files. Arrays, maps and structs become JSON text in CSV."""
    kind = format_of(path, format)
    if kind == "csv":
        deep = (T.ArrayType, T.MapType, T.StructType)
        df = df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, deep) else F.col(f"`{f.name}`") for f in df.schema])
        df.write.mode(mode).csv(path, header=True)
    else:
        getattr(df.write.mode(mode), kind)(path)


def save_array(df: DataFrame, path: str) -> None:
    """One file that holds a JSON array of the rows, written a row at a time through Spark's file systems."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(conf).create(where, True)
    try:
        rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("x")).toLocalIterator()
        pending, size, before = ["["], 0, ""
        for r in rows:
            pending += [before, r["x"]]
            before, size = ",\n", size + len(r["x"])
            if size > 1_000_000:
                out.write("".join(pending).encode())
                pending, size = [], 0
        out.write("".join([*pending, "]\n"]).encode())
    finally:
        out.close()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without one gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stonecrop-"))
    return spark.sparkContext.getCheckpointDir()


#: Paths of the tables written since each open ``scratch`` block began, and of all that are there.
_scratch: list[list[str]] = []
_written: set[str] = set()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.add(path)
    for block in _scratch:
        block.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables, wherever Spark's file systems keep them."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _written.discard(path)


def clean(spark: SparkSession) -> None:
    """Delete all tables that this program wrote with ``materialize``; results that were not saved by then are lost."""
    discard(spark, sorted(_written))


class Keep:
    """Writes tables that outlive a ``scratch`` block; ``path`` is the last one's."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    @property
    def path(self) -> str:
        return self.paths[-1]

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        out = materialize(df, name)
        self.paths.append(_scratch[-1][-1])
        return out


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Keep]:
    """A block at whose end the tables that ``materialize`` wrote in it are deleted, but for those written by what it gives."""
    made: list[str] = []
    keep = Keep()
    _scratch.append(made)
    try:
        yield keep
    finally:
        _scratch.pop()
        discard(spark, [x for x in made if x not in keep.paths])
