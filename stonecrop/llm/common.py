"""What the training-data operators share: the shared folder, Arrow access to text, labelled samples.

Arrow batches have the session's size: Spark closes one at 10,000 rows or 64 MB unless told otherwise, whichever comes first.
They are worked on in smaller parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stonecrop.functions.arrays import let
from stonecrop.sources.files import discard, materialize, scratch, shared_dir

__all__ = ["append_column", "discard", "free_name", "id_crc32", "labelled_sample", "let", "map_rows", "materialize", "parts", "raw_texts", "read", "scratch", "shared_dir", "strings"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


#: Rows and bytes of a part of a batch; a longer text is a part of its own.
PART_ROWS, PART_BYTES = 512, 4 * 2**20


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in smaller parts, which share their memory: what is made of a part, often many times its size, stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.zeros(batch.num_rows, np.int64)
        for c in batch.columns:
            if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
                sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            last = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES, "right"))
            n = max(1, min(last - at, PART_ROWS))
            yield batch.slice(at, n)
            at += n


def map_rows(df: DataFrame, schema: T.StructType | str, make: Callable[[pa.RecordBatch], list[list]]) -> DataFrame:
    """``make`` turns a part of a batch into one list per column of ``schema``."""
    out = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            columns = make(batch)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, out)


def append_column(df: DataFrame, name: str, kind: T.DataType, text_col: str, of: Callable[[list[bytes]], list]) -> DataFrame:
    """``df`` with one more column, which ``of`` makes from the texts; the other columns pass through."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    arrow = to_arrow_schema(out)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            extra = pa.array(of(raw_texts(batch.column(at))), arrow.field(len(arrow) - 1).type)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)] + [extra], schema=arrow)

    return df.mapInArrow(run, out)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def id_crc32(column: str) -> F.Column:
    """crc32 of an id written as decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled documents, the ids least by a hash; a row an id.

    ``limit`` is the bound of the sample, so the ids (8 bytes each) may be broadcast.
    Of several labels of an id the least counts, of several texts the least by hash, then by itself;
    copies of a row go before the shuffle. Rows without id, text or label are left out.
    """
    chosen = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    chosen = chosen.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).dropna()
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("x"))
    return one.select("doc_id", "x.text", "x.label")
