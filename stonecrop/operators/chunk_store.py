"""A table of text chunks with vectors, brought up to date by path and time of change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stonecrop.functions import kinds
from stonecrop.functions import text as text_functions
from stonecrop.operators import embed, similarity


def chunk_rows(files: DataFrame, path_col: str = "path", text_col: str = "text", mtime_col: str = "mtime", max_tokens: int = 512) -> DataFrame:
    """(path, chunk_idx, text, mtime) of the chunks of files; blank texts have none."""
    rows = files.filter(F.trim(text_col) != "")
    made = rows.select(F.col(path_col).alias("path"), F.posexplode(text_functions.chunks(F.col(text_col), max_tokens)).alias("chunk_idx", "text"), F.col(mtime_col).cast("string").alias("mtime"))
    return made.withColumn("chunk_idx", F.col("chunk_idx").cast("long"))


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """``files`` whose (path, mtime) ``known`` doesn't have."""
    key = lambda df: df.select("path", F.col("mtime").cast("string").alias("mtime"))
    return files.withColumn("mtime", F.col("mtime").cast("string")).join(key(known).distinct(), ["path", "mtime"], "left_anti")


class ChunkStore:
    """Parquet folders, one a version; the newest counts."""

    def __init__(self, spark: SparkSession, folder: str, embedder: Callable[[list[str]], list[list[float]]] | None = None, max_tokens: int = 512) -> None:
        self.spark, self.folder, self.embedder, self.max_tokens, self.version = spark, folder, embedder, max_tokens, 0

    @property
    def table(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.folder}/v{self.version}") if self.version else None

    def index(self, files: DataFrame) -> DataFrame:
        """Take in files (path, text, mtime): those new or changed are chunked and embedded; chunks of changed and gone files go."""
        files = files.filter(kinds.is_text(F.col("path"))).withColumn("mtime", F.col("mtime").cast("string"))
        old = self.table
        new = files if old is None else changed_files(files, old)
        made = embed.text_embedding(chunk_rows(new, max_tokens=self.max_tokens), embedder=self.embedder, max_chars=None, out="vector")
        if old is not None:
            made = old.join(files.select("path", "mtime").distinct(), ["path", "mtime"], "left_semi").select(*made.columns).unionByName(made)
        made.write.mode("overwrite").parquet(f"{self.folder}/v{self.version + 1}")
        self.version += 1
        return self.table

    def search(self, text: str, top_k: int = 5) -> DataFrame:
        """(path, chunk_idx, text, distance): the nearest by cosine distance; ``top_k`` is held to 1 to 20."""
        vector = (self.embedder or embed.hashed_embedder())([text])[0]
        distance = 1 - similarity.cosine(F.col("vector"), F.array(*map(F.lit, vector)))
        rows = self.table.filter("vector is not null").select("path", "chunk_idx", "text", distance.alias("distance"))
        return rows.orderBy("distance", "path", "chunk_idx").limit(max(1, min(20, top_k)))
