"""A table of files: a Spark DataFrame with enrichment, search, duplicates and a lineage."""

from __future__ import annotations

import time
from collections.abc import Callable
from pathlib import PurePath
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from stonecrop.functions import kinds, paths
from stonecrop.operators import dedup, embed, integrity, profile, relational
from stonecrop.sources import files, tree


class Groups:
    """Grouped rows of a frame; what their aggregates give is a frame again."""

    def __init__(self, frame: FileFrame, groups: GroupedData, name: str) -> None:
        self._frame, self._groups, self._name = frame, groups, name

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__"):
            raise AttributeError(name)
        found = getattr(self._groups, name)

        def call(*args: Any, **kwargs: Any) -> Any:
            out = found(*args, **kwargs)
            if isinstance(out, GroupedData):
                return Groups(self._frame, out, self._name)
            return self._frame._next(out, f"{self._name}.{name}") if isinstance(out, SparkFrame) else out

        return call


class FileFrame:
    """Wraps a Spark DataFrame; methods that aren't here go to it, and DataFrames that come back are wrapped.

    Each step returns a new frame whose lineage has one more entry.
    """

    def __init__(self, data: Any = None, spark: SparkSession | None = None, lineage: tuple[dict, ...] = ()) -> None:
        self.df, self.lineage = _made(data, spark), lineage

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__"):
            raise AttributeError(name)
        found = getattr(self.df, name)
        if not callable(found) or isinstance(found, Column):
            return found

        def call(*args: Any, **kwargs: Any) -> Any:
            args = tuple(a.df if isinstance(a, FileFrame) else a for a in args)
            out = found(*args, **kwargs)
            if isinstance(out, GroupedData):
                return Groups(self, out, name)
            return self._next(out, name) if isinstance(out, SparkFrame) else out

        return call

    def __getitem__(self, key: Any) -> Any:
        out = self.df[key]
        return self._next(out, "getitem") if isinstance(out, SparkFrame) else out

    def __len__(self) -> int:
        return self.df.count()

    def _next(self, df: SparkFrame, operation: str, **params: Any) -> FileFrame:
        entry = {"operation": operation, "params": {k: str(v) if isinstance(v, PurePath) else v for k, v in params.items()}, "timestamp": time.strftime("%Y-%m-%dT%H:%M:%S")}
        return FileFrame(df, lineage=(*self.lineage, entry))

    def add_lineage_entry(self, operation: str, **params: Any) -> FileFrame:
        return self._next(self.df, operation, **params)

    def with_value(self, name: str, value: Any, order: str | list[str] | None = None) -> FileFrame:
        """A column of a constant, an expression, or a list with a value for each row by ``order``."""
        if isinstance(value, list):
            if order is None:
                raise TypeError("rows have no positions: a list needs an order")
            rows = self.with_row_index(order, "__at").df
            if rows.count() != len(value):
                raise ValueError(f"{len(value)} values for {rows.count()} rows")
            made = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(value)], ["__at", "__value"]) if value else None
            joined = rows.drop(name).join(made, "__at") if made is not None else rows.drop(name).withColumn("__value", F.lit(None))
            return self._next(joined.withColumnRenamed("__value", name).drop("__at"), "assign", column=name)
        return self._next(self.df.withColumn(name, value if isinstance(value, Column) else F.lit(value)), "assign", column=name)

    def add_path_components(self) -> FileFrame:
        return self._next(paths.with_components(self.df), "add_path_components")

    def add_file_stats(self, path: str = "path", base_path: str | None = None, compute_hash: bool = False) -> FileFrame:
        return self._next(tree.stat_paths(self.df, path, base_path, compute_hash), "add_file_stats", path=path, base_path=base_path, compute_hash=compute_hash)

    def add_depth(self, root: str | None = None) -> FileFrame:
        return self if "depth" in self.df.columns else self._next(paths.with_depth(self.df, root=root), "add_depth", path=root)

    def enrich(self) -> FileFrame:
        df = paths.with_components(self.df)
        if "size_bytes" not in df.columns:
            df = tree.stat_paths(df)
        return self._next(df if "depth" in df.columns else paths.with_depth(df), "enrich")

    def add_filename_features(self, **options: Any) -> FileFrame:
        return self._next(paths.with_filename_features(self.df, **options), "add_filename_features", **options)

    def add_corruption(self, content_col: str | None = None) -> FileFrame:
        is_file = "is_file" if "is_file" in self.df.columns else None
        return self._next(integrity.with_corruption(self.df, content_col=content_col, is_file_col=is_file), "add_corruption")

    def add_duplicates(self, hash_column: str = "sha256", compute_hash: bool = True) -> FileFrame:
        df = self.df
        if hash_column not in df.columns:
            if not compute_hash:
                raise ValueError(f"no column {hash_column}")
            df = tree.stat_paths(df, compute_hash=True)
        return self._next(dedup.with_duplicate_flags(df, hash_column), "add_duplicates", hash_column=hash_column)

    def add_metadata_embedding(self, columns: list[str] | None = None, max_categories: int = 20) -> FileFrame:
        kind = dict(self.df.dtypes)
        given = [c for c in columns or kind if c != "path"]
        number = [c for c in given if kind[c] in ("bigint", "int", "smallint", "tinyint", "float", "double") or kind[c].startswith("decimal")]
        times = [c for c in given if kind[c] in ("timestamp", "date")]
        texts = [c for c in given if kind[c] in ("string", "boolean") and (columns or c in ("suffix", "owner", "group", "mode_str"))]
        return self._next(embed.metadata_embedding(self.df, number, times, texts, max_categories=max_categories), "add_metadata_embedding")

    def add_embedding(self, text_col: str = "text", embedder: Callable | None = None, max_chars: int | None = 4000) -> FileFrame:
        return self._next(embed.text_embedding(self.df, text_col, "path" if "path" in self.df.columns else None, embedder, max_chars), "add_embedding")

    def add_image_embedding(self, content_col: str = "content", embedder: Callable | None = None) -> FileFrame:
        return self._next(embed.image_embedding(self.df, content_col, embedder=embedder), "add_image_embedding")

    def add_semantic_similarity(self, embedding_col: str = "embedding", top_k: int = 5, metadata_embedding_col: str | None = None, content_weight: float = 0.5) -> FileFrame:
        """The ``top_k`` most similar files of each; files are told apart by path."""
        rows = self.with_row_index("path", "__id").df
        made = embed.with_neighbours(rows, top_k, "__id", "path", embedding_col, meta_col=metadata_embedding_col, content_weight=content_weight)
        return self._next(made.drop("__id"), "add_semantic_similarity", embedding_col=embedding_col, top_k=top_k, metadata_embedding_col=metadata_embedding_col, content_weight=content_weight)

    # the same steps by the names that callers of other frames of files know
    add_file_stats_cols = add_file_stats
    add_depth_col = add_depth
    add_duplicate_cols = add_duplicates
    add_corruption_cols = add_corruption
    add_embedding_cols = add_embedding
    add_image_embedding_cols = add_image_embedding
    add_metadata_embedding_cols = add_metadata_embedding
    add_semantic_similarity_cols = add_semantic_similarity

    def filter_by_extension(self, extensions: list[str] | str) -> FileFrame:
        return self._next(self.df.filter(kinds.has_extension(F.col("path"), extensions)), "filter_by_extension", extensions=extensions)

    def filter_by_pattern(self, pattern: str) -> FileFrame:
        return self._next(self.df.filter(F.col("path").rlike(pattern)), "filter_by_pattern", pattern=pattern)

    def extension_counts(self) -> FileFrame:
        return self._next(profile.extension_counts(self.df), "extension_counts")

    def directory_counts(self) -> FileFrame:
        return self._next(profile.directory_counts(self.df), "directory_counts")

    def evaluate_duplicates(self, mode: str = "auto", cross_dir_paths: list[str] | None = None, **options: Any) -> FileFrame:
        df = self.df.filter("is_file") if "is_file" in self.df.columns else self.df
        found = dedup.find_duplicates(df, mode, **options)
        return self._next(dedup.across_directories(found, cross_dir_paths) if cross_dir_paths else found, "evaluate_duplicates", mode=mode)

    find_duplicates = evaluate_duplicates

    def sort(self, by: str | list[str], descending: bool = False) -> FileFrame:
        return self._next(relational.sort(self.df, by, descending), "sort", by=by, descending=descending)

    def head(self, n: int = 5, order: list[str] | None = None) -> FileFrame:
        """The first ``n`` rows by ``order``; by path, or by all columns, unless it is given."""
        by = order or (["path"] if "path" in self.df.columns else self.df.columns)
        return self._next(self.df.orderBy(*by).limit(n), "head", n=n)

    def largest(self, n: int = 10, ascending: bool = False, column: str = "size_bytes") -> FileFrame:
        """The ``n`` largest or smallest files, ``n`` held to 1 to 100; ties by path."""
        key = F.asc_nulls_last(column) if ascending else F.desc_nulls_last(column)
        return self._next(self.df.orderBy(key, *(["path"] if "path" in self.df.columns else [])).limit(max(1, min(100, n))), "largest", n=n)

    def tail(self, n: int = 5, order: list[str] | None = None) -> FileFrame:
        return self._next(relational.tail(self.df, n, order or (["path"] if "path" in self.df.columns else self.df.columns)), "tail", n=n)

    def unique(self, subset: list[str] | None = None) -> FileFrame:
        keys = subset or self.df.columns
        return self._next(relational.unique(self.df, keys, self.df.columns), "unique", subset=subset)

    def describe(self, percentiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> FileFrame:
        numbers = [c for c, t in self.df.dtypes if t in ("bigint", "int", "double", "float", "smallint")]
        return self._next(relational.describe(self.df, numbers, percentiles), "describe")

    def info(self) -> FileFrame:
        return self._next(relational.info(self.df), "info")

    def estimated_bytes(self) -> int:
        """What Spark's plan says of the size of the rows; nothing is computed."""
        return int(str(self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    def save(self, path: str, format: str | None = None) -> None:
        files.save(self.df, path, format)

    def save_array(self, path: str) -> None:
        """One JSON file that holds an array of the rows."""
        files.save_array(self.df, path)

    def sql(self, query: str, name: str = "self") -> FileFrame:
        """A query over this frame as the table ``name``."""
        return self._next(self.df.sparkSession.sql(query.replace(f"{{{name}}}", "{frame}"), frame=self.df), "sql", query=query)

    def summarize(self, top: int = 10) -> dict:
        """The number of rows and the ``top`` extensions and directories with their counts."""
        parts = {"extensions": profile.extension_counts(self.df, top=top), "directories": profile.directory_counts(self.df, top=top)}
        return {"rows": self.df.count()} | {k: {r[0]: r[1] for r in v.collect()} for k, v in parts.items()}

    def with_row_index(self, order: str | list[str], name: str = "index", offset: int = 0) -> FileFrame:
        """A column with each row's place by ``order``, by counts of the rows before its partition; no partition holds all rows."""
        return self._next(relational.with_row_index(self.df, [order] if isinstance(order, str) else order, name, offset), "with_row_index", order=order)

    def to_arrow(self):
        return self.df.toArrow()

    def to_polars(self):
        """Through Arrow; needs polars."""
        import polars

        return polars.from_arrow(self.df.toArrow())

    def iter_rows(self, named: bool = False):
        """Rows one partition at a time, as tuples or dicts."""
        for r in self.df.toLocalIterator():
            yield r.asDict() if named else tuple(r)

    def to_dicts(self) -> list[dict]:
        return [r.asDict() for r in self.df.collect()]

    def to_dict(self) -> dict[str, list]:
        return self.df.toPandas().to_dict("list")

    def to_pandas(self):
        return self.df.toPandas()

    @property
    def native(self) -> SparkFrame:
        return self.df

    @property
    def shape(self) -> tuple[int, int]:
        return self.df.count(), len(self.df.columns)

    @classmethod
    def from_pandas(cls, given: Any, spark: SparkSession | None = None) -> FileFrame:
        return cls(given, spark)._relabelled("from_pandas")

    def save_csv(self, path: str) -> None:
        self.save(path, "csv")

    def save_parquet(self, path: str) -> None:
        self.save(path, "parquet")

    @classmethod
    def load(cls, spark: SparkSession, path: str, format: str | None = None) -> FileFrame:
        return cls(files.load(spark, path, format))._relabelled("load", path=path)

    def _relabelled(self, operation: str, **params: Any) -> FileFrame:
        return self._next(self.df, operation, **params)


def _made(data: Any, spark: SparkSession | None) -> SparkFrame:
    if isinstance(data, SparkFrame):
        return data
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise ValueError("no active Spark session")
    if data is None:
        return spark.createDataFrame([], "path string")
    if isinstance(data, dict):
        if len({len(v) for v in data.values()}) > 1:
            raise ValueError("the lists differ in length")
        return spark.createDataFrame(list(zip(*data.values(), strict=True)), list(data)) if data and len(next(iter(data.values()))) else spark.createDataFrame([], ", ".join(f"`{k}` string" for k in data) or "path string")
    if hasattr(data, "to_records") and hasattr(data, "columns"):
        return spark.createDataFrame(data)
    if isinstance(data, list) and all(isinstance(x, dict) for x in data) and data:
        return spark.createDataFrame(data)
    if isinstance(data, list) and all(isinstance(x, (str, PurePath)) for x in data):
        return spark.createDataFrame([(str(x),) for x in data], "path string")
    raise ValueError(f"no frame from {type(data).__name__}")
