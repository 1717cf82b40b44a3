"""Embeddings of metadata, texts and images, and neighbours by them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stonecrop.functions import kinds
from stonecrop.functions.arrays import let
from stonecrop.operators import similarity


def _scaled(c: Column, low: float | None, high: float | None) -> Column:
    """Min-max; a constant column gives 0.5, nulls 0."""
    if low is None:
        return F.lit(0.0)
    inner = F.lit(0.5) if high == low else (c - F.lit(float(low))) / F.lit(float(high) - float(low))
    return F.coalesce(F.when(c.isNotNull(), inner), F.lit(0.0))


def metadata_embedding(df: DataFrame, numeric: list[str] = (), datetimes: list[str] = (), categorical: list[str] = (), log_columns: tuple[str, ...] = ("size_bytes", "size"), max_categories: int = 20, out: str = "metadata_embedding") -> DataFrame:
    """Add an array<double>: numbers and times min-max scaled (sizes by log1p first), then a one-hot part for each category column.

    A category column has its ``max_categories`` most frequent values, by count, then value; the rest share one
    place if there are any. A null category is the value ``<null>``. Two small aggregates fix the layout.
    """
    values = {c: F.log1p(F.col(c).cast("double")) if c in log_columns else F.col(c).cast("double") for c in numeric}
    values |= {c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6 for c in datetimes}
    bounds = df.agg(*[f(v).alias(f"{f.__name__}{i}") for i, v in enumerate(values.values()) for f in (F.min, F.max)]).first() if values else []
    parts = [_scaled(v, bounds[2 * i], bounds[2 * i + 1]) for i, v in enumerate(values.values())]
    for c in categorical:
        text = F.coalesce(F.col(c).cast("string"), F.lit("<null>"))
        top = [r[0] for r in df.groupBy(text.alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(max_categories + 1).collect()]
        kept, other = top[:max_categories], len(top) > max_categories
        parts += [F.when(text == v, 1.0).otherwise(0.0) for v in kept]
        if other:
            parts.append(F.when(text.isin(kept), 0.0).otherwise(1.0))
    return df.withColumn(out, F.array(*parts).cast("array<double>"))


#: Factors of the code points of a trigram in its hash.
FACTORS = (7919, 104729, 1299709)


def hashed_embedder(dimensions: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for a model: signed hashes of character trigrams, to unit length.

    With a text lower-cased and a space on either side, trigram abc has h = 7919 a + 104729 b + 1299709 c of its code
    points; it adds 1 to place h mod ``dimensions`` if (h div ``dimensions``) is odd, and takes 1 if it is even.
    """
    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimensions))
        for row, text in zip(out, texts, strict=True):
            points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), "<u4").astype(np.int64)
            h = points[:-2] * FACTORS[0] + points[1:-1] * FACTORS[1] + points[2:] * FACTORS[2]
            row += np.bincount(h % dimensions, weights=2.0 * (h // dimensions % 2) - 1, minlength=dimensions)
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n == 0, 1, n)).tolist()

    return embed


def text_embedding(df: DataFrame, text_col: str = "text", path_col: str | None = None, embedder: Callable[[list[str]], list[list[float]]] | None = None, max_chars: int | None = 4000, out: str = "embedding") -> DataFrame:
    """Add array<double> of the first ``max_chars`` characters, of all of them if it is None; null for blank texts, and for paths that aren't text files.

    ``embedder`` takes a list of texts; it is made once a worker if it has an attribute ``load``.
    """
    run = embedder or hashed_embedder()

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embedded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = run.load() if hasattr(run, "load") else run
        for texts in batches:
            found = pd.Series([None] * len(texts), dtype=object)
            ask = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            for i, v in zip(ask, model([texts.iloc[i] for i in ask]), strict=True):
                found.iloc[i] = [float(x) for x in v]
            yield found

    text = F.col(text_col) if max_chars is None else F.substring(F.col(text_col), 1, max_chars)
    if path_col:
        text = F.when(kinds.is_text(F.col(path_col)), text)
    return df.withColumn(out, embedded(text))


def image_embedding(df: DataFrame, content_col: str = "content", path_col: str = "path", embedder: Callable[[list[bytes]], list[list[float]]] | None = None, out: str = "image_embedding") -> DataFrame:
    """Add array<double> of image bytes by ``embedder``; null for other files, and without an embedder."""
    if embedder is None:
        return df.withColumn(out, F.lit(None).cast("array<double>"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embedded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for data in batches:
            found = pd.Series([None] * len(data), dtype=object)
            ask = [i for i, t in enumerate(data) if t is not None]
            for i, v in zip(ask, embedder([bytes(data.iloc[i]) for i in ask]), strict=True):
                found.iloc[i] = [float(x) for x in v]
            yield found

    return df.withColumn(out, embedded(F.when(kinds.is_image(F.col(path_col)), F.col(content_col))))


def _weighed(vector: Column, meta: Column, weight: float) -> tuple[Column, Column]:
    """Vectors of a row as a query and as a neighbour, whose product is weight * cos + (1 - weight) * meta cos where both have metadata, else cos."""
    def scaled(v: Column, by: float) -> Column:
        return let(F.sqrt(similarity.dot(v, v)), lambda n: F.transform(v, lambda x: F.when(n == 0, 0.0).otherwise(x.cast("double") * by / n)))

    own, rest = weight**0.5, (1 - weight) ** 0.5
    none = F.transform(vector, lambda x: F.lit(0.0))
    c, m = scaled(vector, rest), scaled(meta, rest)
    has = meta.isNotNull()
    # the last two parts make up for the metadata of pairs in which one or both have none
    width = F.coalesce(F.size(meta), F.lit(0))
    query = F.concat(scaled(vector, own), c, F.when(has, none).otherwise(c), F.when(has, m).otherwise(F.array().cast("array<double>")))
    row = F.concat(scaled(vector, own), F.when(has, none).otherwise(c), F.when(has, c).otherwise(none), F.when(has, m).otherwise(F.array().cast("array<double>")))
    return F.struct(query.alias("v"), width.alias("n")), F.struct(row.alias("v"), width.alias("n"))


def with_neighbours(df: DataFrame, k: int = 5, id_col: str = "id", name_col: str = "path", vector_col: str = "embedding", blend: dict[str, float] | None = None, meta_col: str | None = None, content_weight: float = 0.5) -> DataFrame:
    """Add nearest_neighbor_paths and nearest_neighbor_similarities, null where a row has no neighbour.

    With ``meta_col`` similarity is the weighted mean of both cosines for pairs that both have that vector, and the cosine of
    ``vector_col`` for others. ``blend`` instead weighs several columns, which all must be there.
    """
    if missing := {c for c in (vector_col if blend is None else None, meta_col, *(blend or ())) if c} - set(df.columns):
        raise ValueError(f"no column {sorted(missing)}")
    if meta_col:
        size = df.agg(F.max(F.size(F.col(meta_col)))).first()[0] or 0
        pad = lambda x: F.concat(x["v"], F.array_repeat(F.lit(0.0), F.lit(max(size, 0)) - F.greatest(x["n"], F.lit(0))))
        query, row = _weighed(F.col(vector_col), F.col(meta_col), content_weight)
        sides = df.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), query.alias("q"), row.alias("r")).select("id", pad(F.col("q")).alias("q"), pad(F.col("r")).alias("r"))
        found = similarity.nearest(sides.select("id", F.col("r").alias("vector")), sides.select("id", F.col("q").alias("vector")), k, cosine=False)
    else:
        rows = df.select(F.col(id_col).alias("id"), (similarity.blended(blend) if blend else F.col(vector_col)).alias("vector"))
        found = similarity.nearest(rows, rows, k)
    names = df.select(F.col(id_col).alias("neighbour"), F.col(name_col).alias("name"))
    top = found.join(names, "neighbour").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "similarity"))).alias("top"))
    out = df.join(top, df[id_col] == top["query"], "left")
    return out.withColumn("nearest_neighbor_paths", F.col("top.name")).withColumn("nearest_neighbor_similarities", F.col("top.similarity")).drop("query", "top")
