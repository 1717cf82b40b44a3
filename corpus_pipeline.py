"""From raw documents to packed training windows; part of ``stonecrop.llm``.

Each stage takes what its predecessor kept, as Parquet, and its decisions take effect: rejected,
repeated and leaked documents go, personal data is replaced in the texts. What a stage writes for itself is
deleted once its result is written, and that once the next stage's is.

Null and empty texts have fewer than 50 words, so the first stage rejects them; rows without an id are kept as any
others. Repeated rows are copies, of which the second stage keeps one. Columns beyond those of ``documents`` pass
through all stages but the last, whatever their names. An empty table gives an empty one; without labels of
both kinds the first stage has the base rules only, and without benchmark items the third keeps all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stonecrop.llm import decision_list, decontaminate, packing, pii, simhash
from stonecrop.llm.common import discard, read, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject."""
    return decision_list.keep_good(docs, decision_list.fit(docs, read(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs, length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training windows."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", deduplicate), ("decontamination", decontaminated), ("personal_data", private), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(spark, [before])
        before = keep.path
    return STAGES[-1][1](spark, docs, sf_dir)
