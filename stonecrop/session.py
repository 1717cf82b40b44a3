"""Spark sessions with the settings the library is made for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[*]", app: str = "stonecrop", **settings: str) -> SparkSession:
    # Python workers on this machine find the library where it isn't installed, too
    here, known = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (known, here) if x)
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in {**SETTINGS, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
