"""A Spark session with the settings the engine is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "folianta", master: str | None = None, **conf: str) -> SparkSession:
    """An existing session, or a new one with AQE, Arrow and UTC set.

    On a cluster ``spark-submit`` supplies master, memory and the number of
    shuffle partitions; the values here only fill in what is unset locally.
    """
    build = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" not in os.environ:
        build = build.master(master or "local[*]")
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        build = build.config(key, value)
    return build.getOrCreate()
