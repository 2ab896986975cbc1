"""Session defaults for running outside a cluster-provided session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# On a cluster these come from the submitted configuration; every setting here is
# also safe there, because each lets Spark decide at run time from measured sizes.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(app: str = "tabletrail", cores: int | str = "*", **extra: str) -> SparkSession:
    """A ``local[cores]`` session with the defaults above."""
    if cores == "*":
        cores = os.cpu_count() or 1
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
