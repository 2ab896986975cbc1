"""From raw documents to a training mix.

Each stage takes the documents its predecessor kept and returns those it keeps, with the
columns of ``documents``; the mix adds the words it takes of each. Stages are joined by
Parquet tables in the shared folder, so a lost executor never sends work back beyond
the last of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabletrail.llm import decontamination, languages, mixing, secrets, simhash
from tabletrail.llm.common import read, saved

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", languages.stage),
    ("simhash_dedup", simhash.stage),
    ("decontamination", decontamination.stage),
    ("secret_scan", secrets.stage),
    ("source_mix", mixing.stage),
]

# Language profiles and XXH64 fingerprints are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
