"""Readers for the landed parquet tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

TABLES: tuple[str, ...] = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """Read one table; a ``<name>.parquet`` file or folder under ``base_dir``."""
    return spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, base_dir: str, names=TABLES) -> list[str]:
    """Expose the landed tables to ``spark.sql`` under their own names; the names found.

    Existence is asked of Spark's reader, so tables in any store it can open count.
    """
    found = []
    for name in names:
        try:
            read_table(spark, base_dir, name).createOrReplaceTempView(name)
        except AnalysisException:
            continue
        found.append(name)
    return found
