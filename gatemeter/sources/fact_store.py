"""SRC-2: the stored 49-column fact table.

Rows lie in day folders and, inside them, in hash buckets of ``request_id``
sorted by it.  A report on some days opens those folders only, and a join on
``request_id`` with another table of as many buckets (the body features, say)
needs no exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatemeter import fixed
from gatemeter.operators.telemetry import EXTRA_COLUMNS

BUCKETS = 16
KEY = "request_id"


def write_bucketed(rows: DataFrame, name: str, path: str, buckets: int = BUCKETS, day: bool = True) -> DataFrame:
    """Store rows as table ``name`` at ``path``, bucketed and sorted by ``request_id`` and, with ``day``, by folder."""
    if day:
        rows = rows.withColumn("day", F.to_date("ts"))
    # one file per bucket and folder: what a task writes is what one bucket holds
    writer = rows.repartition(buckets, KEY).write.mode("overwrite").format("parquet").option("path", path)
    writer = writer.partitionBy("day") if day else writer
    writer.bucketBy(buckets, KEY).sortBy(KEY).saveAsTable(name)
    return rows.sparkSession.table(name)


def read_facts(spark: SparkSession, path: str, days: tuple[str, str] | None = None) -> DataFrame:
    """The stored facts with the contract's 49 columns and types, first to last day if given.

    Files without one of the columns give nulls; other columns are not read.
    """
    schema = T.StructType([*fixed.TELEMETRY_SCHEMA.fields, *[T.StructField(c, T.LongType()) for c in EXTRA_COLUMNS],
                           T.StructField("day", T.DateType())])
    stored = spark.read.schema(schema).parquet(path)
    if days:
        stored = stored.where(F.col("day").between(F.lit(days[0]).cast("date"), F.lit(days[1]).cast("date")))
    return stored
