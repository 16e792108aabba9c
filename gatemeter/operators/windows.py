"""Running totals that stay balanced when one key holds most of the rows.

``sum(v) OVER (PARTITION BY key ORDER BY o ROWS UNBOUNDED PRECEDING)`` makes
one task sort and scan a whole key; if a single day holds a third of all
calls, that task holds a third of the data.  :func:`running_sum` computes the
same column as a parallel prefix sum:

1. range-partition by ``(key, order...)``: Spark samples the sort keys, so
   each partition receives an equal slice even when a key is hot, and a key
   may span several partitions;
2. a running sum inside each ``(key, partition)`` slice (bounded by the
   partition size);
3. the total of every ``(key, partition)`` slice: at most
   ``partitions + keys`` rows, then prefix-summed over partitions;
4. add the offset back with a join on ``(key, partition)``, which AQE turns
   into a broadcast when the offsets it measured are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
                num_partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = (df.repartitionByRange(n, *[F.col(k) for k in keys], *[F.col(o) for o in order])
              .withColumn("_slice", F.spark_partition_id()))
    # materialise the slice assignment once so every branch sees the same one
    # (range boundaries come from sampling) and so lost executors recompute nothing
    from gatemeter.session import cut_lineage

    ranged = cut_lineage(ranged)
    in_slice = (Window.partitionBy(*keys, "_slice").orderBy(*order)
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.withColumn("_local", F.sum(value).over(in_slice))
    totals = ranged.groupBy(*keys, "_slice").agg(F.sum(value).alias("_t"))
    before = (Window.partitionBy(*keys).orderBy("_slice")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*keys, "_slice",
                            F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    offsets = offsets.select(*keys, "_slice", F.col("_off").cast(local.schema["_local"].dataType)
                             .alias("_off"))
    joined = local.join(offsets, [*keys, "_slice"], "left")
    return joined.withColumn(out, F.col("_local") + F.coalesce(F.col("_off"), F.lit(0))) \
                 .drop("_local", "_off", "_slice")
