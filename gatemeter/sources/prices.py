"""SRC-7: price dimensions as small DataFrames (fixed size, safe to broadcast)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatemeter import fixed

PRICE_SCHEMA = T.StructType([
    T.StructField("price_model", T.StringType(), False),
    # USD per 1M tokens x 100: exact integers because list prices have <= 2 decimals
    T.StructField("in_c", T.LongType(), False),
    T.StructField("out_c", T.LongType(), False),
    T.StructField("cache_read_c", T.LongType(), False),
    T.StructField("cache_write_c", T.LongType(), False),
    T.StructField("premium", T.DoubleType(), False),
])


def _c(x: float) -> int:
    return int(round(x * 100))


def literal_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small constant table built from literals on the JVM side (a local
    relation; no Python worker and no RDD)."""
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, schema.fields)])
               for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def price_table(spark: SparkSession, prices: dict | None = None) -> DataFrame:
    """One row per priced model.  Its size is the size of the price list."""
    prices = fixed.PRICES if prices is None else prices
    rows = [(m, _c(p[0]), _c(p[1]), _c(p[2]), _c(p[3]), float(p[4])) for m, p in prices.items()]
    return literal_table(spark, rows, PRICE_SCHEMA)


def price_map(prices: dict | None = None) -> Column:
    """model -> struct of prices, as one literal map (as many entries as the price list)."""
    prices = fixed.PRICES if prices is None else prices
    items = []
    for model, p in prices.items():
        values = (_c(p[0]), _c(p[1]), _c(p[2]), _c(p[3]), float(p[4]))
        items += [F.lit(model), F.struct(*[F.lit(v).cast(f.dataType).alias(f.name)
                                           for v, f in zip(values, PRICE_SCHEMA.fields[1:])])]
    return F.create_map(*items)
