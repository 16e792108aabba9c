"""Web-search spend (A-18, W-1, J-5).

Spend is kept in integer micro-dollars so daily totals and running totals
are exact; dollars are derived at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatemeter.operators.windows import running_sum


def _search_calls(requests: DataFrame) -> DataFrame:
    return (requests.where((F.col("route") == "tavily") & (F.col("tavily_cost_usd") > 0))
            .select("request_id", "ts", F.to_date("ts").alias("day"),
                    F.round(F.col("tavily_cost_usd") * 1e6).cast("long").alias("cost_micro")))


def daily_search_spend(requests: DataFrame) -> DataFrame:
    """A-18: ``(day, searches, spend_usd)``."""
    return (_search_calls(requests).groupBy("day")
            .agg(F.count(F.lit(1)).alias("searches"),
                 (F.sum("cost_micro").cast("double") / 1e6).alias("spend_usd")))


def running_micro(requests: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Paid searches with ``_run``, the day's spend so far in micro-dollars by (ts, request_id)."""
    return running_sum(_search_calls(requests), ["day"], ["ts", "request_id"], "cost_micro", "_run",
                       num_partitions=num_partitions)


def as_spent() -> list:
    """The logged columns of :func:`running_micro`."""
    return [F.col("request_id"), F.col("ts"), (F.col("cost_micro").cast("double") / 1e6).alias("cost_usd"),
            (F.col("_run").cast("double") / 1e6).alias("spend_today_usd")]


def running_search_spend(requests: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """W-1: each paid search with the day's spend so far (``spend_today_usd``),
    ordered by (ts, request_id) within the day, rounded to 4 decimals as logged."""
    return running_micro(requests, num_partitions).select(*as_spent(), "day")
