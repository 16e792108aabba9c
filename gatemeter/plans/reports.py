"""The published analytic queries over the telemetry table (A-1..A-5, S-1).

Each is one hash aggregate: Spark computes partial aggregates per task
before the shuffle, so the exchange carries one row per (task, group), not
per call.  Money and ratios are rounded on exact integer sums (see
:mod:`gatemeter.functions.usage`), so results do not depend on the order in
which partitions are combined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatemeter.functions import usage as U


def usage_by_session(requests: DataFrame) -> DataFrame:
    """A-1: tokens and cost-equivalent per session, most expensive first.

    ``any_value(session_name)`` is replaced by ``max`` so the answer is
    deterministic (the name is constant within a session).
    """
    return (requests.groupBy("session_id")
            .agg(F.max("session_name").alias("name"),
                 F.count(F.lit(1)).alias("turns"),
                 F.sum(F.col("input_tokens").cast("long")).alias("input"),
                 F.sum(F.col("output_tokens").cast("long")).alias("output"),
                 F.sum(F.col("cache_read_tokens").cast("long")).alias("cache_read"),
                 U.cents_from_micro(F.sum("est_cost_micro_usd")).alias("est_usd"))
            .orderBy(F.col("est_usd").desc(), F.col("session_id").asc_nulls_first()))


def cache_ratio_by_day(requests: DataFrame) -> DataFrame:
    """A-2: cache hit ratio per day on the native route."""
    return (requests.where(F.col("route") == "native")
            .groupBy(F.to_date("ts").alias("day"))
            .agg(U.rational_round(F.sum(F.col("cache_read_tokens").cast("long")),
                                  F.sum(F.col("input_tokens").cast("long")
                                        + F.col("cache_read_tokens").cast("long")), 3)
                 .alias("cache_hit_ratio"))
            .orderBy("day"))


def cost_by_model(requests: DataFrame) -> DataFrame:
    """A-3: calls, tokens and cost-equivalent per upstream model."""
    return (requests.groupBy("upstream_model")
            .agg(F.count(F.lit(1)).alias("calls"),
                 F.sum(F.col("total_tokens").cast("long")).alias("tokens"),
                 U.cents_from_micro(F.sum("est_cost_micro_usd")).alias("est_usd"))
            .orderBy(F.col("est_usd").desc(), F.col("upstream_model")))


def throughput_by_model(requests: DataFrame) -> DataFrame:
    """A-4: mean output throughput and mean TTFT per model, streaming calls.

    The per-call rate has two decimals, so ``rate * 100`` is an exact integer
    and the mean is rounded on exact sums.
    """
    rate_centi = F.round(F.col("output_tokens_per_sec") * 100).cast("long")
    return (requests.where(F.col("stream") & F.col("output_tokens_per_sec").isNotNull())
            .groupBy("upstream_model")
            .agg(F.sum(rate_centi).alias("_r"), F.count(F.lit(1)).alias("_n"),
                 F.sum(F.col("ttft_ms").cast("long")).alias("_t"),
                 F.count("ttft_ms").alias("_tn"))
            .select("upstream_model",
                    U.rational_round(F.col("_r"), F.col("_n") * 100, 1).alias("avg_tok_per_sec"),
                    U.rational_round(F.col("_t"), F.col("_tn"), 0).alias("avg_ttft_ms")))


def totals(requests: DataFrame) -> DataFrame:
    """A-5: number of calls and total output tokens."""
    return requests.agg(F.count(F.lit(1)).alias("calls"),
                        F.sum(F.col("output_tokens").cast("long")).alias("output_tokens"))
