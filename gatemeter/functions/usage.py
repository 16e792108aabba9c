"""Token usage fold, cost and throughput (P-14, P-15, P-18) with exact integers.

Money is computed as an exact integer: prices have at most two decimals, so
``tokens * price * 100`` is an integer count of 1e-8 USD.  Rounding to the
micro-dollar (and to cents in reports) happens on integers, which makes the
result identical on every engine and independent of summation order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nz(c: Column) -> Column:
    """``x or 0``: null counts as zero (T3)."""
    return F.coalesce(c.cast("long"), F.lit(0).cast("long"))


def cache_hit_ratio(input_tokens: Column, cache_read: Column) -> Column:
    """P-14: round(cr / (in + cr), 4) or null when the denominator is 0."""
    return rational_round(cache_read, input_tokens + cache_read, 4, wide=False)


def _idiv(a: Column, b: Column) -> Column:
    """Exact floor(a / b) for non-negative integers, as decimal(38,0).

    ``a - pmod(a, b)`` is a multiple of ``b``, so the decimal quotient is an
    exact integer whatever scale Spark gives it; no float is involved.
    """
    a = a.cast("decimal(38,0)")
    b = b.cast("decimal(38,0)")
    return ((a - F.pmod(a, b)) / b).cast("decimal(38,0)")


def _floor_div(a: Column, b: int) -> Column:
    return _idiv(a, F.lit(b)).cast("long")


def _floor_div_long(a: Column, b) -> Column:
    """floor(a / b) for non-negative longs below 2**53 (per-row values).

    ``a - pmod(a, b)`` is an exact multiple of ``b``, so the double quotient
    is an exact integer.
    """
    a = a.cast("long")
    b = b if isinstance(b, Column) else F.lit(int(b))
    return ((a - F.pmod(a, b)) / b).cast("long")


def rational_round(num: Column, den: Column, digits: int, wide: bool = True) -> Column:
    """Exact half-up rounding of num/den (non-negative integers) to ``digits``.

    Integer arithmetic on 38-digit decimals, so the answer does not depend on
    float error or on the engine; returned as DOUBLE, null when ``den`` is 0.
    """
    scale = 10 ** digits
    if not wide:  # per-row values: numerator * 2 * 10**digits stays below 2**53
        n = num.cast("long")
        d = den.cast("long")
        q = _floor_div_long(n * (2 * scale) + d, d * 2)
        return F.when(den > 0, q.cast("double") / F.lit(float(scale)))
    n = num.cast("decimal(38,0)")
    d = den.cast("decimal(38,0)")
    q = _idiv(n * F.lit(2 * scale) + d, d * F.lit(2))
    return F.when(den > 0, q.cast("double") / F.lit(float(scale)))


def cost_e8(inp: Column, out: Column, cr: Column, cw: Column,
            in_c: Column, out_c: Column, cr_c: Column, cw_c: Column) -> Column:
    """Cost in 1e-8 USD: tokens x (USD per 1M tokens x 100)."""
    return inp * in_c + out * out_c + cr * cr_c + cw * cw_c


def micro_usd(cost_in_e8: Column) -> Column:
    """Half-up to whole micro-dollars (1e-6 USD)."""
    return _floor_div_long(cost_in_e8 + 50, 100)


def usd_from_micro(micro: Column) -> Column:
    return micro.cast("double") / F.lit(1e6)


def cents_from_micro(micro_sum: Column) -> Column:
    """round(sum_usd, 2) on the exact integer sum, as DOUBLE dollars."""
    return _floor_div(micro_sum + 5000, 10000).cast("double") / F.lit(100.0)


def tokens_per_sec(output_tokens: Column, elapsed_ms: Column, ttft_ms: Column) -> Column:
    """P-18: round(out / ((elapsed - ttft) / 1000), 2) when both are positive."""
    gen_ms = elapsed_ms.cast("long") - F.coalesce(ttft_ms.cast("long"), F.lit(0))
    return F.when((gen_ms > 0) & (output_tokens > 0),
                  rational_round(output_tokens.cast("long") * 1000, gen_ms, 2, wide=False))
