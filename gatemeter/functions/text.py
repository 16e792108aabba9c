"""String helpers with the gateway's exact semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatemeter import fixed

# Characters Python's str.strip() removes (str.isspace), built from code points.
_PY_SPACE_CODES = (list(range(0x09, 0x0E)) + list(range(0x1C, 0x21)) + [0x85, 0xA0, 0x1680]
                   + list(range(0x2000, 0x200B)) + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
PY_WHITESPACE = "".join(chr(c) for c in _PY_SPACE_CODES)


def pystrip(s: Column) -> Column:
    """Remove leading/trailing whitespace of every kind (T4), not only spaces.

    ``btrim`` with an explicit character set runs as a JVM character loop.
    """
    return F.btrim(s, F.lit(PY_WHITESPACE))


def blank_to_null(s: Column) -> Column:
    """T6: the empty string counts as missing."""
    return F.when(s == "", F.lit(None).cast("string")).otherwise(s)


def _tenths_half_even(n: Column, unit: int) -> Column:
    """``n / unit`` to one decimal, half-to-even on the exact value, as text.

    Python formats ``n / 1024`` with ``.1f`` by rounding the exact binary
    value half-to-even (1280 B is ``1.2KB``); Java's ``%.1f`` rounds half-up
    (``1.3KB``).  Integer arithmetic reproduces Python exactly.
    """
    x = n.cast("long") * 10
    q = F.floor(x / F.lit(unit)).cast("long")
    r2 = (x - q * unit) * 2
    t = q + F.when(r2 > unit, 1).when((r2 == unit) & (q % 2 == 1), 1).otherwise(0)
    return F.concat((F.floor(t / 10)).cast("long").cast("string"), F.lit("."), (t % 10).cast("string"))


def fmt_size(n: Column) -> Column:
    """P-9: ``512B`` / ``1.5KB`` / ``2.0MB``."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit("B")))
        .when(n < 1024 * 1024, F.concat(_tenths_half_even(n, 1024), F.lit("KB")))
        .otherwise(F.concat(_tenths_half_even(n, 1024 * 1024), F.lit("MB")))
    )


def preview(s: Column, n: int = fixed.PREVIEW_CHARS) -> Column:
    """P-25: first ``n`` characters, newlines as spaces, ``...`` when cut."""
    head = F.replace(F.substring(s, 1, n), F.lit("\n"), F.lit(" "))
    return F.when(F.char_length(s) > n, F.concat(head, F.lit("..."))).otherwise(head)


def token_estimate(s: Column) -> Column:
    """P-24: ``max(1, len(text) // 4)``."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.char_length(s) / 4).cast("long"))


def cut(s: Column, n: int) -> Column:
    return F.substring(s, 1, n)
