"""String helpers against Python's own semantics (the gateway is Python)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatemeter.functions.text import fmt_size, preview, pystrip


def _py_fmt_size(n: int) -> str:
    if n < 1024:
        return f"{n}B"
    if n < 1024 * 1024:
        return f"{n / 1024:.1f}KB"
    return f"{n / (1024 * 1024):.1f}MB"


def test_fmt_size_matches_python(spark):
    values = (list(range(0, 5000, 7)) + [1280, 1024 * 1024 - 1, 1024 * 1024, 2621440, 3 * 1024 * 1024 + 52429]
              + [k * 1024 + 51 * j for k in range(1, 200, 13) for j in range(0, 20)]
              + [k * 1048576 + 52428 * j for k in range(1, 9) for j in range(0, 20)])
    df = spark.createDataFrame([(v,) for v in values], "n long")
    got = {r.n: r.s for r in df.select("n", fmt_size(F.col("n")).alias("s")).collect()}
    assert got == {v: _py_fmt_size(v) for v in values}


def test_strip_and_preview(spark):
    texts = ["  a b \n", " x　", "", "line1\nline2" * 10]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(pystrip(F.col("t")).alias("s"), preview(F.col("t")).alias("p")).collect()
    assert [r.s for r in rows] == [t.strip() for t in texts]
    want = [t[:80].replace("\n", " ") + ("..." if len(t) > 80 else "") for t in texts]
    assert [r.p for r in rows] == want
