"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatemeter.session import checkpoint_dir

T = TypeVar("T")

# ASCII white space only: the other Unicode spaces belong to words.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_RE = f"[^{SPACE_CLASS}]+"
SPACES = " \t\n\x0b\x0c\r"
TO_BLANK = str.maketrans("\t\n\x0b\x0c\r", "     ")
LOWER_AZ = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def split_words(text: str) -> list[str]:
    """The ``WORD_RE`` words of one text (str.split() would also cut at other Unicode spaces)."""
    return [w for w in text.translate(TO_BLANK).split(" ") if w] if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, *cols: Column | str) -> DataFrame:
    """``select`` that Catalyst cannot merge with the next projection.

    Lambdas that read a column by position would otherwise re-evaluate its
    expression for every element.
    """
    return df.select(F.inline(F.array(F.struct(*cols))))


def words(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), ""),
                      F.array().cast("array<string>"))


def integer_vectors(vectors: DataFrame, scale: int, column: str = "embedding") -> DataFrame:
    """Rows whose vector is whole (not null, no null or non-finite component), with ``v``: floor(scale * x) of each."""
    x = F.col(column)
    fits = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # floor() of a double ends at the range of a long
    return vectors.where(x.isNotNull() & fits).withColumn(
        "v", F.transform(x, lambda c: F.floor(scale * c.cast("double")).cast("long")))


_MEMO: dict[object, object] = {}


def worker_memo(key: object, make: Callable[[], T]) -> T:
    """The memo of a Python worker.  Workers are reused by later stages, so another key drops the memo before."""
    if key not in _MEMO:
        if _MEMO:
            _MEMO.clear()
            give_back()
        _MEMO[key] = make()
    return _MEMO[key]


def give_back() -> None:
    """Hand freed memory back to the machine: what the allocators keep would count beside the next memo."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's only
    if trim is not None:
        trim(0)


def written(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/gatemeter-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that no later plan reads."""
    path = getattr(df, "_written_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: (node, component = smallest node of its component).

    Alternating large-star and small-star steps: every step is two joins-free
    aggregations on the smaller endpoint, the edge count never grows, and the
    rounds are logarithmic in the longest chain.  Null endpoints and self loops
    are ignored; no edges give no rows.  A node of very high degree is one
    aggregation key with map-side partial minima, never one collected group.
    """
    def deduplicated(pairs: DataFrame) -> tuple[DataFrame, tuple]:
        out = written(pairs.where("u != v").distinct())
        return out, tuple(out.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    first, mark = deduplicated(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                               .where(F.col(a).isNotNull() & F.col(b).isNotNull()))
    cur = first
    while mark[0]:
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours of u point at the smallest neighbour of u
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours point at the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u")
                 .select(F.inline(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                          F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))))
        nxt, new_mark = deduplicated(small)
        if cur is not first:
            discard(cur)
        cur, done, mark = nxt, new_mark == mark, new_mark
        if done:
            break
    nodes = first.select(F.col("u").alias("node")).unionByName(first.select(F.col("v").alias("node"))).distinct()
    return (nodes.join(cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")), "node", "left")
            .select("node", F.coalesce("m", "node").alias("component")))
