"""Corpus pipeline: quality, toxicity, near-duplicates, mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.

Edge cases, as in the operators: documents whose text is null, empty or blank
score as texts without lines and units, are near-copies of nothing, have size 0
in the mix and pack as their end mark alone; repeated rows are judged one by one
and are one group of near-copies; rows without an id take part like others; very
long texts are read whole; an empty table gives an empty result; other columns,
whatever their names, are carried along up to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatemeter.llm import minhash, mixing, packing, quality_crf, toxicity
from gatemeter.llm.common import table, written
from gatemeter.session import bound_batches


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores below one half go."""
    bound_batches(spark)
    model = quality_crf.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_crf.quality(F.col("text"), model) >= 0.5)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine scores one half or more go."""
    bound_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxicity(F.col("text"), model) < 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (words in shingles of five, similarity 0.8 or more)."""
    bound_batches(spark)
    return minhash.keep_one(docs, shingle=5).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them; the last of a source ends at its target."""
    bound_batches(spark)
    return mixing.draw(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset."""
    bound_batches(spark)
    return packing.pack(docs)


STAGES = [("quality classifier", quality_classifier), ("toxicity", toxicity_filter),
          ("minhash near-dedup", near_duplicates), ("mixing sources", mix_sources),
          ("best-fit packing", pack_sequences)]

# the fitted models and the tokenizer are outside SQL; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
