"""Keys of an append-only Parquet table, so that a batch looks up its own keys only.

The table's files are the truth.  The index is derived from them and kept in the
table's folder under ``_keys``, which readers of the table skip:

* a generation holds the keys of the files that it covers, in 2^g hash buckets
  of about ``bucket_keys`` keys, one folder each, and the list of those files;
* files that no generation covers yet are read themselves, key columns only.

So the two cannot fall out of step after a crash, and a lookup reads the buckets
that the batch's keys fall into plus the keys of at most ``max_files`` young
files: the bytes of a lookup do not grow with the table.  :meth:`KeyIndex.compact`
writes the next generation, with more buckets when the table has grown; appends
call it when ``max_files`` are uncovered, and a maintenance job may do so earlier.
"""

from __future__ import annotations

import os
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "bucket"
FOLDER = "_keys"
MOST_BUCKETS = 1 << 16


class KeyIndex:
    """The stored keys of the table at ``path``; ``keys`` are its key fields."""

    def __init__(self, spark: SparkSession, path: str, keys: T.StructType, bucket_keys: int = 50_000,
                 max_files: int = 256):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.bucket_keys, self.max_files = bucket_keys, max_files
        self.names = keys.fieldNames()

    # --- what is there -----------------------------------------------------------------------------------------
    def _fs(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{FOLDER}")
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def generations(self) -> list[int]:
        """Whole generations (the list of files is written last), oldest first."""
        fs, root = self._fs()
        if not fs.exists(root):
            return []
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path
        found = [int(s.getPath().getName().removeprefix("gen=")) for s in fs.listStatus(root)]
        return sorted(g for g in found if fs.exists(jpath(f"{self._of(g, 'files')}/_SUCCESS")))

    def _of(self, generation: int, what: str) -> str:
        return f"{self.path}/{FOLDER}/gen={generation}/{what}"

    def files(self) -> list[str]:
        """The table's data files, relative to its folder."""
        try:
            found = self.spark.read.schema(self.keys).parquet(self.path).inputFiles()
        except AnalysisException:
            return []
        root = f"{os.path.basename(self.path)}/"
        return [unquote(f).rsplit(root, 1)[1] for f in found]

    def covered(self, generation: int) -> tuple[set[str], int]:
        rows = self.spark.read.schema("file string, buckets int").parquet(self._of(generation, "files")).collect()
        return {r.file for r in rows if r.file is not None}, max(r.buckets for r in rows)

    def _state(self) -> tuple[int | None, int, list[str]]:
        """Newest generation, its buckets, and the files it doesn't cover."""
        known = self.generations()
        covered, buckets = self.covered(known[-1]) if known else (set(), 0)
        return (known[-1] if known else None), buckets, [f for f in self.files() if f not in covered]

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.names), F.lit(buckets)).cast("int")

    def _young(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(self.keys).parquet(*[f"{self.path}/{f}" for f in files]).select(*self.names)

    def _generation(self, generation: int) -> DataFrame:
        schema = T.StructType([*self.keys.fields, T.StructField(BUCKET, T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self._of(generation, "keys"))

    # --- lookup ------------------------------------------------------------------------------------------------
    def stored(self, batch: DataFrame) -> DataFrame | None:
        """Stored keys among which all of the batch's stored keys are; None when nothing is stored."""
        generation, buckets, young = self._state()
        parts = [self._young(young)] if young else []
        if generation is not None:
            base = self._generation(generation)
            present = [r[0] for r in batch.select(self._bucket(buckets)).distinct().collect()]  # at most the buckets
            if len(present) < buckets:
                base = base.where(F.col(BUCKET).isin(present))
            parts.append(base.select(*self.names))
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    # --- maintenance -------------------------------------------------------------------------------------------
    def due(self) -> bool:
        return len(self._state()[2]) >= self.max_files

    def compact(self) -> None:
        """Write the next generation over all files that are there now; the one before stays for running readers."""
        generation, _, young = self._state()
        if not young:
            return
        keys = self._young(young)
        if generation is not None:
            keys = keys.unionByName(self._generation(generation).select(*self.names))
        n = keys.count()
        buckets = 1
        while buckets < MOST_BUCKETS and buckets * self.bucket_keys < n:
            buckets *= 2
        covered = (self.covered(generation)[0] if generation is not None else set()) | set(young)
        fresh = 0 if generation is None else generation + 1
        (keys.withColumn(BUCKET, self._bucket(buckets)).repartition(BUCKET).sortWithinPartitions(BUCKET, *self.names)
         .write.mode("overwrite").partitionBy(BUCKET).parquet(self._of(fresh, "keys")))
        (self.spark.createDataFrame([(f, buckets) for f in sorted(covered)], "file string, buckets int").coalesce(1)
         .write.mode("overwrite").parquet(self._of(fresh, "files")))
        fs, _ = self._fs()
        for old in self.generations()[:-2]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{FOLDER}/gen={old}"), True)
