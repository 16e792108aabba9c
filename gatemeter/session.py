"""SparkSession construction and cluster-facing settings."""

from __future__ import annotations

import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  UTC keeps timestamp arithmetic identical on
# the driver, the executors and the DuckDB oracle; AQE re-plans joins and
# shuffle partition counts at runtime and splits skewed join partitions.
BASE_CONF: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a repeated key in a JSON object counts with its last value, as in Python
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Rows that hold whole texts make Arrow batches of the default row count large in every Python worker.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Hand rows to Python workers in batches of at most ``BATCH_BYTES``."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "gatemeter", extra: dict[str, str] | None = None
              ) -> SparkSession:
    """Build (or reuse) a session with the library's settings.

    On a cluster leave ``master`` unset so spark-submit decides; tests pass
    ``local[*]`` and a small shuffle-partition count.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    Where the setting is absent, a session on one machine (``local[...]``, as in
    tests) gets a private folder; on a cluster that is an error, because
    executors and driver would not see each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = _LOCAL_DIRS.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="gatemeter-ckpt-")
        _LOCAL_DIRS[context.applicationId] = path
    return path


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Functions that run in Python workers are pickled by module name, so the
    workers must be able to import the package wherever it is installed.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED or re.fullmatch(r"local(\[.*\])?", context.master) and _importable():
        return
    folder = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="gatemeter-zip-"), "gatemeter"), "zip",
                                  os.path.dirname(folder), os.path.basename(folder))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def _importable() -> bool:
    """Local workers inherit PYTHONPATH and the working directory, not sys.path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    seen = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    return root in map(os.path.abspath, filter(None, seen))


_SHIPPED: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediates."""
    return os.path.join(checkpoint_dir(spark), name)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared folder, survives executor loss)."""
    df.sparkSession.sparkContext.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)
