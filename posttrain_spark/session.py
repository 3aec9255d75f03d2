"""Session settings and shared scratch space."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Settings the operators rely on.  Adaptive execution sizes the shuffles and splits hot keys.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(name: str, master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).

    Where it is unset, as in tests, a folder in the session's warehouse is taken: executors reach the
    warehouse in any set-up in which they can write tables.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


_RUN_FOLDERS: dict[tuple[str, str], str] = {}


def run_dir(spark: SparkSession) -> str:
    """A folder of this run below the shared folder; it is removed when the driver ends."""
    place = (spark.sparkContext.applicationId, shared_dir(spark))
    if place not in _RUN_FOLDERS:
        folder = f"{place[1]}/run-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _RUN_FOLDERS[place] = folder
    return _RUN_FOLDERS[place]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own for one run below the shared folder."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df, name: str):
    """Write ``df`` once to the shared folder and read it back.

    Used where one narrow frame feeds several passes.  The written table also cuts the lineage, so
    a lost executor costs a re-read and not a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
