"""Where queries and their SQL twins are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL that must give the same rows."""

    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


# Session setting: partitions into which tables are dealt before expensive row-wise work.  Unset, which
# is right for any table of several files or row groups, rows are worked on where they are read.
INPUT_PARTITIONS = "posttrain.input.partitions"


def work_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table about to get expensive row-wise work."""
    partitions = spark.conf.get(INPUT_PARTITIONS, None)
    df = table(spark, sf_dir, name)
    return df.repartition(int(partitions)) if partitions else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
