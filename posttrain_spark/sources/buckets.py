"""Completions and parsed labels as bucketed tables, joined for scoring without an exchange.

Both tables are dealt by the prompt into the same buckets when they are written.  Every later scoring
run reads bucket against bucket: completions, the large side, are never shuffled again.  A bucket is
read by one task, so a prompt with more completions than an even bucket is cut into pieces that lie
in buckets of their own, and its label is stored once per piece.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from posttrain_spark.operators.skew import hot_keys, key_counts, pieces_of
from posttrain_spark.session import durable

# Completions that a bucket should hold; the number of buckets follows.
ROWS_PER_BUCKET = 200_000

# The piece of a prompt that a row belongs to; a NULL prompt is a key like any other.
PIECE = "_piece"


@dataclass(frozen=True)
class ScoringTables:
    """Names of the two tables and what they are joined by."""

    samples: str
    labels: str
    key: str
    buckets: int


def _write(df: DataFrame, name: str, path: str, key: str, buckets: int) -> None:
    # Dealt by the function that places the buckets: one file per bucket.
    dealt = df.repartition(buckets, key, PIECE)
    writer = dealt.write.bucketBy(buckets, key, PIECE).sortBy(key, PIECE)
    writer.format("parquet").option("path", path).saveAsTable(name)


def write_scoring_tables(
    samples: DataFrame,
    labels: DataFrame,
    name: str,
    path: str,
    key: str = "prompt_id",
    spread_by: Sequence[str] = ("sample_idx",),
    buckets: int | None = None,
) -> ScoringTables:
    """Write ``<name>_samples`` and ``<name>_labels`` below ``path``, once for all later scoring runs.

    ``labels`` holds one row per prompt, already parsed.  ``spread_by`` are columns that tell the
    completions of one prompt apart.
    """
    counts = durable(key_counts(samples, key), "prompt-counts")
    if buckets is None:
        rows = counts.agg(F.sum("_rows")).first()[0] or 0
        shuffles = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(shuffles, -(-rows // ROWS_PER_BUCKET))
    pieces = pieces_of(key, hot_keys(counts, key, buckets))
    own = F.when(pieces > 1, F.pmod(F.xxhash64(*spread_by), pieces)).otherwise(0).cast("int")
    tables = ScoringTables(f"{name}_samples", f"{name}_labels", key, buckets)
    _write(samples.withColumn(PIECE, own), tables.samples, f"{path}/samples", key, buckets)
    copies = F.explode(F.sequence(F.lit(0), pieces - 1))
    _write(labels.withColumn(PIECE, copies), tables.labels, f"{path}/labels", key, buckets)
    return tables


def read_scoring_tables(spark: SparkSession, tables: ScoringTables, where: Column | None = None) -> DataFrame:
    """Completions with their prompt's label (NULL where there is none), joined bucket by bucket.

    ``where`` selects completions; it reaches their scan.  The merge keeps large labels from being
    broadcast by a wrong estimate; neither side is exchanged.
    """
    samples = spark.table(tables.samples)
    samples = samples if where is None else samples.filter(where)
    labels = spark.table(tables.labels).hint("merge")
    return samples.join(labels, [tables.key, PIECE], "left").drop(PIECE)


def drop_scoring_tables(spark: SparkSession, tables: ScoringTables) -> None:
    """Forget the tables; their files stay where they were written."""
    for name in (tables.samples, tables.labels):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
