"""Equi-joins whose large side may have hot keys.

Adaptive execution can split a skewed join only when both sides come straight from an exchange, not
when one side is an aggregate or when the join's partitioning is used again further on.  The joins
here split hot keys themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Parameter of the plan alone (results never depend on it): a key with at most so many rows is not
# worth a split, as one task handles it with ease.
MIN_ROWS = 10_000


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per key, counted before the shuffle."""
    return df.groupBy(key).agg(F.count("*").alias("_rows"))


def join_partitions(df: DataFrame) -> int:
    """Partitions a shuffle of this session is cut into."""
    spark = df.sparkSession
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, spark.sparkContext.defaultParallelism)


def hot_keys(counts: DataFrame, key: str, partitions: int) -> dict[int, list]:
    """Keys that hold more rows than an even partition, by the number of pieces they need.

    There are fewer than ``partitions`` of them whatever the data.  A piece is at most half an even
    partition; piece counts are powers of two, so the result has few entries.
    """
    even = counts.agg(F.sum("_rows")).scalar() / partitions
    hot = counts.filter(F.col("_rows") > F.greatest(even, F.lit(MIN_ROWS)))
    needed = F.pow(F.lit(2), F.ceil(F.log2(2 * F.col("_rows") / even))).cast("int")
    pieces: dict[int, list] = {}
    for row in hot.select(key, F.greatest(needed, F.lit(2)).alias("_n")).collect():
        pieces.setdefault(row["_n"], []).append(row[key])
    return pieces


def pieces_of(key: str, hot: dict[int, list]) -> Column:
    """Number of pieces of a row's key; 1 for a key that is not hot."""
    chain = F
    for n, keys in sorted(hot.items()):
        found = F.col(key).isin(*[k for k in keys if k is not None])
        if None in keys:
            found = found | F.col(key).isNull()
        chain = chain.when(F.coalesce(found, F.lit(False)), n)
    return chain.otherwise(1) if hot else F.lit(1)


def skew_join(
    large: DataFrame,
    small: DataFrame,
    key: str,
    spread_by: Sequence[str],
    how: str = "inner",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join on ``key`` with the rows of hot keys spread over many tasks.

    One pass over the keys alone finds the hot ones.  Without any this is the plain join.  Else the
    rows of a hot key in ``large`` are cut into pieces by the hash of ``spread_by`` (columns that
    tell its rows apart) and the matching rows of ``small`` are repeated once per piece; all other
    keys are joined as they are.  ``counts`` may be given when rows per key are known already.
    """
    counts = key_counts(large, key) if counts is None else counts
    hot = hot_keys(counts, key, join_partitions(large))
    if not hot:
        return large.join(small, key, how)
    pieces = pieces_of(key, hot)
    left = large.withColumn(
        "_piece", F.when(pieces > 1, F.pmod(F.xxhash64(*spread_by), pieces)).otherwise(0).cast("int")
    )
    right = small.withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return left.join(right, [key, "_piece"], how).drop("_piece")
