"""Connected components of a graph given as edges, by alternating star operations.

Each round hangs every neighbour of a node below the smallest node seen there ("large star", then
"small star"), so the number of edges never grows and paths shrink by a factor each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from posttrain_spark.session import durable


def _lowest(edges: DataFrame) -> DataFrame:
    """Lowest neighbour of every first node (found before the shuffle, so hot nodes are no matter)."""
    return durable(edges.groupBy("u").agg(F.min("v").alias("_low")), "star-low")


def _star(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Each edge (u, v) as (v, lowest of u).

    Both sides are read from written tables, so adaptive execution can split a node with very many
    edges.
    """
    return edges.join(low, "u").select(F.col("v").alias("u"), F.col("_low").alias("v"))


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both).withColumn("_low", F.least("u", "_low"))
    larger = both.filter(F.col("v") > F.col("u"))
    hung = durable(_star(larger, low).filter(F.col("u") != F.col("v")).distinct(), "star-large")
    low = _lowest(hung)
    small = _star(hung, low).unionByName(low.select("u", F.col("_low").alias("v")))
    return durable(small.filter(F.col("u") != F.col("v")).distinct(), "star-small")


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns ``node`` and ``root`` (smallest node of its component) for every node but the roots.

    ``edges`` has two columns of one orderable type; loops, repeats and either direction are fine.
    An empty input gives an empty result.
    """
    a, b = edges.columns
    tidy = edges.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    current = durable(tidy.distinct(), "edges")
    before, now = None, _state(current)
    while now[0] and now != before:
        current = _round(current)
        before, now = now, _state(current)
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
