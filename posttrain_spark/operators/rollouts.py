"""Group statistics of scored completions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from posttrain_spark.operators.skew import skew_join


def _with_group_stats(
    df: DataFrame, group: str, reward: str, spread_by: Sequence[str] | None
) -> DataFrame:
    """Add ``_mean`` and ``_std`` of each row's group.

    The statistics are pre-aggregated before the shuffle and joined back with hot groups split, so
    a group that holds a large share of the rows never lands in one task, as it would in a window.
    """
    stats = df.groupBy(group).agg(
        F.count("*").alias("_rows"),
        F.avg(reward).alias("_mean"),
        F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("_std"),
    )
    spread_by = [c for c in df.columns if c != group] if spread_by is None else spread_by
    return skew_join(df, stats.drop("_rows"), group, spread_by, counts=stats.select(group, "_rows"))


def advantages(
    df: DataFrame,
    group: str = "prompt_id",
    reward: str = "reward",
    epsilon: float = 1e-4,
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``advantage`` = (reward - group mean) / (group sample deviation + epsilon).

    A group of one gets 0.  ``df`` is read twice: pass a stored, narrow frame when its rewards are
    expensive (see :func:`posttrain_spark.session.durable`).  ``spread_by`` names the columns that
    tell the rows of a group apart; by default all.
    """
    centred = F.col(reward) - F.col("_mean")
    return (
        _with_group_stats(df, group, reward, spread_by)
        .withColumn("advantage", centred / (F.col("_std") + epsilon))
        .drop("_mean", "_std")
    )


def scale_check(
    df: DataFrame,
    group: str = "prompt_id",
    reward: str = "reward",
    scale: float = 10.0,
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Advantages of the reward and of the scaled reward side by side.

    Both come from one set of group statistics: mean and deviation scale with the reward, only the
    epsilon does not.
    """
    centred = F.col(reward) - F.col("_mean")
    return (
        _with_group_stats(df, group, reward, spread_by)
        .withColumn("advantage", centred / (F.col("_std") + 1e-4))
        .withColumn("scaled_advantage", centred * scale / (F.col("_std") * scale + 1e-4))
        .drop("_mean", "_std")
    )


def clipped_ratio(
    df: DataFrame, max_length: int = 2048, by: str | None = None, n_tokens: str = "n_tokens"
) -> DataFrame:
    """Share of completions that reach the length limit."""
    hit = F.avg(F.when(F.col(n_tokens) >= max_length, 1.0).otherwise(0.0)).alias("clipped_ratio")
    return df.groupBy(*([by] if by else [])).agg(hit)


def mask_after_eos(tokens: Column, eos: str | int) -> Column:
    """Tokens up to and including the first end token; all of them when there is none."""
    at = F.array_position(tokens, eos)
    return F.when(at > 0, F.slice(tokens, F.lit(1), at.cast("int"))).otherwise(tokens)


def constraint_rates(verdicts: DataFrame, by: str = "source") -> DataFrame:
    """Satisfaction per (source, constraint) with totals per source and overall."""
    return verdicts.rollup(by, "instruction_id").agg(
        F.count("*").alias("n"),
        F.avg(F.coalesce(F.col("verdict"), F.lit(False)).cast("double")).alias("rate"),
    )


def reward_log(df: DataFrame, step: str = "step", reward: str = "reward") -> DataFrame:
    """Reward summary per logged step."""
    return df.groupBy(step).agg(
        F.avg(reward).alias("reward_mean"),
        F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("reward_std"),
        F.min(reward).alias("reward_min"),
        F.max(reward).alias("reward_max"),
    )
