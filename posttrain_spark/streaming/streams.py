"""Streams (S1 - S6): checkpoint discovery, live comparison, online scoring and advantages.

Each builder returns a streaming DataFrame or a started query.  All state is in the stream's own
checkpoint folder, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from posttrain_spark.operators.evals import (
    by_checkpoint,
    checkpoint_step,
    comparison_cells,
    metric_rows,
)
from posttrain_spark.operators.reward import join_labels, score_multi
from posttrain_spark.sources.metrics import MARKER
from posttrain_spark.streaming.model_files import read_stream

POLL_INTERVAL = "1800 seconds"


def _trigger(writer, once: bool):
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL_INTERVAL)


def stream_checkpoints(
    spark: SparkSession, root: str, skip: Sequence[str] = (), marker: str = MARKER
) -> DataFrame:
    """Checkpoints as they appear, each once, without those in ``skip``.

    The source's offset tells which are new; a marker that is written again is not a new checkpoint.
    """
    found = read_stream(spark, root, marker, prefix="checkpoint-", skip=json.dumps(list(skip)), content="false")
    named = found.select("model").withColumn("step", checkpoint_step(F.col("model")))
    return named.dropDuplicates(["model"])


def evaluate_new(
    checkpoints: DataFrame,
    evaluate: Callable[[DataFrame], None],
    state: str,
    once: bool = True,
) -> StreamingQuery:
    """Hand each batch of new checkpoints to ``evaluate`` in step order (S3).

    An exception in ``evaluate`` stops the query; the batch is repeated after a restart.
    """

    def run(batch: DataFrame, _: int) -> None:
        evaluate(by_checkpoint(batch))

    writer = checkpoints.writeStream.foreachBatch(run).option("checkpointLocation", state)
    return _trigger(writer, once).start()


def add_cells(files: DataFrame, table: str, batch: int) -> None:
    """Add the cells of a batch of metrics files (``model``, ``written``, ``value``) to the table.

    ``batch`` names the folder: a batch that is repeated after a failure overwrites its own and changes
    nothing.
    """
    files = files.persist()
    cells = comparison_cells(metric_rows(files.select("model", "value"))).join(files.select("model", "written"), "model")
    cells.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{table}/batch={batch}_")
    files.unpersist()


def stream_comparison(
    spark: SparkSession, root: str, table: str, state: str, once: bool = True
) -> StreamingQuery:
    """Keep the long comparison table up to date as metrics files land or are written again.

    A batch reads the files that are new or changed since the last one and adds their cells;
    :func:`latest_cells` reads the table back.
    """
    files = read_stream(spark, root, "metrics.json")
    writer = files.writeStream.foreachBatch(lambda batch, number: add_cells(batch, table, number))
    return _trigger(writer.option("checkpointLocation", state), once).start()


def _cells(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(table)


def latest_cells(spark: SparkSession, table: str) -> DataFrame:
    """Each comparison cell as the newest version of its model's file has it.

    A cell that the newest version no longer has is gone.
    """
    rows = _cells(spark, table)
    newest = rows.groupBy("model").agg(F.max("written").alias("written"))
    current = rows.join(newest, ["model", "written"])
    return current.groupBy("model", "column").agg(F.max_by("value", "batch").alias("value"))


def stream_score(rollouts: DataFrame, labels: DataFrame, scale: float = 10.0, **options) -> DataFrame:
    """Score completions as they arrive (S5): a stream-static join and row-wise scoring, no state.

    ``labels`` is read again in every batch, so it should be a stored table of parsed labels.
    """
    return score_multi(join_labels(rollouts, labels), scale, **options)


# Batches without input, which timed state would otherwise ask for without end.
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def write_scores(scored: DataFrame, path: str, state: str, once: bool = True) -> StreamingQuery:
    """Append scored rows to a Parquet table.

    ``once`` ends with the input at hand; timeouts of state are then looked at with the next input.
    """
    writer = (
        scored.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", state)
        .outputMode("append")
    )
    conf = scored.sparkSession.conf
    before = conf.get(EMPTY_BATCHES)
    conf.set(EMPTY_BATCHES, "false" if once else before)
    try:
        return _trigger(writer, once).start()
    finally:
        conf.set(EMPTY_BATCHES, before)


# A prompt's state is dropped when nothing has come for it in this time.
GROUP_TIMEOUT_MS = 24 * 3600 * 1000


def stream_advantages(
    scored: DataFrame,
    n: int = 8,
    group: str = "prompt_id",
    epsilon: float = 1e-4,
    timeout_ms: int = GROUP_TIMEOUT_MS,
) -> DataFrame:
    """Advantages of a prompt's completions once ``n`` different ones are in.

    Needs ``group`` (long), ``sample_idx`` and ``reward``.  A sample that is delivered again counts
    once, in its first version.  The state of a prompt is at most ``n - 1`` waiting samples; of a
    prompt that is complete it is a mark, by which later deliveries are ignored.  Either is dropped
    when nothing has come for the prompt in ``timeout_ms``.
    """

    def collect(key: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        idx, rewards, done = state.get if state.exists else ([], [], False)
        waiting = dict(zip(idx, rewards))
        for chunk in chunks:
            for i, reward in zip(chunk["sample_idx"].tolist(), chunk["reward"].tolist()):
                if not done and i not in waiting:
                    waiting[i] = reward
                if not done and len(waiting) == n:
                    done = True
                    order = sorted(waiting)
                    r = pd.Series([waiting[i] for i in order], dtype="float64")
                    std = r.std(ddof=1) if n > 1 else 0.0
                    yield pd.DataFrame(
                        {
                            group: key[0],
                            "sample_idx": order,
                            "reward": r,
                            "advantage": (r - r.mean()) / (std + epsilon),
                        }
                    )
                    waiting = {}
        state.update((list(waiting), list(waiting.values()), done))
        state.setTimeoutDuration(timeout_ms)

    return scored.select(group, "sample_idx", "reward").groupBy(group).applyInPandasWithState(
        collect,
        outputStructType=f"{group} long, sample_idx int, reward double, advantage double",
        stateStructType="idx array<int>, rewards array<double>, done boolean",
        outputMode="append",
        timeoutConf="ProcessingTimeTimeout",
    )
