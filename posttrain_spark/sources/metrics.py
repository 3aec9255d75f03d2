"""Evaluation files: metrics, verdicts, checkpoints (A4 - A6) and the result writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from posttrain_spark.functions.text import parent_name
from posttrain_spark.operators.evals import by_checkpoint, checkpoint_step
from posttrain_spark.session import scratch_path
from posttrain_spark.sources.files import is_directory, list_names, model_files, move, only_part_file, part_files, partition_value

VERDICT_FILES = "*eval_results_{loose,strict}.jsonl"
# A file that every finished checkpoint holds.
MARKER = "trainer_state.json"
VERDICT_SCHEMA = (
    "sample_id long, follow_all_instructions boolean, follow_instruction_list array<boolean>"
)


def _parent_name():
    return parent_name(F.col("_metadata.file_path"))


def scan_metrics(spark: SparkSession, root: str, model: str | None = None) -> DataFrame:
    """``model`` and the whole text of each ``<root>/<model>/metrics.json``, at depth one only."""
    # Without any file the pattern gives Spark's own error.
    paths = model_files(spark, root, "metrics.json") or f"{root}/*/metrics.json"
    files = spark.read.text(paths, wholetext=True)
    name = F.lit(model) if model else _parent_name()
    return files.select(name.alias("model"), "value")


def scan_metrics_file(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """One metrics file; the model is its directory's name unless given."""
    file = spark.read.text(path, wholetext=True)
    return file.select((F.lit(model) if model else _parent_name()).alias("model"), "value")


def scan_verdicts(spark: SparkSession, root: str, schema: str = VERDICT_SCHEMA) -> DataFrame:
    """Verdict lines of every ``[<stem>-]eval_results_{strict,loose}.jsonl`` below ``root``.

    ``variant`` is strict or loose; ``stem`` is empty for the form without a prefix.
    """
    rows = (
        spark.read.schema(schema)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", VERDICT_FILES)
        .json(root)
    )
    name = F.col("_metadata.file_name")
    pattern = r"^(?:(.*)-)?eval_results_(loose|strict)\.jsonl$"
    return rows.select(
        _parent_name().alias("model"),
        F.regexp_extract(name, pattern, 1).alias("stem"),
        F.regexp_extract(name, pattern, 2).alias("variant"),
        "*",
    ).filter(F.col("variant") != "")


def list_checkpoints(spark: SparkSession, root: str, marker: str = MARKER) -> DataFrame:
    """Checkpoint directories in numeric order.

    One marker file per checkpoint is looked up; its content is never read.
    """
    files = spark.read.format("binaryFile").load(
        model_files(spark, root, marker, "checkpoint-") or f"{root}/checkpoint-*/{marker}"
    )
    return by_checkpoint(
        files.select(_parent_name().alias("model")).withColumn(
            "step", checkpoint_step(F.col("model"))
        )
    )


def _csv_target(spark: SparkSession, path: str) -> str:
    """An existing directory gets the default name inside it, a path without suffix gets .csv."""
    if is_directory(spark, path):
        return f"{path.rstrip('/')}/combined_metrics.csv"
    last = path.rsplit("/", 1)[-1]
    return path if "." in last.strip(".") else f"{path}.csv"


def write_comparison(table: DataFrame, path: str) -> str:
    """Write the comparison table as one CSV file in checkpoint order; returns its path.

    ``model`` comes first, the other columns are sorted, missing values are empty.  The table has
    one row per checkpoint, so one task writes it.
    """
    spark = table.sparkSession
    target = _csv_target(spark, path)
    columns = ["model", *sorted(c for c in table.columns if c != "model")]
    folder = scratch_path(spark, "comparison")
    # Sorted inside the one task: coalescing sorted partitions does not promise their order.
    one = by_checkpoint(table.select(*columns).coalesce(1), within=True)
    writer = one.write.option("maxRecordsPerFile", 0)
    writer.option("header", True).option("nullValue", "").option("emptyValue", "").csv(folder)
    move(spark, only_part_file(spark, folder), target)
    return target


def write_model_row(table: DataFrame, path: str, model: str) -> str:
    """CSV with the one row of ``model`` and only the columns it has."""
    row = table.filter(F.col("model") == model)
    filled = row.select(*[F.count(F.col(f"`{c}`")).alias(c) for c in table.columns]).first()
    return write_comparison(row.select(*[f"`{c}`" for c in table.columns if filled[c]]), path)


def metrics_json(rows: DataFrame) -> DataFrame:
    """Nested metrics JSON per model from long rows (model, benchmark, mode, metric, value).

    Keys are in sorted order at each level, so equal rows give equal text.
    """

    def nest(df: DataFrame, by: list[str], key: str, value: str, out: str) -> DataFrame:
        entry = F.struct(F.col(key).alias("key"), F.col(value).alias("value"))
        return df.groupBy(*by).agg(
            F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(out)
        )

    metrics = nest(rows, ["model", "benchmark", "mode"], "metric", "value", "metrics")
    # Maps cannot be sorted, so the outer levels sort their keys and look the maps up.
    for by, key, value, out in (
        (["model", "benchmark"], "mode", "metrics", "modes"),
        (["model"], "benchmark", "modes", "benchmarks"),
    ):
        keyed = F.map_from_arrays(F.collect_list(key), F.collect_list(value))
        metrics = (
            metrics.groupBy(*by)
            .agg(keyed.alias("_map"))
            .withColumn("_keys", F.array_sort(F.map_keys("_map")))
            .withColumn(out, F.map_from_arrays("_keys", F.transform("_keys", lambda k: F.col("_map")[k])))
            .drop("_map", "_keys")
        )
    return metrics.select("model", F.to_json("benchmarks").alias("value"))


def write_metrics(rows: DataFrame, root: str) -> None:
    """Write ``<root>/<model>/metrics.json`` for each model.

    Spark writes the texts partitioned by model; the files are then renamed, one per model.
    """
    spark = rows.sparkSession
    folder = scratch_path(spark, "metrics")
    texts = metrics_json(rows).repartition("model")
    texts.write.option("maxRecordsPerFile", 0).partitionBy("model").text(folder)
    for name in list_names(spark, folder):
        if name.startswith("model="):
            source = only_part_file(spark, f"{folder}/{name}")
            move(spark, source, f"{root}/{partition_value(name, 'model')}/metrics.json")


def write_verdicts(rows: DataFrame, root: str, stem: str = "") -> None:
    """Write verdict rows as ``<root>/<model>/[<stem>-]eval_results_<variant>.jsonl``.

    Rebalancing gathers a small group in one file and cuts a large one into several; further files
    of a group carry a number in the stem.
    """
    spark = rows.sparkSession
    folder = scratch_path(spark, "verdicts")
    keys = ["model", "variant"]
    rows.hint("rebalance", *keys).write.partitionBy(*keys).json(folder)
    for model in list_names(spark, folder):
        if not model.startswith("model="):
            continue
        for variant in list_names(spark, f"{folder}/{model}"):
            name = f"eval_results_{partition_value(variant, 'variant')}.jsonl"
            for i, part in enumerate(part_files(spark, f"{folder}/{model}/{variant}")):
                prefix = (stem or "part" if i else stem) + (str(i) if i else "")
                target = f"{prefix}-{name}" if prefix else name
                move(spark, part, f"{root}/{partition_value(model, 'model')}/{target}")


def write_reward_log(log: DataFrame, path: str, every: int = 1, step: str = "step") -> None:
    """Append the reward rows of every ``every``-th step to a Parquet table."""
    log.filter(F.col(step) % every == 0).write.mode("append").parquet(path)
