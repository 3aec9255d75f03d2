"""Evaluation roll-up (H1 - H11, C10): verdict rows to cross-checkpoint comparison tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from posttrain_spark.functions.text import is_blank, let, strip

METRICS = "map<string,map<string,map<string,string>>>"
TYPED_METRICS = "map<string,map<string,map<string,variant>>>"
LONG_COLUMNS = ("model", "benchmark", "mode", "metric", "position", "kind", "value")

# Metrics that matter per kind of benchmark, and the ones a fallback never picks.
SYMBOLIC = ("symbolic_correct",)
ACCURACY = ("accuracy",)
CODE_TESTS = ("passing_base_tests", "passing_plus_tests")
FOLLOWING = ("average_score", "instruction_strict_accuracy", "prompt_strict_accuracy")
COMMON = (
    "symbolic_correct", "passing_base_tests", "passing_plus_tests", "average_score",
    "instruction_strict_accuracy", "judge_correct", "prompt_strict_accuracy",
)
BOOKKEEPING = ("num_entries", "avg_tokens", "gen_seconds")


def summarize(
    samples: DataFrame,
    flags: Sequence[str],
    by: Sequence[str] = ("model", "benchmark"),
    mode: str = "pass@1",
) -> DataFrame:
    """Per-sample flags to percentages with two decimals, one long row per metric (H1, H1a, H1b, H1d).

    A flag that is NULL for every sample of a group does not belong to that benchmark and gives no
    row.
    """
    rates = samples.groupBy(*by).agg(
        *[F.round(100 * F.avg(F.col(f).cast("double")), 2).alias(f) for f in flags]
    )
    return (
        rates.unpivot(list(by), list(flags), "metric", "value")
        .filter(F.col("value").isNotNull())
        .withColumn("mode", F.lit(mode))
    )


def summarize_following(verdicts: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Instruction-following scores from strict and loose verdicts, one row per constraint.

    Prompt accuracy: all constraints of a sample hold.  Instruction accuracy: share of constraints
    that hold.  The average score is the mean of the four.
    """
    keys = [*by, "sample_id"]
    strict, loose = F.col("strict").cast("double"), F.col("loose").cast("double")
    samples = verdicts.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(strict).alias("strict_hits"),
        F.sum(loose).alias("loose_hits"),
    )
    hit = {v: F.col(f"{v}_hits") for v in ("strict", "loose")}
    rate = {}
    for v in ("strict", "loose"):
        rate[f"prompt_{v}_accuracy"] = 100 * F.avg((hit[v] == F.col("n")).cast("double"))
        rate[f"instruction_{v}_accuracy"] = 100 * F.sum(hit[v]) / F.sum("n")
    grouped = samples.groupBy(*by).agg(*[c.alias(n) for n, c in rate.items()])
    mean = sum((F.col(n) for n in rate), F.lit(0.0)) / len(rate)
    return grouped.select(
        *by,
        F.round("prompt_strict_accuracy", 2).alias("prompt_strict_accuracy"),
        F.round("instruction_strict_accuracy", 2).alias("instruction_strict_accuracy"),
        F.round("prompt_loose_accuracy", 2).alias("prompt_loose_accuracy"),
        F.round("instruction_loose_accuracy", 2).alias("instruction_loose_accuracy"),
        F.round(mean, 2).alias("average_score"),
    )


def loose_variants(text: Column) -> Column:
    """Eight readings of an answer: without first line, last line or both, and each without ``*``."""

    def readings(lines: Column) -> Column:
        n = F.size(lines)

        def without(first: int, last: int) -> Column:
            kept = F.slice(lines, F.lit(1 + first), F.greatest(n - first - last, F.lit(0)))
            return strip(F.array_join(kept, "\n"))

        return F.array(text, without(1, 0), without(0, 1), without(1, 1))

    # The lines and the four readings are bound: each is made once per row.
    plain = let(F.split(text, "\n"), readings)
    return let(plain, lambda four: F.concat(four, F.transform(four, lambda v: F.replace(v, F.lit("*"), F.lit("")))))


def loose_verdict(text: Column, check) -> Column:
    """True when any non-blank loose variant passes ``check`` (a function from Column to Column)."""
    return F.exists(
        loose_variants(text),
        lambda v: ~is_blank(v) & F.coalesce(check(v), F.lit(False)),
    )


def metric_rows(files: DataFrame, text: str = "value") -> DataFrame:
    """Nested metrics JSON to long rows: model, benchmark, mode, metric, position, kind, value.

    Order comes from the string map, which keeps the order of the file; the type of each value
    comes from the variant map.  Files that do not parse give no rows, see :func:`bad_metrics`.
    """
    parsed = files.select(
        "model",
        F.from_json(text, METRICS).alias("values"),
        F.from_json(text, TYPED_METRICS).alias("types"),
    ).filter(F.col("values").isNotNull())
    modes = parsed.select(
        "model", "types", F.explode("values").alias("benchmark", "modes")
    ).select("model", "types", "benchmark", F.explode("modes").alias("mode", "metrics"))
    rows = modes.select(
        "model", "types", "benchmark", "mode",
        F.posexplode(F.map_entries("metrics")).alias("position", "entry"),
    )
    typed = F.col("types")[F.col("benchmark")][F.col("mode")][F.col("entry.key")]
    return rows.select(
        "model", "benchmark", "mode", F.col("entry.key").alias("metric"), "position",
        F.regexp_replace(F.schema_of_variant(typed), r"\(.*", "").alias("kind"),
        # The parser hands numbers that JSON cannot write on in quotes.
        F.regexp_replace("entry.value", '^"(NaN|-?Infinity)"$', "$1").alias("value"),
    )


def bad_metrics(files: DataFrame, text: str = "value") -> DataFrame:
    """Files whose content is not a metrics object (H8)."""
    return files.filter(F.from_json(text, METRICS).isNull())


def only_pass1(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("mode") == "pass@1")


def important_metrics(benchmark: Column) -> Column:
    """Metric names that matter for a benchmark, first match wins (H3)."""
    name = F.lower(benchmark)

    def has(part: str) -> Column:
        return F.contains(name, F.lit(part))

    def names(values: Sequence[str]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    return (
        F.when(has("gsm8k") | has("math") | F.startswith(name, F.lit("mmlu")), names(SYMBOLIC))
        .when(has("livecodebench"), names(ACCURACY))
        .when(has("human-eval") | has("humaneval"), names(CODE_TESTS))
        .when(has("ifeval"), names(FOLLOWING))
        .otherwise(names(COMMON))
    )


def is_number(kind: Column) -> Column:
    """Numeric as Python sees it: booleans count, quoted numbers do not."""
    return kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN")


def reported_metrics(rows: DataFrame) -> DataFrame:
    """The important metrics of each benchmark, or else its first numeric one in file order (H3, H4)."""
    marked = rows.withColumn(
        "_important", F.array_contains(important_metrics(F.col("benchmark")), F.col("metric"))
    ).withColumn(
        "_fallback", is_number(F.col("kind")) & ~F.col("metric").isin(*BOOKKEEPING)
    )
    pair = F.struct("metric", "value")
    found = marked.groupBy("model", "benchmark").agg(
        F.collect_list(F.when(F.col("_important"), pair)).alias("_picked"),
        F.min_by(F.when(F.col("_fallback"), pair), F.when(F.col("_fallback"), F.col("position"))).alias("_first"),
    )
    chosen = F.when(F.size("_picked") > 0, F.col("_picked")).otherwise(
        F.array_compact(F.array("_first"))
    )
    return found.select("model", "benchmark", F.explode(chosen).alias("_m")).select(
        "model", "benchmark", "_m.metric", "_m.value"
    )


def comparison_cells(rows: DataFrame) -> DataFrame:
    """``model``, column name ``{benchmark}_{metric}`` and the printed value (H5)."""
    return reported_metrics(only_pass1(rows)).select(
        "model", F.concat_ws("_", "benchmark", "metric").alias("column"), "value"
    )


def comparison(cells: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per model, the union of the columns in sorted order (H6).

    Without ``columns`` their names are read first; they are as few as a table is wide.  Having
    none at all is an error.
    """
    if columns is None:
        names = cells.select("column").distinct().orderBy("column").collect()
        columns = [r["column"] for r in names]
    if not columns:
        raise ValueError("no valid metrics found")
    return cells.groupBy("model").pivot("column", sorted(columns)).agg(F.first("value"))


def checkpoint_step(model: Column) -> Column:
    """Number in ``checkpoint-<n>``, ignoring case; NULL without one (H7)."""
    return F.regexp_extract(model, r"(?i)checkpoint-(\d+)", 1).try_cast("long")


def by_checkpoint(df: DataFrame, model: str = "model", within: bool = False) -> DataFrame:
    """Order rows by checkpoint number, unnumbered ones last, then by name; ``within`` partitions only."""
    sort = df.sortWithinPartitions if within else df.orderBy
    return sort(checkpoint_step(F.col(model)).asc_nulls_last(), F.col(model))


def pending(checkpoints: DataFrame, benchmarks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Checkpoint and benchmark pairs that the ledger does not hold yet (H9).

    Every pair of the two short lists is the work list itself; both are bounded by what is trained
    and by the benchmark set.
    """
    listed = benchmarks.agg(F.collect_set("benchmark").alias("_all"))
    pairs = checkpoints.select(
        "model", F.explode(listed.scalar()).alias("benchmark")
    )
    return pairs.join(ledger, ["model", "benchmark"], "left_anti")


def missing_steps(checkpoints: DataFrame, lo: int, hi: int, by: int) -> DataFrame:
    """Steps of the expected grid without a checkpoint."""
    grid = checkpoints.sparkSession.range(lo, hi + 1, by).withColumnRenamed("id", "step")
    found = checkpoints.select(checkpoint_step(F.col("model")).alias("step")).distinct()
    return grid.join(found, "step", "left_anti")


def with_config(rows: DataFrame, config: DataFrame, key: str = "benchmark") -> DataFrame:
    """Attach the run configuration (temperature, top_p, token limit, server) to result rows."""
    return rows.join(config, key, "left")
