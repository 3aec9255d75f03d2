"""Reward scoring.

Scores are computed inside each row with higher-order functions over the constraint array, so
scoring a table of completions needs no explode and no aggregation shuffle, and the same
expressions work on a stream.  The exploded form is kept for reports per constraint.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F

from posttrain_spark.functions.text import is_blank, strip_thinking
from posttrain_spark.operators.constraints import (
    COUNTERPARTS,
    NEW_CHECKS,
    OLD_CHECKS,
    Args,
    Verdict,
    dispatch,
)
from posttrain_spark.operators.labels import parse_any_labels, parse_old_label
from posttrain_spark.operators.skew import skew_join

# Old spellings of check names found in published data.
OLD_ALIASES = {
    "verify_paragraph_count": "paragraph_count",
    "verify_keyword_frequency": "keyword_frequency",
    "verify_letter_frequency": "letter_frequency",
    "validate_word_constraint": "word_constraint",
    "verify_sentence_constraint": "sentence_constraint",
}


def join_labels(
    rollouts: DataFrame,
    labels: DataFrame,
    key: str = "prompt_id",
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Bring each completion together with its prompt's parsed label.

    A prompt with a large share of all completions is split by the columns ``spread_by`` (by
    default all but the key), so its completions are scored by many tasks.  A stream is joined as
    it is: a micro-batch is bounded, and the static side is broadcast when its size allows.
    """
    if rollouts.isStreaming:
        return rollouts.join(labels, key, "left")
    spread_by = [c for c in rollouts.columns if c != key] if spread_by is None else spread_by
    return skew_join(rollouts, labels, key, spread_by, "left")


# Built verdict expressions.  A Column is an unresolved expression over column names, so the same
# one serves any frame; building all checks anew takes seconds of driver time.
_BUILT: dict[tuple, Column] = {}


def _built(key: tuple, checks: dict[str, Verdict], build: Callable[[], Column]) -> Column:
    full_key = (id(SparkContext._active_spark_context), *key, tuple(checks.items()))
    if full_key not in _BUILT:
        _BUILT[full_key] = build()
    return _BUILT[full_key]


def verdict_array(constraints: str, answer: str, checks: dict[str, Verdict] | None = None) -> Column:
    """Verdict per constraint of the array column ``constraints``, in order."""
    checks = NEW_CHECKS if checks is None else checks

    def build() -> Column:
        return F.transform(
            constraints,
            lambda c: dispatch(c["instruction_id"], F.col(answer), Args(c["kwargs"]), checks),
        )

    return _built((constraints, answer), checks, build)


def dispatch_old(answer: str, args: str, checks: dict[str, Verdict]) -> Column:
    """Verdict of the one check an old label names."""

    def build() -> Column:
        values = Args(F.col(args))
        return dispatch(values.text("func_name"), F.col(answer), values, checks)

    return _built((answer, args), checks, build)


def score_multi(
    samples: DataFrame,
    scale: float = 1.0,
    completion: str = "completion",
    constraints: str = "constraints",
    checks: dict[str, Verdict] | None = None,
) -> DataFrame:
    """Add ``verdicts``, ``score`` and ``error`` for multi-constraint labels.

    The score is satisfied / total.  It is 0 for a blank completion or answer, an unreadable label,
    an empty constraint list, or when any constraint could not be checked.
    """
    staged = samples.withColumn("_answer", strip_thinking(F.col(completion))).withColumn(
        "verdicts", verdict_array(constraints, "_answer", checks)
    )
    verdicts = F.col("verdicts")
    blank = F.coalesce(is_blank(F.col(completion)) | is_blank(F.col("_answer")), F.lit(True))
    error = (
        F.when(blank, "blank")
        .when(F.col(constraints).isNull(), "bad_label")
        .when(F.size(verdicts) == 0, "no_constraints")
        .when(F.exists(verdicts, lambda v: v.isNull()), "raised")
    )
    passed = F.size(F.filter(verdicts, lambda v: v))
    score = F.when(error.isNull(), passed / F.size(verdicts) * scale).otherwise(0.0)
    return staged.select(
        *samples.columns, "verdicts", error.alias("error"), score.alias("score")
    )


def score_old(
    samples: DataFrame,
    scale: float = 1.0,
    completion: str = "completion",
    label: str = "ground_truth",
    checks: dict[str, Verdict] | None = None,
) -> DataFrame:
    """Add ``score`` and ``error`` for single-constraint labels with ``func_name``.

    Labels parsed before the join (``old_args``) are used as they are.
    """
    checks = checks or OLD_CHECKS
    named = {**checks, **{a: checks[n] for a, n in OLD_ALIASES.items() if n in checks}}
    args = F.col("old_args") if "old_args" in samples.columns else parse_old_label(F.col(label))
    staged = samples.withColumns(
        {"_answer": strip_thinking(F.col(completion)), "_args": args}
    ).withColumn("_verdict", dispatch_old("_answer", "_args", named))
    name, verdict = Args(F.col("_args")).text("func_name"), F.col("_verdict")
    error = (
        F.when(F.col("_args").isNull(), "bad_label")
        .when(~F.coalesce(name.isin(*named), F.lit(False)), "unknown_check")
        .when(verdict.isNull(), "raised")
    )
    score = F.coalesce(verdict.cast("double") * scale, F.lit(0.0))
    return staged.select(*samples.columns, error.alias("error"), score.alias("score"))


def score_unified(samples: DataFrame, scale: float = 10.0, label: str = "ground_truth") -> DataFrame:
    """Score each row by its own label family (F3); a row that cannot be scored gets 0 and an error.

    Both families are columns of one projection: rows are neither split nor unioned, so the input
    is read once.  Labels should come parsed (``parse_any_labels`` on the prompts, before the join);
    a frame with the label's text only is parsed here, row by row.
    """
    if not {"kind", "constraints", "old_args"} <= {*samples.columns}:
        samples = parse_any_labels(samples, label)
    multi = (
        score_multi(samples, scale)
        .withColumnsRenamed({"score": "_multi", "error": "_multi_error"})
        .drop("verdicts", "constraints")
    )
    both = score_old(multi, scale, label=label).drop("old_args")
    is_old = F.coalesce(F.col("kind") == "old", F.lit(False))
    return (
        both.withColumn("score", F.when(is_old, F.col("score")).otherwise(F.col("_multi")))
        .withColumn("error", F.when(is_old, F.col("error")).otherwise(F.col("_multi_error")))
        .drop("_multi", "_multi_error")
    )


def verdict_rows(samples: DataFrame, constraints: str = "constraints") -> DataFrame:
    """One row per constraint of a scored frame: position, id and verdict (for G5)."""
    pairs = F.arrays_zip(
        F.col(f"{constraints}.instruction_id").alias("instruction_id"),
        F.col("verdicts").alias("verdict"),
    )
    kept = [c for c in samples.columns if c not in (constraints, "verdicts")]
    return samples.select(*kept, F.posexplode(pairs).alias("position", "_pair")).select(
        *kept, "position", "_pair.instruction_id", "_pair.verdict"
    )


def drop_incompatible(
    df: DataFrame, name: str = "func_name", quantifier: str = "quantifier"
) -> DataFrame:
    """Drop word and sentence constraints whose quantifier the new family refuses (C11)."""
    counted = F.col(name).isin(
        "word_constraint", "sentence_constraint",
        "validate_word_constraint", "verify_sentence_constraint",
    )
    refused = F.col(quantifier).isin("around", "at most")
    return df.filter(~F.coalesce(counted & refused, F.lit(False)))


def verifier_diff(samples: DataFrame) -> DataFrame:
    """Compare both families on the same text, per check.

    Needs ``completion``, ``func_name``, ``old_kwargs`` and ``new_kwargs`` (the latter two
    ``map<string,string>``).
    """
    answer = F.col("_answer")
    new_name = F.create_map(*[F.lit(x) for pair in COUNTERPARTS.items() for x in pair])
    staged = (
        samples.filter(F.col("func_name").isin(*COUNTERPARTS))
        .withColumn("_answer", strip_thinking(F.col("completion")))
        .withColumn(
            "_old", dispatch(F.col("func_name"), answer, Args(F.col("old_kwargs")), OLD_CHECKS)
        )
        .withColumn(
            "_new",
            dispatch(
                F.try_element_at(new_name, F.col("func_name")),
                answer,
                Args(F.col("new_kwargs")),
                {n: NEW_CHECKS[n] for n in COUNTERPARTS.values()},
            ),
        )
    )
    return staged.groupBy("func_name").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("_old")).alias("old_passed"),
        F.count_if(F.col("_new")).alias("new_passed"),
        F.count_if(F.col("_new").isNull()).alias("new_raised"),
        F.count_if(~F.col("_old").eqNullSafe(F.col("_new"))).alias("differ"),
    )


def code_pass_rate(results: DataFrame, sample: str = "sample_id", threshold: float = 0.0) -> DataFrame:
    """Share of passed tests per sample; below the threshold it is 0."""
    rate = F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(0.0))
    return (
        results.groupBy(sample)
        .agg(rate.alias("pass_rate"))
        .withColumn(
            "pass_rate",
            F.when(F.col("pass_rate") < threshold, 0.0).otherwise(F.col("pass_rate")),
        )
    )


def combine_rewards(
    df: DataFrame, rewards: dict[str, Column], weights: dict[str, float] | None = None
) -> DataFrame:
    """Add one column per named reward and their (weighted) sum as ``reward``.

    A reward is any double Column over the frame, from the builders here or from a pandas UDF; a
    NULL reward counts as 0.
    """
    weights = weights or {}
    named = df.withColumns({n: F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in rewards.items()})
    total = sum((F.col(n) * weights.get(n, 1.0) for n in rewards), F.lit(0.0))
    return named.withColumn("reward", total)
