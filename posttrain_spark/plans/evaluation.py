"""Evaluation queries: verdict tables to metrics files, comparison tables and work lists.

Verdicts are stand-ins made from ``documents`` joined to ``labels``; a document belongs to a
checkpoint and a benchmark by its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from posttrain_spark.operators import evals as H
from posttrain_spark.operators.constraints import NEW_CHECKS, Args
from posttrain_spark.plans import sql as S
from posttrain_spark.plans.registry import query, table, work_table
from posttrain_spark.plans.rewards import reward_log_frame, REWARD_LOG
from posttrain_spark.session import scratch_path
from posttrain_spark.sources import metrics as M
from posttrain_spark.sources.files import list_names, move, part_files

MODEL = "CASE WHEN doc_id % 9 = 8 THEN 'base v+1' ELSE concat('checkpoint-', 500 * (1 + doc_id % 9)) END"
BENCHMARK = (
    "CASE doc_id % 7 WHEN 0 THEN 'gsm8k' WHEN 1 THEN 'human-eval' WHEN 2 THEN 'mbpp' WHEN 3 THEN 'hendrycks_math' "
    "WHEN 4 THEN 'livecodebench' WHEN 5 THEN 'arena' ELSE 'mmlu' END"
)
FLAGS = ("symbolic_correct", "no_answer", "passing_base_tests", "passing_plus_tests", "accuracy", "judge_correct")
FLAG_SQL = {
    "symbolic_correct": f"CASE WHEN {BENCHMARK} IN ('gsm8k', 'hendrycks_math', 'mmlu') THEN quality = 1 END",
    "no_answer": f"CASE WHEN {BENCHMARK} = 'gsm8k' THEN toxic = 1 END",
    "passing_base_tests": f"CASE WHEN {BENCHMARK} IN ('human-eval', 'mbpp') THEN quality = 1 END",
    "passing_plus_tests": f"CASE WHEN {BENCHMARK} IN ('human-eval', 'mbpp') THEN quality = 1 AND toxic = 0 END",
    "accuracy": f"CASE WHEN {BENCHMARK} = 'livecodebench' THEN quality = 0 END",
    "judge_correct": f"CASE WHEN {BENCHMARK} = 'arena' THEN toxic = 0 END",
}


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr(
        f"{MODEL} AS model", f"{BENCHMARK} AS benchmark", *[f"{e} AS {n}" for n, e in FLAG_SQL.items()]
    )


def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.summarize(samples(spark, sf_dir), FLAGS)


_SAMPLES = f"s AS (SELECT {MODEL} AS model, {BENCHMARK} AS benchmark, {', '.join(f'{e} AS {n}' for n, e in FLAG_SQL.items())} FROM labels)"
_METRICS = f"""{_SAMPLES}, w AS (SELECT model, benchmark, {', '.join(f'round(100 * avg({n}::INT), 2) AS {n}' for n in FLAGS)} FROM s GROUP BY 1, 2),
    m AS (SELECT model, benchmark, 'pass@1' AS mode, metric, value FROM w UNPIVOT (value FOR metric IN ({', '.join(FLAGS)})))"""


@query("summarize", f"WITH {_METRICS} SELECT model, benchmark, mode, metric, value FROM m")
def summarize(spark, sf_dir):
    return metric_table(spark, sf_dir)


@query(
    "summarize_ifeval",
    f"""WITH d AS (SELECT doc_id, {MODEL} AS model, unnest([
          {{'strict': strpos(text, ',') = 0, 'loose': strpos(text, ',') = 0 OR doc_id % 3 = 0}},
          {{'strict': length(text) >= 300, 'loose': length(text) >= 200}}]) AS x FROM documents),
        p AS (SELECT model, doc_id, count(*) AS n, sum(x.strict::INT) AS s, sum(x.loose::INT) AS l FROM d GROUP BY 1, 2),
        r AS (SELECT model, 100 * avg((s = n)::INT) AS ps, 100 * sum(s) / sum(n) AS i_s, 100 * avg((l = n)::INT) AS pl, 100 * sum(l) / sum(n) AS il FROM p GROUP BY 1)
        SELECT model, round(ps, 2) AS prompt_strict_accuracy, round(i_s, 2) AS instruction_strict_accuracy,
          round(pl, 2) AS prompt_loose_accuracy, round(il, 2) AS instruction_loose_accuracy, round((ps + i_s + pl + il) / 4, 2) AS average_score FROM r""",
)
def summarize_ifeval(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr(
        f"{MODEL} AS model", "doc_id AS sample_id",
        """explode(array(
             named_struct('strict', instr(text, ',') = 0, 'loose', instr(text, ',') = 0 OR doc_id % 3 = 0),
             named_struct('strict', length(text) >= 300, 'loose', length(text) >= 200))) AS x""",
    )
    verdicts = rows.select("model", "sample_id", "x.strict", "x.loose")
    return H.summarize_following(verdicts)


LOOSE_TEXT = (
    "CASE doc_id % 4 WHEN 0 THEN concat('\"', text, '\"', chr(10), 'P.S. bye') WHEN 1 THEN concat('Sure:', chr(10), '\"', text, '\"') "
    "WHEN 2 THEN concat('Sure:', chr(10), '*\"', text, '\"*', chr(10), 'Bye') ELSE text END"
)


@query(
    "loose",
    f"""WITH d AS (SELECT doc_id, {LOOSE_TEXT} AS t FROM documents), l AS (SELECT *, string_split(t, chr(10)) AS x FROM d),
        v AS (SELECT doc_id, t, [t, {S.strip("array_to_string(x[2:], chr(10))")}, {S.strip("array_to_string(x[:len(x)-1], chr(10))")},
                {S.strip("array_to_string(x[2:len(x)-1], chr(10))")}] AS b FROM l),
        a AS (SELECT doc_id, t, list_concat(b, list_transform(b, lambda y: replace(y, '*', ''))) AS b FROM v)
        SELECT doc_id, coalesce(starts_with({S.strip('t')}, '"') AND suffix({S.strip('t')}, '"') AND length({S.strip('t')}) > 1, false) AS strict,
          {S.some('b', f"length({S.strip('e')}) > 1 AND starts_with({S.strip('e')}, '" + chr(34) + f"') AND suffix({S.strip('e')}, '" + chr(34) + "')")} AS loose FROM a""",
)
def loose(spark, sf_dir):
    check = NEW_CHECKS["startend:quotation"]
    none = Args(F.lit(None).cast("map<string,string>"))
    d = work_table(spark, sf_dir, "documents").selectExpr("doc_id", f"{LOOSE_TEXT} AS t")
    return d.select(
        "doc_id", check(F.col("t"), none).alias("strict"),
        H.loose_verdict(F.col("t"), lambda v: check(v, none)).alias("loose"),
    )


# --- metrics JSON -----------------------------------------------------------------------------

# One metrics text per document: several benchmarks and modes, numbers, booleans and quoted numbers.
METRICS_TEXT = """concat('{', chr(10), '  "gsm8k": {"pass@1": {"no_answer": ', doc_id % 9, '.5, "symbolic_correct": ', doc_id, '.25}},', chr(10),
  '  "IFEval-ko": {"pass@1": {"average_score": ', doc_id, ', "prompt_strict_accuracy": 10.5, "other": 1}, "majority": {"average_score": 3}},', chr(10),
  '  "custom', doc_id % 3, '": {"pass@1": {"num_entries": 20, "label": "7", "zeta": ', CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE '12.75' END, ', "alpha": ', doc_id, '}},', chr(10),
  '  "plain": {"pass@8": {"accuracy": 9}}', chr(10), CASE WHEN doc_id % 13 = 5 THEN ']' ELSE '}' END)"""


def metric_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('checkpoint-', doc_id) AS model", f"{METRICS_TEXT} AS value"
    )


GOOD = "doc_id % 13 <> 5"
_CELLS = f"""c AS (SELECT concat('checkpoint-', doc_id) AS model, unnest([
      {{'c': 'gsm8k_symbolic_correct', 'v': concat(doc_id, '.25')}}, {{'c': 'IFEval-ko_average_score', 'v': doc_id::VARCHAR}},
      {{'c': 'IFEval-ko_prompt_strict_accuracy', 'v': '10.5'}},
      {{'c': concat('custom', doc_id % 3, '_zeta'), 'v': CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE '12.75' END}}]) AS x
    FROM documents WHERE {GOOD})"""


@query("comparison_cells", f"""WITH {_CELLS} SELECT model, x.c AS "column", x.v AS value FROM c""")
def comparison_cells(spark, sf_dir):
    return H.comparison_cells(H.metric_rows(metric_texts(spark, sf_dir)))


@query(
    "fallback_metric",
    f"""WITH {_CELLS} SELECT model, split_part(x.c, '_', 1) AS benchmark, 'zeta' AS metric, x.v AS value FROM c WHERE starts_with(x.c, 'custom')""",
)
def fallback_metric(spark, sf_dir):
    rows = H.only_pass1(H.metric_rows(metric_texts(spark, sf_dir)))
    return H.reported_metrics(rows.filter(F.startswith("benchmark", F.lit("custom"))))


@query(
    "only_pass1",
    f"""SELECT benchmark, count(*) AS n FROM (SELECT unnest(list_concat(['gsm8k', 'gsm8k', 'IFEval-ko', 'IFEval-ko', 'IFEval-ko'],
          [concat('custom', doc_id % 3), concat('custom', doc_id % 3), concat('custom', doc_id % 3), concat('custom', doc_id % 3)])) AS benchmark
        FROM documents WHERE {GOOD}) GROUP BY 1""",
)
def only_pass1(spark, sf_dir):
    rows = H.only_pass1(H.metric_rows(metric_texts(spark, sf_dir)))
    return rows.groupBy("benchmark").agg(F.count("*").alias("n"))


@query(
    "bad_metrics",
    f"SELECT concat('checkpoint-', doc_id) AS model FROM documents WHERE NOT ({GOOD})",
)
def bad_metrics(spark, sf_dir):
    return H.bad_metrics(metric_texts(spark, sf_dir)).select("model")


@query(
    "important_metrics",
    """SELECT source, lang, CASE lang WHEN 'en' THEN 'symbolic_correct' WHEN 'de' THEN 'passing_base_tests,passing_plus_tests'
         WHEN 'fr' THEN 'average_score,instruction_strict_accuracy,prompt_strict_accuracy' WHEN 'es' THEN 'accuracy'
         ELSE 'symbolic_correct,passing_base_tests,passing_plus_tests,average_score,instruction_strict_accuracy,judge_correct,prompt_strict_accuracy' END AS metrics,
       count(*) AS n FROM documents GROUP BY 1, 2, 3""",
)
def important_metrics(spark, sf_dir):
    name = F.expr(
        "concat(CASE lang WHEN 'en' THEN 'MMLU-' WHEN 'de' THEN 'my-HumanEval-' WHEN 'fr' THEN 'x-IFEval-' "
        "WHEN 'es' THEN 'LiveCodeBench-' ELSE 'other-' END, source)"
    )
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(
        "source", "lang", F.array_join(H.important_metrics(name), ",").alias("metrics")
    ).agg(F.count("*").alias("n"))


_COLUMNS = (
    "arena_judge_correct", "gsm8k_symbolic_correct", "hendrycks_math_symbolic_correct", "human-eval_passing_base_tests",
    "human-eval_passing_plus_tests", "livecodebench_accuracy", "mbpp_passing_base_tests", "mbpp_passing_plus_tests",
    "mmlu_symbolic_correct",
)
_WIDE = f"""{_METRICS}, k AS (SELECT model, concat(benchmark, '_', metric) AS c, value FROM m WHERE metric <> 'no_answer')
    SELECT model, {', '.join(f'''coalesce(max(CASE WHEN c = '{c}' THEN value END), -1) AS "{c}"''' for c in _COLUMNS)} FROM k GROUP BY 1"""


def _comparison(spark, sf_dir, files: DataFrame) -> DataFrame:
    return H.comparison(H.comparison_cells(H.metric_rows(files)), _COLUMNS)


def _numbers(wide: DataFrame) -> DataFrame:
    return wide.select(
        "model",
        *[F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(-1.0)).alias(c) for c in wide.columns if c != "model"],
    )


@query("comparison", f"WITH {_WIDE}")
def comparison(spark, sf_dir):
    return _numbers(_comparison(spark, sf_dir, M.metrics_json(metric_table(spark, sf_dir))))


def _written(spark, sf_dir) -> str:
    root = scratch_path(spark, "results")
    M.write_metrics(metric_table(spark, sf_dir), root)
    return root


@query(
    "write_metrics",
    f"""WITH {_METRICS}, b AS (SELECT model, benchmark, concat('"', benchmark, '":{{"pass@1":{{', string_agg(concat('"', metric, '":', value::VARCHAR), ',' ORDER BY metric), '}}}}') AS t
          FROM m GROUP BY 1, 2) SELECT model, concat('{{', string_agg(t, ',' ORDER BY benchmark), '}}') AS value FROM b GROUP BY 1""",
)
def write_metrics(spark, sf_dir):
    files = M.scan_metrics(spark, _written(spark, sf_dir))
    return files.select("model", F.rtrim("value", F.lit("\n")).alias("value"))


@query("scan_metrics", f"WITH {_WIDE}")
def scan_metrics(spark, sf_dir):
    return _numbers(_comparison(spark, sf_dir, M.scan_metrics(spark, _written(spark, sf_dir))))


@query("write_comparison", f"WITH {_WIDE}")
def write_comparison(spark, sf_dir):
    wide = _comparison(spark, sf_dir, M.metrics_json(metric_table(spark, sf_dir)))
    path = M.write_comparison(wide, scratch_path(spark, "csv"))
    return _numbers(spark.read.option("header", True).csv(path))


@query(
    "write_model_row",
    f"WITH w AS (WITH {_WIDE}) SELECT * FROM w WHERE model = 'checkpoint-500'",
)
def write_model_row(spark, sf_dir):
    wide = _comparison(spark, sf_dir, M.metrics_json(metric_table(spark, sf_dir)))
    path = M.write_model_row(wide, scratch_path(spark, "csv"), "checkpoint-500")
    row = spark.read.option("header", True).csv(path)
    missing = [F.lit(None).cast("string").alias(c) for c in _COLUMNS if c not in row.columns]
    return _numbers(row.select("*", *missing))


@query(
    "scan_verdicts",
    f"""WITH d AS (SELECT {MODEL} AS model, doc_id, quality, toxic FROM labels)
        SELECT model, 'strict' AS variant, count(*) AS n, sum(quality)::BIGINT AS followed FROM d GROUP BY 1
        UNION ALL SELECT model, 'loose', count(*), sum(greatest(quality, toxic))::BIGINT FROM d GROUP BY 1""",
)
def scan_verdicts(spark, sf_dir):
    root = scratch_path(spark, "verdicts")
    rows = table(spark, sf_dir, "labels").selectExpr(
        f"{MODEL} AS model", "doc_id AS sample_id",
        """explode(array(named_struct('variant', 'strict', 'ok', quality = 1),
                         named_struct('variant', 'loose', 'ok', quality = 1 OR toxic = 1))) AS x""",
    ).select(
        "model", "sample_id", "x.variant", F.col("x.ok").alias("follow_all_instructions"),
        F.array("x.ok").alias("follow_instruction_list"),
    )
    # One half of the models uses the prefixed file names, the other the plain ones.
    prefixed = F.col("model").isin("base", "checkpoint-500", "checkpoint-1000", "checkpoint-1500")
    M.write_verdicts(rows.filter(prefixed), root, stem="output")
    M.write_verdicts(rows.filter(~prefixed), root)
    return M.scan_verdicts(spark, root).groupBy("model", "variant").agg(
        F.count("*").alias("n"), F.count_if("follow_all_instructions").alias("followed")
    )


def write_markers(models: DataFrame, root: str) -> None:
    """Write the marker file of each model's directory."""
    spark = models.sparkSession
    folder = scratch_path(spark, "markers")
    models.select("model", F.lit("done").alias("value")).repartition("model").write.partitionBy("model").text(folder)
    for name in list_names(spark, folder):
        if name.startswith("model="):
            part = part_files(spark, f"{folder}/{name}")[0]
            move(spark, part, f"{root}/{name.removeprefix('model=')}/{M.MARKER}")


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr(f"{MODEL} AS model").distinct()


@query(
    "list_checkpoints",
    f"""SELECT DISTINCT {MODEL} AS model, regexp_extract({MODEL}, '\\d+')::BIGINT AS step FROM labels WHERE {MODEL} <> 'base v+1'""",
)
def list_checkpoints(spark, sf_dir):
    root = scratch_path(spark, "checkpoints")
    write_markers(models(spark, sf_dir), root)
    return M.list_checkpoints(spark, root)


# The checkpoint a document was produced by: a bounded set of names, some without a number.
RUN = (
    "CASE WHEN doc_id % 5 = 0 THEN concat('run-', doc_id % 15) "
    "ELSE concat('x/Checkpoint-', 25 * (doc_id % 64), '-hf') END"
)


@query(
    "checkpoint_order",
    f"""WITH m AS (SELECT DISTINCT {RUN} AS model FROM documents)
       SELECT model, row_number() OVER (ORDER BY nullif(regexp_extract(lower(model), 'checkpoint-(\\d+)', 1), '')::BIGINT NULLS LAST, model) AS place FROM m""",
)
def checkpoint_order(spark, sf_dir):
    names = table(spark, sf_dir, "documents").selectExpr(f"{RUN} AS model").distinct()
    # One row per model: the list of models is short by nature.
    order = Window.orderBy(H.checkpoint_step(F.col("model")).asc_nulls_last(), "model")
    return names.select("model", F.row_number().over(order).cast("long").alias("place"))


@query(
    "pending",
    f"""WITH c AS (SELECT DISTINCT {MODEL} AS model FROM labels), b AS (SELECT DISTINCT source AS benchmark FROM documents),
        l AS (SELECT DISTINCT {MODEL} AS model, source AS benchmark FROM documents JOIN labels USING (doc_id))
        SELECT model, benchmark FROM c, b WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.model = c.model AND l.benchmark = b.benchmark)""",
)
def pending(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ledger = docs.join(labels, "doc_id").selectExpr(f"{MODEL} AS model", "source AS benchmark").distinct()
    benchmarks = docs.select(F.col("source").alias("benchmark")).distinct()
    return H.pending(models(spark, sf_dir), benchmarks, ledger)


@query(
    "missing_steps",
    f"""SELECT g AS step FROM generate_series(250, 4500, 250) AS x(g)
        WHERE g NOT IN (SELECT regexp_extract({MODEL}, '\\d+')::BIGINT FROM labels WHERE {MODEL} <> 'base v+1')""",
)
def missing_steps(spark, sf_dir):
    return H.missing_steps(models(spark, sf_dir), 250, 4500, 250)


@query(
    "eval_config",
    f"""WITH {_METRICS} SELECT model, benchmark, metric, value, CASE WHEN benchmark IN ('gsm8k', 'human-eval', 'mbpp', 'hendrycks_math') THEN 0.6 ELSE 0.0 END::DOUBLE AS temperature,
        CASE WHEN benchmark IN ('gsm8k', 'human-eval', 'mbpp', 'hendrycks_math') THEN 2048 ELSE 1024 END::BIGINT AS max_tokens FROM m""",
)
def eval_config(spark, sf_dir):
    rows = metric_table(spark, sf_dir).drop("mode")
    sampled = F.col("benchmark").isin("gsm8k", "human-eval", "mbpp", "hendrycks_math")
    config = rows.select("benchmark").distinct().select(
        "benchmark", F.when(sampled, 0.6).otherwise(0.0).alias("temperature"),
        F.when(sampled, 2048).otherwise(1024).cast("long").alias("max_tokens"),
    )
    return H.with_config(rows, config)


@query("write_reward_log", f"SELECT * FROM ({REWARD_LOG}) WHERE step % 2 = 0")
def write_reward_log(spark, sf_dir):
    path = scratch_path(spark, "rewards")
    M.write_reward_log(reward_log_frame(spark, sf_dir), path, every=2)
    return spark.read.parquet(path)
