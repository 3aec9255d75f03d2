import csv
import json

import pytest
from pyspark.sql import functions as F

from posttrain_spark.operators import evals as H
from posttrain_spark.sources import metrics as M

EXAMPLE = {
    "gsm8k": {"pass@1": {"symbolic_correct": 71.5, "no_answer": 6.25}},
    "human-eval": {"pass@1": {"passing_base_tests": 50.5, "passing_plus_tests": 44.25}},
    "ifeval": {"pass@1": {"average_score": 61.0, "instruction_strict_accuracy": 58.75}},
    "mbpp": {"pass@1": {"passing_base_tests": 40.5, "passing_plus_tests": 33.75}},
}
SEVEN = [
    "gsm8k_symbolic_correct", "human-eval_passing_base_tests", "human-eval_passing_plus_tests",
    "ifeval_average_score", "ifeval_instruction_strict_accuracy", "mbpp_passing_base_tests",
    "mbpp_passing_plus_tests",
]


def put(root, model, metrics):
    folder = root / model
    folder.mkdir(parents=True)
    text = metrics if isinstance(metrics, str) else json.dumps(metrics, indent=2)
    (folder / "metrics.json").write_text(text)


@pytest.fixture()
def results(tmp_path):
    root = tmp_path / "results"
    for model in ("checkpoint-1000", "checkpoint-500"):
        put(root, model, EXAMPLE)
    put(root, "base", {"extra": {"pass@1": {"num_entries": 3, "label": "9", "flag": True, "x": 2}, "majority": {"accuracy": 1}}})
    put(root, "checkpoint-1500", "{broken")
    put(root, "deep/checkpoint-1", EXAMPLE)
    return str(root)


def cells(spark, root):
    return H.comparison_cells(H.metric_rows(M.scan_metrics(spark, root)))


def test_example_gives_the_seven_columns(spark, results):
    wide = H.comparison(cells(spark, results).filter("model = 'checkpoint-500'"))
    assert wide.columns == ["model", *SEVEN]
    assert wide.first()["gsm8k_symbolic_correct"] == "71.5"


def test_fallback_is_the_first_number_in_file_order(spark, results):
    got = {r.column: r.value for r in cells(spark, results).filter("model = 'base'").collect()}
    assert got == {"extra_flag": "true"}


def test_bad_and_deep_files(spark, results):
    files = M.scan_metrics(spark, results)
    assert {r.model for r in files.collect()} == {"base", "checkpoint-500", "checkpoint-1000", "checkpoint-1500"}
    assert [r.model for r in H.bad_metrics(files).collect()] == ["checkpoint-1500"]


def test_no_valid_file_is_an_error(spark, tmp_path):
    put(tmp_path, "checkpoint-1", "{broken")
    with pytest.raises(ValueError, match="no valid metrics"):
        H.comparison(cells(spark, str(tmp_path)))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        M.scan_metrics(spark, str(tmp_path / "nowhere")).count()


def test_csv_output(spark, results, tmp_path):
    wide = H.comparison(cells(spark, results))
    target = M.write_comparison(wide, str(tmp_path / "out" / "table"))
    assert target.endswith("table.csv")
    rows = list(csv.reader(open(target)))
    assert rows[0] == ["model", "extra_flag", *SEVEN]
    assert [r[0] for r in rows[1:]] == ["checkpoint-500", "checkpoint-1000", "base"]
    assert rows[3][1:] == ["true"] + [""] * 7 and rows[1][1] == ""
    (tmp_path / "dir").mkdir()
    assert M.write_comparison(wide, str(tmp_path / "dir")).endswith("dir/combined_metrics.csv")
    single = M.write_model_row(wide, str(tmp_path / "one.csv"), "base")
    assert open(single).read().split() == ["model,extra_flag", "base,true"]


def test_metrics_round_trip(spark, tmp_path):
    rows = [("checkpoint-5", b, m, k, float(v)) for b, ms in EXAMPLE.items() for m, kv in ms.items() for k, v in kv.items()]
    df = spark.createDataFrame(rows, "model string, benchmark string, mode string, metric string, value double")
    M.write_metrics(df, str(tmp_path / "r"))
    assert json.load(open(tmp_path / "r" / "checkpoint-5" / "metrics.json")) == EXAMPLE
    one = M.scan_metrics_file(spark, str(tmp_path / "r" / "checkpoint-5" / "metrics.json"), "named")
    assert one.first().model == "named"


def test_verdict_files_with_and_without_prefix(spark, tmp_path):
    for name in ("output-eval_results_loose.jsonl", "eval_results_strict.jsonl", "other.jsonl"):
        folder = tmp_path / "checkpoint-2"
        folder.mkdir(exist_ok=True)
        (folder / name).write_text('{"sample_id": 1, "follow_all_instructions": true}\n')
    got = {(r.model, r.stem, r.variant) for r in M.scan_verdicts(spark, str(tmp_path)).collect()}
    assert got == {("checkpoint-2", "output", "loose"), ("checkpoint-2", "", "strict")}


def test_checkpoint_order(spark, tmp_path):
    for n in (1000, 90, 500):
        folder = tmp_path / f"checkpoint-{n}"
        folder.mkdir()
        (folder / M.MARKER).write_text("{}")
    assert [r.step for r in M.list_checkpoints(spark, str(tmp_path)).collect()] == [90, 500, 1000]
    df = spark.createDataFrame([("b",), ("Checkpoint-10",), ("a",), ("checkpoint-9",)], "model string")
    assert [r.model for r in H.by_checkpoint(df).collect()] == ["checkpoint-9", "Checkpoint-10", "a", "b"]


def test_loose_variants(spark):
    text = "Sure:\n*body* here\nBye"
    got = spark.createDataFrame([(text,)], "t string").select(H.loose_variants(F.col("t"))).first()[0]
    lines = text.split("\n")
    base = [text, "\n".join(lines[1:]).strip(), "\n".join(lines[:-1]).strip(), "\n".join(lines[1:-1]).strip()]
    assert got == base + [b.replace("*", "") for b in base]


def test_summaries(spark):
    df = spark.createDataFrame(
        [("m", "gsm8k", True, None), ("m", "gsm8k", False, None), ("m", "gsm8k", False, None), ("m", "mbpp", None, True)],
        "model string, benchmark string, symbolic_correct boolean, passing_base_tests boolean",
    )
    got = {(r.benchmark, r.metric): r.value for r in H.summarize(df, ["symbolic_correct", "passing_base_tests"]).collect()}
    assert got == {("gsm8k", "symbolic_correct"): 33.33, ("mbpp", "passing_base_tests"): 100.0}
    rows = [("m", 1, True, True), ("m", 1, False, True), ("m", 2, True, True)]
    v = spark.createDataFrame(rows, "model string, sample_id long, strict boolean, loose boolean")
    r = H.summarize_following(v).first()
    assert (r.prompt_strict_accuracy, r.instruction_strict_accuracy) == (50.0, 66.67)
    assert (r.prompt_loose_accuracy, r.average_score) == (100.0, 79.17)


def test_work_lists(spark):
    models = spark.createDataFrame([("checkpoint-250",), ("checkpoint-750",)], "model string")
    benches = spark.createDataFrame([("a",), ("b",)], "benchmark string")
    ledger = spark.createDataFrame([("checkpoint-250", "a")], "model string, benchmark string")
    got = sorted(tuple(r) for r in H.pending(models, benches, ledger).collect())
    assert got == [("checkpoint-250", "b"), ("checkpoint-750", "a"), ("checkpoint-750", "b")]
    assert sorted(r.step for r in H.missing_steps(models, 250, 1000, 250).collect()) == [500, 1000]


def test_names_with_spaces_and_colons(spark, tmp_path):
    rows = [("run 50% a+b", "gsm8k", "pass@1", "symbolic_correct", 1.5), ("at 12:30", "gsm8k", "pass@1", "symbolic_correct", 1.0), ("plain", "gsm8k", "pass@1", "symbolic_correct", 2.0)]
    df = spark.createDataFrame(rows, "model string, benchmark string, mode string, metric string, value double")
    M.write_metrics(df, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["at 12:30", "plain", "run 50% a+b"]
    assert sorted(r.model for r in M.scan_metrics(spark, str(tmp_path / "out")).collect()) == ["at 12:30", "plain", "run 50% a+b"]


def test_numbers_that_json_cannot_write(spark):
    text = '{"b": {"pass@1": {"x": NaN, "y": 1.5}}}'
    rows = H.metric_rows(spark.createDataFrame([("m", text)], "model string, value string")).collect()
    assert {r.metric: r.value for r in rows} == {"x": "NaN", "y": "1.5"}
