import pytest
from pyspark.sql import functions as F

from posttrain_spark.sources.metrics import MARKER
from posttrain_spark.streaming import streams as T


def finish(query):
    query.awaitTermination()


def add(root, *numbers):
    for n in numbers:
        folder = root / f"checkpoint-{n}"
        folder.mkdir(parents=True)
        (folder / MARKER).write_text("{}")


def test_each_checkpoint_once_in_order_over_restarts(spark, tmp_path):
    root, state, seen = tmp_path / "run", str(tmp_path / "state"), []

    def go():
        stream = T.stream_checkpoints(spark, str(root), skip=["checkpoint-90"])
        finish(T.evaluate_new(stream, lambda b: seen.append([r.step for r in b.collect()]), state))

    add(root, 1000, 90, 500)
    go()
    add(root, 250)
    go()
    assert [s for s in seen if s] == [[500, 1000], [250]]


def test_failed_evaluation_stops_and_is_repeated(spark, tmp_path):
    root, state, seen = tmp_path / "run", str(tmp_path / "state"), []
    add(root, 10)

    def fail(batch):
        raise RuntimeError("evaluation failed")

    with pytest.raises(Exception, match="evaluation failed"):
        finish(T.evaluate_new(T.stream_checkpoints(spark, str(root)), fail, state))
    again = T.stream_checkpoints(spark, str(root))
    finish(T.evaluate_new(again, lambda b: seen.extend(r.step for r in b.collect()), state))
    assert seen == [10]


def test_advantages_wait_for_whole_groups(spark, tmp_path):
    """Groups arrive in pieces over several runs; a group of five of eight is withheld."""
    source, state, out = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "out")
    schema = "prompt_id long, sample_idx int, reward double"
    rows = [(p, i, float((p + i * i) % 7)) for p in range(3) for i in range(8 if p < 2 else 5)]
    for part in (rows[:5], rows[5:11], rows[11:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        finish(T.write_scores(T.stream_advantages(stream), out, state))
    got = spark.read.parquet(out)
    from posttrain_spark.operators.rollouts import advantages

    full = spark.createDataFrame([r for r in rows if r[0] < 2], schema)
    want = {(r.prompt_id, r.sample_idx): r.advantage for r in advantages(full).collect()}
    found = {(r.prompt_id, r.sample_idx): r.advantage for r in got.collect()}
    assert found.keys() == want.keys()
    assert all(found[k] == pytest.approx(want[k]) for k in want)


def test_names_with_colons_and_rewritten_markers(spark, tmp_path):
    root, state, seen = tmp_path / "run", str(tmp_path / "state"), []

    def go():
        stream = T.stream_checkpoints(spark, str(root), skip=["checkpoint-7"])
        finish(T.evaluate_new(stream, lambda b: seen.append([r.model for r in b.collect()]), state))

    add(root, "20:a", "3 b%20", 7)
    (root / "other-1").mkdir()
    (root / "checkpoint-9").mkdir()
    go()
    (root / "checkpoint-20:a" / MARKER).write_text("{ }")
    add(root, "5+c")
    go()
    assert [s for s in seen if s] == [["checkpoint-3 b%20", "checkpoint-20:a"], ["checkpoint-5+c"]]


def test_only_new_or_rewritten_metrics_are_read(spark, tmp_path):
    """The second run's batch holds the changed file alone, and its cells replace the old ones."""
    import json
    import os

    root, table, state = tmp_path / "results", str(tmp_path / "cells"), str(tmp_path / "state")

    def put(model, value, when):
        path = root / model / "metrics.json"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps({"gsm8k": {"pass@1": {"symbolic_correct": value, "no_answer": 1.0}}}))
        os.utime(path, (when, when))

    put("checkpoint-1:x", 10.0, 1_000)
    put("checkpoint-2", 20.0, 1_000)
    finish(T.stream_comparison(spark, str(root), table, state))
    put("checkpoint-2", 25.0, 2_000)
    finish(T.stream_comparison(spark, str(root), table, state))
    finish(T.stream_comparison(spark, str(root), table, state))
    rows = spark.read.option("recursiveFileLookup", "true").parquet(table)
    assert sorted((r.model, r.batch) for r in rows.select("model", "batch").distinct().collect()) == [
        ("checkpoint-1:x", 0), ("checkpoint-2", 0), ("checkpoint-2", 1),
    ]
    cells = {(r.model, r.value) for r in T.latest_cells(spark, table).collect()}
    assert ("checkpoint-2", "25.0") in cells and ("checkpoint-1:x", "10.0") in cells and ("checkpoint-2", "20.0") not in cells
