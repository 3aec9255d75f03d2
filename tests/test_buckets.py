"""Scoring tables: joined without an exchange, hot prompts spread, NULL and missing prompts kept."""

import pytest
from pyspark.sql import functions as F

from posttrain_spark.operators import reward as R, skew
from posttrain_spark.plans import rewards as P
from posttrain_spark.sources import buckets as B


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_reads_buckets_without_an_exchange(spark, small):
    samples, tables = P.stored_samples(spark, small)
    text = plan(R.score_unified(samples))
    assert "Exchange" not in text and "SortMergeJoin" in text and "Bucketed: true" in text
    # A condition on completions reaches their scan.
    some = B.read_scoring_tables(spark, tables, F.col("turn") > 2)
    assert "GreaterThan(turn,2)" in plan(some) and some.filter("turn <= 2").count() == 0
    B.drop_scoring_tables(spark, tables)
    assert not spark.catalog.tableExists(tables.samples)


@pytest.mark.parametrize("hot", [True, False])
def test_hot_null_and_missing_prompts(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(skew, "MIN_ROWS", 50 if hot else 10**6)
    rows = [(1 if i % 3 else None if i % 2 else i, i, f"c{i}") for i in range(1200)]
    samples = spark.createDataFrame(rows, "prompt_id long, sample_idx long, completion string")
    labels = spark.createDataFrame([(k, f"l{k}") for k in range(600)] + [(None, "none")], "prompt_id long, label string")
    tables = B.write_scoring_tables(samples, labels, f"hot_{hot}", str(tmp_path), buckets=8)
    joined = B.read_scoring_tables(spark, tables)
    assert "Exchange" not in plan(joined)
    plain = samples.join(labels, "prompt_id", "left").select(joined.columns)
    assert sorted(map(str, joined.collect())) == sorted(map(str, plain.collect()))
    largest = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 500 if hot else largest >= 800


def test_empty_tables(spark, tmp_path):
    samples = spark.createDataFrame([], "prompt_id long, sample_idx long, completion string")
    labels = spark.createDataFrame([], "prompt_id long, label string")
    tables = B.write_scoring_tables(samples, labels, "nothing", str(tmp_path))
    assert B.read_scoring_tables(spark, tables).collect() == []
