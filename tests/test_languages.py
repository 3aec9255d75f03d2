"""Language model: brute-force counts, held-out accuracy, the check in a constraint array."""

import math
import re

from pyspark.sql import functions as F

from posttrain_spark.operators import languages as L
from posttrain_spark.operators import reward as R


def brute(text):
    low = " " + " ".join(re.findall(r"[^\W\d_]+", (text or "").lower())) + " "
    codes = [ord(c) for c in low]
    return [(a * 961 + b * 31 + c) % L.BUCKETS for a, b, c in zip(codes, codes[1:], codes[2:])]


def test_trigrams_and_weights_against_brute_force(spark):
    rows = [("en", "The cat, the hat! 12"), ("de", "Über die Brücke"), ("en", ""), ("en", None), (None, "zzz"), ("de", "a\U0001d4d0b 😀")]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = df.select("text", L.trigrams(F.col("text")).alias("g")).collect()
    assert [r.g for r in got] == [brute(r.text) for r in got]
    model = L.fit_languages(df)
    assert model.languages == ["de", "en"]
    for name, weights in model.weights:
        grams = [b for lang, text in rows if lang == name for b in brute(text)]
        total = len(grams) + L.BUCKETS
        assert all(abs(w - 1000 * math.log((grams.count(b) + 1) / total)) <= 0.51 for b, w in enumerate(weights))


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = L.fit_languages(docs.filter("doc_id % 3 <> 0"))
    assert L.accuracy(model, docs.filter("doc_id % 3 = 0 AND n_chars > 40")) > 0.95


def test_check_in_a_constraint_array(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("n_chars > 200")
    model = L.fit_languages(docs)
    args = F.create_map(F.lit("language"), "wanted")
    samples = docs.limit(20).select("text", "lang", F.explode(F.array("lang", F.lit("xx"))).alias("wanted")).select(
        F.col("text").alias("completion"), "wanted",
        F.array(F.struct(F.lit(L.CHECK).alias("instruction_id"), args.alias("kwargs"))).alias("constraints"),
    )
    got = R.score_multi(samples, checks=model.checks()).collect()
    assert all((r.score, r.error) == (0.0, "raised") for r in got if r.wanted == "xx")
    assert sum(r.score for r in got if r.wanted != "xx") >= 19
    nothing = L.fit_languages(docs.limit(0))
    assert nothing.languages == [] and docs.limit(2).select(nothing.predict(F.col("text"))).first()[0] is None
    assert spark.range(1).select(model.predict(F.lit("12 + 3"))).first()[0] is None


def test_batches_agree_with_the_expression(spark, small, monkeypatch):
    odd = ["", " ", "a", "ab", "12 + 3", "Über die Brücke", "a\U0001d4d0b 😀", "the cat " * 900, None]
    docs = spark.createDataFrame([(t, lang) for t in odd for lang in ("en", "de", None)], "text string, lang string")
    real = spark.read.parquet(f"{small}/documents.parquet").select("text", "lang")
    for own in (docs, real):
        # Two languages of the same texts tie everywhere.
        model = L.fit_languages(own.unionByName(own.filter("lang = 'en'").withColumn("lang", F.lit("en2"))))
        text = F.col("text")
        rows = own.withColumn("a", model.predict(text)).withColumn("b", model.predict_batches(text)).collect()
        assert [r.a for r in rows] == [r.b for r in rows]
        assert "en2" in {r.b for r in rows} and "en" not in {r.b for r in rows}
    monkeypatch.setattr(L, "BLOCK_BYTES", 4)
    given = [f" {t} " for t in ("", "a", "über", "", "the cat", "\U0001d4d0b")]
    cut = [f[i:j].tolist() for f, low, high in L._buckets(L.pa.array(given)) for i, j in zip(low, high, strict=True)]
    assert cut == [[] if t == "  " else brute(t) for t in given]


def test_more_languages_than_a_task_holds(spark):
    rows = [(f"l{i % 150:03}", "abc" * (1 + i % 7)) for i in range(600)]
    model = L.fit_languages(spark.createDataFrame(rows, "lang string, text string").coalesce(1))
    assert model.languages == sorted({lang for lang, _ in rows})
    for name, weights in model.weights[::37]:
        grams = [b for lang, text in rows if lang == name for b in brute(text)]
        assert all(
            abs(w - 1000 * math.log((grams.count(b) + 1) / (len(grams) + L.BUCKETS))) <= 0.51 for b, w in enumerate(weights)
        )


def test_the_query_scores_no_character_in_a_higher_order_function(spark, small, capsys):
    from __spark_entry__ import queries

    queries()["language_model"](spark, small).explain("extended")
    plan = capsys.readouterr().out
    assert "lambda" not in plan and "ArrowEvalPython" in plan
