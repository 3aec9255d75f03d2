import json
import re

from pyspark.sql import functions as F

from posttrain_spark.operators import labels as L, reward as R
from posttrain_spark.sources.conversations import spaced_json

LABELS = {
    "[{'instruction_id': ['a', 'b'], 'kwargs': [None, {'N': 3, 'x': True}]}]": [("a", None), ("b", {"N": "3", "x": "true"})],
    "[{'instruction_id': ['a'], 'kwargs': [{'q': \"it's None, True\"}]}]": [("a", {"q": "it's None, True"})],
    "[{'instruction_id': ['a'], 'kwargs': [{'q': '\\x41\\u00e9\\n'}]}]": [("a", {"q": "Aé\n"})],
    "['{\"instruction_id\": [\"a\"], \"kwargs\": [{\"N\": null}]}']": [("a", {"N": None})],
    "[{'instruction_id': ['a', 'b'], 'kwargs': [{}]}, {'ignored': 1}]": [("a", {})],
    "[{'instruction_id': ('a',), 'kwargs': ({'N': 0x10},)},]": [("a", {"N": "16"})],
    "[{'instruction_id': ['a'], 'kwargs': [{'keywords': ['x', 'y']}]}]": [("a", {"keywords": '["x","y"]'})],
    "[{'instruction_id': ['a'], 'kwargs': [{'keyword': 'c(d'}]}]": None,
    "[{'instruction_id': ['a'], 'kwargs': [{'keyword': 'c(d)?'}]}]": [("a", {"keyword": "c(d)?"})],
    "[{\"instruction_id\": [\"a\"], \"kwargs\": [null]}]": None,
    "[{'instruction_id': ['a']}]": None,
    "[{'instruction_id': ['a'], 'kwargs': [{}]}] trailing": None,
    "[]": None,
    "": None,
    "not a literal": None,
}


def test_multi_labels(spark):
    df = spark.createDataFrame([(k,) for k in LABELS], "ground_truth string")
    got = {r.ground_truth: r.constraints for r in L.parse_multi_labels(df).collect()}
    for text, want in LABELS.items():
        found = got[text]
        if want is None:
            assert found is None, text
            continue
        pairs = [(c.instruction_id, c.kwargs) for c in found]
        loose = [(i, {k: v.replace(" ", "") if v and v.startswith("[") else v for k, v in a.items()} if a is not None else None) for i, a in pairs]
        assert loose == want, text


def test_plain_labels_do_not_need_python(spark):
    plain = list(LABELS)[:2]
    df = spark.createDataFrame([(k,) for k in plain], "ground_truth string")
    assert df.filter(~L._is_plain_literal(F.col("ground_truth"))).count() == 0


def test_label_kind(spark):
    cases = {
        '{"func_name": "x"}': "old",
        '{"name": "x"}': "multi",
        "{'func_name': 'x'}": "multi",
        '[{"func_name": 1}]': "multi",
        '{"func_name": 1} x': "multi",
        "3": "multi",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.k for r in df.select("t", L.label_kind(F.col("t")).alias("k")).collect()}
    assert got == cases


def test_old_label_keeps_nested_values(spark):
    label = json.dumps({"func_name": "validate_choice", "options": ["a", "b"], "N": None})
    row = spark.createDataFrame([(label,)], "t string").select(L.parse_old_label(F.col("t")).alias("m")).first()
    assert row.m["func_name"] == "validate_choice" and row.m["N"] is None
    assert json.loads(row.m["options"]) == ["a", "b"]


def test_very_long_quoted_text(spark):
    long = "it is " * 20_000 + "don't \\ stop\n" * 1_000
    rows = [
        (1, repr([{"instruction_id": ["combination:repeat_prompt"], "kwargs": [{"prompt_to_repeat": long}]}])),
        (2, repr([{"instruction_id": ["combination:repeat_prompt"], "kwargs": [{"prompt_to_repeat": "\\n" * 50_000}]}])),
    ]
    parsed = L.parse_multi_labels(spark.createDataFrame(rows, "id int, ground_truth string"))
    got = {r.id: r.constraints[0]["kwargs"]["prompt_to_repeat"] for r in parsed.collect()}
    assert got == {1: long, 2: "\\n" * 50_000}


def test_braces_in_keywords(spark):
    words = ["{", "x{y}", "a{,3}", "b{2}", "[{]", "}", "{}"]
    text = "{ x{y} { aaa bb { } {}"
    label = repr([{"instruction_id": ["keywords:existence"], "kwargs": [{"keywords": words}]}])
    df = spark.createDataFrame([(label, text)], "ground_truth string, completion string")
    row = R.score_multi(L.parse_multi_labels(df)).first()
    assert (row.error, row.score) == (None, 1.0)
    for pattern in [*words, "a{,}", r"\{", "a{1,2}}"]:
        assert re.findall(pattern, text) == re.findall(L.portable_braces(pattern), text)


def test_json_with_very_long_strings(spark):
    text = '{"a":"' + "x,y:" * 30_000 + '\\"","b":[1,2]}'
    df = spark.createDataFrame([(text,)], "t string").select(spaced_json(F.col("t")).alias("t"))
    assert df.first().t == text.replace('{"a":', '{"a": ').replace(',"b":[1,2]', ', "b": [1, 2]')
