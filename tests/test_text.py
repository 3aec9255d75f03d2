import json
import re

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from posttrain_spark.functions import answers as A
from posttrain_spark.functions import text as X


def values(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


SPACED = st.lists(
    st.text(alphabet="aé \t\n  　<>/thinkanswer*-", max_size=30), min_size=1, max_size=20
)
FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@FEW
@given(SPACED)
def test_strip_is_python_strip(spark, texts):
    assert values(spark, texts, X.strip(F.col("t"))) == [t.strip() for t in texts]


@FEW
@given(SPACED)
def test_chunks_is_python_split(spark, texts):
    assert values(spark, texts, X.chunks(F.col("t"))) == [t.split() for t in texts]


def test_strip_thinking(spark):
    cases = {
        "<think>a</think> b": "b",
        "x": "x",
        "<think>a</think>": "",
        " <|assistant|> <answer>q</answer>\n": "q",
        "a</think>b</think>c": "c",
        "": "",
    }
    assert values(spark, list(cases), X.strip_thinking(F.col("t"))) == list(cases.values())


def test_is_json_agrees_with_the_json_module(spark):
    texts = ['{"a":1}', '{"a":1} x', "{'a':1}", "[1,2]", "1", '"s"', "", "nul", "null", "{", "1,2", '"a":1', "[1]]", "a"]

    def ok(text):
        try:
            json.loads(text)
            return True
        except ValueError:
            return False

    assert values(spark, texts, X.is_json(F.col("t"))) == [ok(t) for t in texts]


def test_words_and_sentences(spark):
    texts = ["Ein Wort_1, zwei!", "Über 30 naïve—tests"]
    assert values(spark, texts, X.words(F.col("t"))) == [re.findall(r"\w+", t) for t in texts]
    assert values(spark, ['One. "Two!" Three? four'], X.sentences(F.col("t"))) == [
        ["One.", '"Two!"', "Three?", "four"]
    ]


def test_last_number_rule(spark):
    cases = {
        "1,2,3": "3",
        "-5": "5",
        "x=.5": ".5",
        "1,234 and 5,678": "5678",
        "none": "none",
        "a -3.5": "-3.5",
        "12. 7": "7",
        "٣ apples": "٣",
    }
    assert values(spark, list(cases), A.last_number(F.col("t"))) == list(cases.values())


def test_last_boxed_any_depth(spark):
    deep = r"\boxed{" + "{" * 9 + "x" + "}" * 9 + "}"
    texts = [r"\boxed{1} then \boxed{\frac{1}{2}} end", r"\boxed{open", "none", deep, r"\boxed{a}}"]
    assert values(spark, texts, A.last_boxed(F.col("t"))) == [
        r"\frac{1}{2}", None, None, "{" * 9 + "x" + "}" * 9, "a",
    ]


def test_math_scores(spark):
    rows = [
        (r"so \boxed{\frac{1}{2}}", "0.5", 1.0),
        (r"\boxed{2}", "3", 0.0),
        ("Final Answer: The final answer is 1,234 units. I hope it is correct.", "1234", 1.0),
        ("we get $x=3$", "3", 1.0),
        ("12", "12.0", 1.0),
        ("nothing", "x", 0.0),
    ]
    df = spark.createDataFrame(rows, "p string, l string, want double")
    got = df.select(A.check_math(F.col("p"), F.col("l")).alias("s"), "want").collect()
    assert [r.s for r in got] == [r.want for r in got]


def test_last_code_block(spark):
    cases = {
        "```python\na\n``` mid ```\nb\n```": "b",
        "no fence": "no fence",
        "```open": "```open",
        "```py\nx```": "py\nx",
    }
    assert values(spark, list(cases), A.last_code_block(F.col("t"))) == list(cases.values())


def test_numbers_are_equal_as_rationals(spark):
    """Without floats: fractions, decimals of any length, percent, mixed numbers, signs, zero denominators."""
    from posttrain_spark.functions import answers as A

    cases = [
        ("1/3", "0.3333333333333333", False), ("1/2", "0.5", True), (r"\frac{1}{2}", "50%", True), ("50\\%", "50", True),
        ("50%", "0.5", True), ("50%", "50\\%", True), (r"3\frac{1}{2}", "3.5", True), (r"-3\frac{1}{2}", "-7/2", True),
        ("+4", "4.", True), (".50", "0.5", True), ("007", "7", True), ("-0", "0", True),
        ("0.1000000000000000055511151231257827", "0.1", False),
        ("123456789012345678901234567890.10", "123456789012345678901234567890.1", True),
        ("1/0", "2/0", False), ("1/0", "1/0", False), (r"\frac{-1}{-2}", "0.5", True), (r"\frac{1.5}{0.3}", "5", True),
        ("abc", "abc", False), ("", "", False), (None, "1", False), ("9" * 18, "9" * 18 + ".0", True),
        ("1" + "0" * 18 + "/1", "1", False), ("9" * 60 + "/3", "3", False), ("-.5", "-1/2", True), (r"\frac{1}{-2}", "-.5", True),
        (r"1234567\frac{1234567}{1234567}", "1234568", False), (r"1234\frac{123456}{123456}", "1235", True),
    ]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string")
    got = df.select("a", "b", A.same_number(F.col("a"), F.col("b")).alias("same")).collect()
    assert [(r.a, r.b, r.same) for r in got] == cases
