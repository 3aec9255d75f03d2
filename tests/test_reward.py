import pytest
from pyspark.sql import functions as F

from posttrain_spark.operators import rollouts as G
from posttrain_spark.operators.constraints import NEW_CHECKS, OLD_CHECKS, Args, register_check
from posttrain_spark.operators.reward import (
    code_pass_rate, drop_incompatible, score_multi, score_old, score_unified, verdict_rows,
)


def verdict(spark, check, text, family="new", **args):
    checks = NEW_CHECKS if family == "new" else OLD_CHECKS
    pairs = [x for k, v in args.items() for x in (F.lit(k), F.lit(str(v)))]
    kwargs = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(checks[check](F.col("t"), Args(kwargs))).first()[0]


def test_all_checks_are_registered():
    assert len(NEW_CHECKS) == 54 and len(OLD_CHECKS) == 14


@pytest.mark.parametrize("divider, old, new", [(" * * * ", True, False), (" *** ", False, True)])
def test_paragraph_dividers_exclude_each_other(spark, divider, old, new):
    text = f"one{divider}two"
    assert verdict(spark, "paragraph_count", text, "old", N=2) is old
    assert verdict(spark, "length_constraints:number_paragraphs", text, num_paragraphs=2) is new


def test_keyword_matching_differs(spark):
    assert verdict(spark, "keyword_frequency", "a category", "old", word="cat", N=1) is False
    args = dict(keyword="cat", frequency=1, relation="at least")
    assert verdict(spark, "keywords:frequency", "a category", **args) is True


@pytest.mark.parametrize("relation", ["around", "at most"])
def test_new_family_refuses_old_quantifiers(spark, relation):
    for check, arg in (("number_words", "num_words"), ("number_sentences", "num_sentences")):
        args = {arg: 3, "relation": relation}
        assert verdict(spark, f"length_constraints:{check}", "a b c", **args) is None


def test_old_quantifiers(spark):
    words = " ".join("w" for _ in range(95))
    assert verdict(spark, "word_constraint", words, "old", N=100, quantifier="around") is True
    assert verdict(spark, "word_constraint", words, "old", N=110, quantifier="around") is False
    assert verdict(spark, "word_constraint", words, "old", N=95, quantifier="at most") is True
    for n, want in ((1, True), (3, True), (4, False)):
        got = verdict(spark, "sentence_constraint", "A. B? C", "old", N=n + 1, quantifier="around")
        assert got is want


def test_choice_directions(spark):
    options = '["yes or no"]'
    assert verdict(spark, "validate_choice", "yes", "old", options=options) is True
    assert verdict(spark, "validate_choice", "yes or no!", "old", options=options) is False
    check = "detectable_format:constrained_response"
    assert verdict(spark, check, "Well. My answer is yes. Bye") is True
    assert verdict(spark, check, "yes") is False


def test_blank_inner_paragraph_fails(spark):
    check = "length_constraints:number_paragraphs"
    assert verdict(spark, check, "***a***b***", num_paragraphs=2) is True
    assert verdict(spark, check, "a*** ***b", num_paragraphs=2) is False


def test_missing_argument_is_null(spark):
    for check in ("length_constraints:number_words", "keywords:existence", "startend:end_checker", "copy:copy",
                  "first_word:first_word_answer", "keywords:keyword_specific_position", "copy:repeat_phrase"):
        assert verdict(spark, check, "some text") is None, check


CONSTRAINTS = "prompt_id long, completion string, constraints array<struct<instruction_id:string,kwargs:map<string,string>>>"
DOT, COMMA, WORDS = "punctuation:punctuation_dot", "punctuation:no_comma", "length_constraints:number_words"


def scored(spark, completion, constraints, scale=10.0):
    df = spark.createDataFrame([(1, completion, constraints)], CONSTRAINTS)
    return score_multi(df, scale).first()


def test_two_of_three_scores_six_point_six_seven(spark):
    row = scored(spark, "a b, c", [(DOT, None), (COMMA, None), (WORDS, {"num_words": "2", "relation": "at least"})])
    assert round(row.score, 2) == 6.67 and row.error is None


def test_zero_scores_and_their_reasons(spark):
    ok = [(DOT, None)]
    cases = [
        ("", ok, "blank"), ("<think>x</think>", ok, "blank"), (None, ok, "blank"), ("a", None, "bad_label"),
        ("a", [], "no_constraints"), ("a", [(DOT, None), ("no:such", None)], "raised"),
        ("a", [(DOT, None), (WORDS, {"num_words": "1", "relation": "around"})], "raised"),
    ]
    for completion, constraints, error in cases:
        row = scored(spark, completion, constraints)
        assert (row.score, row.error) == (0.0, error)


def test_thinking_is_not_scored(spark):
    assert scored(spark, "<think>a, b</think>ok", [(COMMA, None)]).score == 10.0


def test_verdict_rows(spark):
    df = spark.createDataFrame([(1, "a,", [(DOT, None), (COMMA, None)])], CONSTRAINTS)
    rows = verdict_rows(score_multi(df)).orderBy("position").collect()
    assert [(r.instruction_id, r.verdict) for r in rows] == [(DOT, True), (COMMA, False)]


def test_old_and_unified(spark):
    rows = [
        ("no comma", '{"func_name": "validate_no_commas"}', 10.0, None),
        ("a b", '{"func_name": "validate_word_constraint", "N": 2, "quantifier": "at least"}', 10.0, None),
        ("a", '{"func_name": "nope"}', 0.0, "unknown_check"),
        ("a", '{"func_name": "word_constraint", "N": 2}', 0.0, "raised"),
        ("a", "[{'instruction_id': ['punctuation:no_comma'], 'kwargs': [None]}]", 10.0, None),
        ("a", '{"name": 1}', 0.0, "bad_label"),
        ("a", "{", 0.0, "bad_label"),
    ]
    df = spark.createDataFrame(rows, "completion string, ground_truth string, want double, why string")
    for r in score_unified(df).collect():
        assert (r.score, r.error) == (r.want, r.why), r.ground_truth
    old = df.filter(F.startswith("ground_truth", F.lit('{"func'))).drop("why")
    assert [r.score for r in score_old(old, 10.0).collect()] == [10.0, 10.0, 0.0, 0.0]


def test_own_check_can_be_registered(spark):
    try:
        register_check("mine:shout")(lambda text, args: F.endswith(text, F.lit("!")))
        assert scored(spark, "hey!", [("mine:shout", None)]).score == 10.0
    finally:
        NEW_CHECKS.pop("mine:shout")


def test_incompatible_rows_are_dropped(spark):
    rows = [("word_constraint", "around"), ("word_constraint", "at least"), ("validate_title", "around"), ("sentence_constraint", None)]
    df = spark.createDataFrame(rows, "func_name string, quantifier string")
    assert [tuple(r) for r in drop_incompatible(df).collect()] == rows[1:]


def test_code_pass_rate(spark):
    df = spark.createDataFrame([(1, True), (1, False), (2, False), (2, False), (2, True), (3, None)], "sample_id long, passed boolean")
    got = {r.sample_id: r.pass_rate for r in code_pass_rate(df, threshold=0.4).collect()}
    assert got == {1: 0.5, 2: 0.0, 3: 0.0}


def test_advantages(spark):
    import statistics

    groups = {1: [0.0, 5.0, 10.0, 10.0], 2: [3.0], 3: [4.0, 4.0]}
    rows = [(g, float(r)) for g, rs in groups.items() for r in rs]
    df = spark.createDataFrame(rows, "prompt_id long, reward double")
    got = G.advantages(df).collect()
    for r in got:
        rs = groups[r.prompt_id]
        std = statistics.stdev(rs) if len(rs) > 1 else 0.0
        assert r.advantage == pytest.approx((r.reward - statistics.mean(rs)) / (std + 1e-4))
    for g in groups:
        assert sum(r.advantage for r in got if r.prompt_id == g) == pytest.approx(0, abs=1e-9)


def test_scale_changes_the_fourth_digit(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 0.5)], "prompt_id long, reward double")
    rows = G.scale_check(df).filter("reward = 1.0").first()
    assert rows.advantage != rows.scaled_advantage
    assert rows.advantage == pytest.approx(rows.scaled_advantage, rel=1e-3)


def test_mask_after_eos(spark):
    df = spark.createDataFrame([([1, 9, 2, 9],), ([1, 2],), ([],)], "t array<int>")
    assert [r[0] for r in df.select(G.mask_after_eos(F.col("t"), 9)).collect()] == [[1, 9], [1, 2], []]
