"""One query per constraint check, over all documents and their whole texts.

Each case says, in SQL both engines read, how the answer and the arguments are derived from a
document row, and, in the oracle's SQL, when the check holds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from posttrain_spark.functions.text import sentences
from posttrain_spark.operators import boundaries
from posttrain_spark.operators.constraints import (
    CHOICES,
    LANGUAGE_PROFILES,
    LANGUAGE_SCRIPTS,
    NEW_CHECKS,
    OLD_CHECKS,
    Args,
)
from posttrain_spark.plans import sql as S
from posttrain_spark.plans.registry import query, work_table
from posttrain_spark.session import durable


@dataclass(frozen=True)
class Case:
    check: str
    holds: str
    answer: str = "text"
    args: dict[str, str] = field(default_factory=dict)
    family: str = "new"


RELATION = (
    "CASE doc_id % 5 WHEN 0 THEN 'around' WHEN 1 THEN 'at least' WHEN 2 THEN 'at least' "
    "ELSE 'less than' END"
)
QUANTIFIER = (
    "CASE doc_id % 4 WHEN 0 THEN 'around' WHEN 1 THEN 'at least' WHEN 2 THEN 'at most' "
    "ELSE 'exactly' END"
)


def by(n: int, *values: str) -> str:
    """CASE on ``doc_id % n``: one value per remainder, the last one for the rest."""
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE doc_id % {n} {arms} ELSE {values[-1]} END"


def fill(word_start: str) -> str:
    return f"concat({word_start}, text)"


def copied(extra: str = "' x'") -> str:
    return by(3, "text", "concat(' ', lower(text), ' ')", f"concat(text, {extra})")


NL2 = "concat(chr(10), chr(10))"
BREAK = "' *** '"

NEW_CASES = [
    Case(
        "change_case:english_lowercase",
        r"NOT regexp_matches(t, '[\p{Lu}\p{Lt}]') AND regexp_matches(t, '\p{Ll}')",
        by(2, "lower(text)", "text"),
    ),
    Case(
        "change_case:english_capital",
        r"NOT regexp_matches(t, '[\p{Ll}\p{Lt}]') AND regexp_matches(t, '\p{Lu}')",
        "CASE WHEN lang = 'en' AND doc_id % 2 = 0 THEN upper(text) ELSE text END",
    ),
    Case(
        "change_case:capital_word_frequency",
        S.relation(
            f"len(list_filter({S.words('t')}, lambda w: upper(w) = w AND regexp_matches(w, '\\p{{Lu}}')))",
            "a_capital_relation", "a_capital_frequency::DOUBLE",
        ),
        "concat(text, ' NASA')",
        {"capital_relation": RELATION, "capital_frequency": "1 + doc_id % 6"},
    ),
    Case(
        "keywords:existence",
        "regexp_matches(t, '(?i)en') AND regexp_matches(t, '(?i)th.s?')",
        args={"keywords": """'["en","th.s?"]'"""},
    ),
    Case(
        "keywords:frequency",
        S.relation(S.hits("t", "in", "i"), "a_relation", "a_frequency::DOUBLE"),
        args={"keyword": "' in '", "relation": RELATION, "frequency": "doc_id % 40"},
    ),
    Case(
        "keywords:letter_frequency",
        "CASE WHEN regexp_matches(a_letter, '^[A-Za-z]$') THEN "
        + S.relation("(length(lower(t)) - length(replace(lower(t), lower(a_letter), '')))", "a_let_relation", "a_let_frequency::DOUBLE")
        + " END",
        args={
            "letter": by(7, "'E'", "'n'", "'#'", "'t'"),
            "let_relation": RELATION,
            "let_frequency": "doc_id % 60",
        },
    ),
    Case(
        "keywords:forbidden_words",
        r"NOT regexp_matches(t, '(?i)(^|[^\p{L}\p{N}_])(the|und|la)($|[^\p{L}\p{N}_])')",
        args={"forbidden_words": """'["the","und","la"]'"""},
    ),
    Case(
        "length_constraints:number_words",
        S.relation(f"len({S.words('t')})", "a_relation", "a_num_words::DOUBLE"),
        args={"relation": RELATION, "num_words": "10 * (doc_id % 50)"},
    ),
    Case(
        "length_constraints:number_sentences",
        S.relation(f"len({S.sentences('t')})", "a_relation", "a_num_sentences::DOUBLE"),
        args={"relation": RELATION, "num_sentences": "1 + doc_id % 40"},
    ),
    Case(
        "length_constraints:number_paragraphs",
        f"coalesce(len({S.filled(S.paragraphs('t'))}) = a_num_paragraphs::DOUBLE, false)",
        by(4, "text", f"concat(text, {BREAK}, text)", f"concat({BREAK}, text, '***')",
           f"concat(text, {BREAK}, {BREAK}, text)"),
        {"num_paragraphs": "1 + doc_id % 2"},
    ),
    Case(
        "length_constraints:nth_paragraph_first_word",
        "coalesce(p[a_nth_paragraph::INT] IS NOT NULL AND a_nth_paragraph::INT <= n "
        "AND n = a_num_paragraphs::DOUBLE AND lower(regexp_extract("
        "ltrim(ltrim(w, ''''), '\"'), '^[^.,?!''\"]*', 0)) = lower(a_first_word), false)",
        by(3, f"concat(text, {NL2}, 'Second, we end')", f"concat(text, {NL2}, {NL2}, 'second')", "text"),
        {"num_paragraphs": "2", "nth_paragraph": "2", "first_word": "'Second'"},
    ),
    Case(
        "detectable_format:json_format",
        S.json_ok("b"),
        by(
            5,
            "concat('```json', chr(10), '{\"n\": ', doc_id, '}', chr(10), '```')",
            "concat('[', doc_id, ', null, {\"a\": [1.5, true]}]')",
            "concat('{\"n\": ', doc_id, '} x')",
            "concat('{''n'': ', doc_id, '}')",
            "text",
        ),
    ),
    Case(
        "detectable_format:title",
        S.some(S.find("t", r"<<[^\n]+>>"), "length(" + S.strip("rtrim(ltrim(e, '<'), '>')") + ") > 0"),
        by(3, "concat('<<Title ', doc_id, '>>', chr(10), text)", "concat('<<  >> ', text)", "text"),
    ),
    Case(
        "detectable_format:multiple_sections",
        S.hits("t", S.WS + r"?Section" + S.WS + r"?\p{Nd}+" + S.WS + "?") + " >= a_num_sections::DOUBLE",
        by(3, "concat('Section 1 ', text, ' Section 2 ', text)", "concat('Section 1', chr(10), text)", "text"),
        {"section_spliter": "'Section'", "num_sections": "1 + doc_id % 2"},
    ),
    Case(
        "detectable_format:number_highlighted_sections",
        "len(list_filter(" + S.find("t", r"\*[^\n*]*\*") + ", lambda h: length(" + S.strip("trim(h, '*')") + ") > 0))"
        " + len(list_filter(" + S.find("t", r"\*\*([^\n*]*)\*\*", 1) + ", lambda h: length(" + S.strip("h") + ") > 0))"
        " >= a_num_highlights::DOUBLE",
        by(4, "concat('*one* ', text, ' *two*')", "concat('**one** ', text)", "concat('* * ', text)", "text"),
        {"num_highlights": "1 + doc_id % 3"},
    ),
    Case(
        "detectable_format:number_bullet_lists",
        "(" + S.hits("t", "(?m)^" + S.WS + r"*\*[^\*].*$") + " + " + S.hits("t", "(?m)^" + S.WS + "*-.*$")
        + ") = a_num_bullets::DOUBLE",
        by(3, "concat('* one', chr(10), '- two', chr(10), text)", "concat('** one', chr(10), '  - two ', text)", "text"),
        {"num_bullets": "doc_id % 3"},
    ),
    Case(
        "detectable_format:constrained_response",
        " OR ".join(f"contains(t, {S.quoted(c)})" for c in CHOICES),
        by(4, "concat(text, ' My answer is yes.')", "concat('My answer is no. ', text)",
           "concat('my answer is no. ', text)", "text"),
    ),
    Case(
        "detectable_content:number_placeholders",
        S.hits("t", r"\[.*?\]") + " >= a_num_placeholders::DOUBLE",
        by(3, "concat('[name] ', text, ' [date]')", "concat(text, ' [x')", "concat('[]', text)"),
        {"num_placeholders": "1 + doc_id % 2"},
    ),
    Case(
        "detectable_content:postscript",
        r"CASE a_postscript_marker WHEN 'P.P.S' THEN regexp_matches(lower(t), 'p\.\s?p\.\s?s') "
        r"WHEN 'P.S.' THEN regexp_matches(lower(t), 'p\.\s?s\.') END",
        by(4, "concat(text, chr(10), 'P.S. bye')", "concat(text, chr(10), 'p. p. s bye')",
           "concat(text, ' p. s. bye')", "text"),
        {"postscript_marker": by(2, "'P.S.'", "'P.P.S'")},
    ),
    Case("punctuation:no_comma", "strpos(t, ',') = 0"),
    Case(
        "startend:end_checker",
        "suffix(lower(trim(" + S.strip("t") + ", '\"')), 'the end.')",
        by(3, "concat(text, ' The End. ')", "concat('\"', text, ' the end.\" ')", "text"),
        {"end_phrase": "' The end. '"},
    ),
    Case(
        "startend:quotation",
        f"length({S.strip('t')}) > 1 AND left({S.strip('t')}, 1) = '\"' AND right({S.strip('t')}, 1) = '\"'",
        by(4, "concat('\"', text, '\" ')", "concat('\"', text)", "'\"'", "text"),
    ),
    Case(
        "combination:two_responses",
        "coalesce(len(q) = 2 AND q[1] <> q[2], false)",
        by(5, "concat(text, '******', text, ' b')", "concat(text, '****** ', text)",
           "concat('******', text, '******', 'b ', text, '******')",
           "concat(text, '******', ' ', '******', 'b')", "text"),
    ),
    Case(
        "combination:repeat_prompt",
        f"starts_with(lower({S.strip('t')}), lower({S.strip('a_prompt_to_repeat')}))",
        by(3, "concat(' ', lower(text), ' done')", "concat('So: ', text)", "text"),
        {"prompt_to_repeat": "concat(text, ' ')"},
    ),
    Case(
        "language:response_language",
        "coalesce((SELECT CASE WHEN best.hits > 0 THEN best.language END FROM (SELECT list_max(l) AS best)) "
        "= a_language, true)",
        args={"language": "CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END"},
    ),
    Case(
        "copy:copy", f"lower({S.strip('t')}) = lower({S.strip('a_prompt_to_repeat')})",
        copied(), {"prompt_to_repeat": "text"},
    ),
    Case(
        "copy:copying_simple", f"lower({S.strip('t')}) = lower({S.strip('a_prompt_to_repeat')})",
        copied("'!'"), {"prompt_to_repeat": "concat(text, chr(10))"},
    ),
    Case(
        "copy:copying_multiple",
        "len(string_split(t, '******')) = a_N::DOUBLE AND "
        + S.every("string_split(t, '******')", f"lower({S.strip('e')}) = lower({S.strip('a_prompt_to_repeat')})"),
        by(3, "concat(text, '******', text)", "concat(text, ' ****** ', lower(text), ' ****** ', text)",
           "concat(text, '******x')"),
        {"prompt_to_repeat": "text", "N": "2 + doc_id % 2"},
    ),
    Case(
        "copy:repeat_phrase",
        "len(r) = a_small_n::DOUBLE AND "
        + S.every("r", f"len({S.chunks('e')}) = 2 AND (({S.chunks('e')})[1] <> 'beta')::INT + (({S.chunks('e')})[2] <> 'gamma')::INT <= 1"),
        by(4, "concat(text, ' alpha beta gamma delta, alpha beta x delta.')",
           "concat('alpha x gamma delta ', text)", "concat('alpha x y delta ', text, ' alpha beta gamma delta')", "text"),
        {"phrase": "'alpha beta gamma delta'", "small_n": "2 - doc_id % 2"},
    ),
    Case(
        "count:count_increment_word",
        S.hits("t", "zebra", "i") + " = 1 AND " + S.hits("t", "yak", "i") + " = 2",
        by(3, "concat('Zebra yak ', text, ' YAK')", "concat('zebra yak ', text)", "concat('zebra zebra yak yak ', text)"),
        {"keyword1": "'zebra'", "keyword2": "'yak'"},
    ),
    Case(
        "count:count_unique",
        f"len({S.words('t')}) = len(list_distinct({S.words('t')}))",
        by(3, "concat('one two ', doc_id)", "concat('one two one ', doc_id)", "text"),
    ),
    Case(
        "count:counting_composition",
        "coalesce(len(f) = 3 AND " + S.every(
            "f",
            f"len({S.sentences('e')}) = a_n_sent::DOUBLE AND len(list_filter({S.sentences('e')}, "
            f"lambda s: len({S.words('s')}) <> a_n_words::DOUBLE)) = 0",
        ) + ", false)",
        by(4, "'One two. Three four. *** Five six. Seven eight. *** A b. C d.'",
           "concat('One two. Three ', doc_id, '. *** Five six. Seven eight. *** A b. C d.')",
           "concat('One two. Three. *** Five six. Seven eight. *** A b. C ', doc_id, '.')", "text"),
        {"n_sent": "2", "n_words": "2"},
    ),
    Case("paragraphs:paragraphs", f"len({S.paragraphs('t')}) = 2",
         by(3, f"concat(text, {BREAK}, text)", "concat(text, '***', text, '***')", "text")),
    Case("paragraphs:paragraphs2", "len(string_split(t, concat(chr(10), chr(10)))) = 2",
         by(3, f"concat(text, {NL2}, text)", f"concat(text, {NL2}, text, {NL2})", "text")),
    Case(
        "count:lowercase_counting",
        f"len(list_filter({S.words('t')}, lambda w: w = lower(w))) <= a_N::DOUBLE",
        args={"N": "10 * (doc_id % 50)"},
    ),
    Case(
        "letters:letter_counting",
        S.relation(S.hits("t", r"\p{L}"), "a_relation", "a_N::DOUBLE"),
        args={"relation": RELATION, "N": "50 * (doc_id % 50)"},
    ),
    Case(
        "letters:letter_counting2",
        S.relation("(length(lower(t)) - length(replace(lower(t), lower(a_letter), '')))", "a_let_relation", "a_let_frequency::DOUBLE"),
        args={"letter": "'a'", "let_relation": RELATION, "let_frequency": "doc_id % 90"},
    ),
    Case(
        "detectable_format:bigram_wrapping",
        "len(list_filter(range(len(c)), lambda i: CASE WHEN i % 2 = 0 AND i = len(c) - 1 THEN false "
        "WHEN i % 2 = 0 THEN NOT starts_with(c[i + 1], '<<') ELSE NOT suffix(c[i + 1], '>>') END)) = 0",
        by(4, "concat('<<I am>> <<at ', doc_id, '>>')", "concat('<<I am>> <<at ', doc_id, '>> home')",
           "concat('<<I am>> at ', doc_id, '>>')", "text"),
    ),
    Case(
        "detectable_format:sentence_hyphens",
        S.every(f"string_split({S.strip('t')}, '-')", f"e = {S.strip('e')} AND len({S.sentences('e')}) <= 1"),
        by(4, "concat('One here.-Two ', doc_id, '.-Three.')", "concat('One here.- Two ', doc_id, '.')",
           "concat('One. Two.-Three ', doc_id, '.')", "text"),
    ),
    Case(
        "detectable_format:square_brackets",
        S.every(S.chunks("t"), "starts_with(e, '[') AND suffix(e, ']')"),
        by(3, "concat('[one] [', doc_id, ']')", "concat('[one] two [', doc_id, ']')", "text"),
    ),
    Case(
        "first_word:first_word_sent",
        S.every(S.sentences("t"), f"lower(({S.words('e')})[1]) = 'the'"),
        by(3, "concat('The ', doc_id, '. THE end!')", "concat('The ', doc_id, '. An end!')", "text"),
        {"first_word": "'The'"},
    ),
    Case(
        "first_word:first_word_answer", f"coalesce(lower(({S.words('t')})[1]) = 'the', false)",
        by(2, "concat('The ', text)", "text"), {"first_word": "'the'"},
    ),
    Case(
        "last_word:last_word_sent",
        S.every(S.sentences("t"), f"lower(({S.words('e')})[-1]) = 'end'"),
        by(3, "concat(doc_id, ' end. The End!')", "concat(doc_id, ' end. The x!')", "text"),
        {"last_word": "'End'"},
    ),
    Case(
        "last_word:last_word_answer", f"coalesce(lower(({S.words('t')})[-1]) = 'end', false)",
        by(2, "concat(text, ' END.')", "text"), {"last_word": "'end'"},
    ),
    Case(
        "keywords:exclude_word_harder", "strpos(t, a_keyword) = 0",
        args={"keyword": by(3, "'the'", "'und'", "'et'")},
    ),
    Case(
        "keywords:keyword_specific_position",
        f"coalesce((regexp_extract_all(({S.sentences('t')})[a_n::INT], '{S.WORD}'))[a_m::INT] = a_keyword, false)",
        by(3, "concat('One here. Two word there. ', text)", "concat('Two word here. ', text)", "text"),
        {"keyword": "'word'", "n": "2 - doc_id % 2", "m": "2"},
    ),
    Case(
        "keywords:no_adjacent_consecutive",
        "len(list_filter(range(1, len(i)), lambda k: i[k + 1] - i[k] = 1)) = 0",
        by(3, "concat('zoo xylo ', doc_id, ' cat')", "concat('apple Banana ', doc_id)", "text"),
    ),
    Case(
        "keywords:palindrome",
        S.some(S.words("t"), "length(e) > 1 AND lower(e) = reverse(lower(e))"),
        by(3, "concat('Otto ', text)", "concat('ab cd ', doc_id * 1000 + 12)", "text"),
    ),
    Case(
        "keywords:start_end",
        f"coalesce(lower(({S.words('t')})[1]) = lower(({S.words('t')})[-1]), false)",
        by(3, "concat('Sun ', text, ' sun.')", "concat('Sun ', text, ' moon.')", "text"),
    ),
    Case(
        "keywords:word_count_different_numbers",
        S.relation(S.hits("t", "er", "i"), "a_relation", "a_frequency::DOUBLE"),
        args={"keyword": "'er'", "relation": RELATION, "frequency": "doc_id % 30"},
    ),
    Case("keywords:word_once", S.hits("t", "tion", "i") + " >= 1", args={"keyword": "'tion'"}),
    Case("punctuation:punctuation_dot", "strpos(t, '.') = 0", by(2, "replace(text, '.', ';')", "text")),
    Case("punctuation:punctuation_exclamation", "strpos(t, '!') = 0", by(4, "concat(text, '!')", "text")),
    Case(
        "new:copy_span_idx",
        f"lower({S.strip('t')}) = lower({S.strip('substr(a_prompt_to_repeat, a_n_start::INT + 1, a_n_end::INT - a_n_start::INT)')})",
        by(2, "substr(text, 3, 1 + doc_id % 20)", "concat(substr(text, 3, 1 + doc_id % 20), 'x')"),
        {"prompt_to_repeat": "text", "n_start": "2", "n_end": "3 + doc_id % 20"},
    ),
]

OLD_CASES = [
    Case("paragraph_count", "len(string_split(t, '* * *')) = a_N::DOUBLE",
         by(3, "concat(text, ' * * * ', text)", "concat(text, ' *** ', text)", "text"),
         {"N": "1 + doc_id % 2"}, "old"),
    Case("keyword_frequency", f"len(list_filter({S.words('t')}, lambda w: w = a_word)) = a_N::DOUBLE",
         args={"word": by(3, "'the'", "'la'", "'und'"), "N": "doc_id % 4"}, family="old"),
    Case("letter_frequency", "length(t) - length(replace(t, a_letter, '')) = a_N::DOUBLE",
         args={"letter": "'z'", "N": "doc_id % 4"}, family="old"),
    Case("word_constraint",
         f"CASE a_quantifier WHEN 'at least' THEN len({S.chunks('t')}) >= a_N::DOUBLE "
         f"WHEN 'at most' THEN len({S.chunks('t')}) <= a_N::DOUBLE "
         f"WHEN 'around' THEN len({S.chunks('t')}) BETWEEN a_N::DOUBLE * 0.9 AND a_N::DOUBLE * 1.1 END",
         args={"quantifier": QUANTIFIER, "N": "10 * (1 + doc_id % 50)"}, family="old"),
    Case("sentence_constraint",
         "CASE a_quantifier WHEN 'at least' THEN n >= a_N::DOUBLE WHEN 'at most' THEN n <= a_N::DOUBLE "
         "WHEN 'around' THEN abs(n - a_N::DOUBLE) <= 1 END",
         args={"quantifier": QUANTIFIER, "N": "1 + doc_id % 30"}, family="old"),
    Case("validate_choice", "strpos('I say yes or no', t) > 0 OR strpos('maybe', t) > 0",
         by(4, "'yes'", "'may'", "concat('yes ', doc_id)", "text"),
         {"options": """'["I say yes or no","maybe"]'"""}, "old"),
    Case("verify_keywords", "strpos(lower(t), 'en') > 0 AND strpos(lower(t), 'th') > 0",
         args={"keyword_list": """'["En","th"]'"""}, family="old"),
]
SHARED_OLD = {
    "validate_lowercase": "change_case:english_lowercase",
    "validate_uppercase": "change_case:english_capital",
    "validate_no_commas": "punctuation:no_comma",
    "validate_quotation": "startend:quotation",
    "validate_json_format": "detectable_format:json_format",
    "validate_title": "detectable_format:title",
    "validate_two_responses": "combination:two_responses",
}
_new = {c.check: c for c in NEW_CASES}
OLD_CASES += [
    Case(old, _new[new].holds, _new[new].answer, _new[new].args, "old")
    for old, new in SHARED_OLD.items()
]

# Values that a verdict reads more than once, computed beside the answer in the oracle.
STEPS = {
    "length_constraints:nth_paragraph_first_word": [
        ("p", "string_split(t, concat(chr(10), chr(10)))"),
        ("n", f"len(list_filter(p, lambda x: length({S.strip('x')}) > 0))"),
        ("w", f"({S.chunks('p[a_nth_paragraph::INT]')})[1]"),
    ],
    "detectable_format:json_format": [
        ("s", S.strip("t")),
        ("b", S.strip("CASE WHEN starts_with(s, '```json') THEN rtrim(substr(s, 8), '`') ELSE s END")),
    ],
    "combination:two_responses": [
        ("x", "string_split(t, '******')"),
        ("q", S.filled("x")),
    ],
    "copy:repeat_phrase": [("r", S.find("t", r"\balpha\b(.*?)\bdelta\b", 1))],
    "count:counting_composition": [("f", S.filled(S.paragraphs("t")))],
    "detectable_format:bigram_wrapping": [("c", S.chunks("t"))],
    "keywords:no_adjacent_consecutive": [
        ("i", f"list_transform({S.words('t')}, lambda w: unicode(lower(left(w, 1))))")
    ],
    "sentence_constraint": [
        ("n", r"len(string_split(regexp_replace(t, '([.?])" + S.WS + r"', '\1' || chr(1), 'g'), chr(1)))")
    ],
    "language:response_language": [
        ("v", f"list_transform({S.words('t')}, lambda w: lower(w))"),
        ("l", "[" + ", ".join(
            [f"{{'hits': len(list_filter(v, lambda w: w IN ({', '.join(S.quoted(x) for x in p)}))), 'language': '{code}'}}"
             for code, p in LANGUAGE_PROFILES.items()]
            + [f"{{'hits': {S.hits('t', p)}, 'language': '{code}'}}" for code, p in LANGUAGE_SCRIPTS.items()]
        ) + "]"),
    ],
}
STEPS |= {old: STEPS[new] for old, new in SHARED_OLD.items() if new in STEPS}


def _oracle(case: Case) -> str:
    args = "".join(f", CAST({e} AS VARCHAR) AS a_{n}" for n, e in case.args.items())
    layers, source = [f"d AS (SELECT doc_id, {case.answer} AS t{args}, lang FROM documents)"], "d"
    for i, (name, expression) in enumerate(STEPS.get(case.check, [])):
        layers.append(f"s{i} AS (SELECT *, {expression} AS {name} FROM {source})")
        source = f"s{i}"
    layers.append(f"v AS (SELECT doc_id, ({case.holds}) AS ok FROM {source})")
    verdict = "CASE WHEN ok IS NULL THEN 'raise' WHEN ok THEN 'true' ELSE 'false' END AS verdict"
    return f"WITH {', '.join(layers)} SELECT doc_id, {verdict} FROM v"


def _build(case: Case):
    checks = NEW_CHECKS if case.family == "new" else OLD_CHECKS

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        answers = work_table(spark, sf_dir, "documents").selectExpr(
            "doc_id", f"{case.answer} AS t", *[f"CAST({e} AS STRING) AS a_{n}" for n, e in case.args.items()]
        )
        pairs = [x for n in case.args for x in (F.lit(n), F.col(f"a_{n}"))]
        kwargs = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")
        verdict = checks[case.check](F.col("t"), Args(kwargs))
        return answers.select("doc_id", verdict.alias("ok")).select(
            "doc_id", F.coalesce(F.col("ok").cast("string"), F.lit("raise")).alias("verdict")
        )

    return build


def query_name(case: Case) -> str:
    prefix = "check_" if case.family == "new" else "check_old_"
    return prefix + case.check.replace(":", "_")


for _case in [*NEW_CASES, *OLD_CASES]:
    query(query_name(_case), _oracle(_case))(_build(_case))


# Texts with abbreviations, which the given tables lack: commas and an article become some.
SHORTENED = "replace(replace(text, ', ', ' Dr. '), ' the ', ' e.g. the ')"
_EDGES = r"""'^[(\[{"''“‘«]+|[)\]}"''”’»]+$'"""


@query(
    "sentence_model",
    rf"""WITH d AS (SELECT {SHORTENED} AS text FROM documents),
      t AS (SELECT regexp_replace(unnest({S.chunks('text')}), {_EDGES}, '', 'g') AS t FROM d),
      c AS (SELECT regexp_replace(lower(t), '\.$', '') AS word, regexp_matches(t, '[^.]\.$')::INT AS dot FROM t),
      n AS (SELECT word, sum(dot)::BIGINT AS n_dotted, (count(*) - sum(dot))::BIGINT AS n_plain FROM c WHERE regexp_matches(word, '\p{{L}}') GROUP BY 1),
      r AS (SELECT sum(n_dotted)::DOUBLE / (sum(n_dotted) + sum(n_plain)) AS rate FROM n),
      s AS (SELECT *, length(word) - length(replace(word, '.', '')) AS inner_dots, n_dotted + n_plain AS k,
        2 * ((n_dotted * ln(0.99) + n_plain * ln(1 - 0.99)) - (n_dotted * ln(rate) + n_plain * ln(1 - rate))) AS ratio FROM n, r WHERE n_dotted > 0)
      SELECT word, n_dotted, n_plain, ratio * exp(-(length(word) - inner_dots)) * (inner_dots + 1)
        * pow((length(word) - inner_dots)::DOUBLE, -n_plain) >= 0.3 AS is_abbreviation FROM s""",
)
def sentence_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word type seen with a period, and whether it is learned as an abbreviation."""
    docs = work_table(spark, sf_dir, "documents").select(F.expr(SHORTENED).alias("text"))
    scored = boundaries.abbreviations(durable(boundaries.type_counts(docs), "type-counts"))
    learned = (F.col("score") >= boundaries.ABBREVIATION).alias("is_abbreviation")
    return scored.select("word", "n_dotted", "n_plain", learned)


@query("sentences_learned")
def sentences_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document by the learned table, beside those by the rule alone."""
    docs = work_table(spark, sf_dir, "documents").select("doc_id", F.expr(SHORTENED).alias("text"))
    model = boundaries.fit_sentences(docs)
    return docs.select(
        "doc_id",
        model.count(F.col("text")).alias("n_sentences"),
        F.size(sentences(F.col("text"))).cast("long").alias("n_by_rule"),
    )
