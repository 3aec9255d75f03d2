"""Reward queries: labels, scoring, advantages and reward reports.

Completions are the assistant turns of ``conversations``; a conversation is a prompt and its turns
are the samples of that prompt.  Labels are built per conversation, by its id, as the literal texts
the label readers expect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from posttrain_spark.functions.tokens import token_count, tokens
from posttrain_spark.operators import labels as L
from posttrain_spark.operators import languages as N
from posttrain_spark.operators import reward as R
from posttrain_spark.operators import rollouts as G
from posttrain_spark.plans import sql as S
from posttrain_spark.plans.registry import query, table, work_table
from posttrain_spark.session import durable, scratch_path
from posttrain_spark.sources import buckets as B

# Label text of a conversation, in SQL that both engines read.  chr(39) is the single quote.
Q = "chr(39)"


def _literal(ids: list[str], kwargs: list[str]) -> str:
    """A Python-literal label as a SQL expression; ``{x}`` in kwargs is replaced by SQL ``x``."""
    id_list = ", ".join(f"'{i}'" for i in ids)
    text = f"[{{'instruction_id': [{id_list}], 'kwargs': [{', '.join(kwargs)}]}}]"
    parts = text.replace("'", "''").split("@@")
    return "concat('" + parts[0] + "'" + "".join(
        f", {p}" if i % 2 == 0 else f", '{p}'" for i, p in enumerate(parts[1:])
    ) + ")"


LABEL_CASES = {
    0: _literal(
        ["punctuation:no_comma", "length_constraints:number_words"],
        ["None", "{'num_words': @@20 + conv_id % 60@@, 'relation': 'at least'}"],
    ),
    1: _literal(
        ["keywords:frequency", "startend:end_checker", "keywords:existence"],
        ["{'keyword': 'en', 'frequency': @@1 + conv_id % 20@@, 'relation': 'at least'}",
         "{'end_phrase': '.', 'unused': None}", "{'keywords': ['th', 'e']}"],
    ),
    2: _literal(
        ["length_constraints:number_paragraphs", "keywords:letter_frequency"],
        ["{'num_paragraphs': 1}",
         "{'letter': 'e', 'let_frequency': @@conv_id % 90@@, 'let_relation': 'less than'}"],
    ),
    3: _literal(
        ["punctuation:no_comma", "length_constraints:number_words"],
        ["{}", "{'num_words': 5, 'relation': 'around'}"],
    ),
    4: _literal(
        ["punctuation:punctuation_exclamation", "punctuation:no_comma", "keywords:palindrome"],
        ["{}", "None"],
    ),
    5: _literal(["punctuation:punctuation_exclamation", "no_such:check"], ["None", "None"]),
    6: "concat('[{\"instruction_id\": [\"punctuation:no_comma\"], \"kwargs\": [null]}] ', conv_id)",
    7: "concat('[]', conv_id)",
    8: _literal([], []),
    9: "concat('[', chr(39), '{\"instruction_id\": [\"punctuation:no_comma\"], \"kwargs\": [{\"N\": null}]}', chr(39), ', ', conv_id, ']')",
}
MULTI_LABEL = "CASE conv_id % 10 " + " ".join(f"WHEN {k} THEN {v}" for k, v in LABEL_CASES.items()) + " END"

OLD_LABEL_CASES = {
    0: """concat('{"func_name": "validate_no_commas", "N": null, "id": ', conv_id, '}')""",
    1: """concat('{"func_name": "validate_word_constraint", "N": ', 10 + conv_id % 90, ', "quantifier": "at least"}')""",
    2: """concat('{"func_name": "letter_frequency", "letter": "q", "N": ', conv_id % 3, '}')""",
    3: """concat('{"func_name": "no_such_check", "N": ', conv_id, '}')""",
    4: """concat('{"name": "validate_no_commas", "N": ', conv_id, '}')""",
    5: """concat('{"func_name": "sentence_constraint", "N": ', 1 + conv_id % 9, ', "quantifier": "around"}')""",
    6: """concat('{''func_name'': ', conv_id, '}')""",
}
OLD_LABEL = "CASE conv_id % 7 " + " ".join(f"WHEN {k} THEN {v}" for k, v in OLD_LABEL_CASES.items()) + " END"
ANY_LABEL = f"CASE WHEN conv_id % 2 = 0 THEN {OLD_LABEL} ELSE {MULTI_LABEL} END"

# Completion text: some turns carry a think block, some nothing but one.
COMPLETION = (
    "CASE (conv_id + turn) % 6 WHEN 0 THEN concat('<think>', chr(10), 'a, b', chr(10), '</think> <answer>', text, '</answer>') "
    "WHEN 1 THEN CASE WHEN turn % 5 = 1 THEN '<think>only</think>' ELSE text END ELSE text END"
)


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = work_table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return turns.selectExpr("conv_id AS prompt_id", "turn", f"{COMPLETION} AS completion")


def prompts(spark: SparkSession, sf_dir: str, label: str = MULTI_LABEL) -> DataFrame:
    """One label per conversation, built once and not per completion."""
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return ids.selectExpr("conv_id AS prompt_id", f"{label} AS ground_truth")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = L.parse_multi_labels(prompts(spark, sf_dir)).drop("ground_truth")
    return R.score_multi(
        R.join_labels(rollouts(spark, sf_dir), labels, spread_by=["turn"]), scale=10.0
    )


ANSWERS = f"""answers AS (
  SELECT conv_id, turn, c, {S.think_stripped('c')} AS a,
         (length({S.strip('c')}) = 0 OR length({S.think_stripped('c')}) = 0) AS blank
  FROM (SELECT conv_id, turn, {COMPLETION} AS c FROM conversations WHERE role = 'assistant'))"""

NO_COMMA = "(strpos(a, ',') = 0)"
NO_BANG = "(strpos(a, '!') = 0)"


def _mean(*verdicts: str) -> str:
    return "(" + " + ".join(f"({v})::INT" for v in verdicts) + f") / {float(len(verdicts))}"


MULTI_SCORE = "CASE WHEN blank THEN 0.0 ELSE CASE conv_id % 10 " + " ".join(
    f"WHEN {k} THEN {v}"
    for k, v in {
        0: _mean(NO_COMMA, f"len({S.words('a')}) >= 20 + conv_id % 60"),
        1: _mean(S.hits("a", "en", "i") + " >= 1 + conv_id % 20", "suffix(lower(trim(a, '\"')), '.')",
                 "regexp_matches(a, '(?i)th') AND regexp_matches(a, '(?i)e')"),
        2: _mean(f"coalesce(len({S.filled(S.paragraphs('a'))}) = 1, false)",
                 "length(lower(a)) - length(replace(lower(a), 'e', '')) < conv_id % 90"),
        4: _mean(NO_BANG, NO_COMMA),
        9: _mean(NO_COMMA),
    }.items()
) + " ELSE 0.0 END END"
OLD_SCORE = "CASE conv_id % 7 " + " ".join(
    f"WHEN {k} THEN ({v})::INT::DOUBLE"
    for k, v in {
        0: NO_COMMA,
        1: f"len({S.chunks('a')}) >= 10 + conv_id % 90",
        2: "length(a) - length(replace(a, 'q', '')) = conv_id % 3",
        5: r"abs(len(string_split(regexp_replace(a, '([.?])" + S.WS + r"', '\1' || chr(1), 'g'), chr(1))) - (1 + conv_id % 9)) <= 1",
    }.items()
) + " ELSE 0.0 END"
SCORES = f"{ANSWERS}, scores AS (SELECT conv_id AS prompt_id, turn, 10.0 * ({MULTI_SCORE}) AS reward FROM answers)"
ERROR = (
    "CASE WHEN blank THEN 'blank' WHEN conv_id % 10 IN (6, 7) THEN 'bad_label' "
    "WHEN conv_id % 10 = 8 THEN 'no_constraints' WHEN conv_id % 10 IN (3, 5) THEN 'raised' ELSE 'none' END"
)


@query(
    "score_multi",
    f"WITH {ANSWERS} SELECT conv_id AS prompt_id, turn, round(10.0 * ({MULTI_SCORE}), 6) AS score, {ERROR} AS error FROM answers",
)
def score_multi(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "prompt_id", "turn", F.round("score", 6).alias("score"),
        F.coalesce("error", F.lit("none")).alias("error"),
    )


@query(
    "parse_multi_label",
    """SELECT DISTINCT conv_id AS prompt_id,
       (CASE conv_id % 10 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 2
          WHEN 5 THEN 2 WHEN 8 THEN 0 WHEN 9 THEN 1 ELSE -1 END)::BIGINT AS n,
       CASE conv_id % 10
         WHEN 0 THEN 'punctuation:no_comma,length_constraints:number_words'
         WHEN 1 THEN 'keywords:frequency,startend:end_checker,keywords:existence'
         WHEN 2 THEN 'length_constraints:number_paragraphs,keywords:letter_frequency'
         WHEN 3 THEN 'punctuation:no_comma,length_constraints:number_words'
         WHEN 4 THEN 'punctuation:punctuation_exclamation,punctuation:no_comma'
         WHEN 5 THEN 'punctuation:punctuation_exclamation,no_such:check'
         WHEN 8 THEN '' WHEN 9 THEN 'punctuation:no_comma' ELSE 'unreadable' END AS ids,
       CASE conv_id % 10 WHEN 0 THEN (20 + conv_id % 60)::VARCHAR WHEN 1 THEN '["th","e"]'
         WHEN 2 THEN (conv_id % 90)::VARCHAR WHEN 3 THEN 'around' ELSE 'none' END AS argument
       FROM conversations""",
)
def parse_multi_label(spark, sf_dir):
    parsed = L.parse_multi_labels(prompts(spark, sf_dir))
    c = F.col("constraints")
    last = F.try_element_at(c, F.lit(-1))["kwargs"]
    argument = F.when(
        F.col("prompt_id") % 10 == 3, F.try_element_at(last, F.lit("relation"))
    ).otherwise(
        F.coalesce(*[F.try_element_at(last, F.lit(n)) for n in ("num_words", "keywords", "let_frequency")])
    )
    return parsed.select(
        "prompt_id",
        F.coalesce(F.size(F.coalesce(c)), F.lit(-1)).cast("long").alias("n"),
        F.coalesce(F.array_join(F.col("constraints.instruction_id"), ","), F.lit("unreadable")).alias("ids"),
        F.coalesce(argument, F.lit("none")).alias("argument"),
    )


@query(
    "parse_old_label",
    """SELECT DISTINCT conv_id AS prompt_id,
       CASE conv_id % 7 WHEN 0 THEN 'validate_no_commas' WHEN 1 THEN 'validate_word_constraint'
         WHEN 2 THEN 'letter_frequency' WHEN 3 THEN 'no_such_check' WHEN 5 THEN 'sentence_constraint'
         ELSE 'none' END AS func_name,
       CASE conv_id % 7 WHEN 1 THEN 10 + conv_id % 90 WHEN 2 THEN conv_id % 3 WHEN 3 THEN conv_id
         WHEN 4 THEN conv_id WHEN 5 THEN 1 + conv_id % 9 ELSE -1 END::BIGINT AS n FROM conversations""",
)
def parse_old_label(spark, sf_dir):
    args = L.parse_old_label(F.col("ground_truth"))
    return prompts(spark, sf_dir, OLD_LABEL).select(
        "prompt_id",
        F.coalesce(args["func_name"], F.lit("none")).alias("func_name"),
        F.coalesce(args["N"].try_cast("long"), F.lit(-1)).alias("n"),
    )


@query(
    "label_kind",
    """SELECT DISTINCT conv_id AS prompt_id, CASE WHEN conv_id % 2 = 0 AND conv_id % 7 NOT IN (4, 6)
       THEN 'old' ELSE 'multi' END AS kind FROM conversations""",
)
def label_kind(spark, sf_dir):
    return prompts(spark, sf_dir, ANY_LABEL).select(
        "prompt_id", L.label_kind(F.col("ground_truth")).alias("kind")
    )


@query(
    "score_old",
    f"WITH {ANSWERS} SELECT conv_id AS prompt_id, turn, {OLD_SCORE} AS score FROM answers",
)
def score_old(spark, sf_dir):
    labels = prompts(spark, sf_dir, OLD_LABEL).select(
        "prompt_id", L.parse_old_label(F.col("ground_truth")).alias("old_args")
    )
    samples = R.join_labels(rollouts(spark, sf_dir), labels, spread_by=["turn"])
    return R.score_old(samples).select("prompt_id", "turn", "score")


@query(
    "score_unified",
    f"""WITH {ANSWERS} SELECT conv_id AS prompt_id, turn, round(10.0 * CASE
          WHEN conv_id % 2 = 0 AND conv_id % 7 NOT IN (4, 6) THEN {OLD_SCORE}
          WHEN conv_id % 2 = 0 THEN 0.0 ELSE {MULTI_SCORE} END, 6) AS score FROM answers""",
)
def score_unified(spark, sf_dir):
    labels = L.parse_any_labels(prompts(spark, sf_dir, ANY_LABEL)).drop("ground_truth")
    samples = R.join_labels(rollouts(spark, sf_dir), labels, spread_by=["turn"])
    return R.score_unified(samples).select("prompt_id", "turn", F.round("score", 6).alias("score"))


# Documents that the language model does not learn from.
HELD_OUT = "substring(md5(CAST(doc_id AS STRING)), 1, 1) IN ('0', '1', '2')"
WANTED = "CASE WHEN doc_id % 3 = 0 THEN 'en' WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END"

_LETTERS = r"(' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}]+', ' ', 'g')) || ' ')"
_CODES = f"list_transform(string_split({_LETTERS}, ''), lambda c: ord(c))"
_BUCKET = "list_transform(list_zip(c, c[2:], c[3:], true), lambda x: (x[1] * 961 + x[2] * 31 + x[3]) % 4096)"


@query(
    "language_model",
    f"""WITH d AS (SELECT doc_id, lang, {HELD_OUT} AS held_out, {WANTED} AS wanted, {_CODES} AS c FROM documents),
      g AS (SELECT doc_id, lang, held_out, b, count(*) AS n
            FROM (SELECT doc_id, lang, held_out, unnest({_BUCKET}) AS b FROM d) GROUP BY ALL),
      c AS (SELECT lang, b, sum(n) AS n FROM g WHERE NOT held_out AND lang IS NOT NULL GROUP BY 1, 2),
      t AS (SELECT lang, ln(sum(n) + 4096) AS total FROM c GROUP BY 1),
      w AS (SELECT t.lang, b, floor(1000 * (ln(coalesce(c.n, 0) + 1) - total) + 0.5)::BIGINT AS w
            FROM t CROSS JOIN (SELECT range AS b FROM range(4096)) LEFT JOIN c USING (lang, b)),
      s AS (SELECT doc_id, w.lang, sum(n * w) AS score FROM g JOIN w USING (b) GROUP BY 1, 2),
      p AS (SELECT doc_id, arg_max(lang, (score, lang)) AS predicted FROM s GROUP BY 1)
      SELECT doc_id, held_out, predicted, CASE WHEN wanted IN (SELECT lang FROM t) THEN coalesce(predicted = wanted, true) END AS follows
      FROM d LEFT JOIN p USING (doc_id)""",
)
def language_model(spark, sf_dir):
    """Each document's language by a model of the others, and whether it is the wanted one."""
    docs = work_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = N.fit_languages(docs.filter(f"NOT {HELD_OUT}"))
    guessed = docs.select(
        "doc_id", F.expr(HELD_OUT).alias("held_out"), model.predict_batches(F.col("text")).alias("predicted"),
        F.expr(WANTED).alias("wanted"),
    )
    follows = model.agrees(F.col("predicted"), F.col("wanted")).alias("follows")
    return guessed.select("doc_id", "held_out", "predicted", follows)


def stored_samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, B.ScoringTables]:
    """Completions and labels of both families, written as bucketed tables and joined from there."""
    labels = L.parse_any_labels(prompts(spark, sf_dir, ANY_LABEL)).drop("ground_truth")
    path = scratch_path(spark, "scoring")
    name = "scoring_" + path.rpartition("-")[2]
    tables = B.write_scoring_tables(rollouts(spark, sf_dir), labels, name, path, spread_by=["turn"])
    return B.read_scoring_tables(spark, tables), tables


@query(
    "score_stored",
    f"""WITH {ANSWERS} SELECT conv_id AS prompt_id, turn, round(10.0 * CASE
          WHEN conv_id % 2 = 0 AND conv_id % 7 NOT IN (4, 6) THEN {OLD_SCORE}
          WHEN conv_id % 2 = 0 THEN 0.0 ELSE {MULTI_SCORE} END, 6) AS score FROM answers""",
)
def score_stored(spark, sf_dir):
    samples, _ = stored_samples(spark, sf_dir)
    return R.score_unified(samples).select("prompt_id", "turn", F.round("score", 6).alias("score"))


@query(
    "strip_thinking",
    f"""WITH {ANSWERS} SELECT conv_id, turn, md5(a) AS answer_md5, length(a) AS n_chars, blank FROM answers""",
)
def strip_thinking(spark, sf_dir):
    answer = R.strip_thinking(F.col("completion"))
    return rollouts(spark, sf_dir).select(
        F.col("prompt_id").alias("conv_id"), "turn", F.md5(answer).alias("answer_md5"),
        F.length(answer).cast("long").alias("n_chars"),
        (R.is_blank(F.col("completion")) | R.is_blank(answer)).alias("blank"),
    )


@query(
    "combine_rewards",
    f"""SELECT doc_id, (strpos(text, ',') = 0)::INT::DOUBLE AS no_comma, least({S.token_count('text')}, 512) / 512.0::DOUBLE AS length,
        round((strpos(text, ',') = 0)::INT + 0.5 * least({S.token_count('text')}, 512) / 512.0::DOUBLE, 6) AS reward FROM documents""",
)
def combine_rewards(spark, sf_dir):
    text = F.col("text")
    rewards = {
        "no_comma": ~F.contains(text, F.lit(",")),
        "length": F.least(token_count(text), F.lit(512)) / 512,
    }
    df = R.combine_rewards(work_table(spark, sf_dir, "documents"), rewards, {"length": 0.5})
    return df.select("doc_id", "no_comma", "length", F.round("reward", 6).alias("reward"))


# --- comparison of the two families -----------------------------------------------------------

DIFF_NAME = (
    "CASE doc_id % 6 WHEN 0 THEN 'paragraph_count' WHEN 1 THEN 'keyword_frequency' "
    "WHEN 2 THEN 'letter_frequency' WHEN 3 THEN 'word_constraint' WHEN 4 THEN 'sentence_constraint' "
    "ELSE 'validate_no_commas' END"
)
DIFF_QUANTIFIER = "CASE WHEN doc_id % 4 < 2 THEN 'at least' WHEN doc_id % 4 = 2 THEN 'around' ELSE 'at most' END"
DIFF_TEXT = "CASE WHEN doc_id % 18 = 0 THEN concat(text, ' * * * ', text) WHEN doc_id % 18 = 6 THEN concat(text, ' *** ', text) ELSE text END"


@query(
    "verifier_diff",
    f"""WITH d AS (SELECT {DIFF_NAME} AS func_name, {DIFF_QUANTIFIER} AS quantifier, 1 + doc_id % 9 AS n,
                 {S.strip(DIFF_TEXT)} AS t FROM documents),
    c AS (SELECT *, len(string_split(t, '* * *')) AS old_p, coalesce(len({S.filled(S.paragraphs('t'))}) = 2, false) AS new_p,
            len(list_filter({S.words('t')}, lambda w: w = 'the')) AS old_k, {S.hits('t', 'the', 'i')} AS new_k,
            length(t) - length(replace(t, 'e', '')) AS old_l, length(t) - length(replace(lower(t), 'e', '')) AS new_l,
            len({S.chunks('t')}) AS old_w, len({S.words('t')}) AS new_w,
            len(string_split(regexp_replace(t, '([.?]){S.WS}', '\\1' || chr(1), 'g'), chr(1))) AS old_s,
            len({S.sentences('t')}) AS new_s FROM d),
    v AS (SELECT func_name,
      CASE func_name WHEN 'paragraph_count' THEN old_p = 2 WHEN 'keyword_frequency' THEN old_k = n
        WHEN 'letter_frequency' THEN old_l = n WHEN 'validate_no_commas' THEN strpos(t, ',') = 0
        WHEN 'word_constraint' THEN CASE quantifier WHEN 'at least' THEN old_w >= 20 * n WHEN 'at most' THEN old_w <= 20 * n
          ELSE old_w BETWEEN 20 * n * 0.9 AND 20 * n * 1.1 END
        ELSE CASE quantifier WHEN 'at least' THEN old_s >= 20 * n WHEN 'at most' THEN old_s <= 20 * n ELSE abs(old_s - 20 * n) <= 1 END END AS o,
      CASE func_name WHEN 'paragraph_count' THEN new_p WHEN 'keyword_frequency' THEN new_k >= n
        WHEN 'letter_frequency' THEN new_l >= n WHEN 'validate_no_commas' THEN strpos(t, ',') = 0
        WHEN 'word_constraint' THEN CASE quantifier WHEN 'at least' THEN new_w >= 20 * n END
        ELSE CASE quantifier WHEN 'at least' THEN new_s >= 20 * n END END AS w FROM c)
    SELECT func_name, count(*) AS n, count(*) FILTER (o) AS old_passed, count(*) FILTER (w) AS new_passed,
      count(*) FILTER (w IS NULL) AS new_raised, count(*) FILTER (o IS DISTINCT FROM w) AS differ FROM v GROUP BY 1""",
)
def verifier_diff(spark, sf_dir):
    docs = work_table(spark, sf_dir, "documents").selectExpr(
        f"{DIFF_TEXT} AS completion", f"{DIFF_NAME} AS func_name", f"{DIFF_QUANTIFIER} AS quantifier",
        "CAST(1 + doc_id % 9 AS STRING) AS n", "CAST(20 * (1 + doc_id % 9) AS STRING) AS bound",
    )
    samples = docs.selectExpr(
        "completion", "func_name",
        """map('word', 'the', 'letter', 'e', 'quantifier', quantifier, 'N', CASE func_name
             WHEN 'paragraph_count' THEN '2' WHEN 'word_constraint' THEN bound
             WHEN 'sentence_constraint' THEN bound ELSE n END) AS old_kwargs""",
        """map('keyword', 'the', 'frequency', n, 'letter', 'e', 'let_frequency', n, 'let_relation', 'at least',
             'relation', CASE func_name WHEN 'keyword_frequency' THEN 'at least' ELSE quantifier END,
             'num_words', bound, 'num_sentences', bound, 'num_paragraphs', '2') AS new_kwargs""",
    )
    return R.verifier_diff(samples)


@query(
    "filter_incompatible",
    f"""SELECT doc_id, {DIFF_NAME} AS func_name, {DIFF_QUANTIFIER} AS quantifier FROM documents
        WHERE NOT ({DIFF_NAME} IN ('word_constraint', 'sentence_constraint') AND {DIFF_QUANTIFIER} IN ('around', 'at most'))""",
)
def filter_incompatible(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"{DIFF_NAME} AS func_name", f"{DIFF_QUANTIFIER} AS quantifier"
    )
    return R.drop_incompatible(docs)


# --- group statistics -------------------------------------------------------------------------

def stored_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards written once: completions are scored one time, the two passes read the numbers."""
    rewards = scored(spark, sf_dir).select("prompt_id", "turn", F.col("score").alias("reward"))
    return durable(rewards, "rewards")


GROUPED = f"""{SCORES}, g AS (SELECT prompt_id, avg(reward) AS m, coalesce(stddev_samp(reward), 0) AS s
    FROM scores GROUP BY 1)"""


@query(
    "advantages",
    f"""WITH {GROUPED} SELECT prompt_id, turn, round(reward, 6) AS reward,
        round((reward - m) / (s + 1e-4), 6) + 0.0 AS advantage FROM scores JOIN g USING (prompt_id)""",
)
def advantages(spark, sf_dir):
    rewards = stored_rewards(spark, sf_dir)
    return G.advantages(rewards, spread_by=["turn"]).select(
        "prompt_id", "turn", F.round("reward", 6).alias("reward"),
        (F.round("advantage", 6) + 0.0).alias("advantage"),
    )


@query(
    "advantage_scale_check",
    f"""WITH {GROUPED} SELECT prompt_id, turn, round((reward - m) / (s + 1e-4), 6) + 0.0 AS advantage,
        round((10 * reward - 10 * m) / (10 * s + 1e-4), 6) + 0.0 AS scaled_advantage
        FROM scores JOIN g USING (prompt_id)""",
)
def advantage_scale_check(spark, sf_dir):
    rewards = stored_rewards(spark, sf_dir)
    return G.scale_check(rewards, spread_by=["turn"]).select(
        "prompt_id", "turn", (F.round("advantage", 6) + 0.0).alias("advantage"),
        (F.round("scaled_advantage", 6) + 0.0).alias("scaled_advantage"),
    )


@query(
    "clipped_ratio",
    f"""SELECT source, round(avg(CASE WHEN {S.token_count('text')} >= 256 THEN 1.0 ELSE 0.0 END), 6) AS clipped_ratio
        FROM documents GROUP BY 1""",
)
def clipped_ratio(spark, sf_dir):
    docs = work_table(spark, sf_dir, "documents").select("source", token_count(F.col("text")).alias("n_tokens"))
    return G.clipped_ratio(docs, 256, by="source").select("source", F.round("clipped_ratio", 6).alias("clipped_ratio"))


@query(
    "mask_after_eos",
    f"""WITH d AS (SELECT doc_id, {S.find('text', S.TOKENS)} AS k FROM documents)
        SELECT doc_id, len(k) AS n_tokens, CASE WHEN list_position(k, '.') > 0 THEN list_position(k, '.')
        ELSE len(k) END::BIGINT AS n_kept FROM d""",
)
def mask_after_eos(spark, sf_dir):
    docs = work_table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("tokens"))
    kept = G.mask_after_eos(F.col("tokens"), ".")
    return docs.select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.size(kept).cast("long").alias("n_kept")
    )


@query(
    "constraint_rates",
    f"""WITH {ANSWERS}, v AS (
          SELECT conv_id, 'c' || (turn % 3) AS source, x.id AS instruction_id, x.ok AS ok FROM (SELECT *, unnest(CASE conv_id % 10
            WHEN 0 THEN [{{'id': 'punctuation:no_comma', 'ok': {NO_COMMA}}},
                         {{'id': 'length_constraints:number_words', 'ok': len({S.words('a')}) >= 20 + conv_id % 60}}]
            WHEN 1 THEN [{{'id': 'keywords:frequency', 'ok': {S.hits('a', 'en', 'i')} >= 1 + conv_id % 20}},
                         {{'id': 'startend:end_checker', 'ok': suffix(lower(trim(a, '"')), '.')}},
                         {{'id': 'keywords:existence', 'ok': regexp_matches(a, '(?i)th') AND regexp_matches(a, '(?i)e')}}]
            WHEN 2 THEN [{{'id': 'length_constraints:number_paragraphs', 'ok': coalesce(len({S.filled(S.paragraphs('a'))}) = 1, false)}},
                         {{'id': 'keywords:letter_frequency', 'ok': length(lower(a)) - length(replace(lower(a), 'e', '')) < conv_id % 90}}]
            WHEN 3 THEN [{{'id': 'punctuation:no_comma', 'ok': {NO_COMMA}}}, {{'id': 'length_constraints:number_words', 'ok': false}}]
            WHEN 4 THEN [{{'id': 'punctuation:punctuation_exclamation', 'ok': {NO_BANG}}}, {{'id': 'punctuation:no_comma', 'ok': {NO_COMMA}}}]
            WHEN 5 THEN [{{'id': 'punctuation:punctuation_exclamation', 'ok': {NO_BANG}}}, {{'id': 'no_such:check', 'ok': false}}]
            WHEN 9 THEN [{{'id': 'punctuation:no_comma', 'ok': {NO_COMMA}}}] ELSE [] END) AS x FROM answers))
        SELECT coalesce(source, 'all') AS source, coalesce(instruction_id, 'all') AS instruction_id, count(*) AS n,
          round(avg(ok::INT), 6) AS rate FROM v GROUP BY ROLLUP (source, instruction_id)""",
)
def constraint_rates(spark, sf_dir):
    samples = scored(spark, sf_dir).withColumn("source", F.concat(F.lit("c"), F.col("turn") % 3))
    rates = G.constraint_rates(R.verdict_rows(samples))
    return rates.select(
        F.coalesce("source", F.lit("all")).alias("source"),
        F.coalesce("instruction_id", F.lit("all")).alias("instruction_id"),
        "n", F.round("rate", 6).alias("rate"),
    )


REWARD_LOG = f"""WITH {SCORES} SELECT (prompt_id // 16)::BIGINT AS step, round(avg(reward), 6) AS reward_mean,
    round(coalesce(stddev_samp(reward), 0), 6) AS reward_std, round(min(reward), 6) AS reward_min,
    round(max(reward), 6) AS reward_max FROM scores GROUP BY 1"""


def reward_log_frame(spark, sf_dir) -> DataFrame:
    rewards = scored(spark, sf_dir).select(
        F.floor(F.col("prompt_id") / 16).alias("step"), F.col("score").alias("reward")
    )
    log = G.reward_log(rewards)
    return log.select("step", *[F.round(c, 6).alias(c) for c in log.columns if c != "step"])


query("reward_log", REWARD_LOG)(reward_log_frame)
