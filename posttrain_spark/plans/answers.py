"""Number, math and code answer queries.

Predictions and labels are sentences made from ``orders`` and ``lineitem`` figures; code test
results come from ``events``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from posttrain_spark.functions import answers as A
from posttrain_spark.operators.reward import code_pass_rate
from posttrain_spark.plans import answer_sql as Q
from posttrain_spark.plans import sql as S
from posttrain_spark.plans.registry import query, table, work_table

K = "o_orderkey"
CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"

NUMBER_TEXT = f"""CASE {K} % 6
  WHEN 0 THEN concat('The total is ', CAST({K} AS STRING), ',', CAST(100 + {K} % 900 AS STRING), ' dollars')
  WHEN 1 THEN concat('First ', CAST({K} % 7 AS STRING), ' then -', CAST({CENTS} AS STRING))
  WHEN 2 THEN concat('x=.', CAST(10 + {K} % 90 AS STRING))
  WHEN 3 THEN concat('about -', CAST({K} AS STRING), '.5 in all')
  WHEN 4 THEN 'No Answer'
  ELSE concat('1,2,', CAST({K} % 10 AS STRING)) END"""
NUMBER_LABEL = f"""CASE {K} % 6
  WHEN 0 THEN concat(CAST({K} AS STRING), CAST(100 + {K} % 900 AS STRING))
  WHEN 1 THEN CAST({CENTS} + {K} % 2 AS STRING)
  WHEN 2 THEN concat('.', CAST(10 + {K} % 90 AS STRING))
  WHEN 3 THEN concat('-', CAST({K} AS STRING), '.5')
  WHEN 4 THEN 'no answer'
  ELSE CAST({K} % 9 AS STRING) END"""


@query(
    "gsm8k",
    rf"""WITH d AS (SELECT {K}, {NUMBER_TEXT} AS p, {NUMBER_LABEL} AS l FROM orders),
      j AS (SELECT *, regexp_replace(p, '(\d),(\d)', '\1\2', 'g') AS r FROM d),
      x AS (SELECT *, coalesce(list_extract(regexp_extract_all(r, '[-+]?\d*\.\d+|\d+'), -1), r) AS e FROM j)
      SELECT {K}, e AS extracted, (lower(e) = lower(l))::INT::DOUBLE AS score FROM x""",
)
def gsm8k(spark, sf_dir):
    d = work_table(spark, sf_dir, "orders").selectExpr(K, f"{NUMBER_TEXT} AS p", f"{NUMBER_LABEL} AS l")
    return d.select(
        K, A.last_number(F.col("p")).alias("extracted"),
        A.check_gsm8k(F.col("p"), F.col("l")).alias("score"),
    )


# chr(92) is the backslash, which the two engines read differently inside a literal.
B = "chr(92)"
MATH_TEXT = f"""CASE {K} % 13
  WHEN 0 THEN concat('So ', {B}, 'boxed{{1}} and at last ', {B}, 'boxed{{', {B}, 'frac{{', CAST({K} % 50 AS STRING), '}}{{4}}}} done')
  WHEN 1 THEN concat('Final Answer: The final answer is ', CAST({K} AS STRING), ',', CAST(100 + {K} % 900 AS STRING), ' units. I hope it is correct.')
  WHEN 2 THEN concat('We get $y = 2$ and then $x = ', CAST({K} % 40 AS STRING), '$')
  WHEN 3 THEN CAST({K} AS STRING)
  WHEN 4 THEN concat({B}, 'boxed{{', {B}, 'text{{', CAST({K} AS STRING), '}} cm}}')
  WHEN 5 THEN concat({B}, 'boxed{{', CAST({K} AS STRING))
  WHEN 6 THEN concat('The answer is a ', CAST({K} AS STRING), ' dollars')
  WHEN 7 THEN concat({B}, 'boxed{{', CAST({K} % 50 AS STRING), '%}}')
  WHEN 8 THEN concat({B}, 'boxed{{', CAST(1 + {K} % 9 AS STRING), {B}, 'frac{{1}}{{', CAST(2 + {K} % 3 AS STRING), '}}}}')
  WHEN 9 THEN concat({B}, 'boxed{{0.', CAST({K} AS STRING), '00000000000000005551115123}}')
  WHEN 10 THEN concat({B}, 'boxed{{', {B}, 'frac{{', CAST({K} AS STRING), '}}{{3}}}}')
  WHEN 11 THEN concat('So $', CAST({K} AS STRING), '/', CAST({K} % 5 AS STRING), '$')
  ELSE concat({B}, 'boxed{{0.', CAST(10 + {K} % 90 AS STRING), '}}') END"""
MATH_LABEL = f"""CASE {K} % 13
  WHEN 0 THEN concat(CAST({K} % 50 AS STRING), '/4')
  WHEN 1 THEN concat(CAST({K} AS STRING), CAST(100 + {K} % 900 AS STRING))
  WHEN 2 THEN CAST({K} % 20 AS STRING)
  WHEN 3 THEN concat(CAST({K} AS STRING), '.0')
  WHEN 4 THEN concat(CAST({K} AS STRING), CASE WHEN {K} % 3 = 0 THEN ' cm' ELSE '1' END)
  WHEN 5 THEN CAST({K} AS STRING)
  WHEN 6 THEN concat('Theansweris', CAST({K} AS STRING))
  WHEN 7 THEN CASE {K} % 3 WHEN 0 THEN CAST({K} % 50 AS STRING) WHEN 1 THEN concat(CAST({K} % 50 AS STRING), '/100') ELSE '7.5' END
  WHEN 8 THEN CASE {K} % 2 WHEN 0 THEN concat(CAST(1 + {K} % 9 AS STRING), '.5') ELSE concat(CAST(3 + 2 * ({K} % 9) AS STRING), '/2') END
  WHEN 9 THEN concat('.', CAST({K} AS STRING), CASE WHEN {K} % 2 = 0 THEN '' ELSE '000000000000000055511151230' END)
  WHEN 10 THEN concat('0', CAST({K} AS STRING), '/3', CASE WHEN {K} % 2 = 0 THEN '.00' ELSE '1' END)
  WHEN 11 THEN CAST({K} AS STRING)
  ELSE concat('.', CAST(10 + {K} % 90 AS STRING), '0') END"""
MATH_SOURCE = f"SELECT {K} AS k, {MATH_TEXT} AS p, {MATH_LABEL} AS l FROM orders"


def _math(spark, sf_dir):
    return work_table(spark, sf_dir, "orders").selectExpr(K, f"{MATH_TEXT} AS p", f"{MATH_LABEL} AS l")


@query(
    "last_boxed",
    rf"""WITH d AS (SELECT {K}, {MATH_TEXT} AS p FROM orders),
      t AS (SELECT *, list_extract(string_split(p, {B} || 'boxed'), -1) AS tail, contains(p, {B} || 'boxed') AS has FROM d)
      SELECT {K}, coalesce(CASE WHEN has AND regexp_matches(tail, '^\{{([^{{}}]|\{{([^{{}}]|\{{[^{{}}]*\}})*\}})*\}}')
        THEN regexp_extract(tail, '^\{{((?:[^{{}}]|\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})*)\}}', 1) END, 'none') AS boxed FROM t""",
)
def last_boxed(spark, sf_dir):
    d = _math(spark, sf_dir)
    return d.select(K, F.coalesce(A.last_boxed(F.col("p")), F.lit("none")).alias("boxed"))


@query("math", Q.verdict(MATH_SOURCE, Q.CANDIDATES, K))
def math(spark, sf_dir):
    d = _math(spark, sf_dir)
    return d.select(K, A.check_math(F.col("p"), F.col("l")).alias("score"))


@query("math_strict", Q.verdict(MATH_SOURCE, Q.STRICT, K))
def math_strict(spark, sf_dir):
    d = _math(spark, sf_dir)
    return d.select(K, A.check_math_strict(F.col("p"), F.col("l")).alias("score"))


@query(
    "normalize_answer",
    f"{Q.read(MATH_SOURCE)} SELECT k AS {K}, coalesce(phrase, {Q.joined(Q.normal('p'))}) AS normal FROM x",
)
def normalize_answer(spark, sf_dir):
    d = _math(spark, sf_dir)
    found = F.coalesce(A.final_phrase(F.col("p")), A.normalize_answer(F.col("p")))
    return d.select(K, found.alias("normal"))


@query(
    "between_dollars",
    f"""WITH d AS (SELECT {K}, {MATH_TEXT} AS p FROM orders) SELECT {K}, CASE WHEN len(string_split(p, '$')) > 2
        THEN list_extract(string_split(p, '$'), -2) ELSE 'none' END AS quoted FROM d""",
)
def between_dollars(spark, sf_dir):
    d = _math(spark, sf_dir)
    return d.select(
        K, F.coalesce(A.between_last_dollars(F.col("p")), F.lit("none")).alias("quoted")
    )


CODE_TEXT = """CASE doc_id % 4
  WHEN 0 THEN concat('Try:', chr(10), '```python', chr(10), 'x = ', doc_id, chr(10), '```', chr(10), text)
  WHEN 1 THEN concat('```', chr(10), 'a', chr(10), '```', text, '```python', chr(10), text, '```')
  WHEN 2 THEN concat('```python ', text) ELSE text END"""


@query(
    "code_block",
    rf"""WITH d AS (SELECT doc_id, {CODE_TEXT} AS t FROM documents),
      x AS (SELECT doc_id, t, list_extract(regexp_extract_all(t, '(?s)```(?:python)?(.*?)```', 1), -1) AS c FROM d)
      SELECT doc_id, md5(coalesce({S.strip('c')}, t)) AS code_md5 FROM x""",
)
def code_block(spark, sf_dir):
    d = work_table(spark, sf_dir, "documents").selectExpr("doc_id", f"{CODE_TEXT} AS t")
    return d.select("doc_id", F.md5(A.last_code_block(F.col("t"))).alias("code_md5"))


@query(
    "code_pass_rate",
    """WITH r AS (SELECT user_id, avg((value > 5)::INT) AS rate FROM events GROUP BY 1)
       SELECT user_id AS sample_id, round(CASE WHEN rate < 0.5 THEN 0 ELSE rate END, 6) AS pass_rate FROM r""",
)
def code_pass_rates(spark, sf_dir):
    results = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sample_id"), (F.col("value") > 5).alias("passed")
    )
    rates = code_pass_rate(results, threshold=0.5)
    return rates.select("sample_id", F.round("pass_rate", 6).alias("pass_rate"))
