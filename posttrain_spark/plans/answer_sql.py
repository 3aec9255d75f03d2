"""SQL twins of the answer readers: normaliser, rationals and verdicts spelled out for DuckDB."""

from __future__ import annotations

from posttrain_spark.functions import answers as A
from posttrain_spark.plans import sql as S


def text(value: str) -> str:
    """A SQL literal; backslashes and line feeds stand for themselves."""
    return "'" + value.replace("'", "''") + "'"


def normal(value: str) -> str:
    """The answer normaliser."""
    out = f"list_extract(string_split({value}, '='), -1)"
    for old, new in (*A.ANSWER_REPLACEMENTS, *((word, "") for word in A.ANSWER_REMOVALS)):
        out = f"replace({out}, {text(old)}, {text(new)})"
    for pattern, replacement in A.ANSWER_PATTERNS:
        # A group is named by a backslash here, and a dollar is a dollar.
        new = replacement.replace("\\$", "@").replace("$", "\\").replace("@", "$")
        out = f"regexp_replace({out}, {text(pattern)}, {text(new)}, 'g')"
    return f"replace({out}, '$', '')"


def joined(value: str) -> str:
    """Digit groups without their commas."""
    plain = f"replace({value}, ',', '')"
    return f"CASE WHEN regexp_full_match({plain}, '[0-9]+') THEN {plain} ELSE {value} END"


def rational(x: str, side: str) -> str:
    """Columns ``n``, ``d`` and ``p`` (percent) of a text, in integers of 128 bits."""

    def group(*at: int) -> str:
        return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, {text(A.NUMBER_FORM)}, {i}), '')" for i in at) + ")"

    def digits(t: str) -> str:
        return f"replace({t}, '.', '')::HUGEINT"

    def tens(t: str) -> str:
        places = f"CASE WHEN contains({t}, '.') THEN length(list_extract(string_split({t}, '.'), -1)) ELSE 0 END"
        return f"('1' || repeat('0', {places}))::HUGEINT"

    whole, top, bottom = f"coalesce({group(2)}, '0')", group(3, 5, 7), f"coalesce({group(4, 6)}, '1')"
    below = f"{digits(bottom)} * {tens(top)}"
    ok = f"regexp_matches({x}, {text(A.NUMBER_FORM)}) AND length({whole} || {top} || {bottom}) <= {A.MOST_DIGITS}"
    sign = f"(CASE WHEN starts_with({x}, '-') THEN -1 ELSE 1 END)"
    return (
        f"CASE WHEN {ok} THEN {sign} * ({digits(whole)} * {below} + {digits(top)} * {tens(bottom)}) END AS n{side}, "
        f"CASE WHEN {ok} THEN nullif({below}, 0) END AS d{side}, coalesce({group(8)}, '') <> '' AS p{side}"
    )


def plain(x: str) -> str:
    """A decimal without zeros that do not count."""
    whole, places = f"string_split({x}, '.')[1]", f"rtrim(coalesce(string_split({x}, '.')[2], ''), '0')"
    bare = f"ltrim(ltrim({whole}, '+-'), '0')"
    value = f"(CASE WHEN {bare} = '' THEN '0' ELSE {bare} END || '.' || {places})"
    sign = f"(CASE WHEN starts_with({x}, '-') AND regexp_matches({value}, '[1-9]') THEN '-' ELSE '' END)"
    return f"CASE WHEN regexp_full_match({x}, '[-+]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)') THEN {sign} || {value} END"


def phrase(p: str) -> str:
    """The normalised answer between the closing phrases."""
    pattern = text("Final Answer: The final answer is(.*?). I hope it is correct\\.")
    whole = f"{p} || {text(A.CLOSING_PHRASE)}"
    found = S.strip(f"regexp_extract({whole}, {pattern}, 1)")
    return f"CASE WHEN regexp_matches({whole}, {pattern}) THEN {joined(normal(found))} END"


def boxed(p: str, tail: str) -> str:
    """What the last box holds, with braces three deep; ``tail`` is what follows the word."""
    inner = r"(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*"
    has = f"contains({p}, chr(92) || 'boxed')"
    return (
        f"CASE WHEN {has} AND starts_with({tail}, ' ') THEN substr(string_split({tail}, '$')[1], 2) "
        f"WHEN {has} AND regexp_matches({tail}, '^\\{{{inner}\\}}') THEN regexp_extract({tail}, '^\\{{({inner})\\}}', 1) END"
    )


def read(source: str) -> str:
    """Steps up to ``x``: key ``k``, prediction ``p``, label ``l`` and the answers read from it."""
    return f"""WITH t AS ({source}),
      r AS (SELECT *, list_extract(string_split(p, chr(92) || 'boxed'), -1) AS tail FROM t),
      x AS (SELECT k, p, l, {boxed('p', 'tail')} AS boxed, {phrase('p')} AS phrase,
        CASE WHEN len(string_split(p, '$')) > 2 THEN list_extract(string_split(p, '$'), -2) END AS quoted FROM r)"""


CANDIDATES = f"""CASE WHEN boxed IS NOT NULL OR phrase IS NOT NULL THEN list_filter([boxed, phrase], lambda v: v IS NOT NULL)
        WHEN quoted IS NOT NULL THEN [{joined(normal('quoted'))}] ELSE [{joined(normal('p'))}, p] END"""
STRICT = f"[coalesce(phrase, {joined(normal('p'))})]"


def verdict(source: str, candidates: str, key: str) -> str:
    """``score`` per key: whether any candidate equals the label, as texts or as numbers."""
    return f"""{read(source)},
      each AS (SELECT k, l, unnest({candidates}) AS c FROM x),
      raw AS (SELECT k, {normal('c')} AS a, {normal('l')} AS b FROM each),
      joined AS (SELECT k, {joined('a')} AS a, {joined('b')} AS b FROM raw),
      numbers AS (SELECT *, {rational('a', '1')}, {rational('b', '2')} FROM joined),
      judged AS (SELECT k, coalesce(a = b, false) OR coalesce(n1 * d2 = n2 * d1, false)
          OR coalesce(p1 AND NOT p2 AND n1 * d2 = 100 * n2 * d1, false)
          OR coalesce(p2 AND NOT p1 AND 100 * n1 * d2 = n2 * d1, false)
          OR coalesce({plain('a')} = {plain('b')}, false) AS hit FROM numbers)
      SELECT k AS {key}, bool_or(hit)::INT::DOUBLE AS score FROM judged GROUP BY 1"""
