"""Ground-truth labels (A7 - A9): text of either family to typed columns.

Labels are parsed once per prompt, before the join to completions.
"""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from posttrain_spark.functions.text import find_all, is_json

CONSTRAINTS = "array<struct<instruction_id:string,kwargs:map<string,string>>>"
ELEMENT = "instruction_id array<string>, kwargs array<map<string,string>>"

# A Python literal cut into quoted strings and the text between them.
# Unrolled and possessive: strings of any length are matched without recursion.
LITERAL_PIECES = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^'"]++"""
# Inside quoted strings: escapes that JSON reads differently or not at all.
PYTHON_ONLY_ESCAPE = r"""\\[^'"\\/bfnrt]"""
# Outside quoted strings: words that are JSON but not Python.
JSON_ONLY_WORD = r"\b(null|true|false|NaN|Infinity)\b"
# Arguments that the checks use as regular expressions.
PATTERN_ARGS = (
    "keyword", "keywords", "keyword1", "keyword2", "forbidden_words", "section_spliter",
    "postscript_marker",
)
PATTERN_CHARACTERS = r"[\\^$*+?{}\[\]|()]"
# Regular-expression forms that Python has and the JVM lacks or reads differently.
NOT_PORTABLE = re.compile(r"\(\?P|\(\?\(|\(\?[a-zA-Z-]*[aL]|\\[Z0U]|\[\[|&&|\[\^?\]")
# An escape, a character class, a quantifier in braces, or a brace that is literal text.
BRACES = re.compile(r"\\.|\[\^?(?:\\.|[^\]\\])*\]|\{(\d*)(?:(,)(\d*))?\}|[{}]", re.DOTALL)

SINGLE_QUOTED_JSON = {
    "allowSingleQuotes": "true",
    "allowBackslashEscapingAnyCharacter": "true",
}


def label_kind(label: Column) -> Column:
    """``old`` for a JSON object with ``func_name``, ``multi`` for everything else."""
    keys = F.json_object_keys(label)
    old = F.when(is_json(label), F.array_contains(keys, "func_name"))
    return F.when(F.coalesce(old, F.lit(False)), "old").otherwise("multi")


def parse_old_label(label: Column) -> Column:
    """Argument map of an old label; NULL unless the text is a JSON object."""
    return F.when(is_json(label), F.from_json(label, "map<string,string>"))


def _is_quoted(piece: Column) -> Column:
    return piece.rlike("^['\"]")


def _as_json(label: Column) -> Column:
    """The literal with Python's bare words replaced; quoted text is left alone."""

    def swap(piece: Column) -> Column:
        out = piece
        for python_word, json_word in (("None", "null"), ("True", "true"), ("False", "false")):
            out = F.regexp_replace(out, rf"\b{python_word}\b", json_word)
        return F.when(_is_quoted(piece), piece).otherwise(out)

    return F.array_join(F.transform(find_all(label, LITERAL_PIECES), swap), "")


def _is_plain_literal(label: Column) -> Column:
    """True when the JVM reads the label exactly as Python does."""
    odd = F.exists(
        find_all(label, LITERAL_PIECES),
        lambda p: F.when(_is_quoted(p), p.rlike(PYTHON_ONLY_ESCAPE)).otherwise(
            p.rlike(JSON_ONLY_WORD)
        ),
    )
    return ~odd


def _constraints(element: Column) -> Column:
    """Zip ids with arguments, truncated to the shorter list; NULL when either list is missing."""
    ids, kwargs = element["instruction_id"], element["kwargs"]
    n = F.least(F.size(ids), F.size(kwargs))
    zipped = F.arrays_zip(
        F.slice(ids, 1, n).alias("instruction_id"), F.slice(kwargs, 1, n).alias("kwargs")
    )
    return F.when(ids.isNotNull() & kwargs.isNotNull(), zipped.cast(CONSTRAINTS))


def _uses_patterns(constraints: Column) -> Column:
    """True when an argument used as a regular expression holds more than literal text."""
    return F.exists(
        constraints,
        lambda c: F.exists(
            F.array(*[F.try_element_at(c["kwargs"], F.lit(a)) for a in PATTERN_ARGS]),
            # Lists arrive as JSON text, so their own brackets do not count.
            lambda v: F.coalesce(
                F.regexp_replace(v, r'^\["|"\]$', "").rlike(PATTERN_CHARACTERS), F.lit(False)
            ),
        ),
    )


def portable_braces(pattern: str) -> str:
    """The pattern with braces written so that the JVM reads them as Python does.

    Python takes a brace that begins no quantifier as literal text, and ``{,n}`` as ``{0,n}``.
    """

    def one(found: re.Match) -> str:
        text = found[0]
        if text[0] in "\\[":
            return text
        if text in "{}" or text == "{}":
            return text.replace("{", "\\{").replace("}", "\\}")
        low, comma, high = found[1], found[2] or "", found[3] or ""
        if not low and not comma:
            return text.replace("{", "\\{").replace("}", "\\}")
        return f"{{{low or 0}{comma}{high}}}"

    return BRACES.sub(one, pattern)


def read_literal(label: str | None) -> str | None:
    """JSON text of element 0 of a literal label; None where reading it raises.

    Arguments that are not valid regular expressions also raise in the check itself, so a label
    holding one scores 0 as a whole and is reported as unreadable here.
    """
    if label is None:
        return None
    try:
        element = ast.literal_eval(label)[0]
        if isinstance(element, str):
            element = json.loads(element)
        pairs = list(zip(element["instruction_id"], element["kwargs"]))
        for _, args in pairs:
            for name in PATTERN_ARGS:
                value = (args or {}).get(name)
                for pattern in value if isinstance(value, list) else [value]:
                    if pattern is not None and NOT_PORTABLE.search(str(pattern)):
                        return None
                    re.compile(str(pattern))
                if isinstance(value, list):
                    args[name] = [portable_braces(v) if isinstance(v, str) else v for v in value]
                elif isinstance(value, str):
                    args[name] = portable_braces(value)
        return json.dumps(
            {"instruction_id": [k for k, _ in pairs], "kwargs": [a for _, a in pairs]}
        )
    except (ValueError, SyntaxError, TypeError, KeyError, IndexError, re.error,
            AttributeError, MemoryError, RecursionError):
        return None


@F.pandas_udf(StringType())
def _read_literals(labels: pd.Series) -> pd.Series:
    return labels.map(read_literal)


def parse_any_labels(prompts: DataFrame, label: str = "ground_truth") -> DataFrame:
    """Add ``kind``, ``constraints`` and ``old_args``: everything scoring needs of a label's text.

    Meant for the distinct prompts, before the join to completions.
    """
    parsed = parse_multi_labels(prompts, label)
    return parsed.withColumns({"kind": label_kind(F.col(label)), "old_args": parse_old_label(F.col(label))})


def parse_multi_labels(
    prompts: DataFrame, label: str = "ground_truth", output: str = "constraints"
) -> DataFrame:
    """Add the typed constraint list of a multi label; NULL where reading it raises.

    Plain literals are read on the JVM.  Only the others are sent to Python: the reader there gets
    NULL for every plain row, so no shuffle or join is needed to bring the two back together.
    """
    wrapped = F.concat(F.lit('{"v":'), _as_json(F.col(label)), F.lit("}"))
    first = F.get(F.from_json(wrapped, "v array<string>", SINGLE_QUOTED_JSON)["v"], F.lit(0))
    quick = _constraints(F.from_json(F.col("_first"), ELEMENT))
    slow = _constraints(F.from_json(F.col("_python"), ELEMENT))
    checked = F.when(~_uses_patterns(F.col("_quick")), F.col("_quick"))
    columns = prompts.columns
    return (
        prompts.select(*columns, F.when(_is_plain_literal(F.col(label)), first).alias("_first"))
        .select(*columns, quick.alias("_quick"))
        .select(*columns, checked.alias("_quick"))
        .select(
            *columns,
            "_quick",
            _read_literals(F.when(F.col("_quick").isNull(), F.col(label))).alias("_python"),
        )
        .select(*columns, F.coalesce(F.col("_quick"), slow).alias(output))
    )
