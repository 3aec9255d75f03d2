"""SQL fragments (DuckDB) that say the same as the Column helpers, written independently of them."""

from __future__ import annotations

from posttrain_spark.functions.text import WHITESPACE

WS = f"[{WHITESPACE}]"
WORD = r"[\p{L}\p{N}_]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {quoted(WHITESPACE)})"


def find(x: str, pattern: str, group: int = 0, options: str = "") -> str:
    return f"regexp_extract_all({x}, {quoted(pattern)}, {group}, '{options}')"


def hits(x: str, pattern: str, options: str = "") -> str:
    return f"len({find(x, pattern, 0, options)})"


def words(x: str) -> str:
    return find(x, WORD)


def chunks(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {quoted(WS + '+')}), lambda c: length(c) > 0)"


def sentences(x: str) -> str:
    marked = (
        f"regexp_replace({x}, {quoted('([.!?]+[' + chr(34) + chr(39) + ')' + chr(92) + ']]*)' + WS + '+')}, "
        r"'\1' || chr(1), 'g')"
    )
    parts = f"list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')})"
    return f"list_filter({parts}, lambda s: length(s) > 0)"


def paragraphs(x: str) -> str:
    return f"regexp_split_to_array({x}, {quoted(WS + '?[*][*][*]' + WS + '?')})"


def filled(parts: str) -> str:
    """Non-blank parts, or NULL when an inner part is blank."""
    inner = f"({parts})[2:len({parts})-1]"
    return (
        f"CASE WHEN len(list_filter({inner}, lambda p: length({strip('p')}) = 0)) > 0 THEN NULL "
        f"ELSE list_filter(list_transform({parts}, lambda p: {strip('p')}), lambda p: length(p) > 0) END"
    )


def every(items: str, condition: str) -> str:
    """True when ``condition`` (on ``e``) holds for all items."""
    return f"(len(list_filter({items}, lambda e: NOT coalesce({condition}, false))) = 0)"


def some(items: str, condition: str) -> str:
    return f"(len(list_filter({items}, lambda e: coalesce({condition}, false))) > 0)"


def relation(count: str, name: str, bound: str) -> str:
    return (
        f"CASE {name} WHEN 'less than' THEN {count} < {bound} "
        f"WHEN 'at least' THEN {count} >= {bound} END"
    )


def json_ok(x: str) -> str:
    return f"json_valid({x})"


def think_stripped(x: str) -> str:
    opened = strip(f"replace({x}, '<|assistant|>', '')")
    answer = f"list_extract(string_split({opened}, '</think>'), -1)"
    return strip(f"replace(replace({answer}, '<answer>', ''), '</answer>', '')")


TOKENS = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def token_count(x: str) -> str:
    return hits(x, TOKENS)
