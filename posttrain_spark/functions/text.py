"""Text helpers as Column expressions.

Python's string rules are Unicode-wide while the JVM defaults are ASCII, so every
class used below is spelled out.  The same class strings are valid in Java and RE2,
which lets the SQL checks reuse them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = f"[{WHITESPACE}]"
WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
# A sentence ends at . ! or ?, optional closing quotes or brackets, then whitespace.
SENTENCE_END = "([.!?]+[\"')\\]]*)" + SPACE_CLASS + "+"
SENTENCE_MARK = "\x01"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Unicode-wide trim on both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.length(strip(text)) == 0


def find_all(text: Column, pattern: str | Column, group: int = 0) -> Column:
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.regexp_extract_all(text, pattern, F.lit(group))


def count_matches(text: Column, pattern: str | Column) -> Column:
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.regexp_count(text, pattern)


def ignoring_case(pattern: Column) -> Column:
    return F.concat(F.lit("(?iud)"), pattern)


def words(text: Column) -> Column:
    return find_all(text, WORD)


def word_count(text: Column) -> Column:
    return count_matches(text, WORD)


def chunks(text: Column) -> Column:
    """Whitespace-separated pieces, never empty."""
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda x: F.length(x) > 0)


def sentences(text: Column) -> Column:
    """Non-blank sentences, trimmed."""
    marked = F.regexp_replace(text, SENTENCE_END, "$1" + SENTENCE_MARK)
    parts = F.transform(F.split(marked, SENTENCE_MARK), strip)
    return F.filter(parts, lambda s: F.length(s) > 0)


def split_literal(text: Column, sep: str) -> Column:
    return F.split(text, r"\Q" + sep + r"\E")


def first_of(items: Column) -> Column:
    return F.get(items, F.lit(0))


def last_of(items: Column) -> Column:
    # Reversed first, so that ``items`` is evaluated once.
    return F.get(F.reverse(items), F.lit(0))


def drop_prefix(text: Column, prefix: str) -> Column:
    return F.when(
        F.startswith(text, F.lit(prefix)), F.substring(text, len(prefix) + 1, 2**31 - 1)
    ).otherwise(text)


def drop_suffix(text: Column, suffix: str) -> Column:
    return F.when(
        F.endswith(text, F.lit(suffix)),
        F.substr(text, F.lit(1), F.length(text) - len(suffix)),
    ).otherwise(text)


def strip_thinking(text: Column) -> Column:
    """The answer part of a completion: what follows the last ``</think>``, without answer tags."""
    opened = strip(F.replace(text, F.lit("<|assistant|>"), F.lit("")))
    answer = F.substring_index(opened, "</think>", -1)
    for tag in ("<answer>", "</answer>"):
        answer = F.replace(answer, F.lit(tag), F.lit(""))
    return strip(answer)


def is_json(text: Column) -> Column:
    """Strict JSON validity.

    The bare parser accepts trailing text after a value; wrapping the text in a list and in
    an object refuses that.
    """
    in_list = F.concat(F.lit("["), text, F.lit("]"))
    in_object = F.concat(F.lit('{"v":'), text, F.lit("}"))
    return (
        F.try_parse_json(in_list).isNotNull() & F.try_parse_json(in_object).isNotNull()
    )


def parent_name(path: Column) -> Column:
    """Name of the directory a file lies in; paths of files come percent-encoded."""
    name = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
