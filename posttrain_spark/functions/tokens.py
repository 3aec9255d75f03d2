"""Token counting (C4): a built-in counter, and any other by a function from Column to Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from posttrain_spark.functions.text import TOKEN, count_matches, find_all

Counter = str | Callable[[Column], Column]


def token_count(text: Column, counter: Counter = "regex") -> Column:
    """Tokens in ``text``.

    ``"regex"`` counts words and single punctuation marks on the JVM.  Any function from Column to
    Column may be given instead.
    """
    if callable(counter):
        return counter(text)
    if counter != "regex":
        raise ValueError(f"unknown token counter: {counter!r}")
    return F.coalesce(count_matches(text, TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    return find_all(text, TOKEN)
