"""Sentence boundaries learned from unlabelled texts, for the sentence checks.

Abbreviations are word types that come with a period far more often than chance (a log-likelihood ratio,
damped by their length and by every occurrence without the period); sentence starters are types that
follow the other periods far more often than chance.  All given texts are read once, in Spark, for counts of
distinct tokens; what a token says is worked out once per distinct token, and all types over the
thresholds, only these, reach the driver.  A period after an abbreviation ends no sentence
unless a starter in upper case follows.  Applying the model is an expression: no shuffle, no Python.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F

from posttrain_spark.functions.text import let, sentences
from posttrain_spark.operators.constraints import NEW_CHECKS, OLD_CHECKS, Verdict
from posttrain_spark.session import durable

# Published thresholds of the method: abbreviations, sentence starters, and how sure a period is to follow
# an abbreviation.
ABBREVIATION, STARTER, SURE = 0.3, 30.0, 0.99

# The characters of WHITESPACE as ranges: a quarter of the comparisons for each character of a text.
SPACES = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
# A token whose period is its last character.
DOTTED = r"[^.]\.$"

# Stands for the period of an abbreviation while a text is cut; it is in no word and ends no sentence.
HELD = "\ue000"

SENTENCE_CHECKS = (
    "length_constraints:number_sentences", "detectable_format:sentence_hyphens", "first_word:first_word_sent",
    "last_word:last_word_sent",
)
OLD_SENTENCE_CHECKS = ("sentence_constraint",)


def _pieces(docs: DataFrame, text: str) -> DataFrame:
    """``ts``, the whitespace-separated pieces of every text; the first and the last may be empty."""
    return docs.select(F.split(F.coalesce(F.col(text), F.lit("")), SPACES).alias("ts"))


def _clean(piece: Column) -> Column:
    """The token without brackets and quotes around it."""
    return F.regexp_replace(piece, r"^[(\[{\"'“‘«]+|[)\]}\"'”’»]+$", "")


def _bare(token: Column) -> Column:
    """The type of a token: lower case, without a period at its end."""
    return F.regexp_replace(F.lower(token), r"\.$", "")


def _among(word: Column, words: Sequence[str]) -> Column:
    """``word.isin(*words)``, the words sent to the JVM as one string: a call for each takes minutes where there are many."""
    jvm = SparkContext._active_spark_context._jvm
    kind = jvm.java.lang.Class.forName("java.util.ArrayList")
    return Column(word._jc.isInCollection(jvm.com.fasterxml.jackson.databind.ObjectMapper().readValue(json.dumps(words), kind)))


def _surprise(k: Column, n: Column, p: Column, q: Column) -> Column:
    """Twice the log ratio of seeing ``k`` of ``n`` at rate ``q`` and at rate ``p``; rates are between 0 and 1."""

    def log(rate: Column) -> Column:
        return k * F.log(rate) + (n - k) * F.log(1 - rate)

    return 2 * (log(q) - log(p))


def token_pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences ``n`` of every ``token`` as it stands, by the token ``before`` it where that one has a
    period (else NULL)."""
    both = F.arrays_zip(F.concat(F.array(F.lit("")), F.col("ts")).alias("before"), F.col("ts").alias("token"))
    found = _pieces(docs, text).select(F.inline(both)).filter("token <> ''")
    before = F.when(F.contains("before", F.lit(".")), F.col("before")).alias("before")
    return found.groupBy(before, "token").agg(F.count("*").alias("n"))


def _types(tokens: DataFrame) -> DataFrame:
    t = tokens.select(_clean(F.col("token")).alias("t"), "n")
    dotted = F.when(F.col("t").rlike(DOTTED), F.col("n")).otherwise(F.lit(0))
    return (
        t.select(_bare(F.col("t")).alias("word"), dotted.alias("dot"), "n")
        .filter(F.col("word").rlike(r"\p{L}"))
        .groupBy("word")
        .agg(F.sum("dot").alias("n_dotted"), (F.sum("n") - F.sum("dot")).alias("n_plain"))
    )


def type_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Types with a letter: ``word``, ``n_dotted`` and ``n_plain``, occurrences with and without a period."""
    token = _pieces(docs, text).select(F.explode("ts").alias("token")).filter("token <> ''")
    return _types(token.groupBy("token").agg(F.count("*").alias("n")))


def abbreviations(counts: DataFrame) -> DataFrame:
    """``counts`` of types seen with a period, with their ``score`` as abbreviations."""
    total = counts.agg(F.sum("n_dotted").alias("d"), F.sum("n_plain").alias("p")).first()
    n, d = (total["d"] or 0) + (total["p"] or 0), total["d"] or 0
    rate = min(max(d / n, 1e-9), 1 - 1e-9) if n else 0.5
    k, count = F.col("n_dotted").cast("double"), (F.col("n_dotted") + F.col("n_plain")).cast("double")
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    size = (F.length("word") - inner).cast("double")
    ratio = _surprise(k, count, F.lit(rate), F.lit(SURE))
    score = ratio * F.exp(-size) * (inner + 1) * F.pow(size, -F.col("n_plain").cast("double"))
    return counts.filter("n_dotted > 0").withColumn("score", score)


@dataclass(frozen=True)
class SentenceModel:
    """Lower-case abbreviations (without their last period) and sentence starters."""

    abbreviations: tuple[str, ...]
    starters: tuple[str, ...]

    def hold(self, text: Column) -> Column:
        """The text with the periods that end no sentence replaced by HELD."""
        if not self.abbreviations:
            return text

        def held(pieces: Column) -> Column:
            def one(piece: Column, i: Column) -> Column:
                # Turned round, the last token is found at once.
                token = F.reverse(F.regexp_extract(F.reverse(piece), r"^(\S+)", 1))
                last = _bare(F.regexp_replace(token, r"^[(\[{\"'“‘«]+", ""))
                after = F.regexp_extract(F.get(pieces, i + 1), r"^\s+[(\[{\"'“‘«]*(\S+)", 1)
                first = F.regexp_replace(F.lower(after), r"[^\p{L}\p{M}\p{N}]+$", "")
                starts = after.rlike(r"^\p{Lu}") & _among(first, self.starters) if self.starters else F.lit(False)
                short = _among(last, self.abbreviations) & ~F.coalesce(starts, F.lit(False))
                return F.when(short, F.regexp_replace(piece, r"\.$", HELD)).otherwise(piece)

            return F.array_join(F.transform(pieces, one), "")

        # Cut behind every period before white space: the last token of a piece is a candidate.
        return let(F.split(text, r"(?=\s)(?<=[^.\s]\.)"), held)

    def sentences(self, text: Column) -> Column:
        """Non-blank sentences, trimmed, as they stand in the text."""
        return F.transform(sentences(self.hold(text)), lambda s: F.replace(s, F.lit(HELD), F.lit(".")))

    def count(self, text: Column) -> Column:
        """Number of ``sentences``."""
        return F.size(sentences(self.hold(text))).cast("long")

    def _with(self, builder: Verdict) -> Verdict:
        return lambda text, args: builder(self.hold(text), args)

    def checks(self) -> dict[str, Verdict]:
        """All new checks, those on sentences by this model; for ``score_multi(..., checks=...)``."""
        return {**NEW_CHECKS, **{n: self._with(NEW_CHECKS[n]) for n in SENTENCE_CHECKS}}

    def old_checks(self) -> dict[str, Verdict]:
        """All old checks, those on sentences by this model."""
        return {**OLD_CHECKS, **{n: self._with(OLD_CHECKS[n]) for n in OLD_SENTENCE_CHECKS}}


def starter_counts(docs: DataFrame, short: list[str], text: str = "text") -> DataFrame:
    """``word``, its occurrences ``n`` and those right after a period that is no abbreviation's, ``n_after``."""
    return _followers(token_pairs(docs, text), short)


def _followers(pairs: DataFrame, short: list[str]) -> DataFrame:
    t = pairs.select(_clean(F.col("before")).alias("before"), F.lower(_clean(F.col("token"))).alias("t"), "n")
    ends = F.coalesce(F.col("before").rlike(DOTTED), F.lit(False))
    if short:
        ends = ends & ~F.coalesce(_among(_bare(F.col("before")), short), F.lit(False))
    word = F.regexp_replace("t", r"[^\p{L}\p{M}\p{N}]+$", "")
    found = t.select(word.alias("word"), "n", F.when(ends, F.col("n")).otherwise(F.lit(0)).alias("after"))
    return found.filter(F.col("word").rlike(r"\p{L}")).groupBy("word").agg(
        F.sum("n").alias("n"), F.sum("after").alias("n_after")
    )


def _starters(counts: DataFrame) -> DataFrame:
    """Types that follow sentence ends more often than chance, with their ``score``."""
    total = counts.agg(F.sum("n").alias("n"), F.sum("n_after").alias("a")).first()
    n, ends = total["n"] or 0, total["a"] or 0
    if not 0 < ends < n:
        return counts.filter(F.lit(False)).withColumn("score", F.lit(0.0))
    c, k = F.col("n").cast("double"), F.col("n_after").cast("double")

    def rate(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(1e-9)), F.lit(1 - 1e-9))

    overall, inside, outside = rate(c / n), rate(k / ends), rate((c - k) / (n - ends))
    ratio = _surprise(k, F.lit(float(ends)), overall, inside) + _surprise(c - k, F.lit(float(n - ends)), overall, outside)
    return counts.filter(k / ends > c / n).withColumn("score", ratio)


def fit_sentences(docs: DataFrame, text: str = "text") -> SentenceModel:
    """A model of all given texts, read once; NULL and empty texts teach nothing."""

    def best(scored: DataFrame, least: float) -> list[str]:
        return sorted(r["word"] for r in scored.filter(F.col("score") >= least).select("word").collect())

    pairs = durable(token_pairs(docs, text), "token-pairs")
    tokens = pairs.groupBy("token").agg(F.sum("n").alias("n"))
    short = best(abbreviations(durable(_types(tokens), "type-counts")), ABBREVIATION)
    starters = best(_starters(durable(_followers(pairs, short), "starter-counts")), STARTER)
    return SentenceModel(tuple(short), tuple(starters))
