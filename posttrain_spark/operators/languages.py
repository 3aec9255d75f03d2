"""Language identification learned from labelled texts, for the response-language check.

A model counts character trigrams per language over all given texts, in Spark, and keeps their rounded
log probabilities by bucket.  A text is scored by whole numbers: no shuffle and no word lists.  Columns of
texts are counted and scored in Arrow batches; inside higher-order functions, as in constraint arrays, where
Spark takes no Python, ``predict`` gives the same answer as an expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from posttrain_spark.functions.text import let
from posttrain_spark.operators.constraints import NEW_CHECKS, Verdict

CHECK = "language:response_language"
# Buckets that trigrams fall into: a model holds as many whole numbers per language.
BUCKETS = 4_096
# Weights of the three characters of a trigram in its bucket.
FACTORS = (961, 31, 1)
# Texts of a batch are worked on together up to about this many bytes.
BLOCK_BYTES = 1 << 20
# Languages whose counts a task holds before it hands them on.
HELD_LANGUAGES = 64


def letters(text: Column) -> Column:
    """Lower-case letters, other characters as one space, a space at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")), F.lit(" "))


def trigrams(text: Column) -> Column:
    """Buckets of all trigrams of a text's letters, in order; empty without letters."""

    def buckets(codes: Column) -> Column:
        last = F.size(codes) - len(FACTORS)
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            starts,
            lambda i: F.pmod(sum((F.get(codes, i + k) * f for k, f in enumerate(FACTORS)), F.lit(0)), F.lit(BUCKETS)),
        )

    return let(F.transform(F.split(letters(F.coalesce(text, F.lit(""))), ""), F.ascii), buckets)


def _buckets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of neighbouring texts of ``letters``, and where those of each text start and stop."""
    block = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // BLOCK_BYTES
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        held = texts.slice(low, high - low)
        codes = np.frombuffer("".join(held.to_pylist()).encode("utf-32-le"), "<u4")
        lengths = pc.utf8_length(held).to_numpy(zero_copy_only=False).astype(np.int64)
        last = max(len(codes) - len(FACTORS) + 1, 0)
        found = sum(codes[k : k + last] * np.uint32(f) for k, f in enumerate(FACTORS)) % np.uint32(BUCKETS)
        ends = np.cumsum(lengths)
        # The two spaces at the edges of a text are there without letters, too.
        yield found, ends - lengths, ends - len(FACTORS) + 1


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``language``, ``bucket`` and ``n`` from languages and texts of letters."""
    counts: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for name, own in counts.items():
            seen = np.flatnonzero(own)
            arrays = [pa.repeat(pa.scalar(name, pa.string()), len(seen)), pa.array(seen.astype(np.int32)), pa.array(own[seen])]
            yield pa.RecordBatch.from_arrays(arrays, names=["language", "bucket", "n"])
        counts.clear()

    for batch in batches:
        batch = batch.take(pc.sort_indices(batch.column(0)))
        at = 0
        for found, starts, stops in _buckets(batch.column(1)):
            names = batch.column(0).slice(at, len(starts)).to_pylist()
            at += len(starts)
            for i, name in enumerate(names):
                if name not in counts:
                    if len(counts) == HELD_LANGUAGES:
                        yield from rows()
                    counts[name] = np.zeros(BUCKETS, np.int64)
                own = found[starts[i] : stops[i]]
                if len(own) < BUCKETS:
                    np.add.at(counts[name], own, 1)
                else:
                    counts[name] += np.bincount(own, minlength=BUCKETS)
    yield from rows()


@dataclass(frozen=True)
class LanguageModel:
    """Rounded log probabilities, a thousand to one unit, of the buckets of every language."""

    weights: tuple[tuple[str, tuple[int, ...]], ...]

    @property
    def languages(self) -> list[str]:
        return [name for name, _ in self.weights]

    def predict(self, text: Column) -> Column:
        """The likeliest language, the last in code order on a tie; NULL without letters.

        An expression for use inside higher-order functions; elsewhere ``predict_batches`` is many times quicker.
        """

        def scored(found: Column) -> Column:
            sums = [F.struct(_sum(found, own).alias("score"), F.lit(name).alias("language")) for name, own in self.weights]
            return F.when(F.size(found) > 0, F.array_max(F.array(*sums))["language"])

        return let(trigrams(text), scored) if self.weights else F.lit(None).cast("string")

    def predict_batches(self, text: Column) -> Column:
        """As ``predict``, for columns of a frame or a stream: one Arrow batch of texts at a time."""
        if not self.weights:
            return F.lit(None).cast("string")
        names = pa.array(self.languages, pa.string())
        weights = np.array([own for _, own in self.weights], np.int64)

        @F.arrow_udf("string")
        def likeliest(texts: pa.Array) -> pa.Array:
            picked = []
            for found, starts, stops in _buckets(texts):
                best = np.zeros(len(starts), np.int64)
                top = None
                for k, own in enumerate(weights):
                    sums = np.concatenate(([0], np.cumsum(own[found])))
                    score = sums[stops] - sums[starts]
                    better = score >= top if k else np.ones(len(starts), bool)
                    best, top = np.where(better, k, best), np.where(better, score, top)
                picked.append(pa.array(best, mask=stops <= starts))
            return names.take(pa.concat_arrays(picked))

        return likeliest(letters(F.coalesce(text, F.lit(""))))

    def agrees(self, predicted: Column, wanted: Column) -> Column:
        """Whether the predicted language is the wanted one: text without letters passes, a language that the
        model does not know has no verdict."""
        return F.when(wanted.isin(*self.languages), F.coalesce(predicted == wanted, F.lit(True)))

    def check(self) -> Verdict:
        """The check with this model, see ``agrees``."""
        return lambda text, args: self.agrees(self.predict(text), args.text("language"))

    def checks(self) -> dict[str, Verdict]:
        """All new checks, with this model's language check; for ``score_multi(..., checks=...)``."""
        return {**NEW_CHECKS, CHECK: self.check()}


def _sum(buckets: Column, weights: tuple[int, ...]) -> Column:
    # One array literal: the text is split once, when the plan is optimised.
    known = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")
    return F.aggregate(buckets, F.lit(0).cast("long"), lambda total, b: total + F.get(known, b))


def fit_languages(docs: DataFrame, text: str = "text", language: str = "lang") -> LanguageModel:
    """A model of the languages named in ``docs``; rows without a language or letters teach nothing.

    Trigrams are counted where texts are read; only one count per language and bucket is shuffled and
    brought to the driver, whatever the number of texts.
    """
    labelled = docs.select(F.col(language).alias("language"), F.col(text).alias("text")).filter("language IS NOT NULL")
    own = labelled.select(F.col("language").cast("string"), letters(F.coalesce("text", F.lit(""))))
    grams = own.mapInArrow(_count_buckets, "language string, bucket int, n long")
    counts: dict[str, dict[int, int]] = {}
    for row in grams.groupBy("language", "bucket").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(row["language"], {})[row["bucket"]] = row["n"]

    def weigh(own: dict[int, int]) -> tuple[int, ...]:
        total = math.log(sum(own.values()) + BUCKETS)
        return tuple(math.floor(1000 * (math.log(own.get(b, 0) + 1) - total) + 0.5) for b in range(BUCKETS))

    return LanguageModel(tuple((name, weigh(own)) for name, own in sorted(counts.items())))


def accuracy(model: LanguageModel, docs: DataFrame, text: str = "text", language: str = "lang") -> float | None:
    """Share of texts with letters whose language is predicted; None without any."""
    guess = docs.filter(F.col(language).isNotNull()).withColumn("_guess", model.predict_batches(F.col(text)))
    return guess.agg(F.avg((F.col("_guess") == F.col(language)).cast("double"))).first()[0]
