"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression.

The lexicon is learned from labelled rows: words, and beginnings of words, that stand in toxic
documents far more often than in others.  A document is then described by how densely, how close
together and how close to the second person it uses them, by its capitals and punctuation, and by
how often words are written with digits or symbols in place of letters.

Labels are taken from rows whose crc32(doc_id) mod 5 is not 0; the others stay for evaluation.  The
fit uses at most ``FIT_ROWS`` of them (those with the smallest digest of the id), so what reaches
the driver is bounded: that many feature rows and at most ``LEXICON`` terms.  Scoring is one pass
over the texts without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from posttrain_spark.llm.trees import Forest, Isotonic, fit, fit_isotonic
from posttrain_spark.plans.registry import query, table
from posttrain_spark.session import durable

# Labelled rows of the fit at most, and terms of the lexicon at most.
FIT_ROWS = 20_000
LEXICON = 1_000
# A term is taken when the lower bound of its share of toxic documents, at so many standard errors,
# is above this share.
ERRORS, SHARE = 2.0, 0.5
# Lengths of the beginnings of words that can be terms.
BEGINNINGS = (4, 5, 6)
# Words to either side of a term within which a second person counts.
NEAR = 5
# Words of the densest stretch.
STRETCH = 50
# Words kept by a Python worker between rows.
MOST_WORDS = 500_000

# Second-person words of the four languages.
SECOND_PERSON = """
you your yours yourself yourselves du dich dir dein deine deiner deinem deinen ihr euch euer
tu te toi ton ta tes vous votre vos tú ti tuyo tuya tus usted ustedes vosotros
""".split()
# What digits and symbols stand for in place of letters.
STAND_INS = str.maketrans({
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e",
})

FEATURES = (
    "log_words", "hits", "hit_rate", "weighted_rate", "distinct_hits", "densest_stretch", "hits_near_person",
    "person_rate", "capitals", "all_capital_words", "exclamations", "punctuation", "obfuscated_rate", "obfuscated_hits",
)
# More lexicon evidence never lowers the score.
MONOTONE = (0, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 1)

_CHUNK = re.compile(r"\S+")
_EDGE = ".,;:!?\"'()[]{}<>*#%&|~_-=+/\\«»„“”‘’…¡¿$"


@dataclass(frozen=True)
class Model:
    """Everything scoring needs; a few hundred KB at most."""

    words: dict[str, float]
    beginnings: dict[str, float]
    forest: Forest
    calibration: Isotonic

    def term(self, word: str) -> float:
        """Weight of a lower-case word, 0 when it is not in the lexicon."""
        found = self.words.get(word, 0.0)
        for n in BEGINNINGS:
            if len(word) >= n:
                found = max(found, self.beginnings.get(word[:n], 0.0))
        return found

    def score(self, features: np.ndarray) -> np.ndarray:
        return np.clip(self.calibration(self.forest.score(features)), 0.0, 1.0)


class _Marks(dict):
    """What a chunk between white space says: (weight, obfuscated, second person, all capitals)."""

    def __init__(self, model: Model):
        self.model, self.person = model, frozenset(SECOND_PERSON)

    def __missing__(self, chunk: str) -> tuple[float, bool, bool, bool] | None:
        if len(self) >= MOST_WORDS:
            self.clear()
        word = chunk.strip(_EDGE)
        low = word.lower()
        weight = self.model.term(low)
        odd = not word.isalpha() and any(c.isalpha() for c in word)
        hidden = False
        if not weight and (odd or not chunk.isalpha()):
            clear = chunk.lower().translate(STAND_INS)
            weight = max(
                self.model.term(re.sub(r"[\W_]", "", clear)), self.model.term(re.sub(r"[\W\d_]", "", chunk.lower()))
            )
            hidden = weight > 0 and odd
        mark = (weight, odd, low in self.person, len(word) > 1 and word.isupper())
        mark = mark + (hidden,) if any(mark) else None
        self[chunk] = mark
        return mark


def _features(text: str, marks: _Marks) -> list[float]:
    chunks = _CHUNK.findall(text)
    n = len(chunks)
    if not n:
        return [0.0] * len(FEATURES)
    found = [(i, m, c) for i, (m, c) in enumerate(zip(map(marks.__getitem__, chunks), chunks, strict=True)) if m]
    hits = [(i, m[0], c.lower()) for i, m, c in found if m[0] > 0]
    people = np.array([i for i, m, _ in found if m[2]])
    places = np.array([i for i, _, _ in hits])
    near = 0
    if len(people) and len(places):
        at = np.searchsorted(people, places - NEAR)
        near = int((people[np.minimum(at, len(people) - 1)] - places <= NEAR)[at < len(people)].sum())
    densest = int((np.searchsorted(places, places + STRETCH) - np.arange(len(places))).max()) if hits else 0
    letters = max(1, sum(map(str.isalpha, text)) if not text.isascii() else len(re.findall(r"[A-Za-z]", text)))
    capitals = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    return [
        float(np.log1p(n)),
        len(hits),
        len(hits) / n,
        sum(w for _, w, _ in hits) / n,
        len({c for _, _, c in hits}),
        densest,
        near,
        len(people) / n,
        capitals / letters,
        sum(m[3] for _, m, _ in found) / n,
        text.count("!") / n,
        len(re.findall(r"[^\w\s]", text)) / n,
        sum(m[1] for _, m, _ in found) / n,
        sum(m[4] for _, m, _ in found),
    ]


def features(texts: list[str | None], model: Model) -> np.ndarray:
    """Rows of FEATURES; NULL and empty texts are rows of zeros."""
    marks = _Marks(model)
    rows = [_features(t or "", marks) for t in texts]
    return np.array(rows, float).reshape(-1, len(FEATURES))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; an id of NULL counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Terms and their log-odds weights, from rows with ``text`` and ``toxic``."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)))
    kinds = [F.transform(F.col("_w"), lambda w: F.struct(F.lit(0).alias("n"), w.alias("t")))]
    for n in BEGINNINGS:
        long = F.filter("_w", lambda w, n=n: F.length(w) >= n)
        cut = F.array_distinct(F.transform(long, lambda w, n=n: F.substring(w, 1, n)))
        kinds.append(F.transform(cut, lambda w, n=n: F.struct(F.lit(n).alias("n"), w.alias("t"))))
    terms = sample.withColumn("_w", words).select("toxic", F.explode(F.concat(*kinds)).alias("term"))
    counted = terms.groupBy("term.n", "term.t").agg(
        F.sum("toxic").cast("double").alias("bad"), F.count("*").cast("double").alias("all")
    )
    share, z2 = F.col("bad") / F.col("all"), ERRORS**2
    spread = ERRORS * F.sqrt(share * (1 - share) / F.col("all") + z2 / (4 * F.col("all") ** 2))
    lower = (share + z2 / (2 * F.col("all")) - spread) / (1 + z2 / F.col("all"))
    weight = F.log((F.col("bad") + 0.5) / (F.col("all") - F.col("bad") + 0.5))
    best = (
        counted.withColumn("low", lower).filter(F.col("low") > SHARE).withColumn("weight", weight)
        .orderBy(F.desc("low"), "n", "t").limit(LEXICON).collect()
    )
    words = {r["t"]: r["weight"] for r in best if r["n"] == 0}
    return words, {r["t"]: r["weight"] for r in best if r["n"] > 0}


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the texts of labelled rows.  Rows without an id, a label or a document are no examples;
    where labels of an id differ, the higher counts.  Without examples of both kinds every text gets
    the base rate (0.5 smoothed) as its score."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64(F.col("doc_id"), F.lit("fit"))
    few = known.orderBy(order, "doc_id").limit(FIT_ROWS)
    # The sample is broadcast: FIT_ROWS rows of two numbers.
    texts = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", "text", "toxic")
    sample = durable(texts, "toxic-sample")
    words, beginnings = _lexicon(sample)
    blank = Model(words, beginnings, fit(np.empty((0, len(FEATURES))), np.empty(0)), fit_isotonic(*2 * [np.empty(0)]))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = features(batch.column(1).to_pylist(), blank)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(rows.tolist(), pa.list_(pa.float64()))],
                names=["doc_id", "toxic", "x"],
            )

    rows = sample.mapInArrow(described, "doc_id long, toxic int, x array<double>").toArrow()
    ids = rows.column("doc_id").to_numpy()
    order = np.lexsort((rows.column("toxic").to_numpy(), ids))
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))[order]
    y = rows.column("toxic").to_numpy()[order]
    # A quarter of the rows calibrates, with trees that have not seen it; the rest and then all fit.
    apart = np.arange(len(y)) % 4 == 0
    trial = fit(x[~apart], y[~apart], MONOTONE)
    calibration = fit_isotonic(trial.score(x[apart]), y[apart])
    return Model(words, beginnings, fit(x, y, MONOTONE), calibration)


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a score from 0 to 1; a column named like ``out`` is replaced.

    NULL and empty texts get the score of a text without words.
    """
    kept = [c for c in docs.columns if c.lower() != out.lower() or c == text]
    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).withColumn(out, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = _Marks(model)
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            rows = [_features(t or "", marks) for t in column(text).to_pylist()]
            x = np.array(rows, float).reshape(-1, len(FEATURES))
            made = pa.array(model.score(x), pa.float64())
            yield pa.RecordBatch.from_arrays([*map(column, kept), made], names=[*kept, out])

    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below ``threshold``, columns as they were."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels), out="_toxicity")
    return scored.filter(F.col("_toxicity") < threshold).drop("_toxicity")


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")), out="score")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
