"""Quality rules: boosted trees over document statistics, on top of fixed base rules.

Base statistics are counted on whole texts: words, symbols, repeated lines, and words in windows of
eight that occur again in the same text.  A text fails the base rules with fewer than ``LEAST_WORDS``
words or with over ``REPEATED`` percent of its words in repeated windows.  What passes is judged by
trees fitted on the labelled rows; they may only lower a document's quality for more symbols, more
repeated lines or more repetition, and may not be moved the other way by noise.

The nodes are flat arrays, scored for a whole Arrow batch at once, in one pass over the texts
without a shuffle.  The fit uses at most ``FIT_ROWS`` labelled rows (smallest digests of the id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from posttrain_spark.llm.hashing import text_blocks, window_hashes, word_hashes
from posttrain_spark.llm.trees import Forest, fit
from posttrain_spark.plans.registry import query, table

# Labelled rows of the fit at most.
FIT_ROWS = 20_000
# Base rules.
LEAST_WORDS, REPEATED = 20, 30
WINDOW = 8
# A document is kept from this score on.  Below one half: it takes good evidence to drop a document.
KEEP = 0.35

# The symbols that are counted.
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "capital_rate", "digit_rate",
    "mark_rate", "words_per_line", "distinct_rate",
)
MONOTONE = (0, 0, -1, -1, -1, -1, 0, -1, 0, 0)

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
# Bytes that begin a character of UTF-8.
_BEGINS = np.ones(256, bool)
_BEGINS[0x80:0xC0] = False


def _class(low: str, high: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[ord(low) : ord(high) + 1] = True
    return out


_CAPITAL, _DIGIT = _class("A", "Z"), _class("0", "9")
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def _before(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place."""
    return np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))


def _repeated(windows: np.ndarray, words: int) -> int:
    """Words of a text that lie in a window found twice or more in it."""
    _, inverse, count = np.unique(windows, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[inverse] > 1)
    if not len(again):
        return 0
    edges = np.zeros(words + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def _dup_lines(lines: list[bytes]) -> int:
    filled = [line for line in lines if line.strip(b" \t\n\v\f\r")]
    return len(filled) - len(set(filled))


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS (long) and FEATURES (double) of every text; NULL and empty texts are rows of zeros."""
    counts, described = [], []
    for data, bounds in text_blocks(texts):
        starts, ends, hashes = word_hashes(data, lower=False)
        at = np.searchsorted(starts, bounds)
        begins = _before(_BEGINS[data])
        symbols, capitals, digits, marks = (_before(c[data]) for c in (_IS_SYMBOL, _CAPITAL, _DIGIT, _MARK))
        word_chars = np.concatenate(([0], np.cumsum(begins[ends] - begins[starts])))
        windows = window_hashes(hashes, WINDOW)
        raw = data.tobytes()
        for k in range(len(bounds) - 1):
            low, high = bounds[k], bounds[k + 1] - 1
            i, j = at[k], at[k + 1]
            n, chars = int(j - i), int(word_chars[j] - word_chars[i])
            lines = raw[low:high].split(b"\n")
            row = (
                n, chars, int(symbols[high] - symbols[low]), _dup_lines(lines),
                _repeated(windows[i : j - WINDOW + 1], n) if n > WINDOW else 0,
            )
            counts.append(row)
            share = 1 / max(n, 1)
            letters = 1 / max(chars, 1)
            described.append((
                np.log1p(n), chars * share, row[2] * share, row[3] / len(lines), row[4] * share,
                (capitals[high] - capitals[low]) * letters, (digits[high] - digits[low]) * letters,
                (marks[high] - marks[low]) * share, n / len(lines),
                len(np.unique(hashes[i:j])) * share,
            ))
    return np.array(counts, np.int64).reshape(-1, len(COUNTS)), np.array(described, float).reshape(-1, len(FEATURES))


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > REPEATED * counts[:, 0])


def fit_quality(docs: DataFrame, labels: DataFrame) -> Forest:
    """Fit on labelled rows that pass the base rules.  Rows without an id, a label or a document are
    no examples; where labels of an id differ, the higher counts.  Without examples of both kinds the
    trees give every document one score."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.max("quality").cast("int").alias("quality")
    )
    few = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit("quality")), "doc_id").limit(FIT_ROWS)
    # The sample is broadcast: FIT_ROWS rows of two numbers.
    texts = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", "text", "quality")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, x = statistics(batch.column(1))
            passed = pa.array(~base_failed(counts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))],
                names=["doc_id", "quality", "x"],
            ).filter(passed)

    rows = texts.mapInArrow(described, "doc_id long, quality int, x array<double>").toArrow()
    y = rows.column("quality").to_numpy()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, y, rows.column("doc_id").to_numpy()))
    return fit(x[order], y[order], MONOTONE)


def judge_quality(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """``docs`` with COUNTS, ``base_failed``, ``quality_score`` and ``kept``; columns of those names are
    replaced.  NULL and empty texts have no words and so fail the base rules."""
    own = (*COUNTS, "base_failed", "quality_score", "kept")
    names = [c for c in docs.columns if c.lower() not in own]
    schema = docs.select(*(F.col(f"`{c}`") for c in names))
    for c in COUNTS:
        schema = schema.withColumn(c, F.lit(0).cast("long"))
    for c, zero in (("base_failed", False), ("quality_score", 0.0), ("kept", False)):
        schema = schema.withColumn(c, F.lit(zero))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            counts, x = statistics(column(text))
            failed, score = base_failed(counts), forest.score(x)
            made = [*map(pa.array, counts.T.copy()), pa.array(failed), pa.array(score), pa.array(~failed & (score >= KEEP))]
            yield pa.RecordBatch.from_arrays([*map(column, names), *made], names=[*names, *own])

    return docs.mapInArrow(run, schema.schema)


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels"))).drop("text")
