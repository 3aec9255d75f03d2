"""Line dedup by content-defined chunks of lines.

A hash rolls over the hashes of a text's lines.  Every line with words begins a chunk that ends with the
line in which it reaches ``LEAST_WORDS`` words, and ends one that reaches back as far.  So a chunk's edges
depend on its own lines alone and move with them, whatever stands around.  Chunks overlap: none is
sampled away, as a passage between foreign lines may hold no whole chunk of a partition.  A line with
that many words is a chunk by itself; shorter runs, like closing braces or one-word answers, are in
none.

A chunk that occurs more than once in the corpus stays where it occurs first (smallest id, then
position).  Elsewhere, chunks that continue each other against the same first place are joined line by
line into runs, the bytes of each run are compared with its first place, and its lines are removed.
Every repeated run with LEAST_WORDS words is the union of its chunks, each of which has an earlier
place: so exactly the lines of all such runs go, and the first occurrence of a line never does.
Lines without words count inside a run, not at its edges.

Only hashes are shuffled to find repeats; texts are read again for repeated runs alone, and each
repeated line is moved once per place it is compared with.  Hashes and runs that very many documents
share are counted before the shuffle and their rows spread in the joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from posttrain_spark.llm.hashing import mix
from posttrain_spark.operators.skew import skew_join
from posttrain_spark.plans.registry import query, table
from posttrain_spark.session import durable

# Words from which a repeated run of lines is removed.
LEAST_WORDS = 50

# Odd, so that it has an inverse modulo 2**64.
_STEP = 0x9E6C63D0676A9A99
_BACK = pow(_STEP, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))


def chunks(text: str, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First lines, end lines and hashes of all chunks of a text; lines are what stands between ``\\n``."""
    lines = text.split("\n")
    words = np.fromiter((len(line.split()) for line in lines), np.int64, len(lines))
    until = np.concatenate(([0], np.cumsum(words)))
    if until[-1] < least:
        none = np.empty(0, np.int64)
        return none, none, none.view(np.uint64)
    filled = np.flatnonzero(words)
    ahead = np.searchsorted(until, until[filled] + least, "left")
    back = np.searchsorted(until, until[filled + 1] - least, "right") - 1
    whole, reached = ahead < len(until), back >= 0
    first = np.concatenate((filled[whole], back[reached]))
    end = np.concatenate((ahead[whole], filled[reached] + 1))
    pair = np.unique(first * (len(lines) + 1) + end)
    first, end = pair // (len(lines) + 1), pair % (len(lines) + 1)
    hashed = (xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) for line in lines)
    values = np.fromiter(hashed, np.uint64, len(lines))
    # Hashes of lines, each times a power that undoes its place: the sum of a range rolls along.
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _powers(_BACK, len(lines))[:-1])))
    rolled = (sums[end] - sums[first]) * _powers(_STEP, len(lines))[first]
    return first, end, mix(rolled + mix((end - first).astype(np.uint64)))


def _identity(doc_id: str, text: str) -> list[Column]:
    """Rows are told apart by id and text: those without an id, or that repeat one, by their texts."""
    return [F.col(f"`{doc_id}`").cast("long").alias("id"), F.xxhash64(f"`{text}`").alias("mark")]


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, mark, line, end, hash) of all chunks."""
    for batch in batches:
        found = [chunks(text or "") for text in batch.column(2).to_pylist()]
        at = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        parts = [np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in range(3)]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c).take(pa.array(at)) for c in (0, 1)),
                *(pa.array(p.astype(np.int32)) for p in parts[:2]),
                pa.array(parts[2].astype(np.uint64).view(np.int64)),
            ],
            names=["id", "mark", "line", "end", "hash"],
        )


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, mark, run, line, end, first, body) of the runs listed with each text."""
    for batch in batches:
        at, run, line, end, first, body = [], [], [], [], [], []
        for i, (text, wanted) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            lines = text.split("\n")
            for w in wanted:
                at.append(i)
                run.append(w["run"])
                line.append(w["line"])
                end.append(w["end"])
                first.append(w["first"])
                body.append("\n".join(lines[w["line"] : w["end"]]))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 1)),
                *(pa.array(v, k) for v, k in zip((run, line, end, first, body), kinds, strict=True)),
            ],
            names=["id", "mark", "run", "line", "end", "first", "body"],
        )


def _without(text: str | None, gone: list[dict] | None) -> str | None:
    if not text or not gone:
        return text
    lines = text.split("\n")
    drop = set()
    for g in gone:
        drop.update(range(g["line"], g["end"]))
    rest = [line for i, line in enumerate(lines) if i not in drop]
    # Lines without words do not stay alone.
    return "\n".join(rest) if any(line.strip() for line in rest) else ""


def _runs(found: DataFrame, repeats: DataFrame) -> DataFrame:
    """Repeated chunks joined where they continue each other against one first text, as
    ``id``, ``mark``, ``line``, ``end`` and the first place ``first_id``, ``first_mark``, ``first_line``."""
    again = ~(
        F.col("id").eqNullSafe(F.col("first_id"))
        & (F.col("mark") == F.col("first_mark"))
        & (F.col("line") == F.col("first_line"))
    )
    copies = skew_join(
        found, repeats.drop("_rows"), "hash", ["id", "mark", "line"], counts=repeats.select("hash", "_rows")
    )
    copies = copies.filter(again).withColumn("shift", F.col("line") - F.col("first_line"))
    texts = ["id", "mark", "first_id", "first_mark", "shift"]
    along = Window.partitionBy(*texts).orderBy("line", "end")
    reached = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("line") > reached, F.lit(True)).cast("int")
    joined = copies.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(along))
    runs = joined.groupBy(*texts, "_run").agg(F.min("line").alias("line"), F.max("end").alias("end"))
    return runs.withColumn("first_line", F.col("line") - F.col("shift")).drop("_run", "shift")


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of lines to remove: ``id`` and ``mark`` of the row, ``line`` and ``end``."""
    source = docs.select(*_identity(doc_id, text), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL")
    found = durable(
        source.mapInArrow(_chunk_rows, "id long, mark long, line int, end int, hash long"), "chunks"
    )
    # Rows without an id come last in the order of first occurrences.
    place = F.struct(F.col("id").isNull().alias("none"), "id", "mark", "line")
    repeats = durable(
        found.groupBy("hash")
        .agg(F.count("*").alias("_rows"), F.min(place).alias("first"))
        .filter("_rows > 1")
        .select("hash", "_rows", *(F.col(f"first.{c}").alias(f"first_{c}") for c in ("id", "mark", "line"))),
        "repeats",
    )
    runs = _runs(found, repeats)
    lines = (F.col("end") - F.col("line")).cast("string")
    name = F.concat_ws(":", F.coalesce(F.col("first_id").cast("string"), F.lit("?")), "first_mark", "first_line", lines)
    runs = durable(runs.withColumn("run", name), "runs")
    firsts = runs.select(
        F.col("first_id").alias("id"), F.col("first_mark").alias("mark"), "run", F.col("first_line").alias("line"),
        (F.col("first_line") + F.col("end") - F.col("line")).alias("end"), F.lit(True).alias("first"),
    ).distinct()
    wanted = runs.select("id", "mark", "run", "line", "end", F.lit(False).alias("first")).unionByName(firsts)
    by_row = durable(
        wanted.groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(
            F.collect_set(F.struct("run", "line", "end", "first")).alias("wanted")
        ),
        "wanted-runs",
    )
    # The plan is the same at every size: a list of rows that grows with the corpus is not broadcast.
    same = (F.col("mark") == F.col("_mark")) & F.col("id").eqNullSafe(F.col("_id"))
    bodies = durable(
        source.join(by_row.hint("merge"), same).select("id", "mark", "text", "wanted").mapInArrow(
            _run_rows, "id long, mark long, run string, line int, end int, first boolean, body string"
        ),
        "bodies",
    )
    first_bodies = durable(
        bodies.filter("first").groupBy("run").agg(F.min("body").alias("first_body")), "first-bodies"
    )
    copies = bodies.filter("NOT first").drop("first")
    compared = skew_join(copies, first_bodies, "run", ["id", "mark", "line"])
    return compared.filter("body = first_body").select("id", "mark", "line", "end")


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    n_chars: str | None = "n_chars",
    least_share: float = 0.0,
) -> DataFrame:
    """``docs`` without the repeated runs, columns as they were; ``n_chars`` is counted anew.

    Every row stays unless less than ``least_share`` of its words is left: by default a text all of whose
    lines are repeats becomes empty.  NULL and empty texts stay as they are.  Rows that repeat an id
    with the same text count as one document, so none of them loses what it would lose to itself;
    with other texts they are rows of their own.  Rows without an id come last in the order in which
    first occurrences are chosen.  Very long texts are read whole; equal runs in one text are repeats
    like any other; of an empty table nothing is left.
    """
    gone = durable(
        repeated_runs(docs, doc_id, text)
        .groupBy(F.col("id").alias("_gone_id"), F.col("mark").alias("_gone_mark"))
        .agg(F.collect_set(F.struct("line", "end")).alias("_gone")), "gone",
    )
    names = docs.columns
    whole = F.struct(*(F.col(f"`{c}`") for c in names)).alias("_doc")
    ident, mark = _identity(doc_id, text)
    keyed = docs.select(whole, ident.alias("_id"), mark.alias("_mark"))
    same = (F.col("_mark") == F.col("_gone_mark")) & F.col("_id").eqNullSafe(F.col("_gone_id"))
    joined = keyed.join(gone.hint("merge"), same, "left")
    rest = [c for c in names if c != text]
    flat = joined.select(*(F.col("_doc").getField(c).alias(c) for c in rest), F.col("_doc").getField(text).alias(text), "_gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            texts, gone = batch.column(last - 1).to_pylist(), batch.column(last).to_pylist()
            made = [_without(t, g) for t, g in zip(texts, gone, strict=True)]
            stays = [
                not g or len(m.split()) >= least_share * len(t.split()) for t, m, g in zip(texts, made, gone, strict=True)
            ]
            kept = pa.RecordBatch.from_arrays(
                [*batch.columns[: last - 1], pa.array(made, pa.string())], names=[*rest, text]
            )
            yield kept if all(stays) else kept.filter(pa.array(stays))

    schema = flat.drop("_gone").schema
    cleaned = flat.mapInArrow(run, schema)
    if n_chars in names:
        counted = F.when(F.col(text).isNotNull(), F.length(text).cast(docs.schema[n_chars].dataType))
        cleaned = cleaned.withColumn(n_chars, counted)
    return cleaned.select(*(F.col(f"`{c}`") for c in names))


@query("op9_line_dedup")
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    cleaned = dedup_lines(docs.withColumn("n_before", F.coalesce(F.length("text"), F.lit(0)).cast("long")))
    return cleaned.select(
        "doc_id", "n_before", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )
