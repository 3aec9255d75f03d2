"""From documents to token ids: toxicity, line dedup, near duplicates, mixing, BPE.

Each stage is a function of (spark, docs, sf_dir).  ``run`` writes each one's result as Parquet in the
shared folder and reads it back for the next, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from posttrain_spark.llm import bpe, jaccard_join, line_dedup, mixing, toxicity
from posttrain_spark.plans.registry import query, table
from posttrain_spark.session import durable

# Share of a document's words that line dedup must leave: the rest is then no near copy of what it repeats.
LEAST_SHARE = 0.2

# Share of the tokens left after cleaning that the mix may hold.
MIX_SHARE = (9, 10)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that stand in an earlier document or place.

    Copies, of which less than LEAST_SHARE of the words is left, go: exact copies would stay as empty
    texts, near copies as the few lines that were changed.
    """
    return line_dedup.dedup_lines(docs, least_share=LEAST_SHARE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component; documents without words all stay.

    Rows that repeat an id stay or go together; so do rows without an id, which go only if each of them is
    linked to a row that has one.
    """
    found = jaccard_join.near_duplicates(docs)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = durable(kept.select(F.col("doc_id").alias("_kept_id")).distinct(), "kept-ids")
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept_id")), "left_semi")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One epoch at most of each leaf, to the target weights."""
    drawn = mixing.mix_sources(
        docs,
        mixing.domain_of(F.col("source")),
        F.col("lang"),
        F.col("source"),
        mixing.WEIGHTS,
        share=MIX_SHARE,
    )
    return drawn.select(*(F.col(f"`{c}`") for c in docs.columns))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text."""
    import public_tokenizers

    coded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.drop("text").withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("mixing", mix),
    ("bpe", tokenize),
]

# The first stage is a trained model and the last an automaton: SQL cannot say them.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
