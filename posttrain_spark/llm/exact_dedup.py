"""Exact duplicates: groups of one 128-bit content hash, split by their bytes, one row of each stays.

Texts are hashed once, next to the scan.  Only digests are shuffled to find the groups; texts are read
again for groups of several rows alone, where equal ones are folded together before they are shuffled,
so a group of any size sends one text per task.  A hash shared by different texts gives one class per
text.  DataFrame operations only.

NULL counts as an empty text, and empty texts are equal to each other.  Rows without an id come
before every id.  Of rows that repeat an id and a text one stays, the first as stored.  Very long texts
are compared whole.  An empty table gives no rows.  Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from posttrain_spark.operators.skew import skew_join
from posttrain_spark.plans.registry import query, table
from posttrain_spark.session import durable

Hash = Callable[[Column], Column]


def content_hash(text: Column) -> Column:
    """128 bits of a text, as hex."""
    return F.md5(text)


def _places(rows: DataFrame, keys: list[str], keep: str) -> DataFrame:
    """Size of each group and the row that stays: by id, then the first of those that repeat it."""
    pick = F.max if keep == "largest" else F.min
    # Rows that repeat an id are numbered downwards, so that the largest pair names the first of them.
    turn = -F.col("_row") if keep == "largest" else F.col("_row")
    chosen = pick(F.struct(F.col("_id"), turn.alias("_turn")))
    return rows.groupBy(*keys).agg(F.count("*").alias("_n"), chosen.alias("_kept"))


def exact_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: str = "smallest",
    normalise: Hash = lambda text: text,
    hashed: Hash = content_hash,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    ``keep`` says which id of a group stays, the ``smallest`` or the ``largest``.  Texts are equal when
    they are identical after ``normalise``.  ``hashed`` is the hash that groups are found by; a weak one
    costs time, not results.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")
    text = normalise(F.coalesce(F.col(f"`{text_column}`"), F.lit("")))
    ident = F.col(f"`{id_column}`").alias("_id")
    rows = durable(
        docs.select(ident, hashed(text).alias("_hash"), F.sha2(text, 256).alias("text_sha256")).withColumn(
            "_row", F.monotonically_increasing_id()
        ),
        "content-hashes",
    )
    groups = durable(_places(rows, ["_hash"], keep).filter("_n > 1"), "hash-groups")
    shared = skew_join(
        docs.select(ident, hashed(text).alias("_hash"), text.alias("_text"), F.sha2(text, 256).alias("text_sha256")),
        # By merge at every size; the condition lets Spark's runtime filter spare large inputs the shuffle of
        # texts that occur once.
        groups.filter("_n > 1").select("_hash").hint("merge"),
        "_hash",
        ["_id", "text_sha256"],
        counts=groups.select("_hash", F.col("_n").alias("_rows")),
    )
    # Grouped by the texts themselves: equal bytes fall together in each task before the shuffle.
    texts = shared.select("_hash", "_text").distinct().groupBy("_hash").agg(F.count("*").alias("_texts"))
    mixed = durable(texts.filter("_texts > 1").select("_hash"), "collisions")
    if mixed.isEmpty():
        found = _with_places(rows, groups, "_hash")
    else:
        alone = rows.join(mixed, "_hash", "left_anti")
        found = _with_places(alone, groups, "_hash").unionByName(_by_text(shared.join(mixed, "_hash", "left_semi"), keep))
    kept = F.col("_kept._id")
    stays = kept.eqNullSafe(F.col("_id")) & (F.abs("_kept._turn") == F.col("_row"))
    return found.select(
        F.col("_id").alias("doc_id"),
        F.when(F.col("_n").isNull(), F.col("_id")).otherwise(kept).alias("keep_id"),
        F.coalesce("_n", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("_n").isNull(), True).otherwise(stays).alias("kept"),
        "text_sha256",
    )


def _with_places(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    counts = groups.select(key, F.col("_n").alias("_rows"))
    joined = skew_join(rows, groups, key, ["_row"], "left", counts=counts)
    return joined.select("_id", "_row", "text_sha256", "_n", "_kept")


def _by_text(shared: DataFrame, keep: str) -> DataFrame:
    """Rows of a hash that different texts share, with the group of their own text."""
    rows = durable(shared.withColumn("_row", F.monotonically_increasing_id()), "collided")
    # Stored, so that the join has an exchange on both sides and may split a hot text.
    groups = durable(_places(rows, ["_hash", "_text"], keep), "collided-groups")
    return rows.join(groups, ["_hash", "_text"]).select("_id", "_row", "text_sha256", "_n", "_kept")


@query(
    "op13_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
              doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
       FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")
