"""Mixing sources to target weights by hierarchical budgets.

Sources form a tree: domain, language, source.  A token budget flows from the root to the leaves.
At every node it is shared among the children by weight; a child whose subtree cannot use its share
(its tokens times the allowed epochs) is filled, and what it leaves goes to its siblings, again by
weight.  Only when a whole family is filled does the rest go to the family's own siblings, one level
up.  Each leaf then takes whole epochs and, from one more seeded epoch, the longest prefix of
documents that its rest of the budget holds.

Everything is DataFrame operations.  The tree has one row per (domain, language, source).  Order
within a leaf is by digest and is never sorted as a whole: documents fall into ``BUCKETS`` buckets
by digest, the buckets' tokens are summed, and only the one bucket in which a leaf's budget ends is
ordered document by document.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from posttrain_spark.plans.registry import query, table
from posttrain_spark.session import durable

WORD = r"[^\x20\x09-\x0D]+"
# Buckets of the digest order; a leaf's budget ends in one of them.
BUCKETS = 65_536
LEVELS = ("_domain", "_language", "_source")
WIDE = "decimal(38,0)"


def _named(column: Column) -> Column:
    """A key that keeps NULL and the empty text apart."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("?"))


def _weight(level: int, weights: Mapping[tuple[str, ...], int]) -> Column:
    """Weight of a node by its path; 1 where none is given."""
    own = {path: w for path, w in weights.items() if len(path) == level + 1}
    if not own:
        return F.lit(1).cast(WIDE)
    path = F.concat_ws("\x1f", *LEVELS[: level + 1])
    chain = F
    for names, w in sorted(own.items()):
        chain = chain.when(path == "\x1f".join(f"={n}" for n in names), F.lit(w))
    return chain.otherwise(F.lit(1)).cast(WIDE)


def _share(nodes: DataFrame, level: int, budget: str) -> DataFrame:
    """Adds ``_budget_<level>``: what each node gets of its parent's ``budget``.

    Families fill up by rising capacity per weight.  A node is filled when its capacity is at most
    its part of what is left for it and those after it; the rest share what is left by weight,
    rounded down.
    """
    family = Window.partitionBy(*LEVELS[:level]) if level else Window.partitionBy(F.lit(0))
    rising = family.orderBy(F.col("_cap").cast("double") / F.col("_weight").cast("double"), LEVELS[level])
    before = F.coalesce(F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("_weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    left = F.col(budget) - F.col("_before")
    full = F.col("_cap") * F.col("_after") <= left * F.col("_weight")
    rest = F.col(budget) - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(family), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("_weight"))).over(family)
    return (
        nodes.withColumn("_before", before.cast(WIDE))
        .withColumn("_after", after.cast(WIDE))
        .withColumn("_full", full)
        .withColumn("_rest", rest.cast(WIDE))
        .withColumn("_open", open_weight.cast(WIDE))
        .withColumn(
            f"_budget_{level}",
            F.when(F.col("_full"), F.col("_cap")).otherwise(F.expr("(_rest * _weight) div _open")).cast(WIDE),
        )
        .drop("_before", "_after", "_full", "_rest", "_open")
    )


def budgets(
    leaves: DataFrame,
    weights: Mapping[tuple[str, ...], int],
    share: tuple[int, int],
    epochs: int,
) -> DataFrame:
    """Token budget of every leaf.  ``leaves`` has the three keys and ``_tokens``.

    The root's budget is ``share`` (a fraction) of all tokens; no leaf gets more than ``epochs``
    times its tokens.
    """
    part, whole = share
    tree = leaves.withColumn("_cap", (F.col("_tokens") * F.lit(epochs)).cast(WIDE))
    total = leaves.agg(F.sum("_tokens")).first()[0] or 0
    tree = tree.withColumn("_root", F.lit(str(int(total) * part // whole)).cast(WIDE))
    root = tree.select(*LEVELS, "_tokens", "_cap", "_root")
    got, budget = None, "_root"
    for level in range(len(LEVELS)):
        keys = LEVELS[: level + 1]
        nodes = root.groupBy(*keys).agg(F.sum("_cap").cast(WIDE).alias("_cap"), F.first("_root").alias("_root"))
        if got is not None:
            nodes = nodes.join(got.select(*LEVELS[:level], budget), list(LEVELS[:level]))
        got = _share(nodes.withColumn("_weight", _weight(level, weights)), level, budget)
        budget = f"_budget_{level}"
    return root.select(*LEVELS, "_tokens").join(
        got.select(*LEVELS, F.col(budget).cast("long").alias("_budget")), list(LEVELS)
    )


def mix_sources(
    docs: DataFrame,
    domain: Column,
    language: Column,
    source: Column,
    weights: Mapping[tuple[str, ...], int],
    share: tuple[int, int] = (1, 1),
    epochs: int = 1,
    seed: int = 42,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """The rows drawn for the mix, with all columns of ``docs`` and ``_epoch``, ``_tokens``, the keys.

    A row is returned once per epoch it is drawn in (``_epoch`` from 0).  Tokens are words; a NULL
    or empty text has none and is drawn where it stands in the order; a leaf without any tokens is
    drawn once.  NULL keys form leaves of their own.  Order within an epoch: md5 of seed, epoch and id, then id, tokens and a hash of the
    text, so rows that repeat an id have a place each.  ``docs`` may have any other columns; those
    named like one of the added ones are replaced.  An empty table gives an empty result.
    """
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"),
        _named(domain).alias("_domain"),
        _named(language).alias("_language"),
        _named(source).alias("_source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("_tokens"),
        F.col(doc_id).cast("string").alias("_id"),
    )
    leaves = durable(keyed.groupBy(*LEVELS).agg(F.sum("_tokens").alias("_tokens")), "leaves")
    plan = budgets(leaves, weights, share, epochs)
    plan = durable(
        plan.select(
            *LEVELS,
            F.when(F.col("_tokens") > 0, F.expr("_budget div _tokens")).otherwise(F.lit(1)).alias("_whole"),
            F.when(F.col("_tokens") > 0, F.col("_budget") % F.col("_tokens")).otherwise(F.lit(0)).alias("_part"),
        ),
        "plan",
    )

    def placed(rows: DataFrame, leaf_table: DataFrame) -> DataFrame:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_whole").cast("string"), F.coalesce("_id", F.lit("?"))))
        return (
            rows.join(leaf_table, list(LEVELS))
            .withColumn("_digest", digest)
            .withColumn("_bucket", F.conv(F.substring("_digest", 1, 4), 16, 10).cast("int"))
        )

    summed = placed(keyed.drop("_row"), plan).groupBy(*LEVELS, "_part", "_bucket").agg(F.sum("_tokens").alias("_sum"))
    order = Window.partitionBy(*LEVELS).orderBy("_bucket")
    running = summed.withColumn("_until", F.sum("_sum").over(order))
    # The first bucket that does not fit; NULL where all fit.
    ends = running.filter("_until > _part").groupBy(*LEVELS).agg(
        F.min("_bucket").alias("_last"),
        F.min(F.col("_until") - F.col("_sum")).alias("_taken"),
    )
    ends = durable(plan.join(ends, list(LEVELS), "left"), "ends")

    rows = placed(keyed, ends)
    inside = F.sum("_tokens").over(
        Window.partitionBy(*LEVELS)
        .orderBy("_digest", "_id", "_tokens", F.xxhash64(F.col("_row")[text]))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    last = (
        rows.filter((F.col("_bucket") == F.col("_last")) & (F.col("_part") > 0))
        .withColumn("_inside", inside)
        .filter(F.col("_taken") + F.col("_inside") <= F.col("_part"))
        .drop("_inside")
        .withColumn("_epoch", F.col("_whole"))
    )
    below = F.col("_last").isNull() | (F.col("_bucket") < F.col("_last"))
    drawn = F.col("_whole") + F.when(below & (F.col("_part") > 0), 1).otherwise(0)
    bulk = rows.filter(drawn > 0).withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), drawn - 1)))
    chosen = bulk.unionByName(last)
    own = ("_epoch", "_tokens", *LEVELS)
    kept = [F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in own]
    return chosen.select(*kept, F.col("_epoch").cast("int").alias("_epoch"), "_tokens", *LEVELS)


# Production targets: the domains of the given sources, and their weights.
DOMAINS = ("web", "books", "code", "forum", "news")
WEIGHTS = {
    ("web",): 4, ("books",): 2, ("code",): 2,
    ("web", "en"): 3, ("books", "en"): 2, ("forum", "en"): 2,
    ("web", "en", "src0"): 2,
}


def domain_of(source: Column) -> Column:
    """Domain by the number of the source, four sources to a domain; other names are their own."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int")
    name = F.element_at(F.array(*map(F.lit, DOMAINS)), F.pmod(F.floor(number / 4), F.lit(len(DOMAINS))).cast("int") + 1)
    return F.coalesce(name, F.lit("other"))


_ORACLE = r"""
WITH docs AS (
  SELECT doc_id, text, coalesce('=' || lang, '?') AS l, coalesce('=' || source, '?') AS s,
    '=' || coalesce((['web', 'books', 'code', 'forum', 'news'])[
      (TRY_CAST(regexp_extract(source, '([0-9]{1,9})$', 1) AS INT) // 4) % 5 + 1], 'other') AS d,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents),
leaves AS (SELECT d, l, s, sum(tokens)::HUGEINT AS tokens, sum(tokens)::HUGEINT * 2 AS cap FROM docs GROUP BY d, l, s),
n0 AS (
  SELECT d, sum(cap)::HUGEINT AS cap, CASE d WHEN '=web' THEN 4 WHEN '=books' THEN 2 WHEN '=code' THEN 2 ELSE 1 END AS w,
    (SELECT sum(tokens)::HUGEINT * 3 // 4 FROM leaves) AS b FROM leaves GROUP BY d),
f0 AS (
  SELECT *, cap * sum(w) OVER (ORDER BY cap / w::DOUBLE, d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <=
    (b - coalesce(sum(cap) OVER (ORDER BY cap / w::DOUBLE, d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS f
  FROM n0),
b0 AS (
  SELECT d, CASE WHEN f THEN cap ELSE (b - coalesce(sum(cap) FILTER (f) OVER (), 0))::HUGEINT * w
    // (sum(w) FILTER (NOT f) OVER ())::HUGEINT END AS b FROM f0),
n1 AS (
  SELECT d, l, sum(cap)::HUGEINT AS cap, CASE d || l WHEN '=web=en' THEN 3 WHEN '=books=en' THEN 2
    WHEN '=forum=en' THEN 2 ELSE 1 END AS w, any_value(b0.b) AS b FROM leaves JOIN b0 USING (d) GROUP BY d, l),
f1 AS (
  SELECT *, cap * sum(w) OVER (PARTITION BY d ORDER BY cap / w::DOUBLE, l ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <=
    (b - coalesce(sum(cap) OVER (PARTITION BY d ORDER BY cap / w::DOUBLE, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS f
  FROM n1),
b1 AS (
  SELECT d, l, CASE WHEN f THEN cap ELSE (b - coalesce(sum(cap) FILTER (f) OVER (PARTITION BY d), 0))::HUGEINT * w
    // (sum(w) FILTER (NOT f) OVER (PARTITION BY d))::HUGEINT END AS b FROM f1),
n2 AS (
  SELECT d, l, s, tokens, cap, CASE d || l || s WHEN '=web=en=src0' THEN 2 ELSE 1 END AS w, b
  FROM leaves JOIN b1 USING (d, l)),
f2 AS (
  SELECT *, cap * sum(w) OVER (PARTITION BY d, l ORDER BY cap / w::DOUBLE, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <=
    (b - coalesce(sum(cap) OVER (PARTITION BY d, l ORDER BY cap / w::DOUBLE, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS f
  FROM n2),
b2 AS (
  SELECT d, l, s, tokens, CASE WHEN f THEN cap ELSE (b - coalesce(sum(cap) FILTER (f) OVER (PARTITION BY d, l), 0))::HUGEINT * w
    // (sum(w) FILTER (NOT f) OVER (PARTITION BY d, l))::HUGEINT END AS b FROM f2),
plan AS (SELECT d, l, s, CASE WHEN tokens > 0 THEN b // tokens ELSE 1 END AS whole,
  CASE WHEN tokens > 0 THEN b % tokens ELSE 0 END AS part FROM b2),
ordered AS (
  SELECT docs.*, whole, part, sum(tokens) OVER (PARTITION BY d, l, s
    ORDER BY md5('42:' || whole || ':' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until
  FROM docs JOIN plan USING (d, l, s)),
drawn AS (
  SELECT *, unnest(range(0, (whole + CASE WHEN part > 0 AND until <= part THEN 1 ELSE 0 END)::BIGINT)) AS epoch FROM ordered)
SELECT doc_id, d[2:] AS domain, l[2:] AS lang, s[2:] AS source, epoch::INT AS epoch, tokens AS n_tokens FROM drawn
"""


@query("op2_mixing", _ORACLE)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    drawn = mix_sources(
        docs, domain_of(F.col("source")), F.col("lang"), F.col("source"), WEIGHTS, share=(3, 4), epochs=2
    )
    return drawn.select(
        "doc_id",
        F.substring("_domain", 2, 1_000).alias("domain"),
        "lang",
        "source",
        F.col("_epoch").alias("epoch"),
        F.col("_tokens").alias("n_tokens"),
    )
