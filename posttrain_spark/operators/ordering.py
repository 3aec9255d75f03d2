"""Global row numbers, prefix sums and exact cuts without a one-partition window or a driver sketch.

Ranks take two distributed passes.  Rows are sorted over range partitions and stored once with their
partition and place; the totals of the partitions, one row each, give every partition its start, which
is joined back.  A cut after n rows needs no order at all: the value of the n-th row is found by counting
value ranges, and both sides are a comparison with it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, FloatType

from posttrain_spark.session import durable

# A partition is ordered by one task: it holds about so many rows.
ROWS_PER_PARTITION = 100_000

# Value ranges counted at once, and rows whose values the driver may look at one by one.
CELLS = 1_024
FEW = 10_000


def shuffle_key(key: Column, seed: int = 42) -> Column:
    """Pseudo-random order of ``key`` for a seed; equal on every engine with md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def default_partitions(df: DataFrame) -> int:
    """Follows the number of rows; at least the session's shuffle partitions."""
    shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, shuffles, -(-df.count() // ROWS_PER_PARTITION))


def in_ranges(
    df: DataFrame, order: Sequence[Column], group: Sequence[str] = (), partitions: int | None = None
) -> DataFrame:
    """``df`` sorted by ``group`` and ``order`` over range partitions, not yet stored, with ``_slot``.

    ``_slot`` grows in that order: the partition in its upper, the place in the partition in its lower 33
    bits.  Rows equal in all of it are told apart by their place in the input, so a value that a third
    of all rows share is cut over several partitions like any other.  ``df`` is read twice (bounds are
    drawn first): pass a stored frame.
    """
    partitions = partitions or default_partitions(df)
    names = [f"_order{i}" for i in range(len(order))]
    keyed = df.withColumns({**dict(zip(names, order)), "_place": F.monotonically_increasing_id()})
    by = [*(F.col(f"`{g}`") for g in group), *names, "_place"]
    ranged = keyed.repartitionByRange(partitions, *by).sortWithinPartitions(*by)
    return ranged.select(
        *(F.col(f"`{c}`") for c in df.columns), F.monotonically_increasing_id().alias("_slot")
    )


def slot_partition() -> Column:
    """The range partition of a row of :func:`in_ranges`."""
    return F.shiftright("_slot", 33)


def rank_rows(
    df: DataFrame,
    order: Sequence[Column],
    group: Sequence[str] = (),
    sums: Mapping[str, str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``ordinal`` (position from 0) by ascending ``order``, and sums of columns over the rows before.

    ``sums`` names the added columns and what they sum up (NULL counts as 0).  Positions and sums run
    over the whole frame, or start anew in every ``group``; NULL is a group like any other.  NULL keys
    come first.  A group of any size is spread over range partitions: only one row per partition and
    group takes part in the sums that place the partitions.
    """
    placed = durable(in_ranges(df, order, group, partitions), "ranks").withColumn("_part", slot_partition())
    amounts = {n: F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0)) for n, c in (sums or {}).items()}
    keys = [F.col(f"`{g}`") for g in group]
    totals = placed.groupBy(*keys, "_part").agg(
        F.count("*").alias("_rows"),
        F.min("_slot").alias("_low"),
        *(F.sum(a).alias(f"_sum{i}") for i, a in enumerate(amounts.values())),
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)

    def earlier(column: str) -> Column:
        return F.coalesce(F.sum(column).over(before), F.lit(0))

    starts = totals.select(
        F.col("_part").alias("_start_part"),
        *(k.alias(f"_start{i}") for i, k in enumerate(keys)),
        (earlier("_rows") - F.col("_low")).alias("_first"),
        *(earlier(f"_sum{i}").alias(f"_base{i}") for i in range(len(amounts))),
    )
    same = F.col("_part") == F.col("_start_part")
    for i, k in enumerate(keys):
        same = same & k.eqNullSafe(F.col(f"_start{i}"))
    added = {"ordinal": F.col("_first") + F.col("_slot")}
    inside = Window.partitionBy("_part", *keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    for i, (name, amount) in enumerate(amounts.items()):
        placed = placed.withColumn(f"_run{i}", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        added[name] = F.col(f"_base{i}") + F.col(f"_run{i}")
    found = placed.join(starts, same)
    return found.select(*(F.col(f"`{c}`") for c in df.columns), *(v.alias(n) for n, v in added.items()))


def number_rows(
    df: DataFrame,
    key: str,
    weight: str | None = None,
    tie: str | None = None,
    seed: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``ordinal`` and, with ``weight``, ``offset``, as :func:`rank_rows` does.

    The order is by ``key`` (NULL first), then by the digest of ``tie``.  With ``seed`` it is the seeded
    shuffle order of ``key`` instead.  Pass a stored, narrow frame.
    """
    column = F.col(f"`{key}`")
    if seed is not None:
        order = [shuffle_key(column, seed), column] + ([F.col(f"`{tie}`")] if tie else [])
    else:
        order = [column] + ([shuffle_key(F.col(f"`{tie}`")), F.col(f"`{tie}`")] if tie else [])
    return rank_rows(df, order, sums={"offset": weight} if weight else None, partitions=partitions)


def _kind(value: Column, floating: bool) -> Column:
    """0 for NULL, 1 for minus infinity, 2 for numbers, 3 for infinity, 4 for NaN: in the sort order."""
    kind = F.when(value.isNull(), 0)
    if floating:
        inf = float("inf")
        kind = kind.when(F.isnan(value), 4).when(value == inf, 3).when(value == -inf, 1)
    return kind.otherwise(2)


def _holding(parts: list, by: str, n: int, below: int) -> tuple:
    """The part with the n-th row, if any, and the rows below it; parts are in the order of ``by``."""
    for part in sorted(parts, key=lambda p: p[by]):
        if below + part["rows"] >= n:
            return part, below
        below += part["rows"]
    return None, below


def nth_value(
    df: DataFrame, value: Column, n: int, bounds: tuple[float, float] | None = None
) -> tuple[object, int, int] | None:
    """The value of the n-th row (from 1) by a numeric ``value``, NULL first and NaN last; the number of
    rows below it, and of rows equal to it.  None where there are fewer rows.

    Exact: ranges of equal width are counted, at most ``CELLS`` at once, and the one with the n-th row is
    counted again until it holds few rows.  No row is moved and no order is made.  ``bounds`` save the pass
    that looks for them where all values are known to be numbers between two others, as digests are.
    """
    rows = df.select(value.alias("v"))
    floating = isinstance(rows.schema["v"].dataType, (FloatType, DoubleType))
    rows = rows.withColumns({"kind": _kind(F.col("v"), floating), "x": F.col("v").cast("double")})
    below, held = 0, None
    if bounds is None:
        kinds = rows.groupBy("kind").agg(
            F.count("*").alias("rows"), F.min("x").alias("low"), F.max("x").alias("high"), F.first("v").alias("v")
        )
        kind, below = _holding(kinds.collect(), "kind", n, below)
        if kind is None:
            return None
        if kind["kind"] != 2:
            return kind["v"], below, kind["rows"]
        held, bounds = kind["rows"], (kind["low"], kind["high"])
    low, high = bounds
    rows = rows.filter("kind = 2")
    # Halves, so that the width of any two doubles is finite.
    while held is None or held > FEW and high / 2 > low / 2:
        part = (F.col("x") / 2 - low / 2) / (high / 2 - low / 2)
        cells = (
            rows.filter(F.col("x").between(low, high))
            .groupBy(F.least(F.floor(part * CELLS), F.lit(CELLS - 1)).alias("cell"))
            .agg(F.count("*").alias("rows"), F.min("x").alias("low"), F.max("x").alias("high"))
        )
        cell, below = _holding(cells.collect(), "cell", n, below)
        if cell is None:
            return None
        held, low, high = cell["rows"], cell["low"], cell["high"]
    values = rows.filter(F.col("x").between(low, high)).groupBy("v").agg(F.count("*").alias("rows"))
    found, below = _holding(values.collect(), "v", n, below)
    return found["v"], below, found["rows"]


def _below(value: Column, bound) -> Column:
    """Whether ``value`` comes before ``bound``; NULL comes first, NaN last."""
    return F.lit(False) if bound is None else value.isNull() | (value < F.lit(bound))


def _json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))


# The values of :func:`_number`.
DIGITS = (0.0, 2.0**52)


def _number(digest: Column) -> Column:
    """The first 13 digits of a hex digest: exact as a double."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def cut_after(
    df: DataFrame, key: str, n: int, seed: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The first ``min(n, rows)`` rows in the order of :func:`number_rows`, and the rest.

    Both sides are a comparison with the key of the n-th row.  Only where some, not all, of the rows with
    that key are taken, those rows (and no others) are cut further by a digest of the whole row; rows
    equal in every column are counted out as copies.  So the cut is exact for any key: repeated, NULL,
    or the same in all rows.  ``df`` is read a few times for its key alone: pass a stored frame or one
    that is cheap to read.
    """
    nothing = df.filter(F.lit(False))
    if n <= 0:
        return nothing, df
    column, digest = F.col(f"`{key}`"), F.md5(_json(df))
    whole = [(_number(digest), DIGITS), (_number(F.substring(digest, 14, 13)), DIGITS)]
    if seed is None:
        levels = [(column, None), *whole]
    else:
        shuffled = shuffle_key(column, seed)
        levels = [(_number(shuffled), DIGITS), (_number(F.substring(shuffled, 14, 13)), DIGITS), *whole]
    first, left, same = F.lit(False), n, F.lit(True)
    for level, bounds in levels:
        found = nth_value(df.filter(same), level, left, bounds)
        if found is None:
            return df, nothing
        bound, below, equal = found
        first = first | (same & _below(level, bound))
        same = same & level.eqNullSafe(F.lit(bound))
        left -= below
        if left == equal:
            return df.filter(first | same), df.filter(~(first | same))
    copies = df.filter(same).limit(1)

    def repeated(times: int) -> DataFrame:
        return copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_copy")

    return (
        df.filter(first).unionByName(repeated(left)),
        df.filter(~(first | same)).unionByName(repeated(equal - left)),
    )
