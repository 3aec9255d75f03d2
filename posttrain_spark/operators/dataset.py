"""Dataset assembly."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from posttrain_spark.functions.tokens import Counter, token_count
from posttrain_spark.operators.ordering import cut_after, number_rows, shuffle_key
from posttrain_spark.operators.skew import skew_join
from posttrain_spark.session import durable

# Fixed value.
SYSTEM_PROMPT = "You are a helpful assistant. Follow the user's instructions carefully."


def make_prompt(df: DataFrame, system_prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """Add ``prompt``: a fixed system message and the first message's content as the user."""
    message = "struct<role:string,content:string>"
    first = F.get(F.col("messages"), F.lit(0))["content"]
    return df.withColumn(
        "prompt",
        F.array(
            F.struct(F.lit("system"), F.lit(system_prompt)).cast(message),
            F.struct(F.lit("user"), first).cast(message),
        ),
    )


def select_columns(df: DataFrame, columns: Sequence[str] = ("prompt", "ground_truth")) -> DataFrame:
    return df.select(*columns)


def filter_long_prompts(df: DataFrame, max_tokens: int = 4096, counter: Counter = "regex") -> DataFrame:
    """Keep rows whose last prompt message has at most ``max_tokens`` tokens."""
    content = F.get(F.col("prompt"), F.size("prompt") - 1)["content"]
    return df.filter(token_count(content, counter) <= max_tokens)


def cap_rows(df: DataFrame, n: int = 1_000_000, key: str = "conv_id") -> DataFrame:
    """The first ``min(n, rows)`` rows by a numeric ``key``, NULL first; ties are cut by a digest.

    The cap is a comparison with the value of the n-th row, so no task ever holds the result.
    """
    return cut_after(df, key, n)[0]


def limit_samples(df: DataFrame, n: int = 3, key: str = "item_id") -> DataFrame:
    """A smoke-run sample: the first few rows by ``key``."""
    return df.orderBy(key).limit(n)


def truncate(df: DataFrame, max_length: int, columns: Sequence[str] = ("tokens", "mask")) -> DataFrame:
    """Cut token arrays (and their masks) to ``max_length``; 0 or less means no limit."""
    if max_length <= 0:
        return df
    return df.withColumns({c: F.slice(F.col(c), 1, max_length) for c in columns})


def mix(sources: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Concatenate datasets on common columns, keeping duplicates; ``source`` names the origin."""
    parts = [df.select(*columns, F.lit(name).alias("source")) for name, df in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def shuffle(df: DataFrame, key: Column | str, seed: int = 42) -> DataFrame:
    """Seeded total order: a range-partitioned sort on the digest of the key."""
    key = F.col(key) if isinstance(key, str) else key
    return df.orderBy(shuffle_key(key, seed), key)


def train_eval_split(
    df: DataFrame, key: str, n: int = 200, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Exact-size hold-out: train and eval, ``n`` rows (or all there are) to eval.

    Both sides are a comparison with the shuffle position of the n-th row; neither needs a join.
    """
    held, rest = cut_after(df, key, n, seed=seed)
    return rest, held


def expand_generations(df: DataFrame, n: int = 8) -> DataFrame:
    """``n`` rows per prompt with ``sample_idx`` 0 to n - 1."""
    return df.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def pack_wrapped(
    df: DataFrame, key: str, max_length: int, n_tokens: str = "n_tokens", tie: str | None = None
) -> DataFrame:
    """Concatenate token streams in ``key`` order and cut every ``max_length`` tokens.

    One row per piece: ``pack_id``, the key, and the piece as ``start`` / ``end`` token positions
    inside its example.  Only key and length are moved, never the texts.
    """
    columns = [key, n_tokens] + ([tie] if tie else [])
    # Filtered after it is stored, else lengths would be computed for the filter and once more.
    lengths = durable(df.select(*columns), "pack-lengths").filter(F.col(n_tokens) > 0)
    placed = number_rows(lengths, key, weight=n_tokens, tie=tie)
    begin, end = F.col("offset"), F.col("offset") + F.col(n_tokens)
    size = F.lit(max_length).cast("long")
    first = F.floor(begin / size).cast("long")
    last = F.floor((end - 1) / size).cast("long")
    pieces = placed.withColumn("pack_id", F.explode(F.sequence(first, last)))
    pack_start = F.col("pack_id") * size
    return pieces.select(
        "pack_id",
        *[c for c in columns if c != n_tokens],
        (F.greatest(begin, pack_start) - begin).alias("start"),
        (F.least(end, pack_start + size) - begin).alias("end"),
        (F.greatest(begin, pack_start) - pack_start).alias("pack_start"),
    )


def materialize_packs(pieces: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """Training rows ``pack_id``, ``tokens``, ``mask`` from the pieces of :func:`pack_wrapped`.

    ``tokens`` holds ``key``, ``tokens`` and ``mask`` per example.  An example cut into very many pieces
    is split over tasks by pack; a pack gathers at most its length in tokens.
    """
    cut = F.col("end") - F.col("start")
    begin = (F.col("start") + 1).cast("int")
    sliced = skew_join(pieces, tokens.select(key, "tokens", "mask"), key, ["pack_id"]).select(
        "pack_id",
        F.struct(
            "pack_start",
            F.slice("tokens", begin, cut.cast("int")).alias("tokens"),
            F.slice("mask", begin, cut.cast("int")).alias("mask"),
        ).alias("_piece"),
    )
    packs = sliced.groupBy("pack_id").agg(F.array_sort(F.collect_list("_piece")).alias("_pieces"))
    return packs.select(
        "pack_id",
        F.flatten("_pieces.tokens").alias("tokens"),
        F.flatten("_pieces.mask").alias("mask"),
    )


def rl_prompts(
    df: DataFrame,
    key: str,
    system_prompt: str = SYSTEM_PROMPT,
    max_tokens: int = 4096,
    n_eval: int = 200,
    seed: int = 42,
    counter: Counter = "regex",
) -> tuple[DataFrame, DataFrame]:
    """Train and eval prompts from rows with ``messages`` and ``ground_truth``: build, prune, drop long
    ones, hold out."""
    built = make_prompt(df, system_prompt).select(key, "prompt", "ground_truth")
    return train_eval_split(filter_long_prompts(built, max_tokens, counter), key, n_eval, seed)


def best_fit(lengths: Sequence[int], max_length: int) -> list[int]:
    """Bin of each length, longest first, each into the fullest bin that still holds it."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    open_bins: list[list[int]] = [[] for _ in range(max_length + 1)]
    mask, bins, placed = 0, 0, [0] * len(lengths)
    for i in order:
        size = lengths[i]
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            target = open_bins[room].pop()
            if not open_bins[room]:
                mask &= ~(1 << room)
        else:
            room, target = max_length, bins
            bins += 1
        placed[i] = target
        left = room - size
        if left:
            open_bins[left].append(target)
            mask |= 1 << left
    return placed


def _pack_groups(items: DataFrame, group: str, length: str, max_length: int, number: str) -> DataFrame:
    """Add ``number``: the best-fit-decreasing bin of each item in its group, which one task packs."""
    order = [(c, "ascending") for c in items.columns if c != group]
    schema = items.withColumn(number, F.lit(0).cast("int")).schema

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(order)
        bins = best_fit(rows[length].to_pylist(), max_length)
        return rows.append_column(number, pa.array(bins, pa.int32()))

    return items.groupBy(group).applyInArrow(pack, schema)


def _merge_half_empty(packs: DataFrame, max_length: int, rows_per_shard: int) -> DataFrame | None:
    """Where packs go that are joined with half-empty packs of other shards: ``shard``, ``pack``, ``to_shard``,
    ``to_pack``; None where at most one pack is half empty."""
    half = durable(packs.filter(F.col("_used") * 2 <= max_length), "half-packs")
    count = half.count()
    if count < 2:
        return None
    # Two to a shard at least, so that every round joins some.
    shards = -(-count // max(rows_per_shard, 2))
    dealt = half.withColumn("_group", F.pmod(F.xxhash64("shard", "pack"), F.lit(shards)).cast("int"))
    bins = durable(_pack_groups(dealt, "_group", "_used", max_length, "_bin"), "joined-packs")
    heads = bins.groupBy("_group", "_bin").agg(F.min(F.struct("shard", "pack")).alias("_to"))
    moves = bins.join(heads, ["_group", "_bin"])
    return moves.select("shard", "pack", F.col("_to.shard").alias("to_shard"), F.col("_to.pack").alias("to_pack"))


def pack_bfd(
    df: DataFrame,
    key: str,
    max_length: int,
    n_tokens: str = "n_tokens",
    shards: int | None = None,
    rows_per_shard: int = 250_000,
) -> DataFrame:
    """Best-fit-decreasing packs that never split an example; longer ones count as ``max_length``.

    Examples are spread over shards of bounded size, also those that share a key or have none, and each
    shard is packed on its own.  That leaves one half-empty pack per shard at most.  These packs are
    gathered from all shards and packed again, as whole items, in as many rounds as their number needs;
    so in the end at most one pack is half empty, as in a single packing, and there are fewer than
    twice the tokens by the length, and one.  Result: the key, ``shard``, ``pack`` (the first of those that
    were joined) and the packed length.
    """
    used = F.least(F.col(n_tokens), F.lit(max_length)).cast("int")
    lengths = durable(
        df.select(key, used.alias("packed_tokens")).filter("packed_tokens > 0").withColumn(
            "_row", F.monotonically_increasing_id()
        ),
        "pack-lengths",
    )
    if shards is None:
        shards = max(1, -(-lengths.count() // rows_per_shard))
    sharded = lengths.withColumn("shard", F.pmod(F.xxhash64(key, "_row"), F.lit(shards)).cast("int"))
    packed = durable(_pack_groups(sharded, "shard", "packed_tokens", max_length, "pack").drop("_row"), "packed")
    while True:
        fills = packed.groupBy("shard", "pack").agg(F.sum("packed_tokens").alias("_used"))
        moves = _merge_half_empty(fills, max_length, rows_per_shard)
        if moves is None:
            return packed
        moved = packed.join(moves, ["shard", "pack"], "left")
        packed = durable(
            moved.withColumns({"shard": F.coalesce("to_shard", "shard"), "pack": F.coalesce("to_pack", "pack")})
            .select(packed.columns),
            "packed",
        )


def batch_plan(
    df: DataFrame,
    key: str,
    per_device: int = 4,
    accumulation: int = 4,
    world: int = 8,
    epochs: int = 1,
    max_steps: int = -1,
    seed: int | None = None,
) -> DataFrame:
    """Where each row is trained: ``epoch``, optimizer ``step``, ``micro_step`` and ``device``.

    A step takes ``per_device * accumulation * world`` rows; the last step of an epoch may be
    short.  ``max_steps`` of 0 or less means no limit.
    """
    keys = durable(df.select(key), "batch-keys")
    across = per_device * world
    per_step = across * accumulation
    steps = F.ceil(F.lit(keys.count()) / per_step).cast("long")
    at = F.col("ordinal")
    plan = number_rows(keys, key, seed=seed).withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))
    )
    in_step = at % per_step
    plan = plan.select(
        key,
        "ordinal",
        "epoch",
        (F.col("epoch") * steps + F.floor(at / per_step)).cast("long").alias("step"),
        F.floor(in_step / across).cast("int").alias("micro_step"),
        F.floor((at % across) / per_device).cast("int").alias("device"),
    )
    return plan.filter(F.col("step") < max_steps) if max_steps > 0 else plan


def with_first_checkpoint(plan: DataFrame, save_steps: int = 500) -> DataFrame:
    """Add ``first_checkpoint``: the earliest saved step whose training had seen the row."""
    return plan.withColumn(
        "first_checkpoint", (F.floor(F.col("step") / save_steps) + 1) * save_steps
    )


def seen_by(plan: DataFrame, checkpoint: int) -> DataFrame:
    """Rows that training had used when ``checkpoint-<n>`` was saved."""
    return plan.filter(F.col("step") < checkpoint)


def seen_counts(plan: DataFrame, save_steps: int = 500) -> DataFrame:
    """Rows used up to each checkpoint: ``checkpoint`` and ``rows_seen``."""
    per_checkpoint = (
        with_first_checkpoint(plan, save_steps)
        .groupBy(F.col("first_checkpoint").alias("checkpoint"))
        .agg(F.count("*").alias("new_rows"))
    )
    # One row per checkpoint: bounded by steps / save_steps.
    up_to = Window.orderBy("checkpoint").rowsBetween(Window.unboundedPreceding, 0)
    return per_checkpoint.select("checkpoint", F.sum("new_rows").over(up_to).alias("rows_seen"))
