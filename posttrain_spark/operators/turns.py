"""Chat rendering at turn level: the same texts, counts, spans and masks without gathering a conversation.

Every turn is rendered on its own row.  What it must know about its conversation (first, last and
query turn) and its neighbours (whether they are tool results) is found from keys, roles and flags,
stretch by stretch, so a conversation of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from posttrain_spark.functions.tokens import Counter, token_count, tokens
from posttrain_spark.operators.chat import message_segments
from posttrain_spark.operators.ordering import rank_rows
from posttrain_spark.session import durable
from posttrain_spark.sources.conversations import message_of


# Turns of one conversation that one task orders to find neighbours.
STRETCH = 1_000

# Packs that are cut from one turn in one go.
PACKS_A_BUNCH = 64


def turn_context(turns: DataFrame, key: str, turn: str, content: str) -> DataFrame:
    """What each turn must know of its conversation, from keys, roles and flags alone.

    ``_tool_before`` and ``_tool_after`` are about the true neighbours, whatever numbers are missing
    between them.  Stretches of ``STRETCH`` turn numbers are ordered on their own; their first and last
    turns, one row per stretch, tell the rest.
    """
    wrapped = F.startswith(F.col(content), F.lit("<tool_response>")) & F.endswith(
        F.col(content), F.lit("</tool_response>")
    )
    query = (F.col("role") == "user") & F.col(content).isNotNull() & ~wrapped
    flags = turns.select(
        key,
        turn,
        F.floor(F.col(turn) / STRETCH).cast("long").alias("_stretch"),
        F.coalesce(F.col("role") == "tool", F.lit(False)).alias("_tool"),
        F.when(query, F.col(turn)).alias("_asked"),
    )
    inside = Window.partitionBy(key, "_stretch").orderBy(turn)
    near = flags.withColumns(
        {"_before": F.lag("_tool").over(inside), "_after": F.lead("_tool").over(inside)}
    ).drop("_asked", "_tool")
    stretches = flags.groupBy(key, "_stretch").agg(
        F.min_by("_tool", turn).alias("_opens"),
        F.max_by("_tool", turn).alias("_ends"),
        F.min(turn).alias("_low"),
        F.max(turn).alias("_high"),
        F.max("_asked").alias("_asked"),
    )
    whole, ordered = Window.partitionBy(key), Window.partitionBy(key).orderBy("_stretch")
    stretches = stretches.select(
        key,
        "_stretch",
        F.lag("_ends").over(ordered).alias("_ends_before"),
        F.lead("_opens").over(ordered).alias("_opens_after"),
        F.min("_low").over(whole).alias("_first"),
        F.max("_high").over(whole).alias("_last"),
        F.max("_asked").over(whole).alias("_query"),
    )
    no = F.lit(False)
    return near.join(stretches, [key, "_stretch"]).select(
        key,
        turn,
        "_first",
        "_last",
        "_query",
        F.coalesce("_before", "_ends_before", no).alias("_tool_before"),
        F.coalesce("_after", "_opens_after", no).alias("_tool_after"),
    )


def turn_segments(
    turns: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    content: str = "text",
    template: str = "thinking",
    header_newline: bool = True,
) -> DataFrame:
    """``key``, ``turn`` and the segments of each turn.

    ``turn`` orders a conversation and may have gaps; the texts are shuffled once.
    """
    placed = turns.join(turn_context(turns, key, turn, content), [key, turn])
    segments = message_segments(
        message_of(turns, content),
        is_first=F.col(turn) == F.col("_first"),
        is_last=F.col(turn) == F.col("_last"),
        after_query=F.col(turn) > F.coalesce(F.col("_query"), F.col("_last")),
        tool_before=F.col("_tool_before"),
        tool_after=F.col("_tool_after"),
        template=template,
        header_newline=header_newline,
        system_first=True,
    )
    return placed.select(key, turn, segments.alias("segments"))


def turn_stats(segments: DataFrame, key: str = "conv_id", counter: Counter = "regex") -> DataFrame:
    """Characters, tokens and trained tokens per conversation, pre-aggregated before the shuffle."""
    pieces = segments.select(key, F.explode("segments").alias("s")).select(key, "s.text", "s.gen")
    size = F.col("_size")
    return (
        pieces.withColumn("_size", token_count(F.col("text"), counter))
        .groupBy(key)
        .agg(
            F.sum(F.length("text")).alias("n_chars"),
            F.sum(size).alias("n_tokens"),
            F.sum(F.when(F.col("gen"), size).otherwise(0)).alias("n_loss_tokens"),
        )
    )


def turn_spans(segments: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row per generated stretch of a conversation's rendered text: ``key``, ``turn``, ``span`` (number
    in the conversation, from 1), ``span_start`` and ``span_end`` in characters.

    Lengths alone are sorted and summed up, over conversations of any length; a turn's own spans are
    then moved by the characters of the turns before.
    """
    local = F.aggregate(
        "segments",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda state, s: F.struct(
            (state["at"] + F.length(s["text"])).alias("at"),
            F.when(
                s["gen"],
                F.array_append(
                    state["spans"],
                    F.struct(state["at"].alias("start"), (state["at"] + F.length(s["text"])).alias("end")),
                ),
            ).otherwise(state["spans"]).alias("spans"),
        ),
    )
    sized = segments.select(key, turn, local.alias("_own")).select(
        key, turn, F.col("_own.at").alias("_chars"), F.col("_own.spans").alias("_spans"), F.size("_own.spans").alias("_found")
    )
    placed = rank_rows(
        durable(sized, "turn-lengths"), [F.col(turn)], [key], {"_before": "_chars", "_earlier": "_found"}
    )
    return placed.select(key, turn, "_before", "_earlier", F.posexplode("_spans").alias("_at", "_span")).select(
        key,
        turn,
        (F.col("_earlier") + F.col("_at") + 1).alias("span"),
        (F.col("_before") + F.col("_span.start")).alias("span_start"),
        (F.col("_before") + F.col("_span.end")).alias("span_end"),
    )


def turn_tokens(segments: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``key``, ``turn``, and the ``tokens`` and ``mask`` (1 where trained) of each turn.

    Tokens are cut per segment, so those of a conversation are the same in both forms.
    """
    cut = F.transform(
        "segments", lambda s: F.struct(tokens(s["text"]).alias("t"), s["gen"].cast("int").alias("g"))
    )
    marks = F.transform("_cut", lambda c: F.array_repeat(c["g"], F.size(c["t"])))
    return segments.select(key, turn, cut.alias("_cut")).select(
        key, turn, F.flatten("_cut.t").alias("tokens"), F.flatten(marks).alias("mask")
    )


def turn_masks(marked: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``marked`` (see :func:`turn_tokens`; pass a stored frame) with ``token_start``, the place of the turn's
    first token in its conversation, and ``loss_start``, the trained tokens before it."""
    trained = F.aggregate("mask", F.lit(0), lambda n, x: n + x)
    sized = durable(marked.select(key, turn, F.size("mask").alias("_tokens"), trained.alias("_trained")), "turn-sizes")
    placed = rank_rows(sized, [F.col(turn)], [key], {"token_start": "_tokens", "loss_start": "_trained"})
    return marked.join(placed.select(key, turn, "token_start", "loss_start"), [key, turn])


def pack_turns(marked: DataFrame, max_length: int, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Wrapped packs as ``pack_id``, ``tokens`` and ``mask``, from the turns of :func:`turn_tokens`.

    The stream of all conversations by ``key``, each by ``turn``, is cut every ``max_length`` tokens.  A turn
    is cut where packs end; a conversation longer than many packs never lies in one row.  Pass a
    stored frame.
    """
    sized = durable(marked.select(key, turn, F.size("mask").alias("_tokens")).filter("_tokens > 0"), "turn-sizes")
    placed = rank_rows(sized, [F.col(key), F.col(turn)], sums={"_begin": "_tokens"})
    begin, end = F.col("_begin"), F.col("_begin") + F.col("_tokens")
    cuts = F.sequence(F.floor(begin / max_length).cast("long"), F.floor((end - 1) / max_length).cast("long"))
    pieces = placed.withColumn("pack_id", F.explode(cuts)).withColumn("_low", F.col("pack_id") * max_length)
    start = F.greatest(begin, F.col("_low"))
    pieces = pieces.select(
        key, turn, "pack_id",
        (start - begin).cast("int").alias("_skip"),
        (F.least(end, F.col("_low") + max_length) - start).cast("int").alias("_take"),
        (start - F.col("_low")).alias("at"),
    )
    # A turn that is cut very often is spread by pack before its tokens are sent to the pieces.
    ranges = pieces.withColumn("_bunch", F.floor(F.col("pack_id") / PACKS_A_BUNCH)).groupBy(key, turn, "_bunch").agg(
        F.collect_list(F.struct("pack_id", "_skip", "_take", "at")).alias("_pieces")
    )
    cut = ranges.join(marked, [key, turn]).select("tokens", "mask", F.explode("_pieces").alias("p")).select(
        "p.pack_id",
        F.struct(
            F.col("p.at").alias("at"),
            F.slice("tokens", F.col("p._skip") + 1, F.col("p._take")).alias("tokens"),
            F.slice("mask", F.col("p._skip") + 1, F.col("p._take")).alias("mask"),
        ).alias("_piece"),
    )
    packs = cut.groupBy("pack_id").agg(F.array_sort(F.collect_list("_piece")).alias("_pieces"))
    return packs.select(
        "pack_id", F.flatten("_pieces.tokens").alias("tokens"), F.flatten("_pieces.mask").alias("mask")
    )
