"""Conversation, prompt and benchmark readers (A1 - A3) and the dataset writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from posttrain_spark.functions.text import find_all, parent_name

MESSAGE = (
    "struct<role:string,content:string,reasoning_content:string,"
    "tool_calls:array<struct<name:string,arguments:string>>>"
)
MESSAGES = f"array<{MESSAGE}>"
_CALL = "name:{t},arguments:{t}"
_MESSAGE_FILE = (
    "array<struct<role:string,content:{t},reasoning_content:{t},"
    "tool_calls:array<struct<{c},function:struct<{c}>>>>>"
)
# Unrolled and possessive: strings of any length are matched without recursion.
JSON_PIECES = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]++'


def spaced_json(text: Column) -> Column:
    """Compact JSON with a space after each comma and colon outside of strings."""

    def space(piece: Column) -> Column:
        return F.when(piece.startswith('"'), piece).otherwise(
            F.regexp_replace(piece, "([,:])", "$1 ")
        )

    return F.array_join(F.transform(find_all(text, JSON_PIECES), space), "")


def messages_from_json(text: Column) -> Column:
    """Message list of a JSON text.

    Content that is not a string becomes NULL.  A ``function`` wrapper around a tool call is
    removed; arguments given as a string are kept as they are, an object is printed as JSON.
    """
    raw = F.from_json(text, _MESSAGE_FILE.format(t="string", c=_CALL.format(t="string")))
    typed = F.from_json(text, _MESSAGE_FILE.format(t="variant", c=_CALL.format(t="variant")))

    def is_text(value: Column) -> Column:
        return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))

    def call(pair: Column) -> Column:
        wrapped = pair["a"]["function"].isNotNull()
        plain = F.when(wrapped, pair["a"]["function"]["arguments"]).otherwise(pair["a"]["arguments"])
        kind = F.when(wrapped, pair["b"]["function"]["arguments"]).otherwise(pair["b"]["arguments"])
        return F.struct(
            F.when(wrapped, pair["a"]["function"]["name"]).otherwise(pair["a"]["name"]).alias("name"),
            F.when(is_text(kind), plain).otherwise(spaced_json(plain)).alias("arguments"),
        )

    def message(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        calls = F.zip_with(
            a["tool_calls"], b["tool_calls"], lambda x, y: F.struct(x.alias("a"), y.alias("b"))
        )
        return F.struct(
            a["role"].alias("role"),
            F.when(is_text(b["content"]), a["content"]).alias("content"),
            F.when(is_text(b["reasoning_content"]), a["reasoning_content"]).alias(
                "reasoning_content"
            ),
            F.transform(calls, call).alias("tool_calls"),
        )

    pairs = F.zip_with(raw, typed, lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    return F.transform(pairs, message).cast(MESSAGES)


def message_of(turns: DataFrame, content: str = "text") -> Column:
    """The message struct of a turn row; reasoning and tool calls are optional columns."""
    names = {"role": "role", "content": content}
    names |= {n: n for n in ("reasoning_content", "tool_calls")}
    fields = [
        (F.col(c) if c in turns.columns else F.lit(None)).alias(n) for n, c in names.items()
    ]
    return F.struct(*fields).cast(MESSAGE)


def turns_to_conversations(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", content: str = "text"
) -> DataFrame:
    """One row per conversation from one row per turn.

    A conversation is one record of the dataset (its message list is one value), so its size is
    bounded by what a record may hold.  Reports that only need counts per conversation should use
    :func:`posttrain_spark.operators.turns.turn_stats`, which does not gather the texts.
    """
    message = F.struct(F.col(turn).alias("turn"), message_of(turns, content).alias("message"))
    ordered = F.array_sort(F.collect_list(message))
    return turns.groupBy(key).agg(F.transform(ordered, lambda m: m["message"]).alias("messages"))


def first_messages(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", content: str = "text"
) -> DataFrame:
    """One row per conversation with a message list of its first message only.

    Prompts need no more than that, so the other turns are dropped before the shuffle and no
    conversation is gathered.
    """
    first = F.min_by(message_of(turns, content), F.col(turn))
    return turns.groupBy(key).agg(F.array(first).alias("messages"))


def read_conversations(spark: SparkSession, path: str, key: str = "conv_id") -> DataFrame:
    """Conversations from Parquet (nested, or one row per turn) or from JSON lines.

    JSON lines hold ``messages`` and optionally ``tools``; a ``split=`` directory level becomes a
    partition column.
    """
    if path.rstrip("/").endswith((".json", ".jsonl")):
        lines = spark.read.text(path)
        fields = F.from_json("value", "messages string, tools array<string>")
        return lines.select("value", fields.alias("_f")).select(
            F.get_json_object("value", f"$.{key}").try_cast("long").alias(key),
            messages_from_json(F.col("_f.messages")).alias("messages"),
            F.transform("_f.tools", spaced_json).alias("tools"),
        )
    df = spark.read.parquet(path)
    return df if "messages" in df.columns else turns_to_conversations(df, key)


def read_split(df: DataFrame, split: str = "train") -> DataFrame:
    """Rows of one split; on a partitioned dataset only its directories are listed and read."""
    return df.filter(F.col("split") == split)


def write_dataset(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy("split").parquet(path)


def read_benchmark(spark: SparkSession, root: str, name: str = "*", schema: str = "item_id long, text string") -> DataFrame:
    """Items of ``<root>/<benchmark>/*.jsonl`` with the benchmark's name."""
    items = spark.read.schema(schema).json(f"{root}/{name}/*.jsonl")
    return items.withColumn("benchmark", parent_name(F.col("_metadata.file_path")))
