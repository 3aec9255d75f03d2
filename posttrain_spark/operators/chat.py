"""Chat rendering and loss spans (D1 - D14) with higher-order functions only.

A message list becomes an array of segments, each a piece of text with a flag telling whether the
model is trained to generate it.  The rendered text, the character spans and the token mask are
three readings of that array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from posttrain_spark.functions.text import let
from posttrain_spark.functions.tokens import tokens

SEGMENTS = "array<struct<text:string,gen:boolean>>"

# Fixed values of the chat format.
IM_START = "<|im_start|>"
IM_END = "<|im_end|>\n"
EMPTY_THINK = "<think>\n\n</think>\n\n"
TOOLS_BEFORE = (
    "# Tools\n\nYou may call one or more functions to assist with the user query.\n\n"
    "You are provided with function signatures within <tools></tools> XML tags:\n<tools>"
)
TOOLS_AFTER = (
    "\n</tools>\n\nFor each function call, return a json object with function name and arguments "
    'within <tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, '
    '"arguments": <args-json-object>}\n</tool_call><|im_end|>\n'
)


def _nl() -> Column:
    return F.lit("\n")


def _segment(text: Column, gen: bool = False) -> Column:
    return F.struct(text.alias("text"), F.lit(gen).alias("gen"))


def _turn(role: str | Column, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.concat(F.lit(IM_START), role, _nl(), content, F.lit(IM_END))


def last_query_index(messages: Column) -> Column:
    """Index of the last user message that is not a wrapped tool response; else the last index."""

    def position(m: Column, i: Column) -> Column:
        wrapped = F.startswith(m["content"], F.lit("<tool_response>")) & F.endswith(
            m["content"], F.lit("</tool_response>")
        )
        return F.when((m["role"] == "user") & m["content"].isNotNull() & ~wrapped, i)

    return F.coalesce(F.array_max(F.transform(messages, position)), F.size(messages) - 1)


def split_reasoning(content: Column, explicit: Column | None = None) -> Column:
    """``struct<reasoning, content>``; explicit reasoning wins over a think block in the text."""
    explicit = F.lit(None).cast("string") if explicit is None else explicit
    before = F.rtrim(F.substring_index(content, "</think>", 1), _nl())
    thought = F.ltrim(F.substring_index(before, "<think>", -1), _nl())
    rest = F.ltrim(F.substring_index(content, "</think>", -1), _nl())
    tagged = F.contains(content, F.lit("</think>"))
    return F.struct(
        F.when(explicit.isNotNull(), explicit).when(tagged, thought).otherwise("").alias("reasoning"),
        F.when(explicit.isNull() & tagged, rest).otherwise(content).alias("content"),
    )


def _tool_calls(calls: Column, content: Column) -> Column:
    def one(call: Column, k: Column) -> Column:
        gap = F.when((k > 0) | (F.length(content) > 0), "\n").otherwise("")
        return F.concat(
            gap, F.lit('<tool_call>\n{"name": "'), F.coalesce(call["name"], F.lit("")),
            F.lit('", "arguments": '), F.coalesce(call["arguments"], F.lit("null")),
            F.lit("}\n</tool_call>"),
        )

    return F.coalesce(F.array_join(F.transform(calls, one), ""), F.lit(""))


def _assistant(m: Column, after_query: Column, is_last: Column, thinking: bool, newline: bool) -> Column:
    def body(parts: Column) -> Column:
        said = parts["content"]
        block = F.concat(
            F.lit("<think>\n"), F.btrim(parts["reasoning"], _nl()), F.lit("\n</think>\n\n"),
            F.ltrim(said, _nl()),
        )
        shown = after_query & (is_last | (F.length(parts["reasoning"]) > 0))
        return F.concat(F.when(shown, block).otherwise(said), _tool_calls(m["tool_calls"], said))

    text = let(
        split_reasoning(F.coalesce(m["content"], F.lit("")), m["reasoning_content"]), body
    )
    header = IM_START + "assistant\n" + ("\n" if newline else "")
    return F.array(_segment(F.lit(header)), _segment(text, thinking), _segment(F.lit(IM_END)))


def _tool_result(content: Column, opens: Column, closes: Column) -> Column:
    return F.concat(
        F.when(opens, IM_START + "user").otherwise(""),
        F.lit("\n<tool_response>\n"), content, F.lit("\n</tool_response>"),
        F.when(closes, IM_END).otherwise(""),
    )


def message_segments(
    m: Column,
    is_first: Column,
    is_last: Column,
    after_query: Column,
    tool_before: Column,
    tool_after: Column,
    template: str = "thinking",
    header_newline: bool = True,
    system_first: bool = False,
) -> Column:
    """Segments of one message from its place in the conversation.

    A leading system message belongs to the head of the text; ``system_first`` prints it here.
    Roles that the format does not know print nothing.
    """
    thinking = template == "thinking"
    content = F.coalesce(m["content"], F.lit(""))
    inline = m["role"] == "system" if system_first else (m["role"] == "system") & ~is_first
    plain = F.when((m["role"] == "user") | inline, _turn(m["role"], content)).when(
        m["role"] == "tool",
        _tool_result(content, is_first | ~tool_before, is_last | ~tool_after),
    )
    spoken = _assistant(m, after_query, is_last, thinking, header_newline and thinking)
    return (
        F.when(m["role"] == "assistant", spoken)
        .when(plain.isNotNull(), F.array(_segment(plain)))
        .otherwise(F.array().cast(SEGMENTS))
    )


def chat_segments(
    messages: str = "messages",
    tools: str | None = None,
    template: str = "thinking",
    add_generation_prompt: bool = False,
    enable_thinking: bool | None = None,
    header_newline: bool = True,
    last_query: Column | None = None,
) -> Column:
    """Segments of a rendered conversation.

    ``template`` is ``thinking`` or ``nonthinking``.  With ``tools=None`` the tool header is left
    out of the plan altogether.  ``header_newline`` keeps the newline that the thinking template
    leaves between the assistant header and the generated part.
    """
    if template not in ("thinking", "nonthinking"):
        raise ValueError(f"unknown template: {template!r}")
    thinking = template == "thinking"
    newline = header_newline and thinking
    msgs = F.col(messages)
    last_query = last_query_index(msgs) if last_query is None else last_query
    count = F.size(msgs)

    def role_at(i: Column) -> Column:
        return F.coalesce(F.get(msgs, i)["role"], F.lit(""))

    def render(m: Column, i: Column) -> Column:
        return message_segments(
            m,
            is_first=i == 0,
            is_last=i == count - 1,
            after_query=i > last_query,
            tool_before=role_at(i - 1) == "tool",
            tool_after=role_at(i + 1) == "tool",
            template=template,
            header_newline=header_newline,
        )

    first = F.get(msgs, F.lit(0))
    system = F.when(first["role"] == "system", F.coalesce(first["content"], F.lit("")))
    head = F.coalesce(_turn("system", system), F.lit(""))
    if tools is not None:
        listed = F.transform(F.col(tools), lambda t: F.concat(_nl(), t))
        with_tools = F.concat(
            F.lit(IM_START + "system\n"),
            F.coalesce(F.concat(system, F.lit("\n\n")), F.lit("")),
            F.lit(TOOLS_BEFORE), F.array_join(listed, ""), F.lit(TOOLS_AFTER),
        )
        head = F.when(F.size(F.col(tools)) > 0, with_tools).otherwise(head)
    parts = [F.array(_segment(head)), F.flatten(F.transform(msgs, render))]
    if add_generation_prompt:
        opening = IM_START + "assistant\n" + ("\n" if newline else "")
        if not thinking:
            parts.append(F.array(_segment(F.lit(opening + EMPTY_THINK))))
        elif enable_thinking is False:
            parts.append(F.array(_segment(F.lit(opening)), _segment(F.lit(EMPTY_THINK), True)))
        else:
            parts.append(F.array(_segment(F.lit(opening))))
    return F.filter(F.concat(*parts), lambda s: F.length(s["text"]) > 0)


def render_chat(df: DataFrame, messages: str = "messages", **options) -> DataFrame:
    """Add ``segments`` and the rendered ``text``; options as in :func:`chat_segments`.

    The last query is bound around the whole list.  As a column of its own it would be folded into
    the per-message expression and searched for once per message.
    """
    segments = let(
        last_query_index(F.col(messages)),
        lambda last: chat_segments(messages, last_query=last, **options),
    )
    return df.withColumn("segments", segments).withColumn(
        "text", F.array_join(F.col("segments.text"), "")
    )


def generation_spans(df: DataFrame, block: int = 256) -> DataFrame:
    """Add ``spans``: character ranges of the rendered text that the model generates.

    Segments are walked in blocks, so the growing list is copied once per block and not once per
    segment; long conversations stay cheap.
    """

    def empty(at: Column) -> Column:
        none = F.array().cast("array<struct<start:int,end:int>>")
        return F.struct(at.alias("at"), none.alias("spans"))

    def step(state: Column, s: Column) -> Column:
        end = state["at"] + F.length(s["text"])
        span = F.struct(state["at"].alias("start"), end.alias("end"))
        found = F.when(s["gen"], F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), found.alias("spans"))

    def walk(state: Column, part: Column) -> Column:
        # The list inside a block starts empty and is joined to the rest at its end.
        return F.aggregate(
            part,
            empty(state["at"]),
            step,
            lambda done: F.struct(
                done["at"].alias("at"), F.concat(state["spans"], done["spans"]).alias("spans")
            ),
        )

    starts = F.sequence(F.lit(1), F.greatest(F.size("segments"), F.lit(1)), F.lit(block))
    blocks = F.transform(starts, lambda i: F.slice("segments", i, F.lit(block)))
    return df.withColumn("spans", F.aggregate(blocks, empty(F.lit(0)), walk, lambda s: s["spans"]))


def loss_mask(df: DataFrame) -> DataFrame:
    """Add ``tokens``, ``mask`` (1 inside generated spans) and ``n_loss_tokens``.

    Tokens are cut per segment, so a token never crosses the edge of a span.
    """
    cut = F.transform(
        "segments",
        lambda s: F.struct(tokens(s["text"]).alias("tokens"), s["gen"].cast("int").alias("gen")),
    )
    marks = F.transform("_cut", lambda c: F.array_repeat(c["gen"], F.size(c["tokens"])))
    return (
        df.withColumn("_cut", cut)
        .withColumn("tokens", F.flatten(F.col("_cut.tokens")))
        .withColumn("mask", F.flatten(marks))
        .withColumn("n_loss_tokens", F.aggregate("mask", F.lit(0), lambda a, x: a + x))
        .drop("_cut")
    )
