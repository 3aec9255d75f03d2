"""Chat queries over ``conversations``.

Tool turns, think blocks, tool calls, wrapped tool responses and unknown roles are written into the
turns by conversation id, so every rule of the format is met.  The SQL twins work on turns and glue
the pieces together, the queries work on message arrays (or, for ``turn_*``, on turns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from posttrain_spark.operators import chat as C
from posttrain_spark.operators import turns as T
from posttrain_spark.plans import sql as S
from posttrain_spark.plans.registry import query, table
from posttrain_spark.session import durable
from posttrain_spark.sources.conversations import read_conversations, turns_to_conversations

NL = "chr(10)"
ROLE = (
    "CASE WHEN role = 'assistant' AND conv_id % 5 = 3 AND turn % 4 = 1 THEN 'tool' "
    "WHEN role = 'user' AND conv_id % 5 = 3 AND turn % 4 = 2 THEN 'tool' "
    "WHEN conv_id % 11 = 7 AND turn = 1 THEN 'critic' ELSE role END"
)
TEXT = (
    "CASE WHEN role = 'assistant' AND (conv_id + turn) % 4 = 1 "
    f"THEN concat('<think>', {NL}, 'plan ', turn, {NL}, {NL}, '</think>', {NL}, {NL}, text) "
    f"WHEN role = 'assistant' AND (conv_id + turn) % 4 = 2 THEN concat({NL}, text) "
    "WHEN role = 'user' AND conv_id % 6 = 1 AND turn > 1 THEN concat('<tool_response>', text, '</tool_response>') "
    "ELSE text END"
)
CALLS = "conv_id % 7 = 2 AND role = 'assistant'"
TOOLS = """concat('{"name": "lookup", "limit": ', conv_id, '}')"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = (
        f"CASE WHEN {CALLS} THEN array(named_struct('name', 'lookup', 'arguments', concat('{{\"id\": ', turn, '}}')), "
        "named_struct('name', 'stop', 'arguments', '{}')) END AS tool_calls"
    )
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", f"{ROLE} AS role", f"{TEXT} AS text", calls
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns_to_conversations(turns(spark, sf_dir))


def _pieces(template: str, generated: str = "true") -> str:
    """CTE ``p``: per turn the text before, inside and after the generated part."""
    newline = f"|| {NL}" if template == "thinking" else ""
    return f"""t AS (SELECT conv_id, turn, {ROLE} AS r, {TEXT} AS c, {CALLS} AS calls FROM conversations),
    q AS (SELECT conv_id, min(turn) AS lo, max(turn) AS hi, coalesce(max(CASE WHEN r = 'user' AND NOT
            (starts_with(c, '<tool_response>') AND suffix(c, '</tool_response>')) THEN turn END), max(turn)) AS ask
          FROM t GROUP BY 1),
    n AS (SELECT t.*, lo, hi, ask, lag(r) OVER w AS pr, lead(r) OVER w AS nr,
            strpos(c, '</think>') > 0 AS tagged FROM t JOIN q USING (conv_id) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    s AS (SELECT *, CASE WHEN tagged THEN ltrim(list_extract(string_split(rtrim(string_split(c, '</think>')[1], {NL}), '<think>'), -1), {NL}) ELSE '' END AS why,
            CASE WHEN tagged THEN ltrim(list_extract(string_split(c, '</think>'), -1), {NL}) ELSE c END AS said FROM n),
    p AS (SELECT conv_id, turn,
      CASE WHEN r = 'assistant' THEN '<|im_start|>assistant' || {NL} {newline}
           WHEN r IN ('user', 'system') THEN '<|im_start|>' || r || {NL} || c || '<|im_end|>' || {NL}
           WHEN r = 'tool' THEN (CASE WHEN turn = lo OR pr <> 'tool' THEN '<|im_start|>user' ELSE '' END) || {NL} || '<tool_response>' || {NL} || c || {NL}
             || '</tool_response>' || (CASE WHEN turn = hi OR nr <> 'tool' THEN '<|im_end|>' || {NL} ELSE '' END)
           ELSE '' END AS head,
      CASE WHEN r = 'assistant' THEN
        (CASE WHEN turn > ask AND (turn = hi OR why <> '') THEN '<think>' || {NL} || trim(why, {NL}) || {NL} || '</think>' || {NL} || {NL} || ltrim(said, {NL}) ELSE said END)
        || (CASE WHEN calls THEN (CASE WHEN said <> '' THEN {NL} ELSE '' END) || '<tool_call>' || {NL} || '{{"name": "lookup", "arguments": {{"id": ' || turn || '}}}}' || {NL} || '</tool_call>'
            || {NL} || '<tool_call>' || {NL} || '{{"name": "stop", "arguments": {{}}}}' || {NL} || '</tool_call>' ELSE '' END)
        ELSE '' END AS body,
      CASE WHEN r = 'assistant' THEN '<|im_end|>' || {NL} ELSE '' END AS tail FROM s)"""


_THINKING, _PLAIN = _pieces("thinking"), _pieces("nonthinking")
_FULL = "string_agg(head || body || tail, '' ORDER BY turn)"


def _digest(df: DataFrame) -> DataFrame:
    return df.select(
        "conv_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars")
    )


@query(
    "render_chat",
    f"""WITH {_THINKING}, x AS (SELECT conv_id, {_FULL} || '<|im_start|>assistant' || {NL} || {NL} AS text FROM p GROUP BY 1)
        SELECT conv_id, md5(text) AS text_md5, length(text) AS n_chars FROM x""",
)
def render_chat(spark, sf_dir):
    return _digest(C.render_chat(conversations(spark, sf_dir), add_generation_prompt=True))


@query(
    "render_nonthinking",
    f"""WITH {_PLAIN}, x AS (SELECT conv_id, {_FULL} || '<|im_start|>assistant' || {NL} || '<think>' || {NL} || {NL} || '</think>' || {NL} || {NL} AS text
          FROM p GROUP BY 1) SELECT conv_id, md5(text) AS text_md5, length(text) AS n_chars FROM x""",
)
def render_nonthinking(spark, sf_dir):
    return _digest(
        C.render_chat(conversations(spark, sf_dir), template="nonthinking", add_generation_prompt=True)
    )


@query(
    "render_no_thinking_prompt",
    f"""WITH {_THINKING}, x AS (SELECT conv_id, {_FULL} || '<|im_start|>assistant' || {NL} || {NL} || '<think>' || {NL} || {NL} || '</think>' || {NL} || {NL} AS text
          FROM p GROUP BY 1) SELECT conv_id, md5(text) AS text_md5, length(text) AS n_chars FROM x""",
)
def render_no_thinking_prompt(spark, sf_dir):
    return _digest(
        C.render_chat(conversations(spark, sf_dir), add_generation_prompt=True, enable_thinking=False)
    )


@query(
    "render_tools",
    f"""WITH {_THINKING}, y AS (SELECT p.*, r, c, lo FROM p JOIN s USING (conv_id, turn)),
      x AS (SELECT conv_id, '<|im_start|>system' || {NL}
        || coalesce(max(CASE WHEN turn = lo AND r = 'system' THEN c || {NL} || {NL} END), '')
        || {S.quoted(C.TOOLS_BEFORE)} || {NL} || {TOOLS} || {S.quoted(C.TOOLS_AFTER)}
        || coalesce(string_agg(CASE WHEN turn = lo AND r = 'system' THEN '' ELSE head || body || tail END, '' ORDER BY turn), '') AS text
        FROM y GROUP BY conv_id)
      SELECT conv_id, md5(text) AS text_md5, length(text) AS n_chars FROM x""",
)
def render_tools(spark, sf_dir):
    df = conversations(spark, sf_dir).withColumn("tools", F.expr(f"array({TOOLS})"))
    return _digest(C.render_chat(df, tools="tools"))


_SPANS = f"""WITH {_THINKING}, z AS (SELECT conv_id, turn, body,
      coalesce(sum(length(head || body || tail)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        + length(head) AS a FROM p)"""


@query(
    "generation_spans",
    _SPANS + """ SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS span,
      a::BIGINT AS span_start, (a + length(body))::BIGINT AS span_end FROM z WHERE body <> ''""",
)
def generation_spans(spark, sf_dir):
    df = C.generation_spans(C.render_chat(conversations(spark, sf_dir)))
    return df.select("conv_id", F.posexplode("spans").alias("pos", "s")).select(
        "conv_id", (F.col("pos") + 1).cast("long").alias("span"),
        F.col("s.start").cast("long").alias("span_start"), F.col("s.end").cast("long").alias("span_end"),
    )


# Tokens of each turn, and whether each is trained.
MARKED = f"""{_THINKING},
    cut AS (SELECT conv_id, turn, {S.find('head', S.TOKENS)} AS h, {S.find('body', S.TOKENS)} AS b, {S.find('tail', S.TOKENS)} AS t FROM p),
    marked AS (SELECT conv_id, turn, h || b || t AS tokens,
      list_transform(h, lambda x: '0') || list_transform(b, lambda x: '1') || list_transform(t, lambda x: '0') AS mask FROM cut)"""


@query(
    "loss_mask",
    f"""WITH {MARKED} SELECT conv_id, sum(len(tokens))::BIGINT AS n_tokens,
      sum(len(list_filter(mask, lambda m: m = '1')))::BIGINT AS n_loss_tokens,
      md5(coalesce(string_agg(array_to_string(tokens, ' '), ' ' ORDER BY turn) FILTER (len(tokens) > 0), '')) AS tokens_md5,
      md5(string_agg(array_to_string(mask, ''), '' ORDER BY turn)) AS mask_md5 FROM marked GROUP BY 1""",
)
def loss_mask(spark, sf_dir):
    df = C.loss_mask(C.render_chat(conversations(spark, sf_dir)))
    return df.select(
        "conv_id", F.size("mask").cast("long").alias("n_tokens"),
        F.col("n_loss_tokens").cast("long").alias("n_loss_tokens"),
        F.md5(F.array_join("tokens", " ")).alias("tokens_md5"),
        F.md5(F.array_join(F.col("mask").cast("array<string>"), "")).alias("mask_md5"),
    )


@query(
    "turn_spans",
    _SPANS + """ SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS span,
      a::BIGINT AS span_start, (a + length(body))::BIGINT AS span_end FROM z WHERE body <> ''""",
)
def turn_spans(spark, sf_dir):
    return T.turn_spans(T.turn_segments(turns(spark, sf_dir)))


_EARLIER = "OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    "turn_masks",
    f"""WITH {MARKED}, sized AS (SELECT *, len(tokens) AS n, len(list_filter(mask, lambda m: m = '1')) AS k FROM marked)
        SELECT conv_id, turn, coalesce(sum(n) {_EARLIER}, 0)::BIGINT AS token_start, coalesce(sum(k) {_EARLIER}, 0)::BIGINT AS loss_start,
          md5(array_to_string(tokens, ' ')) AS tokens_md5, md5(array_to_string(mask, '')) AS mask_md5 FROM sized""",
)
def turn_masks(spark, sf_dir):
    marked = durable(T.turn_tokens(T.turn_segments(turns(spark, sf_dir))), "turn-tokens")
    return T.turn_masks(marked).select(
        "conv_id", "turn", "token_start", "loss_start", F.md5(F.array_join("tokens", " ")).alias("tokens_md5"),
        F.md5(F.array_join(F.col("mask").cast("array<string>"), "")).alias("mask_md5"),
    )


@query(
    "pack_turns",
    f"""WITH {MARKED}, one AS (SELECT conv_id, turn, unnest(tokens) AS token, unnest(mask) AS m, generate_subscripts(tokens, 1) AS k FROM marked),
      placed AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn, k) - 1 AS place FROM one)
      SELECT place // 512 AS pack_id, count(*) AS n_tokens, md5(string_agg(token, ' ' ORDER BY place)) AS tokens_md5,
        md5(string_agg(m, '' ORDER BY place)) AS mask_md5 FROM placed GROUP BY 1""",
)
def pack_turns(spark, sf_dir):
    marked = durable(T.turn_tokens(T.turn_segments(turns(spark, sf_dir))), "turn-tokens")
    return T.pack_turns(marked, 512).select(
        "pack_id", F.size("mask").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"),
        F.md5(F.array_join(F.col("mask").cast("array<string>"), "")).alias("mask_md5"),
    )


@query(
    "turn_stats",
    f"""WITH {_THINKING} SELECT conv_id, sum(length(head || body || tail))::BIGINT AS n_chars,
      sum({S.token_count('head')} + {S.token_count('body')} + {S.token_count('tail')})::BIGINT AS n_tokens,
      sum({S.token_count('body')})::BIGINT AS n_loss_tokens FROM p GROUP BY 1""",
)
def turn_stats(spark, sf_dir):
    return T.turn_stats(T.turn_segments(turns(spark, sf_dir)))


@query(
    "turn_segments",
    f"""WITH {_PLAIN} SELECT conv_id, turn, md5(head || body || tail) AS text_md5 FROM p""",
)
def turn_segments(spark, sf_dir):
    segments = T.turn_segments(turns(spark, sf_dir), template="nonthinking")
    return segments.select(
        "conv_id", "turn", F.md5(F.array_join(F.col("segments.text"), "")).alias("text_md5")
    )


@query(
    "split_reasoning",
    f"""WITH {_THINKING} SELECT conv_id, turn, md5(why) AS reasoning_md5, md5(said) AS content_md5, tagged
        FROM s WHERE r = 'assistant'""",
)
def split_reasoning(spark, sf_dir):
    parts = C.split_reasoning(F.col("text"))
    return turns(spark, sf_dir).filter("role = 'assistant'").select(
        "conv_id", "turn", F.md5(parts["reasoning"]).alias("reasoning_md5"),
        F.md5(parts["content"]).alias("content_md5"),
        F.contains("text", F.lit("</think>")).alias("tagged"),
    )


@query(
    "last_query",
    f"WITH {_THINKING} SELECT conv_id, (ask - lo)::BIGINT AS last_query FROM q",
)
def last_query(spark, sf_dir):
    return conversations(spark, sf_dir).select(
        "conv_id", C.last_query_index(F.col("messages")).cast("long").alias("last_query")
    )


@query(
    "read_conversations",
    """SELECT conv_id, count(*) AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles,
         md5(string_agg(text, '|' ORDER BY turn)) AS contents_md5 FROM conversations GROUP BY 1""",
)
def read_all(spark, sf_dir):
    df = read_conversations(spark, f"{sf_dir}/conversations.parquet")
    return df.select(
        "conv_id", F.size("messages").cast("long").alias("n_messages"),
        F.array_join(F.col("messages.role"), ",").alias("roles"),
        F.md5(F.array_join(F.col("messages.content"), "|")).alias("contents_md5"),
    )
