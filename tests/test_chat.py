import json

import pytest
from pyspark.sql import functions as F

from posttrain_spark.operators import chat as C
from posttrain_spark.operators.turns import turn_segments, turn_stats
from posttrain_spark.sources.conversations import MESSAGES, read_conversations, turns_to_conversations

SCHEMA = f"conv_id long, messages {MESSAGES}"


def m(role, content, reasoning=None, calls=None):
    return (role, content, reasoning, calls)


def render(spark, messages, **options):
    df = spark.createDataFrame([(1, messages)], SCHEMA)
    return C.render_chat(df, **options).first()


def user(text):
    return f"<|im_start|>user\n{text}<|im_end|>\n"


def said(body, newline="\n"):
    return f"<|im_start|>assistant\n{newline}{body}<|im_end|>\n"


def test_system_first_and_later(spark):
    row = render(spark, [m("system", "S"), m("user", "U"), m("system", "T"), m("critic", "x")])
    assert row.text == "<|im_start|>system\nS<|im_end|>\n" + user("U") + "<|im_start|>system\nT<|im_end|>\n"


def test_last_answer_gets_a_think_block_earlier_ones_lose_theirs(spark):
    row = render(spark, [m("user", "a"), m("assistant", "<think>\nr1\n</think>\n\nx"), m("user", "b"), m("assistant", "y")])
    assert row.text == user("a") + said("x") + user("b") + said("<think>\n\n</think>\n\ny")


def test_reasoning_after_the_last_query_is_kept(spark):
    messages = [m("user", "a"), m("assistant", "<think>\nr\n</think>\n\nx"), m("tool", "t1"), m("tool", "t2"), m("assistant", "\ny", "why\n")]
    tools = "<|im_start|>user\n<tool_response>\nt1\n</tool_response>\n<tool_response>\nt2\n</tool_response><|im_end|>\n"
    want = user("a") + said("<think>\nr\n</think>\n\nx") + tools + said("<think>\nwhy\n</think>\n\ny")
    assert render(spark, messages).text == want


def test_wrapped_tool_response_is_not_a_query(spark):
    messages = [m("user", "q"), m("assistant", "p", "r"), m("user", "<tool_response>z</tool_response>"), m("assistant", "e")]
    row = render(spark, messages)
    assert said("<think>\nr\n</think>\n\np") in row.text
    df = spark.createDataFrame([(1, messages)], SCHEMA)
    assert df.select(C.last_query_index(F.col("messages"))).first()[0] == 0


def test_tool_calls(spark):
    calls = [("f", '{"a": 1}'), ("g", "{}")]
    body = '<tool_call>\n{"name": "f", "arguments": {"a": 1}}\n</tool_call>\n<tool_call>\n{"name": "g", "arguments": {}}\n</tool_call>'
    row = render(spark, [m("assistant", "hi", None, calls), m("user", "u"), m("assistant", None, None, calls), m("user", "v")])
    assert row.text == said("hi\n" + body) + user("u") + said(body) + user("v")


def test_generation_prompt_forms(spark):
    msgs = [m("user", "u")]
    empty = "<think>\n\n</think>\n\n"
    assert render(spark, msgs, add_generation_prompt=True).text == user("u") + "<|im_start|>assistant\n\n"
    got = render(spark, msgs, add_generation_prompt=True, enable_thinking=False)
    assert got.text == user("u") + "<|im_start|>assistant\n\n" + empty
    plain = render(spark, msgs, add_generation_prompt=True, template="nonthinking")
    assert plain.text == user("u") + "<|im_start|>assistant\n" + empty
    bare = render(spark, msgs, add_generation_prompt=True, header_newline=False)
    assert bare.text == user("u") + "<|im_start|>assistant\n"
    with pytest.raises(ValueError):
        C.chat_segments(template="other")


def test_nonthinking_has_no_spans(spark):
    df = spark.createDataFrame([(1, [m("user", "u"), m("assistant", "a")])], SCHEMA)
    assert C.generation_spans(C.render_chat(df, template="nonthinking")).first().spans == []


def test_spans_and_mask_cover_the_answer_only(spark):
    df = spark.createDataFrame([(1, [m("user", "u"), m("assistant", "one two"), m("user", "v")])], SCHEMA)
    row = C.loss_mask(C.generation_spans(C.render_chat(df))).first()
    assert [row.text[s.start : s.end] for s in row.spans] == ["one two"]
    assert [t for t, k in zip(row.tokens, row["mask"]) if k] == ["one", "two"]
    assert len(row.tokens) == len(row["mask"]) and row.n_loss_tokens == 2


def test_tool_switch(spark):
    df = spark.createDataFrame([(1, [m("system", "S"), m("user", "u")], ["{}"])], SCHEMA + ", tools array<string>")
    on = C.render_chat(df, tools="tools").first().text
    assert on == "<|im_start|>system\nS\n\n" + C.TOOLS_BEFORE + "\n{}" + C.TOOLS_AFTER + user("u")
    assert C.render_chat(df).first().text == "<|im_start|>system\nS<|im_end|>\n" + user("u")
    none = df.withColumn("tools", F.array().cast("array<string>"))
    assert C.render_chat(none, tools="tools").first().text == "<|im_start|>system\nS<|im_end|>\n" + user("u")


def test_json_lines(spark, tmp_path):
    message = {"role": "assistant", "content": ["x"], "tool_calls": [
        {"function": {"name": "f", "arguments": {"b": 1, "a": "x,y: z"}}}, {"name": "g", "arguments": '{"q":1}'}]}
    path = tmp_path / "c.jsonl"
    path.write_text(json.dumps({"conv_id": 7, "messages": [message], "tools": [{"name": "f"}]}) + "\n")
    row = read_conversations(spark, str(path)).first()
    got = row.messages[0]
    assert row.conv_id == 7 and got.content is None and row.tools == ['{"name": "f"}']
    assert [tuple(c) for c in got.tool_calls] == [("f", json.dumps({"b": 1, "a": "x,y: z"})), ("g", '{"q":1}')]


def test_turn_level_equals_conversation_level(spark, monkeypatch):
    """Also for a conversation that holds most of the rows."""
    from posttrain_spark.operators import skew

    monkeypatch.setattr(skew, "MIN_ROWS", 100)
    roles = ["system", "user", "assistant", "tool", "tool", "assistant", "user", "assistant"]
    rows = [(c, t, roles[(t + c) % len(roles)], f"<think>r</think>w{t} x" if t % 3 else f"t{t}")
            for c, n in ((1, 400), (2, 7), (3, 1), (4, 8)) for t in range(n)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = C.loss_mask(C.render_chat(turns_to_conversations(turns))).select(
        "conv_id", F.length("text").alias("n_chars"), F.size("tokens").alias("n_tokens"), "n_loss_tokens"
    )
    stats = turn_stats(turn_segments(turns))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, stats.collect()))


def test_turn_level_spans_masks_and_packs(spark, monkeypatch):
    """Gathered and turn-level forms agree, with a conversation over many range partitions and turn gaps."""
    from posttrain_spark.operators import ordering, turns as T

    monkeypatch.setattr(ordering, "ROWS_PER_PARTITION", 40)
    monkeypatch.setattr(T, "PACKS_A_BUNCH", 2)
    roles = ["system", "user", "assistant", "tool", "tool", "assistant", "user", "assistant"]
    rows = [(c, t * 3 - 5, roles[(t + c) % len(roles)], f"<think>r</think>w{t} x" if t % 3 else f"t{t}")
            for c, n in ((1, 400), (2, 7), (3, 1), (4, 8)) for t in range(n)]
    rows += [(5, 1, "critic", "not rendered"), (6, 2, "assistant", "many " * 90), (7, 0, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r.conv_id: r for r in C.loss_mask(C.generation_spans(C.render_chat(turns_to_conversations(turns)))).collect()}
    segments = turn_segments(turns)
    spans, masks = {}, {}
    for r in sorted(T.turn_spans(segments).collect()):
        spans.setdefault(r.conv_id, []).append((r.span_start, r.span_end))
        assert r.span == len(spans[r.conv_id])
    marked = T.turn_tokens(segments).cache()
    for r in sorted(T.turn_masks(marked).collect()):
        at = masks.setdefault(r.conv_id, ([], []))
        assert (r.token_start, r.loss_start) == (len(at[0]), sum(at[1]))
        at[0].extend(r.tokens)
        at[1].extend(r["mask"])
    for key, row in whole.items():
        assert spans.get(key, []) == [(s.start, s.end) for s in row.spans]
        assert masks[key] == (row.tokens, row["mask"])
    stream = [x for key in sorted(whole) for x in zip(whole[key].tokens, whole[key]["mask"])]
    packs = sorted(T.pack_turns(marked, 7).collect())
    assert [p.pack_id for p in packs] == list(range(len(packs)))
    assert all(len(p.tokens) == 7 for p in packs[:-1])
    assert [x for p in packs for x in zip(p.tokens, p["mask"])] == stream
    assert T.turn_spans(segments.limit(0)).collect() == [] == T.pack_turns(marked.limit(0), 7).collect()


def test_spans_over_many_blocks(spark):
    messages = [m("user" if i % 2 else "assistant", f"w{i}") for i in range(1500)]
    df = spark.createDataFrame([(1, messages), (2, []), (3, messages[:1])], SCHEMA)
    rendered = C.generation_spans(C.render_chat(df), block=64)
    rows = {r.conv_id: r for r in rendered.collect()}
    for key, msgs in ((1, messages), (2, []), (3, messages[:1])):
        cut = [rows[key].text[s.start : s.end] for s in rows[key].spans]
        assert cut == [x[1] for x in msgs if x[0] == "assistant"]
