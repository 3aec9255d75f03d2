"""Dataset queries: prompts, filters, splits, mixing, packing and batch plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from posttrain_spark.functions.tokens import token_count, tokens
from posttrain_spark.operators import dataset as D
from posttrain_spark.operators.chat import loss_mask, render_chat
from posttrain_spark.operators.ordering import number_rows
from posttrain_spark.plans import sql as S
from posttrain_spark.plans.chat import MARKED, conversations
from posttrain_spark.plans.registry import query, table, work_table
from posttrain_spark.session import durable, scratch_path
from posttrain_spark.sources.conversations import (
    first_messages,
    read_benchmark,
    read_split,
    write_dataset,
)
from posttrain_spark.sources.files import move, part_files

DIGEST = "md5(concat('42:', {}))"


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.make_prompt(first_messages(table(spark, sf_dir, "conversations")))


def document_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work_table(spark, sf_dir, "documents").select(
        "doc_id", token_count(F.col("text")).alias("n_tokens")
    )


LENGTHS = f"lengths AS (SELECT doc_id, {S.token_count('text')} AS n FROM documents)"
FIRST = "first AS (SELECT conv_id, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k = 1)"


@query(
    "make_prompt",
    f"""WITH {FIRST} SELECT conv_id, 'system,user' AS roles, {S.quoted(D.SYSTEM_PROMPT)} AS system_text, text AS user_text FROM first""",
)
def make_prompt(spark, sf_dir):
    prompt = F.col("prompt")
    return D.select_columns(prompts(spark, sf_dir), ["conv_id", "prompt"]).select(
        "conv_id", F.array_join(prompt["role"], ",").alias("roles"),
        prompt[0]["content"].alias("system_text"), prompt[1]["content"].alias("user_text"),
    )


@query(
    "select_columns",
    f"""WITH {FIRST} SELECT md5(concat({S.quoted(D.SYSTEM_PROMPT)}, '|', text)) AS prompt_md5, 'label ' || conv_id AS ground_truth FROM first""",
)
def select_columns(spark, sf_dir):
    df = prompts(spark, sf_dir).withColumn(
        "ground_truth", F.concat(F.lit("label "), F.col("conv_id"))
    )
    return D.select_columns(df).select(
        F.md5(F.array_join(F.col("prompt.content"), "|")).alias("prompt_md5"), "ground_truth"
    )


@query(
    "filter_long_prompts",
    f"WITH {FIRST} SELECT conv_id FROM first WHERE {S.token_count('text')} <= 40",
)
def filter_long_prompts(spark, sf_dir):
    return D.filter_long_prompts(prompts(spark, sf_dir), 40).select("conv_id")


@query("token_count", f"WITH {LENGTHS} SELECT doc_id, n AS n_tokens FROM lengths")
def count_tokens(spark, sf_dir):
    return document_lengths(spark, sf_dir).select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"))


# Keys with NULLs and repeats; which rows of the last key are taken is left to a digest.
SHARED_KEY = "CASE WHEN doc_id % 50 <> 0 THEN CAST(doc_id AS BIGINT) - CAST(doc_id AS BIGINT) % 3 END"


@query("cap_rows", f"SELECT {SHARED_KEY} AS k FROM documents ORDER BY k NULLS FIRST LIMIT 500")
def cap_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("*", f"{SHARED_KEY} AS k")
    return D.cap_rows(docs, 500, "k").select("k")


@query("limit_samples", "SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 3")
def limit_samples(spark, sf_dir):
    return D.limit_samples(table(spark, sf_dir, "benchmark"))


@query(
    "truncate",
    f"""WITH k AS (SELECT doc_id, {S.find('text', S.TOKENS)} AS k FROM documents)
        SELECT doc_id, least(len(k), 64) AS n_tokens, md5(array_to_string(k[1:64], ' ')) AS tokens_md5 FROM k""",
)
def truncate(spark, sf_dir):
    docs = work_table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("tokens"))
    cut = D.truncate(docs, 64, ["tokens"])
    return cut.select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens"),
        F.md5(F.array_join("tokens", " ")).alias("tokens_md5"),
    )


@query(
    "mix",
    """SELECT source, count(*) AS n_rows, count(DISTINCT text) AS n_texts, sum(length(text))::BIGINT AS n_chars FROM (
         SELECT text, 'documents' AS source FROM documents UNION ALL
         SELECT text, 'conversations' AS source FROM conversations UNION ALL
         SELECT text, 'benchmark' AS source FROM benchmark) GROUP BY 1""",
)
def mix(spark, sf_dir):
    names = ("documents", "conversations", "benchmark")
    mixed = D.mix({n: table(spark, sf_dir, n) for n in names}, ["text"])
    # Texts are counted through their digests, so only digests are shuffled.
    return mixed.groupBy("source").agg(
        F.count("*").alias("n_rows"), F.countDistinct(F.md5("text")).alias("n_texts"),
        F.sum(F.length("text")).alias("n_chars"),
    )


@query(
    "shuffle",
    f"SELECT doc_id, row_number() OVER (ORDER BY {DIGEST.format('doc_id')}, doc_id) - 1 AS place FROM documents",
)
def shuffle(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select("doc_id")
    return number_rows(ids, "doc_id", seed=42).select("doc_id", F.col("ordinal").alias("place"))


@query(
    "shuffle_rows",
    f"SELECT doc_id, n_chars, source, row_number() OVER (ORDER BY {DIGEST.format('doc_id')}, doc_id) - 1 AS place FROM documents",
)
def shuffle_rows(spark, sf_dir):
    """The shuffled rows with the place at which each came out."""
    shuffled = D.shuffle(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    # The lower bits of the generated id number the rows of a partition.
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = durable(shuffled.select("*", F.spark_partition_id().alias("part"), inside.alias("row")), "shuffled")
    sizes = placed.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    return placed.join(starts, "part").select(
        "doc_id", "n_chars", "source", (F.col("first") + F.col("row")).alias("place")
    )


_HELD_OUT = f"SELECT doc_id FROM documents ORDER BY {DIGEST.format('doc_id')}, doc_id LIMIT 200"


@query("split_eval", f"SELECT doc_id, n_chars FROM documents WHERE doc_id IN ({_HELD_OUT})")
def split_eval(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return D.train_eval_split(docs, "doc_id")[1]


@query("split_train", f"SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN ({_HELD_OUT})")
def split_train(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return D.train_eval_split(docs, "doc_id")[0]


@query(
    "expand_generations",
    "SELECT conv_id, turn, g AS sample_idx FROM conversations, unnest(generate_series(0, 7)) AS x(g) WHERE role = 'user'",
)
def expand_generations(spark, sf_dir):
    prompts = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn")
    return D.expand_generations(prompts).withColumn("sample_idx", F.col("sample_idx").cast("long"))


@query(
    "pack_wrapped",
    f"""WITH {LENGTHS}, o AS (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n AS a FROM lengths WHERE n > 0),
        x AS (SELECT *, unnest(generate_series((a // 1024)::BIGINT, ((a + n - 1) // 1024)::BIGINT)) AS pack_id FROM o)
        SELECT pack_id, doc_id, (greatest(a, pack_id * 1024) - a)::BIGINT AS piece_start,
          (least(a + n, (pack_id + 1) * 1024) - a)::BIGINT AS piece_end,
          (greatest(a, pack_id * 1024) - pack_id * 1024)::BIGINT AS pack_start FROM x""",
)
def pack_wrapped(spark, sf_dir):
    packs = D.pack_wrapped(document_lengths(spark, sf_dir), "doc_id", 1024)
    return packs.withColumnsRenamed({"start": "piece_start", "end": "piece_end"})


@query(
    "pack_wrapped_fill",
    f"""WITH {LENGTHS}, t AS (SELECT sum(n)::BIGINT AS total FROM lengths)
        SELECT p AS pack_id, least(1024, total - p * 1024)::BIGINT AS filled FROM t, unnest(generate_series(0, (total - 1) // 1024)) AS x(p)""",
)
def pack_wrapped_fill(spark, sf_dir):
    packs = D.pack_wrapped(document_lengths(spark, sf_dir), "doc_id", 1024)
    return packs.groupBy("pack_id").agg(F.sum(F.col("end") - F.col("start")).alias("filled"))


@query(
    "pack_bfd",
    f"WITH {LENGTHS} SELECT doc_id, least(n, 2048)::INT AS packed_tokens, true AS fits, true AS near_best FROM lengths WHERE n > 0",
)
def pack_bfd(spark, sf_dir):
    """Each example's packed length, whether its pack fits, and whether its shard has no more packs than
    best-fit decreasing may need (11/9 of the least possible number, and one)."""
    packs = durable(D.pack_bfd(document_lengths(spark, sf_dir), "doc_id", 2048), "packs")
    filled = packs.groupBy("shard", "pack").agg(F.sum("packed_tokens").alias("filled"))
    shards = filled.groupBy("shard").agg(
        (F.count("*") <= F.ceil(F.sum("filled") / 2048) * 11 / 9 + 1).alias("near_best")
    )
    return packs.join(filled, ["shard", "pack"]).join(shards, "shard").select(
        "doc_id", "packed_tokens", (F.col("filled") <= 2048).alias("fits"), "near_best"
    )


@query(
    "pack_bfd_totals",
    f"""WITH {LENGTHS} SELECT count(*) AS n_examples, sum(least(n, 2048))::BIGINT AS n_tokens, true AS all_fit FROM lengths WHERE n > 0""",
)
def pack_bfd_totals(spark, sf_dir):
    packs = D.pack_bfd(document_lengths(spark, sf_dir), "doc_id", 2048)
    per_pack = packs.groupBy("shard", "pack").agg(
        F.count("*").alias("n"), F.sum("packed_tokens").alias("tokens")
    )
    return per_pack.agg(
        F.sum("n").alias("n_examples"), F.sum("tokens").alias("n_tokens"),
        (F.max("tokens") <= 2048).alias("all_fit"),
    )


@query(
    "pack_across_shards",
    f"""WITH {LENGTHS} SELECT count(*) AS n_examples, sum(least(n, 2048))::BIGINT AS n_tokens, true AS all_fit,
          true AS one_half_empty, true AS within_bound FROM lengths WHERE n > 0""",
)
def pack_across_shards(spark, sf_dir):
    """Packed in sixteen shards: the totals, and the bounds that hold for one packing."""
    lengths = document_lengths(spark, sf_dir)
    packs = D.pack_bfd(lengths, "doc_id", 2048, shards=16).groupBy("shard", "pack").agg(
        F.count("*").alias("n"), F.sum("packed_tokens").alias("tokens")
    )
    return packs.agg(
        F.sum("n").alias("n_examples"), F.sum("tokens").alias("n_tokens"),
        (F.max("tokens") <= 2048).alias("all_fit"),
        (F.count_if(F.col("tokens") * 2 <= 2048) <= 1).alias("one_half_empty"),
        (F.count("*") <= F.ceil(2 * F.sum("tokens") / 2048) + 1).alias("within_bound"),
    )


_PLAN = """o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS c FROM documents),
    plan AS (SELECT doc_id, i AS ordinal, e AS epoch, (e * ceil(c / 128.0) + i // 128)::BIGINT AS step,
      ((i % 128) // 32)::BIGINT AS micro_step, ((i % 32) // 4)::BIGINT AS device FROM o, unnest(generate_series(0, 1)) AS x(e))"""


def _plan(spark, sf_dir, **options) -> DataFrame:
    plan = D.batch_plan(table(spark, sf_dir, "documents"), "doc_id", epochs=2, **options)
    return plan.withColumns({c: F.col(c).cast("long") for c in ("epoch", "micro_step", "device")})


@query("batch_plan", f"WITH {_PLAN} SELECT * FROM plan")
def batch_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@query("batch_plan_max_steps", f"WITH {_PLAN} SELECT * FROM plan WHERE step < 6")
def batch_plan_max_steps(spark, sf_dir):
    return _plan(spark, sf_dir, max_steps=6)


@query("seen_by", f"WITH {_PLAN} SELECT doc_id, epoch, step FROM plan WHERE step < 4")
def seen_by(spark, sf_dir):
    return D.seen_by(_plan(spark, sf_dir), 4).select("doc_id", "epoch", "step")


@query(
    "seen_counts",
    f"""WITH {_PLAN}, f AS (SELECT (step // 4 + 1) * 4 AS checkpoint, count(*) AS n FROM plan GROUP BY 1)
        SELECT checkpoint::BIGINT AS checkpoint, sum(n) OVER (ORDER BY checkpoint)::BIGINT AS rows_seen FROM f""",
)
def seen_counts(spark, sf_dir):
    return D.seen_counts(_plan(spark, sf_dir), save_steps=4)


SPLIT = "CASE WHEN conv_id % 10 = 0 THEN 'validation' ELSE 'train' END"


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "dataset")
    write_dataset(table(spark, sf_dir, "conversations").withColumn("split", F.expr(SPLIT)), path)
    return spark.read.parquet(path)


@query(
    "read_split",
    f"SELECT conv_id, turn, role, text, 'validation' AS split FROM conversations WHERE {SPLIT} = 'validation'",
)
def validation_split(spark, sf_dir):
    return read_split(stored(spark, sf_dir), "validation")


@query(
    "write_dataset",
    f"SELECT {SPLIT} AS split, count(*) AS n_rows, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY 1",
)
def written_dataset(spark, sf_dir):
    return stored(spark, sf_dir).groupBy("split").agg(
        F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("n_chars")
    )


@query(
    "read_benchmark",
    "SELECT CASE WHEN item_id % 2 = 0 THEN 'gsm8k' ELSE 'humaneval' END AS benchmark, item_id, text FROM benchmark",
)
def benchmark_items(spark, sf_dir):
    root = scratch_path(spark, "benchmarks")
    named = table(spark, sf_dir, "benchmark").withColumn(
        "benchmark", F.expr("CASE WHEN item_id % 2 = 0 THEN 'gsm8k' ELSE 'humaneval' END")
    )
    raw = scratch_path(spark, "items")
    named.write.partitionBy("benchmark").json(raw)
    for name in ("gsm8k", "humaneval"):
        for i, part in enumerate(part_files(spark, f"{raw}/benchmark={name}")):
            move(spark, part, f"{root}/{name}/part{i}.jsonl")
    return read_benchmark(spark, root)


@query(
    "sft_dataset",
    f"""WITH {MARKED}, f AS (SELECT conv_id, turn, unnest(tokens) AS token, unnest(mask) AS m, generate_subscripts(tokens, 1) AS i FROM marked),
      o AS (SELECT token, m, row_number() OVER (ORDER BY conv_id, turn, i) - 1 AS spot FROM f)
      SELECT (spot // 512)::BIGINT AS pack_id, count(*) AS n_tokens, md5(string_agg(token, ' ' ORDER BY spot)) AS tokens_md5,
        md5(string_agg(m, '' ORDER BY spot)) AS mask_md5 FROM o GROUP BY 1""",
)
def sft_dataset(spark, sf_dir):
    """Conversations to packed training rows: render, mask, pack, slice."""
    marked = loss_mask(render_chat(conversations(spark, sf_dir))).select("conv_id", "tokens", "mask")
    examples = durable(marked, "examples")
    lengths = examples.select("conv_id", F.size("tokens").alias("n_tokens"))
    packs = D.materialize_packs(D.pack_wrapped(lengths, "conv_id", 512), examples, "conv_id")
    return packs.select(
        "pack_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.md5(F.array_join("tokens", " ")).alias("tokens_md5"),
        F.md5(F.array_join(F.col("mask").cast("array<string>"), "")).alias("mask_md5"),
    )


_RL = f"""built AS (SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY 1),
    short AS (SELECT * FROM built WHERE {S.token_count('text')} <= 64)"""


@query(
    "rl_prompts",
    f"""WITH {_RL} SELECT conv_id, md5(text) AS prompt_md5, conv_id % 3 = 0 AS labelled,
        row_number() OVER (ORDER BY md5('42:' || conv_id), conv_id) <= 20 AS held_out FROM short""",
)
def rl_prompts(spark, sf_dir):
    """Prompts, columns, length filter and hold-out in one chain."""
    firsts = first_messages(table(spark, sf_dir, "conversations"))
    labelled = firsts.withColumn("ground_truth", F.when(F.col("conv_id") % 3 == 0, "label"))
    train, held = D.rl_prompts(labelled, "conv_id", max_tokens=64, n_eval=20)
    both = train.withColumn("held_out", F.lit(False)).unionByName(held.withColumn("held_out", F.lit(True)))
    return both.select(
        "conv_id",
        F.md5(F.element_at("prompt", -1)["content"]).alias("prompt_md5"),
        F.col("ground_truth").isNotNull().alias("labelled"),
        "held_out",
    )
