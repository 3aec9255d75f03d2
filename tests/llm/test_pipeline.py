"""The corpus pipeline on the smallest tables, stage by stage."""

import random
import re

import corpus_pipeline
from posttrain_spark.llm import jaccard_join
from pyspark.sql import functions as F


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("_row", F.lit("clash"))
    columns = docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, before, small)
        docs.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        assert docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        if number == 2:
            found = jaccard_join.near_duplicates(docs)
            assert found.filter("component_id <> doc_id").count() == 0
    assert docs.filter("n_tokens <> size(token_ids)").count() == 0 and docs.count() > 0


def odd_documents():
    """Copies, near copies, shared passages, clean short repeats, NULLs, empty and long texts, repeated ids."""
    rng = random.Random(31)
    words = [a + b for a in ("ka", "lo", "mi", "ru", "te", "so") for b in ("n", "s", "la", "vo", "x", "rim")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = prose(60), [prose(25) for _ in range(6)]
    texts = [prose(rng.choice((3, 30, 90))) for _ in range(14)]
    texts += ["\n".join(base)] * 2 + ["\n".join([*base[:-1], prose(25)]), prose(100) + "\n" + passage, passage + "\n" + prose(9)]
    near = prose(200).split()
    texts += [" ".join(near), " ".join(near[:150] + ["changed"] + near[151:]), "Yes.\nNo.", "Yes.\nNo.", prose(20_000)]
    rows = [(i * 5 % 97, t) for i, t in enumerate(texts)]
    rows += [(None, texts[0]), (None, None), (200, None), (201, ""), (202, " \n"), (rows[3][0], texts[3]), (rows[4][0], "an id again")]
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src5", None]), len(t or ""), "clash") for i, t in rows]


def test_stages_on_odd_documents(spark, small):
    """Each stage on the same rows, against what its operator decides or a brute force says."""
    import public_tokenizers
    import test_documents as T
    from tokenizers import Tokenizer

    from posttrain_spark.llm import toxicity

    rows = odd_documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `_row` string")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def result(name):
        out = stages[name](spark, docs, small)
        assert stages[name](spark, docs.limit(0), small).collect() == []
        if name != "bpe":
            assert out.columns == docs.columns
        return out

    kept = sorted((r["doc_id"], r["text"]) for r in result("toxicity").collect() if r["doc_id"] is not None and r["text"])
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
    assert kept == sorted((r["doc_id"], r["text"]) for r in scored if r["toxicity"] < 0.5 and r["doc_id"] is not None and r["text"])

    T.MARKS.update({r["text"]: r["m"] for r in docs.select("text", F.xxhash64("text").alias("m")).collect()})
    table = [(r[0], r[1]) for r in rows]
    cleaned = T.repeated_lines(table)
    want = []
    for i, t in table:
        left = cleaned[(i is None, i or 0, t)] if t and t.strip() else t
        if left == t or len(left.split()) >= 0.2 * len(t.split()):
            want.append((i, left))
    assert sorted(((r["doc_id"], r["text"]) for r in result("line_dedup").collect()), key=str) == sorted(want, key=str)

    sets = [T.shingles(t) for _, t in table]
    linked = [[100 * len(a & b) >= 80 * len(a | b) > 0 for b in sets] for a in sets]
    group = list(range(len(table)))
    for _ in table:
        group = [min([group[j] for j in range(len(table)) if linked[i][j] or i == j or table[i][0] is not None and table[i][0] == table[j][0]]) for i in range(len(table))]
    least = {}
    for (i, _), g in zip(table, group):
        least[g] = i if least.get(g) is None else least[g] if i is None else min(least[g], i)
    # Rows that repeat an id, or have none, stay or go together.
    own = {i for (i, _), g in zip(table, group) if i == least[g]}
    stay = sorted((r for r in table if r[0] in own), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in result("ngram_jaccard").collect()), key=str) == stay

    drawn = sorted(((r["doc_id"], r["text"]) for r in result("mixing").collect()), key=str)
    left = sorted(table, key=str)
    for r in drawn:
        left.remove(r)  # each row once at most
    size = lambda some: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in some)
    assert drawn and size(drawn) <= size(table) * 9 // 10

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    coded = sorted((str(r["doc_id"]), r["n_tokens"], list(r["token_ids"])) for r in result("bpe").collect())
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in table]
    assert coded == sorted((str(i), len(x), x) for (i, _), x in zip(table, ids))
