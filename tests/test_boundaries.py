"""Learned sentence boundaries: scores against brute force, and the checks with a learned table."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from posttrain_spark.operators import boundaries as B
from posttrain_spark.operators import reward as R


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    nouns = ["house", "river", "stone", "letter", "garden", "window", "market", "road"]
    out = [None, "", "No period", "Dr. Who"]
    for _ in range(400):
        parts = []
        for _ in range(rng.randrange(2, 6)):
            first = rng.choice(["The", "The", "We", "It"])
            title = rng.choice(["", "Dr. Brown and ", "e.g. ", "Prof. Green saw ", "St. Mary near "])
            parts.append(f"{first} {rng.choice(nouns)} met {title}{rng.choice(nouns)} {rng.choice(nouns)}.")
        out.append(" ".join(parts))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def test_abbreviation_scores_against_brute_force(docs, texts):
    counts = {}
    for text in texts:
        for token in (text or "").split():
            token = re.sub(r"^[(\[{\"'“‘«]+|[)\]}\"'”’»]+$", "", token)
            word = re.sub(r"\.$", "", token.lower())
            if any(c.isalpha() for c in word):
                pair = counts.setdefault(word, [0, 0])
                pair[not re.search(r"[^.]\.$", token)] += 1
    dots, plain = (sum(c[i] for c in counts.values()) for i in (0, 1))
    rate = dots / (dots + plain)
    want = {}
    for word, (d, p) in counts.items():
        if d:
            null = d * math.log(rate) + p * math.log(1 - rate)
            alt = d * math.log(0.99) + p * math.log(1 - 0.99)
            size = len(word.replace(".", ""))
            want[word] = 2 * (alt - null) * math.exp(-size) * (word.count(".") + 1) * size ** -float(p)
    got = {r.word: r.score for r in B.abbreviations(B.type_counts(docs)).collect()}
    assert got.keys() == want.keys()
    assert all(got[w] == pytest.approx(want[w], rel=1e-9, abs=1e-12) for w in want)


def test_learned_table_and_sentences(spark, docs):
    model = B.fit_sentences(docs)
    assert set(model.abbreviations) == {"dr", "prof", "st", "e.g"} and "the" in model.starters
    cases = {
        "We met Dr. Brown. It rained.": ["We met Dr. Brown.", "It rained."],
        "See e.g. the house. (Prof. Green) left!": ["See e.g. the house.", "(Prof. Green) left!"],
        "He is a dr. The road is long.": ["He is a dr.", "The road is long."],
        "One.  Two?\nThree": ["One.", "Two?", "Three"],
        "": [], "St.": ["St."],
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    for r in df.select("text", model.sentences(F.col("text")).alias("s")).collect():
        assert r.s == cases[r.text]
    assert spark.range(1).select(model.sentences(F.lit(None).cast("string"))).first()[0] is None


def test_checks_with_the_learned_table(spark, docs):
    model = B.fit_sentences(docs)
    args = F.create_map(F.lit("relation"), F.lit("less than"), F.lit("num_sentences"), F.lit("3"))
    one = F.struct(F.lit("length_constraints:number_sentences").alias("instruction_id"), args.alias("kwargs"))
    samples = spark.createDataFrame([("We met Dr. Brown and Prof. Green. It rained.",)], "completion string")
    samples = samples.withColumn("constraints", F.array(one))
    assert R.score_multi(samples).first().score == 0.0
    assert R.score_multi(samples, checks=model.checks()).first().score == 1.0
    assert set(model.checks()) == set(B.NEW_CHECKS) and set(model.old_checks()) == set(B.OLD_CHECKS)
    nothing = B.fit_sentences(docs.limit(0))
    assert nothing == B.SentenceModel((), ())


def test_texts_are_read_once(spark, tmp_path, docs, texts):
    docs.write.parquet(str(tmp_path / "docs"))
    reads = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    model = B.fit_sentences(spark.read.parquet(str(tmp_path / "docs")).mapInArrow(pass_on, "text string"))
    assert reads.value == len(texts)
    assert model == B.fit_sentences(docs)


def test_counts_of_odd_tokens_against_brute_force(spark):
    odd = [
        "  Dr. Who　(Dr.) \"e.g.\" . .. a.. The\x85the, The. \n", "\t", "(The) “Dr.” Who?\x1c12. We 3.a We.", "Dr.\n\nWho! '' who",
        None, "", "x Dr. (Who) ﻿Dr. who", "“ “ Dr. “ the",
    ]
    df = spark.createDataFrame([(t,) for t in odd * 2], "text string")
    types, after = {}, {}
    for text in odd * 2:
        tokens = [re.sub(r"^[(\[{\"'“‘«]+|[)\]}\"'”’»]+$", "", t) for t in (text or "").split()]
        for before, t in zip([""] + tokens, tokens):
            word = re.sub(r"\.$", "", t.lower())
            if any(c.isalpha() for c in word):
                pair = types.setdefault(word, [0, 0])
                pair[not re.search(r"[^.]\.$", t)] += 1
            word = re.sub(r"[\W_]+$", "", t.lower())
            if any(c.isalpha() for c in word):
                pair = after.setdefault(word, [0, 0])
                pair[0] += 1
                pair[1] += bool(re.search(r"[^.]\.$", before)) and re.sub(r"\.$", "", before.lower()) != "dr"
    assert {r.word: [r.n_dotted, r.n_plain] for r in B.type_counts(df).collect()} == types
    assert {r.word: [r.n, r.n_after] for r in B.starter_counts(df, ["dr"]).collect()} == after
    from posttrain_spark.functions.text import WHITESPACE

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    left = spark.createDataFrame([(every,)], "t string").select(F.regexp_replace("t", B.SPACES, "")).first()[0]
    assert left == "".join(c for c in every if c not in WHITESPACE)


def test_count_is_the_number_of_sentences(spark, docs):
    model = B.fit_sentences(docs)
    odd = docs.union(spark.createDataFrame([("Dr.\nWho. St.\n",), ("He is a dr.\r\n\"Dr. The",), (" . Dr.. We. ",)], "text string"))
    rows = odd.select(F.size(model.sentences(F.col("text"))).alias("a"), model.count(F.col("text")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]


def test_model_holds_all_types_over_the_thresholds(spark):
    """However many abbreviations and starters the texts have, all are learned and applied."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c for a in letters[:10] for b in letters for c in letters][:5_100]
    shorts = spark.createDataFrame([(f"{w}. of {w}. of " * 5,) for w in words], "text string")
    model = B.fit_sentences(shorts)
    assert set(model.abbreviations) == set(words)
    starts = spark.createDataFrame([(f"x{w} of the river the river. " * 20,) for w in words], "text string")
    model = B.SentenceModel(tuple(words), B.fit_sentences(starts).starters)
    assert set(model.starters) == {f"x{w}" for w in words}
    texts = [(f"We met {w}. Brown and {w}. X{w} left.",) for w in words]
    counts = spark.createDataFrame(texts, "text string").select(model.count(F.col("text")).alias("n")).groupBy("n").count().collect()
    assert [(r["n"], r["count"]) for r in counts] == [(2, len(words))]
