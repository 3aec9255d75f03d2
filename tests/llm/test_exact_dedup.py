"""Exact dedup against brute force, with a good hash and with hashes that collide."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from posttrain_spark.llm.exact_dedup import exact_duplicates
from posttrain_spark.operators import skew

SCHEMA = "doc_id long, text string, _row long, _hash string, _id string, kept int"


def rows_of(n, texts, seed=1):
    rng = random.Random(seed)
    rows = [(i * 7 % n, rng.choice(texts)) for i in range(n)]
    rows += [(None, "b"), (None, "b"), (None, None), (3, "only with three"), (3, "only with three"), (3, "")]
    rows += [(n + 5, "x" * 300_000), (n + 6, "x" * 300_000), (n + 7, "x" * 299_999 + "y")]
    return [(*r, 1, "h", "i", 0) for r in rows]


def want_of(rows, keep):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    out = []
    for text, ids in groups.items():
        order = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=keep == "largest")
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, order[0], len(ids), at == 0, digest) for at, i in enumerate(order)]
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize(
    "hashed",
    [F.md5, lambda t: F.length(t).cast("string"), lambda t: F.lit("same")],
    ids=["md5", "length", "constant"],
)
def test_against_brute_force(spark, monkeypatch, keep, hashed):
    monkeypatch.setattr(skew, "MIN_ROWS", 20)
    rows = rows_of(200, ["a", "b", "B", "b ", "", "é", "é", "longer text", None])
    docs = spark.createDataFrame(rows, SCHEMA)
    got = exact_duplicates(docs, keep=keep, hashed=hashed)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == want_of(rows, keep)


def test_normalised_and_empty(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_duplicates(docs, normalise=F.lower).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True)}
    assert exact_duplicates(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        exact_duplicates(docs, keep="any")
