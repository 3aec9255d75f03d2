"""Merkle manifest: addresses, blocks over several layers, and whole trees against brute force."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from posttrain_spark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, ordinal int, digest string, claim string"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(r):
    parts = (r[0], r[3], r[2], r[4], r[1])
    return h("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, index):
    for row in tree[:-1]:
        low = index // 8 * 8
        yield row[low:index], row[index + 1 : low + 8]
        index //= 8


def brute(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    names = sorted(langs, key=lambda n: (n is not None, (n or "").encode()))
    trees = {}
    for name in names:
        langs[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = levels([leaf(r) for r in langs[name]])
    top = levels([trees[n][-1][0] for n in names])
    out = []
    for at, name in enumerate(names):
        for i, r in enumerate(langs[name]):
            steps = [*path(trees[name], i), *path(top, at)]
            value = leaf(r)
            if r[0] is not None and r[1] and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
                value = leaf((r[0], lower, *r[2:]))
            for before, after in steps:
                value = h("".join(before) + value + "".join(after))
            proof = h("".join("".join(b + a) for b, a in steps))
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[name][-1][0], root, proof, value, value == root))
    return out


@pytest.mark.parametrize("count", [1, 2, 3, 5, 6])
def test_addresses_are_a_layout(count):
    """Every node has a place of its own, and every part of the split is contiguous."""
    places = [merkle.address(d, np.arange(8**d), count) for d in range(count)]
    assert sorted(np.concatenate(places)) == list(range(merkle.tree_size(count)))
    if count > 1:
        top = count // 2
        assert sorted(np.concatenate(places[:top])) == list(range(merkle.tree_size(top)))
        one = [p[: 8 ** (d)] for d, p in enumerate(places[top:])]
        size = merkle.tree_size(count - top)
        start = merkle.tree_size(top)
        assert sorted(np.concatenate(one)) == list(range(start, start + size))


@pytest.mark.parametrize(
    "langs, height",
    [(["en", "en", "en", "de", None, "", "é", "ü"], 1), (["en"], 3), ([f"l{i:03}" for i in range(80)], 3)],
    ids=["layers", "one", "many"],
)
def test_against_brute_force(spark, langs, height):
    """Small blocks give several layers; with blocks of one height, trees of 1 to 4 layers."""
    rng = random.Random(len(langs))
    rows = []
    for i in range(700):
        text = rng.choice(["Some Text", "plain", "", None, "ÀÉ upper É", f"Number {i}"])
        rows.append((i * 11 % 1009, text, rng.choice(langs), rng.choice(["a", None]), rng.choice([None, 3]), "t", 1, "d", "c"))
    rows += [rows[5], (None, "No Id", langs[0], "a", 1, "t", 1, "d", "c"), (None, "no id", langs[0], "a", 1, "t", 1, "d", "c")]
    rows += [(12, "A" * 200_000, langs[0], None, None, "t", 1, "d", "c"), (5000, "Lone One", "zz", "b", 1, "t", 1, "d", "c")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert height == 3 or len(merkle.dataset_manifest(docs, height)[0].layers) > 1
    got = merkle.verify(docs, height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def test_one_row_and_nothing(spark):
    rows = [(3, "Text", "en", "s", 4, "t", 1, "d", "c")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in merkle.verify(docs).collect()] == brute(rows)
    none = merkle.verify(docs.limit(0))
    assert none.collect() == [] and none.columns == merkle.verify(docs).columns
