"""Prefix trie against brute force: one partition, many partitions, copies, hot prefixes, odd rows."""

import random
import zlib
from hashlib import sha256
from math import fmod

import pytest

from posttrain_spark.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, part long, node int, key string, _slot long"


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        taken = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - int(fmod(c, 5)), [])[:taken] + turns[taken:]
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves.setdefault(node, 0)
        if not children.get(node):
            leaves[node] = 1
        saved[node] = saved.get(node, 0) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        if node:
            up = node[:-1]
            children[up] = children.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[node]
            saved[up] = saved.get(up, 0) + saved[node]
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((
            min(convs), len(node), parent, len(convs), children.get(node, 0), leaves[node], saved[node],
            sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def talk(seed, convs, turns, texts):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rng.choice(turns)):
            text = rng.choice(texts)
            rows.append((c, t * 2, rng.choice(["user", "user", "assistant", None]), text))
    return rows


CASES = {
    "prefixes": talk(1, range(400), (0, 1, 2, 3, 5, 9, 12), ["a", "b"]),
    "copies": talk(2, range(300), (4,), ["same"]) + talk(3, range(300, 340), (1, 2, 30), ["x", "é", "", None]),
    "unlike": talk(4, range(-40, 120, 3), (1, 5), [f"text {i}" for i in range(500)]),
    "odd": [(None, 1, "user", "x"), (7, None, "user", None), (7, 1, None, "b"), (7, None, "user", "z"), (12, 3, "r", "t" * 200_000), (10, 1, "user", ""), (11, 1, "user", "")],
    "one": [(3, 1, "user", "only")],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("turns", [10**9, 9])
def test_against_brute_force(spark, monkeypatch, name, turns):
    """In one partition, and in partitions of a few turns so that most nodes cross boundaries."""
    monkeypatch.setattr(T, "TURNS_PER_PARTITION", turns)
    monkeypatch.setattr(T, "LEAST_TURNS", turns * 2)
    rows = CASES[name]
    df = spark.createDataFrame([(*r, 1, 2, "k", 3) for r in rows], SCHEMA)
    got = T.prefix_trie(T.sequences(T.rebuilt(df)))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_pieces_of_a_long_list_hash_like_the_list():
    ids = [str(i * 37) for i in range(5_000)]
    pieces = list(T._pieces(ids))
    assert len(pieces) > 3 and ",".join(pieces) == ",".join(ids)


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert T.prefix_trie(T.sequences(T.rebuilt(empty))).collect() == []
