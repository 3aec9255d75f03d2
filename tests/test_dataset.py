import random

import pytest
from pyspark.sql import functions as F

from posttrain_spark.functions.tokens import token_count
from posttrain_spark.operators import dataset as D, ordering
from posttrain_spark.operators.ordering import number_rows


@pytest.fixture(scope="module")
def lengths(spark):
    rng = random.Random(7)
    rows = [(i * 3, rng.choice([0, 1, 5, 40, 300, 2500])) for i in range(700)]
    return spark.createDataFrame(rows, "k long, n_tokens int"), dict(rows)


def test_numbering_with_a_hot_key(spark):
    """One key value holds well over a third of all rows."""
    rows = [(5 if i % 2 else i, f"id{i}", i % 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, tie string, w int")
    got = number_rows(df, "k", weight="w", tie="tie", partitions=16).orderBy("ordinal").collect()
    assert [r.ordinal for r in got] == list(range(3000))
    assert [r.k for r in got] == sorted(r[0] for r in rows)
    total = 0
    for r in got:
        assert r.offset == total
        total += r.w


def test_hot_value_is_spread_over_partitions(spark):
    """Three quarters of the rows share a key; as many share it with all other columns."""
    df = spark.range(4000).select(F.when(F.col("id") < 3000, 9).otherwise(F.col("id")).alias("k"), F.lit(1).alias("tie"))
    placed = ordering.in_ranges(df, [F.col("k"), F.col("tie")], partitions=16)
    largest = placed.groupBy(ordering.slot_partition()).count().agg(F.max("count")).first()[0]
    assert largest < 800


def test_ranks_in_groups_against_brute_force(spark):
    """A NULL group, a hot group, NULL and repeated keys, a name with a dot, weights with NULL."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1.0, 2.0, 3.0, 4.5]), i, rng.choice([None, 0, 2, 7])) for i in range(900)]
    df = spark.createDataFrame(rows, "`g.x` string, k double, i int, w int")
    got = ordering.rank_rows(df, [F.col("k"), -F.col("i")], ["g.x"], sums={"offset": "w"}, partitions=7).collect()
    want = {}
    for g in ("a", "b", None):
        total = 0
        group = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, -r[2]))
        for at, r in enumerate(group):
            want[r[2]] = (at, total)
            total += r[3] or 0
    assert {r.i: (r.ordinal, r.offset) for r in got} == want and len(got) == 900
    assert ordering.rank_rows(df.limit(0), [F.col("k")], ["g.x"]).collect() == []


@pytest.mark.parametrize("kind", ["double", "long"])
def test_nth_value_against_a_sort(spark, monkeypatch, kind):
    """Counted in ranges down to the value: NULL, NaN, infinities, huge and neighbouring numbers."""
    monkeypatch.setattr(ordering, "FEW", 5)
    monkeypatch.setattr(ordering, "CELLS", 4)
    rng = random.Random(11)
    if kind == "double":
        values = [None, float("nan"), float("inf"), -float("inf"), -1.7e308, 1.7e308, 5e-324, 0.0] + [rng.gauss(0, 10.0 ** rng.randrange(9)) for _ in range(60)]
    else:
        values = [None, 2**63 - 1, -(2**63), 2**60, 2**60 + 1, 2**60 + 2] + [rng.choice([7, rng.randrange(1000), 2**55 + rng.randrange(30)]) for _ in range(60)]
    values += values[:20]
    ordered = sorted(values, key=lambda v: (v is not None, v != v, v if v is not None and v == v else 0))
    df = spark.createDataFrame([(v,) for v in values], f"k {kind}").cache()
    for n in (1, 2, 3, 4, 9, 30, len(values) - 3, len(values)):
        value, below, same = ordering.nth_value(df, F.col("k"), n)
        want = ordered[n - 1]
        assert str(value) == str(want)
        assert below < n <= below + same
    assert ordering.nth_value(df, F.col("k"), len(values) + 1) is None


def test_numbering_of_a_seeded_shuffle(spark):
    import hashlib

    df = spark.createDataFrame([(f"x{i}",) for i in range(200)], "k string")
    got = [r.k for r in number_rows(df, "k", seed=3).orderBy("ordinal").collect()]
    assert got == sorted((f"x{i}" for i in range(200)), key=lambda k: hashlib.md5(f"3:{k}".encode()).hexdigest())
    assert [r.k for r in D.shuffle(df, "k", seed=3).collect()] == got


def test_wrapped_packing_against_brute_force(lengths):
    df, by_key = lengths
    stream = [(k, i) for k in sorted(by_key) for i in range(by_key[k])]
    got = D.pack_wrapped(df, "k", 512).orderBy("pack_id", "pack_start").collect()
    rebuilt = [(r.k, i) for r in got for i in range(r.start, r.end)]
    assert rebuilt == stream
    sizes = {}
    for r in got:
        sizes[r.pack_id] = sizes.get(r.pack_id, 0) + r.end - r.start
    assert sorted(sizes) == list(range(len(sizes)))
    assert all(s == 512 for p, s in sizes.items() if p < len(sizes) - 1)


def test_best_fit_packing(lengths):
    df, by_key = lengths
    got = D.pack_bfd(df, "k", 512, shards=3).collect()
    assert {r.k: r.packed_tokens for r in got} == {k: min(n, 512) for k, n in by_key.items() if n}
    packs = {}
    for r in got:
        packs.setdefault((r.shard, r.pack), []).append(r.packed_tokens)
    assert max(map(sum, packs.values())) <= 512
    # The bound of one packing holds over all shards.
    assert sum(sum(p) <= 256 for p in packs.values()) <= 1


@pytest.mark.parametrize("rows_per_shard", [3, 1000])
def test_packing_across_shards(spark, rows_per_shard):
    """Many shards of few short examples, most of which share a key or have none: one packing's bound, in
    one round or several."""
    rng = random.Random(9)
    rows = [(rng.choice([None, 1, 1, i]), rng.choice([3, 5, 9, 40])) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, n_tokens int")
    got = D.pack_bfd(df, "k", 100, shards=60, rows_per_shard=rows_per_shard).collect()
    assert sorted((r.k, r.packed_tokens) for r in got if r.k is not None) == sorted(r for r in rows if r[0] is not None)
    assert len(got) == len(rows)
    packs = {}
    for r in got:
        packs.setdefault((r.shard, r.pack), []).append(r.packed_tokens)
    fills = [sum(p) for p in packs.values()]
    assert max(fills) <= 100 and sum(f <= 50 for f in fills) <= 1
    assert len(fills) <= 2 * sum(fills) / 100 + 1
    shards = {}
    for r in D.pack_bfd(df, "k", 100, shards=4, rows_per_shard=10**6).collect():
        shards[r.shard] = shards.get(r.shard, 0) + 1
    assert max(shards.values()) < 200


def test_best_fit_picks_the_fullest_bin():
    assert D.best_fit([6, 5, 4, 3, 2], 10) == [0, 1, 0, 1, 1]


def test_split_is_exact_disjoint_and_complete(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    train, held = D.train_eval_split(df, "k")
    a, b = ({r.k for r in x.collect()} for x in (train, held))
    assert len(b) == 200 and not a & b and a | b == set(range(1000))
    again = {r.k for r in D.train_eval_split(df.repartition(13), "k")[1].collect()}
    assert again == b
    assert D.train_eval_split(df, "k", n=0)[0].count() == 1000
    assert D.train_eval_split(df, "k", n=0)[1].count() == 0


def test_cap_rows(spark):
    df = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    for n in (0, 3, 400, 10_000):
        want = list(range(0, 5000, 7))[:n]
        assert sorted(r.k for r in D.cap_rows(df, n, "k").collect()) == want
        assert sorted(r.k for r in D.cap_rows(df, n, "k").collect()) == want


def test_batch_plan_against_brute_force(spark):
    df = spark.range(1, 301).withColumnRenamed("id", "k")
    plan = D.batch_plan(df, "k", per_device=2, accumulation=3, world=4, epochs=2)
    for r in plan.collect():
        i = r.k - 1
        assert (r.ordinal, r.step) == (i, r.epoch * 13 + i // 24)
        assert (r.micro_step, r.device) == (i % 24 // 8, i % 8 // 2)
    assert D.batch_plan(df, "k", epochs=2, max_steps=2).count() == 256
    assert D.seen_by(plan, 1).count() == 24
    assert [tuple(r) for r in D.seen_counts(plan, 13).orderBy("checkpoint").collect()] == [(13, 300), (26, 600)]


def test_prompts_and_filters(spark):
    schema = "conv_id long, messages array<struct<role:string,content:string>>"
    df = spark.createDataFrame([(1, [("assistant", "hello you"), ("user", "x")]), (2, [("user", None)]), (3, [("user", "a b c d")])], schema)
    prompts = D.make_prompt(df)
    first = prompts.filter("conv_id = 1").first().prompt
    assert [(x.role, x.content) for x in first] == [("system", D.SYSTEM_PROMPT), ("user", "hello you")]
    assert sorted(r.conv_id for r in D.filter_long_prompts(prompts, 3).collect()) == [1, 2]
    with pytest.raises(ValueError):
        token_count(F.lit("x"), "unknown")
    assert D.expand_generations(df, 8).count() == 24


def test_truncate(spark):
    df = spark.createDataFrame([([1, 2, 3], [0, 1, 1])], "tokens array<int>, mask array<int>")
    assert tuple(D.truncate(df, 2).first()) == ([1, 2], [0, 1])
    assert tuple(D.truncate(df, 0).first()) == ([1, 2, 3], [0, 1, 1])


def test_mix_keeps_duplicates(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "p int, extra string")
    b = spark.createDataFrame([("y", 1)], "other string, p int")
    got = sorted(tuple(r) for r in D.mix({"a": a, "b": b}, ["p"]).collect())
    assert got == [(1, "a"), (1, "a"), (1, "b")]


def test_skew_join_with_hot_keys(spark, monkeypatch):
    from posttrain_spark.operators import skew

    monkeypatch.setattr(skew, "MIN_ROWS", 100)
    key = F.when(F.col("id") < 4000, 7).when(F.col("id") < 5000, 9).otherwise(F.col("id") % 500)
    large = spark.range(6000).select(key.alias("k"), F.col("id").alias("row"))
    small = spark.range(450).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert skew.hot_keys(skew.key_counts(large, "k"), "k", 8) == {16: [7], 4: [9]}
    assert skew.hot_keys(skew.key_counts(small, "k"), "k", 8) == {}
    for how in ("inner", "left"):
        joined = skew.skew_join(large, small, "k", ["row"], how).select("k", "row", "v")
        plain = large.join(small, "k", how).select("k", "row", "v")
        assert sorted(map(str, joined.collect())) == sorted(map(str, plain.collect()))


def test_advantages_with_a_hot_group(spark, monkeypatch):
    from posttrain_spark.operators import rollouts, skew

    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("prompt_id"),
        F.col("id").alias("sample_idx"), (F.col("id") % 5).cast("double").alias("reward"),
    )
    plain = rollouts.advantages(df).collect()
    monkeypatch.setattr(skew, "MIN_ROWS", 100)
    split = rollouts.advantages(df, spread_by=["sample_idx"]).collect()
    assert sorted(map(tuple, split)) == sorted(map(tuple, plain)) and len(split) == 3000


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 6, 9])
@pytest.mark.parametrize("seed", [None, 7])
def test_cut_is_exact_for_any_key(spark, n, seed):
    rows = [(None, "a"), (1, "b"), (1, "b"), (1, "c"), (None, "a"), (2, None)]
    df = spark.createDataFrame(rows, "k long, v string")
    first, rest = ordering.cut_after(df, "k", n, seed=seed)
    first, rest = [tuple(r) for r in first.collect()], [tuple(r) for r in rest.collect()]
    assert len(first) == min(n, 6)
    assert sorted(first + rest, key=str) == sorted(rows, key=str)
    if seed is None and n:
        assert first.count((None, "a")) == min(n, 2)


def test_numbering_of_nulls_and_of_nothing(spark):
    df = spark.createDataFrame([(None, 3), (1, 2), (2, 4)], "k long, n_tokens int")
    packs = D.pack_wrapped(df, "k", 4).orderBy("pack_id", "pack_start").collect()
    assert [(r.pack_id, r.k, r.start, r.end) for r in packs] == [
        (0, None, 0, 3), (0, 1, 0, 1), (1, 1, 1, 2), (1, 2, 0, 3), (2, 2, 3, 4),
    ]
    none = df.limit(0)
    assert D.pack_wrapped(none, "k", 4).collect() == [] == D.batch_plan(none, "k").collect()
    assert D.cap_rows(none, 5, "k").collect() == []
    train, held = D.train_eval_split(none, "k", 5)
    assert train.collect() == [] == held.collect()
