"""Prefix trie of conversations, by union-find over the common prefixes of sorted neighbours.

Conversations, as sequences of 128-bit turn hashes, are sorted over range partitions.  Neighbours
share so many first turns; these edges are taken in descending depth, and every merge of two
components makes the branching node at that depth.  A partition knows how much it shares with the
conversations beyond its two edges, so it can tell nodes that lie in it whole, which it finishes, from
open ones, of which it holds a piece.  The open nodes of a partition form its contracted forest: one
row each.  Forests are merged across boundaries the same way, by walking up the two paths that the
boundary's edge joins.  Nodes between two branching nodes hold the same conversations; they are
spread out at the end.

A conversation is one record: 16 bytes and a length for each of its turns, texts are not moved.
Turns ascend by number, NULL first; turns with one number ascend by hash.  NULL roles and texts are
empty ones.  Rows without a conversation id belong to no conversation and are left out.  Very long
texts count as one hash and a length.  Copies of a conversation, any number of them, are spread over
partitions by id; an empty table has no conversation and gives no node, not even a root.  Other
columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from posttrain_spark.llm.sql import crc32
from posttrain_spark.operators.ordering import in_ranges, slot_partition
from posttrain_spark.plans.registry import query, table
from posttrain_spark.session import durable

WIDTH = 16
# Turns that one task sorts and merges; small inputs are cut finer, to use the session's partitions.
TURNS_PER_PARTITION = 200_000
LEAST_TURNS = 10_000
# Length of the pieces in which the ids that end at a node are hashed.
PIECE = 4_096
NO_ENDS = sha256(b"").hexdigest()


# -- conversations


def turn_hash(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def turn_lists(conversations: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``: hash and UTF-8 bytes of every turn, in order."""
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            "turn",
            turn_hash(F.col("role"), F.col("text")).alias("hash"),
            F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"),
        ).alias("t"),
    )
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Every conversation with its first turns taken from the first one of its block of five.

    As many turns as the CRC-32 of the id modulo 9 says; all if there are fewer, none if that
    conversation is absent.
    """
    lists = durable(turn_lists(conversations), "turn-lists")
    shared = lists.select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("first"))
    taken = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    own = lists.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 5, "taken": taken})
    rest = F.slice("turns", F.col("taken") + 1, F.greatest(F.size("turns") - F.col("taken"), F.lit(0)))
    none = F.array().cast(lists.schema["turns"].dataType)
    first = F.slice(F.coalesce("first", none), F.lit(1), F.col("taken"))
    return own.join(shared, "base", "left").select("conv_id", F.concat(first, rest).alias("turns"))


def sequences(lists: DataFrame) -> DataFrame:
    """``conv_id``, the turn hashes as one binary ``key``, and the bytes of each turn as ``sizes``."""
    return lists.select(
        "conv_id", F.unhex(F.array_join("turns.hash", "")).alias("key"), F.col("turns.size").alias("sizes")
    )


# -- forests


class Forest:
    """Branching nodes over sorted conversations of one partition.

    ``left`` and ``right`` are the turns shared with the conversation before the first and after the
    last one, -1 where there is none.
    """

    def __init__(self, keys: list[bytes], sizes: pa.Array, ids: np.ndarray, left: int, right: int):
        lengths = np.fromiter(map(len, keys), np.int64, len(keys)) // WIDTH
        starts = np.concatenate(([0], np.cumsum(lengths)))
        hashes = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
        shared = self._shared(hashes, lengths, starts)
        # Copies of a conversation are one sequence; their ids ascend.
        same = (shared == lengths[:-1]) & (shared == lengths[1:])
        self.first = np.concatenate(([0], np.flatnonzero(~same) + 1))
        self.ids, self.stop = ids, np.append(self.first[1:], len(keys))
        flat = np.asarray(sizes.flatten(), np.int64)
        self.sums, self.starts = np.concatenate(([0], np.cumsum(flat))), starts
        self.depth = lengths[self.first].tolist()
        self.row = self.first.tolist()
        self.ends = list(range(len(self.first)))
        self.parent = [-1] * len(self.depth)
        self.open = [False] * len(self.depth)
        self.edge = {}
        self._merge(shared[self.first[1:] - 1], left, right)

    @staticmethod
    def _shared(hashes: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Turns that each conversation shares with the next one."""
        least = np.minimum(lengths[:-1], lengths[1:])
        shared = np.zeros(len(least), np.int64)
        at, depth = np.flatnonzero(least > 0), 0
        while len(at):
            equal = (hashes[starts[at] + depth] == hashes[starts[at + 1] + depth]).all(axis=1)
            at, depth = at[equal], depth + 1
            shared[at] = depth
            at = at[least[at] > depth]
        return shared

    def _node(self, depth: int, child: int) -> int:
        self.depth.append(depth)
        self.row.append(self.row[child])
        self.ends.append(-1)
        self.parent.append(-1)
        self.open.append(False)
        return len(self.depth) - 1

    def _under(self, depth: int, top: int) -> int:
        """The node at ``depth`` above ``top``, or ``top`` if it lies there."""
        if self.depth[top] == depth:
            return top
        node = self._node(depth, top)
        self._hang(top, node)
        return node

    def _hang(self, child: int, node: int) -> None:
        self.parent[child] = node
        self.open[node] |= self.open[child]

    def _merge(self, edges: np.ndarray, left: int, right: int) -> None:
        count = len(self.depth)
        link, top = list(range(count)), list(range(count))

        def find(x: int) -> int:
            while link[x] != x:
                link[x] = link[link[x]]
                x = link[x]
            return x

        # (depth, sequence before, sequence after); beyond the partition lies the world, -1.
        edges = [(int(d), i, i + 1) for i, d in enumerate(edges)]
        edges += [(left, -1, 0)] * (left >= 0) + [(right, count - 1, -1)] * (right >= 0)
        for depth, before, after in sorted(edges, key=lambda e: -e[0]):
            if before < 0 or after < 0:
                root = find(max(before, after))
                top[root] = self._under(depth, top[root])
                self.open[top[root]] = True
                self.edge["left" if before < 0 else "right"] = top[root]
                continue
            a, b = find(before), find(after)
            upper, lower = (top[b], top[a]) if self.depth[top[b]] == depth else (top[a], top[b])
            node = self._under(depth, upper)
            self._hang(lower, node)
            link[b] = a
            top[a] = node
        self._under(0, top[find(0)])

    def size(self, row: int, first: int, last: int) -> int:
        """Bytes of the turns ``first`` to ``last`` of a conversation, from 1."""
        s = self.starts[row]
        return int(self.sums[s + last] - self.sums[s + first - 1]) if last >= first else 0

    def tails(self, node: int, above: int) -> list[int]:
        """For each depth from ``above`` + 1 to the node's: bytes of the turns from there to before it."""
        depth, s = self.depth[node], self.starts[self.row[node]]
        if not depth:
            return [0]
        return (self.sums[s + depth - 1] - self.sums[s + above : s + depth]).tolist()

    def ids_ending(self, node: int) -> np.ndarray:
        item = self.ends[node]
        return self.ids[self.first[item] : self.stop[item]] if item >= 0 else self.ids[:0]

    def rows(self) -> Iterator[dict]:
        """Nodes, the deepest first: what closed ones hold, and what open ones hold outside open children."""
        count = len(self.depth)
        convs, leaves, saved, children = [0] * count, [0] * count, [0] * count, [0] * count
        least: list[int | None] = [None] * count
        for node in sorted(range(count), key=lambda n: -self.depth[n]):
            ids, depth, up = self.ids_ending(node), self.depth[node], self.parent[node]
            if len(ids):
                convs[node] += len(ids)
                own = int(ids[0])
                least[node] = own if least[node] is None else min(own, least[node])
            above = self.depth[up] if up >= 0 else -1
            tails = self.tails(node, above)
            last = self.size(self.row[node], depth, depth) if depth else 0
            texts = [str(i) for i in ids.tolist()]
            row = {
                "node": node, "up": up, "open": self.open[node], "depth": depth, "conv_id": least[node],
                "n_convs": convs[node], "n_children": children[node], "tails": tails, "size": last,
            }
            if self.open[node]:
                row |= {"n_leaves": leaves[node], "saved": saved[node], "ends": None, "pieces": list(_pieces(texts))}
            else:
                leaves[node] = leaves[node] or 1
                saved[node] += (convs[node] - 1) * last
                ends = sha256(",".join(texts).encode()).hexdigest()
                row |= {"n_leaves": leaves[node], "saved": saved[node], "ends": ends, "pieces": None}
                if up >= 0:
                    convs[up] += convs[node]
                    leaves[up] += leaves[node]
                    saved[up] += saved[node] + (convs[node] - 1) * tails[0]
                    children[up] += 1
                    least[up] = least[node] if least[up] is None else min(least[up], least[node])
            yield row | {f"at_{side}": self.edge.get(side) == node for side in ("left", "right")}
        self.least = least


def _pieces(texts: list[str]) -> Iterator[str]:
    """Texts joined by commas, in pieces of about PIECE characters."""
    held, size = [], 0
    for text in texts:
        if held and size > PIECE:
            yield ",".join(held)
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield ",".join(held)


NODES = (
    "part long, node int, up int, open boolean, depth long, conv_id long, parent_conv_id long, n_convs long,"
    " n_children long, n_leaves long, saved long, size long, tails array<long>, ends string, pieces array<string>,"
    " at_left boolean, at_right boolean"
)
_LONG = pa.int64()
_NODES = pa.schema([
    ("part", _LONG), ("node", pa.int32()), ("up", pa.int32()), ("open", pa.bool_()), ("depth", _LONG),
    ("conv_id", _LONG), ("parent_conv_id", _LONG), ("n_convs", _LONG), ("n_children", _LONG), ("n_leaves", _LONG),
    ("saved", _LONG), ("size", _LONG), ("tails", pa.list_(_LONG)), ("ends", pa.string()),
    ("pieces", pa.list_(pa.string())), ("at_left", pa.bool_()), ("at_right", pa.bool_()),
])


def _forest(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("_slot")
    left, right = rows["left"][0].as_py(), rows["right"][0].as_py()
    sizes = rows["sizes"].combine_chunks()
    if isinstance(sizes, pa.ChunkedArray):
        sizes = pa.concat_arrays(sizes.chunks)
    forest = Forest(rows["key"].to_pylist(), sizes, rows["conv_id"].to_numpy(), left, right)
    found = list(forest.rows())
    for row in found:
        up = row["up"]
        row["parent_conv_id"] = forest.least[up] if up >= 0 and not forest.open[up] else None
        row["part"] = key[0].as_py()
    return pa.Table.from_pylist([{n: r[n] for n in _NODES.names} for r in found], _NODES)


def _shared_turns(a: Column, b: Column) -> Column:
    turns = F.floor(F.least(F.length(a), F.length(b)) / WIDTH).cast("int")

    def cut(key: Column, i: Column) -> Column:
        return F.substring(key, (i - 1) * WIDTH + 1, F.lit(WIDTH))

    each = F.when(turns > 0, F.sequence(F.lit(1), turns)).otherwise(F.array().cast("array<int>"))
    shared = F.aggregate(
        each, F.lit(0), lambda n, i: F.when((n == i - 1) & (cut(a, i) == cut(b, i)), i).otherwise(n)
    )
    return F.when(a.isNull() | b.isNull(), -1).otherwise(shared)


def forests(keys: DataFrame) -> DataFrame:
    """Closed nodes and open pieces of all partitions, from the result of :func:`sequences`."""
    keys = durable(keys, "sequences")
    shuffles = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = keys.agg(F.sum(F.length("key") / WIDTH + 1)).first()[0] or 0
    cuts = max(int(turns // TURNS_PER_PARTITION), min(shuffles, int(turns // LEAST_TURNS))) + 1
    placed = durable(in_ranges(keys, [F.col("key"), F.col("conv_id")], partitions=cuts), "sorted-sequences")
    placed = placed.withColumn("part", slot_partition())
    edges = placed.groupBy("part").agg(F.min_by("key", "_slot").alias("low"), F.max_by("key", "_slot").alias("high"))
    # One row per partition.
    along = Window.orderBy("part")
    edges = edges.withColumns({"before": F.lag("high").over(along), "after": F.lead("low").over(along)})
    left, right = _shared_turns(F.col("before"), F.col("low")), _shared_turns(F.col("high"), F.col("after"))
    edges = edges.select("part", left.alias("left"), right.alias("right"))
    return placed.join(edges, "part").groupBy("part").applyInArrow(_forest, NODES)


# -- merging across boundaries


class Merged:
    """Open pieces of all partitions, joined at the boundaries into whole nodes."""

    def __init__(self, pieces: list[dict]):
        self.pieces = sorted(pieces, key=lambda p: (p["part"], p["node"]))
        at = {(p["part"], p["node"]): i for i, p in enumerate(self.pieces)}
        self.depth = [p["depth"] for p in self.pieces]
        self.parent = [at.get((p["part"], p["up"]), -1) for p in self.pieces]
        self.link = list(range(len(self.pieces)))
        # Each partition's deepest open node at its left and at its right edge, in order.
        left = [i for i, p in enumerate(self.pieces) if p["at_left"]]
        right = [i for i, p in enumerate(self.pieces) if p["at_right"]]
        for before, after in zip(right, left, strict=True):
            self._join(before, after)

    def find(self, x: int) -> int:
        while x >= 0 and self.link[x] != x:
            self.link[x] = self.link[self.link[x]]
            x = self.link[x]
        return x

    def _join(self, a: int, b: int) -> None:
        """Merge the paths from two nodes to the root, the deepest nodes first."""
        below = -1
        while True:
            a, b = self.find(a), self.find(b)
            if a == b or a < 0 or b < 0:
                upper = a if a >= 0 else b
                if below >= 0:
                    self.parent[below] = upper
                return
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            if below >= 0:
                self.parent[below] = a
            below, up = a, self.parent[a]
            if self.depth[a] == self.depth[b]:
                self.link[b] = a
                b = self.parent[b]
            a = up

    def rows(self) -> Iterator[dict]:
        """One row per piece, with the whole node it belongs to; ``whole`` marks the first piece of each."""
        count = len(self.pieces)
        total: dict[int, dict] = {}
        for i in range(count):
            piece, own = self.pieces[i], total.setdefault(
                self.find(i), {"n_convs": 0, "n_leaves": 0, "saved": 0, "n_children": 0, "conv_id": None, "first": i}
            )
            for name in ("n_convs", "n_leaves", "saved", "n_children"):
                own[name] += piece[name]
            own["conv_id"] = _least(own["conv_id"], piece["conv_id"])
        for i in sorted(total, key=lambda n: -self.depth[n]):
            own, up = total[i], self.find(self.parent[i])
            above = self.depth[up] if up >= 0 else -1
            own["tails"] = self.pieces[i]["tails"][-(self.depth[i] - above) :]
            own["n_leaves"] = own["n_leaves"] or 1
            own["saved"] += (own["n_convs"] - 1) * self.pieces[i]["size"]
            if up >= 0:
                over = total[up]
                over["n_convs"] += own["n_convs"]
                over["n_leaves"] += own["n_leaves"]
                over["saved"] += own["saved"] + (own["n_convs"] - 1) * own["tails"][0]
                over["n_children"] += 1
                over["conv_id"] = _least(over["conv_id"], own["conv_id"])
        for i, piece in enumerate(self.pieces):
            node = self.find(i)
            up = self.find(self.parent[node])
            own = {k: v for k, v in total[node].items() if k != "first"}
            yield own | {
                "part": piece["part"], "node": piece["node"], "merged": node, "whole": total[node]["first"] == i,
                "depth": self.depth[node], "parent_conv_id": total[up]["conv_id"] if up >= 0 else None,
            }


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


WHOLE = (
    "part long, node int, merged long, whole boolean, depth long, conv_id long, parent_conv_id long, n_convs long,"
    " n_children long, n_leaves long, saved long, tails array<long>"
)
_WHOLE = pa.schema([
    ("part", _LONG), ("node", pa.int32()), ("merged", _LONG), ("whole", pa.bool_()), ("depth", _LONG), ("conv_id", _LONG),
    ("parent_conv_id", _LONG), ("n_convs", _LONG), ("n_children", _LONG), ("n_leaves", _LONG), ("saved", _LONG),
    ("tails", pa.list_(_LONG)),
])


def _merge(rows: pa.Table) -> pa.Table:
    return pa.Table.from_pylist(list(Merged(rows.to_pylist()).rows()), _WHOLE)


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's pieces, read in order and never held together."""
    node, state = None, None

    def done():
        return pa.RecordBatch.from_pydict({"merged": pa.array([node], _LONG), "ends": [state.hexdigest()]})

    for batch in batches:
        for merged, piece in zip(batch["merged"].to_pylist(), batch["piece"].to_pylist()):
            if merged != node:
                if state:
                    yield done()
                node, state = merged, sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
    if state:
        yield done()


def prefix_trie(keys: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    nodes = durable(forests(keys), "trie-nodes")
    names = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "tails"]
    pieces = nodes.filter("open").drop("pieces", "ends", "parent_conv_id").withColumn("all", F.lit(0))
    # The contracted forests: one row per partition and node that crosses its edges.
    merged = durable(pieces.groupBy("all").applyInArrow(_merge, WHOLE), "merged-nodes")
    held = nodes.filter("open").select("part", "node", F.posexplode("pieces").alias("at", "piece"))
    held = held.join(merged.select("part", "node", "merged"), ["part", "node"])
    ends = (
        held.select("merged", "part", "at", "piece")
        .repartition("merged")
        .sortWithinPartitions("merged", "part", "at")
        .mapInArrow(_hash_pieces, "merged long, ends string")
    )
    whole = merged.filter("whole").join(ends, "merged", "left").select(*names, F.coalesce("ends", F.lit(NO_ENDS)).alias("ends"))
    above = merged.select(F.col("part"), F.col("node").alias("up"), F.col("conv_id").alias("_open_conv"))
    closed = nodes.filter("NOT open").join(above, ["part", "up"], "left")
    closed = closed.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_open_conv")).select(*names, "ends")
    spread = closed.unionByName(whole).select("*", F.posexplode("tails").alias("_at", "_tail"))
    steps = F.size("tails")
    last = F.col("_at") == steps - 1
    return spread.select(
        "conv_id",
        (F.col("depth") - steps + 1 + F.col("_at")).alias("depth"),
        F.when(F.col("_at") == 0, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("_tail")).alias("saved_tokens"),
        F.when(last, F.col("ends")).otherwise(NO_ENDS).alias("ends_sha256"),
    )


_TAKEN = f"({crc32('conv_id::VARCHAR')} % 9)"


@query(
    "op11_prefix_trie",
    f"""WITH own AS MATERIALIZED (
          SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k,
                 coalesce(role, '') AS role, coalesce(text, '') AS text
          FROM conversations WHERE conv_id IS NOT NULL),
        convs AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 5 AS base, {_TAKEN} AS taken FROM (SELECT DISTINCT conv_id FROM own)),
        turns AS (
          SELECT c.conv_id, 0 AS side, o.k, role, text FROM convs c JOIN own o ON o.conv_id = c.base AND o.k <= c.taken UNION ALL
          SELECT c.conv_id, 1, o.k, role, text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.k > c.taken),
        placed AS (
          SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY side, k) AS d, strlen(text) AS size,
                 sha256(strlen(role) || ':' || role || text) AS h FROM turns),
        steps AS MATERIALIZED (
          SELECT conv_id, 0 AS d, 0 AS size, '' AS prefix FROM convs UNION ALL
          SELECT conv_id, d, size, string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY d) FROM placed),
        lengths AS (SELECT conv_id, max(d) AS n FROM steps GROUP BY 1),
        nodes AS MATERIALIZED (
          SELECT prefix, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
                 coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = n), '') AS ends
          FROM steps JOIN lengths USING (conv_id) GROUP BY prefix),
        edges AS MATERIALIZED (SELECT prefix, left(prefix, 64 * (d - 1)) AS up FROM nodes WHERE d > 0),
        children AS (SELECT up AS prefix, count(*) AS n_children FROM edges GROUP BY 1),
        below AS (
          SELECT s.prefix, count(*) FILTER (WHERE c.n_children IS NULL) AS n_leaves, sum((v.n_convs - 1) * v.size) AS saved
          FROM nodes v JOIN steps s ON s.conv_id = v.conv_id AND s.d <= v.d LEFT JOIN children c ON c.prefix = v.prefix GROUP BY 1)
        SELECT v.conv_id, v.d::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(c.n_children, 0) AS n_children,
               b.n_leaves, b.saved::BIGINT AS saved_tokens, sha256(v.ends) AS ends_sha256
        FROM nodes v JOIN below b USING (prefix) LEFT JOIN children c USING (prefix)
        LEFT JOIN edges e USING (prefix) LEFT JOIN nodes p ON p.prefix = e.up""",
)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(sequences(rebuilt(table(spark, sf_dir, "conversations"))))
