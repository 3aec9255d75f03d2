"""Merkle manifest of a dataset: one tree per language, one over the languages' roots.

Trees are cut into aligned subtrees of equal height (BLOCK_HEIGHT), one stored row each, whose nodes lie
in van Emde Boas order: the levels are split at half height, the top part comes first and the bottom
parts follow one after another, each laid out the same way.  Where a node lies is arithmetic on its
depth and index, which serves both construction and the retrieval of siblings.  Roots of blocks are
the leaves of the next layer of blocks, until a tree is one block.

Leaves ascend by id, rows without an id first; rows that repeat an id ascend by leaf hash.  A NULL
language is a tree of its own and comes first.  NULL fields are told from empty ones.  Very long
texts are hashed whole, next to the scan.  Of equal rows every one is a leaf.  An empty table has no
leaves and gives no rows.  Other columns of the input are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from posttrain_spark.llm.sql import crc32
from posttrain_spark.operators.ordering import rank_rows
from posttrain_spark.operators.skew import skew_join
from posttrain_spark.plans.registry import query, table
from posttrain_spark.session import durable

FANOUT = 8
# A block of this height holds 512 leaves, and 585 nodes of 32 bytes.
BLOCK_HEIGHT = 3

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# -- layout


def tree_size(levels: int) -> int:
    return (FANOUT**levels - 1) // (FANOUT - 1)


def address(depth: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Where the nodes ``index`` of one depth lie in a full tree of so many levels."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(depth, index, top)
    below = levels - top
    span = FANOUT ** (depth - top)
    inside = address(depth - top, index % span, below)
    return tree_size(top) + index // span * tree_size(below) + inside


def height_of(leaves: int) -> int:
    """Levels of edges of a tree over so many leaves."""
    height = 0
    while FANOUT**height < leaves:
        height += 1
    return height


def widths(leaves: int, height: int) -> list[int]:
    """Nodes of a block at each depth, the root first."""
    return [-(-leaves // FANOUT ** (height - d)) for d in range(height + 1)]


def _hex(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def build_block(leaves: list[str], height: int) -> tuple[bytes, str]:
    """The nodes of a block in van Emde Boas order, and its root; nodes that are missing stay zero."""
    nodes = np.zeros((tree_size(height + 1), 32), np.uint8)
    row = leaves
    for depth in range(height, -1, -1):
        raw = np.frombuffer(bytes.fromhex("".join(row)), np.uint8).reshape(-1, 32)
        nodes[address(depth, np.arange(len(row)), height + 1)] = raw
        if depth:
            row = [_hex("".join(row[i : i + FANOUT])) for i in range(0, len(row), FANOUT)]
    return nodes.tobytes(), row[0]


class Block:
    """Sibling retrieval in a stored block below a trail to the root of everything."""

    def __init__(self, nodes: bytes, leaves: int, height: int, trail: list[dict]):
        cells = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
        self.height, self.trail = height, trail
        self.runs: list[list[str]] = []
        for depth, width in enumerate(widths(leaves, height)):
            row = cells[address(depth, np.arange(width), height + 1)].tobytes().hex()
            step = 64 * FANOUT
            self.runs.append([row[i : i + step] for i in range(0, len(row), step)])
        self.above = "".join(t["others"] for t in trail)
        self._proofs: dict[tuple[int, int], str] = {}
        self._folds: dict[tuple[int, int], str] = {}

    def _cut(self, depth: int, index: int) -> tuple[str, str]:
        run, at = self.runs[depth][index // FANOUT], index % FANOUT * 64
        return run[:at], run[at + 64 :]

    def trail_of(self, index: int) -> list[dict]:
        """Place in its run and the other members, level by level up to the last root."""
        out = []
        for depth in range(self.height, 0, -1):
            before, after = self._cut(depth, index)
            out.append({"at": index % FANOUT, "others": before + after})
            index //= FANOUT
        return out + self.trail

    def proof(self, index: int, depth: int | None = None) -> str:
        """The siblings of a node on its way up, one after another."""
        depth = self.height if depth is None else depth
        if not depth:
            return self.above
        before, after = self._cut(depth, index)
        parent = depth - 1, index // FANOUT
        if parent not in self._proofs:
            self._proofs[parent] = self.proof(parent[1], parent[0])
        return before + after + self._proofs[parent]

    def fold(self, value: str, index: int, depth: int | None = None) -> str:
        """The last root, computed from a value in the place of a node and the siblings.

        What follows from a node's own value is computed once per node.
        """
        depth = self.height if depth is None else depth
        if not depth:
            for step in self.trail:
                at = 64 * step["at"]
                value = _hex(step["others"][:at] + value + step["others"][at:])
            return value
        before, after = self._cut(depth, index)
        parent = depth - 1, index // FANOUT
        if before + value + after != self.runs[depth][index // FANOUT]:
            return self.fold(_hex(before + value + after), parent[1], parent[0])
        if parent not in self._folds:
            self._folds[parent] = self.fold(_hex(before + value + after), parent[1], parent[0])
        return self._folds[parent]


# -- construction


@dataclass
class Manifest:
    """Leaves with their places, layers of blocks from the lowest up, and the root of every tree."""

    leaves: DataFrame
    layers: list[DataFrame]
    roots: DataFrame
    height: int = BLOCK_HEIGHT

    @property
    def block(self) -> int:
        return FANOUT**self.height


BLOCKS = "tree string, block long, size long, leaves int, height int, nodes binary, digest string"
TRAIL = "array<struct<at:int,others:string>>"


def _in_order(rows: pa.Table) -> pa.Table:
    return rows.sort_by("ordinal")


def _build(most: int, key: tuple, rows: pa.Table) -> pa.Table:
    rows = _in_order(rows)
    size = rows["size"][0].as_py()
    height = min(most, height_of(size))
    nodes, root = build_block(rows["digest"].to_pylist(), height)
    out = {
        "tree": [key[0].as_py()], "block": [key[1].as_py()], "size": [size], "leaves": [len(rows)],
        "height": [height], "nodes": [nodes], "digest": [root],
    }
    schema = pa.schema([
        ("tree", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("leaves", pa.int32()),
        ("height", pa.int32()), ("nodes", pa.binary()), ("digest", pa.string()),
    ])
    return pa.table(out, schema)


def block_of(ordinal: Column, block: int) -> Column:
    return F.floor(ordinal / block).cast("long")


def build_trees(leaves: DataFrame, height: int = BLOCK_HEIGHT) -> Manifest:
    """Trees over stored ``leaves``: ``tree``, ``size`` (leaves of the tree), ``ordinal``, ``digest``.

    One pass per layer; there are as many layers as the largest tree needs, the logarithm of its
    leaves to the base of a block's leaves.
    """
    block = FANOUT**height

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        return _build(height, key, rows)

    largest = leaves.agg(F.max("size")).first()[0] or 0
    layers, roots = [], []
    items = leaves.select("tree", "size", "ordinal", "digest")
    while largest:
        blocks = items.withColumn("block", block_of(F.col("ordinal"), block)).groupBy("tree", "block")
        layer = durable(blocks.applyInArrow(build, BLOCKS), f"merkle-{len(layers)}")
        layers.append(layer)
        roots.append(layer.filter(F.col("size") <= block).select("tree", F.col("digest").alias("root")))
        items = layer.filter(F.col("size") > block).select(
            "tree", F.ceil(F.col("size") / block).alias("size"), F.col("block").alias("ordinal"), "digest"
        )
        largest = -(-largest // block) if largest > block else 0
    if not layers:
        return Manifest(leaves, [], leaves.select("tree", F.col("digest").alias("root")), height)
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return Manifest(leaves, layers, durable(found, "merkle-roots"), height)


# -- proofs


def _paired(rows: pa.Table, blocks: pa.Table) -> tuple[pa.Table, list[int], Block]:
    """The items of a block in order, their places in it, and the block."""
    rows, found = _in_order(rows), blocks.to_pylist()[0]
    places = [i - found["first"] for i in rows["ordinal"].to_pylist()]
    return rows, places, Block(found["nodes"], found["leaves"], found["height"], found["trail"])


TRAILS = f"tree string, ordinal long, trail {TRAIL}"
_TRAIL = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.string())]))


def _trails(key: tuple, rows: pa.Table, blocks: pa.Table) -> pa.Table:
    rows, places, block = _paired(rows, blocks)
    trails = [block.trail_of(i) for i in places]
    columns = [rows["tree"].cast(pa.string()), rows["ordinal"], pa.array(trails, _TRAIL)]
    return pa.table(columns, ["tree", "ordinal", "trail"])


def _proofs(key: tuple, rows: pa.Table, blocks: pa.Table) -> pa.Table:
    rows, places, block = _paired(rows, blocks)
    folded = [block.fold(v, i) for v, i in zip(rows["claim"].to_pylist(), places)]
    proofs = [_hex(block.proof(i)) for i in places]
    rows = rows.drop_columns(["block"])
    return rows.append_column("proof_sha256", pa.array(proofs)).append_column("folded_root", pa.array(folded))


def _descend(manifest: Manifest, level: int, items: DataFrame, trails: DataFrame, read, schema) -> DataFrame:
    """What ``read`` finds for the items of a layer, block by block, below the trails of the blocks."""
    first = (F.col("block") * manifest.block).alias("first")
    held = manifest.layers[level].join(trails, ["tree", "block"]).select("*", first).groupBy("tree", "block")
    placed = items.withColumn("block", block_of(F.col("ordinal"), manifest.block)).groupBy("tree", "block")
    return placed.cogroup(held).applyInArrow(read, schema)


def _no_trail(trees: DataFrame) -> DataFrame:
    return trees.select("tree", F.array().cast(TRAIL).alias("trail"))


def _down_to(manifest: Manifest, top: DataFrame, lowest: int) -> DataFrame:
    """Trails of the blocks of layer ``lowest``, from those of the trees' roots in ``top``."""
    tops = top.withColumn("block", F.lit(0).cast("long"))
    trails = None
    for level in range(len(manifest.layers) - 1, lowest - 1, -1):
        layer = manifest.layers[level]
        # Trees that end in this layer start from their root's trail, the others from the layer above.
        own = layer.filter(F.col("size") <= manifest.block).select("tree", "block").join(tops, ["tree", "block"])
        if trails is not None:
            items = layer.filter(F.col("size") > manifest.block).select("tree", F.col("block").alias("ordinal"))
            found = _descend(manifest, level + 1, items, trails, _trails, TRAILS)
            own = own.unionByName(found.withColumnRenamed("ordinal", "block").select(own.columns))
        trails = durable(own, f"trails-{level}")
    return trails


def prove(manifest: Manifest, claims: DataFrame, top: DataFrame) -> DataFrame:
    """``claims`` with ``proof_sha256`` and ``folded_root``, the root that follows from ``claim`` in the place
    of the leaf (``tree``, ``ordinal``).  ``top`` holds the trail of every tree's root."""
    schema = claims.select("*", F.lit("").alias("proof_sha256"), F.lit("").alias("folded_root")).schema
    return _descend(manifest, 0, claims, _down_to(manifest, top, 0), _proofs, schema)


def root_trails(manifest: Manifest) -> DataFrame:
    """``tree``, ``ordinal`` and whole trail of every leaf; meant for trees over few leaves."""
    items = manifest.leaves.select("tree", "ordinal")
    trails = _down_to(manifest, _no_trail(manifest.roots), 0)
    return _descend(manifest, 0, items, trails, _trails, TRAILS)


# -- documents


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(**changed: Column) -> Column:
    """The hash of a row's fields, each with its length; ``changed`` gives other values for some."""
    return F.sha2(F.concat(*(_field(changed.get(f, F.col(f))) for f in FIELDS)), 256)


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tree_of(lang: Column) -> Column:
    """A name for each language's tree, never NULL, in the order of the languages with NULL first."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def placed_leaves(leaves: DataFrame, order: list[Column], trees: str = "tree") -> DataFrame:
    """Stored leaves with ``ordinal`` and ``size`` in their tree; a tree of any size is spread."""
    counts = durable(leaves.groupBy(trees).agg(F.count("*").alias("size")), "tree-sizes")
    ranked = rank_rows(leaves, order, group=[trees])
    sized = skew_join(ranked, counts, trees, ["ordinal"], counts=counts.select(trees, F.col("size").alias("_rows")))
    return durable(sized, "merkle-leaves")


def dataset_manifest(docs: DataFrame, height: int = BLOCK_HEIGHT) -> tuple[Manifest, Manifest]:
    """The trees of all languages (leaves carry ``doc_id``, ``digest`` and ``tampered``) and the tree over
    their roots, named by an empty string."""
    spoiled = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = leaf_hash(text=F.translate(F.col("text"), UPPER, UPPER.lower()))
    leaves = durable(
        docs.select(
            tree_of(F.col("lang")).alias("tree"),
            "doc_id",
            leaf_hash().alias("digest"),
            F.when(spoiled, lowered).alias("tampered"),
        ),
        "leaf-hashes",
    )
    languages = build_trees(placed_leaves(leaves, [F.col("doc_id"), F.col("digest")]), height)
    names = languages.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    return languages, build_trees(placed_leaves(durable(names, "subroots"), [F.col("name")]), height)


def verify(docs: DataFrame, height: int = BLOCK_HEIGHT) -> DataFrame:
    """Per row of ``docs``: its leaf, subroot and root, the hash of its proof, and whether the root follows
    from the proof and the leaf, or the leaf of the tampered text."""
    languages, whole = dataset_manifest(docs, height)
    if not languages.layers:
        empty = languages.leaves.select("doc_id", F.col("digest").alias("leaf"))
        names = ("subroot", "root", "proof_sha256", "folded_root")
        return empty.select("*", *(F.lit("").alias(n) for n in names), F.lit(True).alias("verified"))
    root = whole.roots.first()["root"]
    places = whole.leaves.select("ordinal", F.col("name").alias("tree"), F.col("digest").alias("subroot"))
    trails = root_trails(whole).select("ordinal", "trail").join(places, "ordinal")
    trails = durable(trails.drop("ordinal"), "subroot-trails")
    leaves = languages.leaves
    claims = leaves.select(
        "tree", "ordinal", "doc_id", F.col("digest").alias("leaf"), F.coalesce("tampered", "digest").alias("claim")
    )
    proofs = durable(prove(languages, claims, trails.select("tree", "trail")), "proofs")
    sizes = places.join(leaves.groupBy("tree").agg(F.count("*").alias("_rows")), "tree").select("tree", "_rows")
    return skew_join(proofs, places.select("tree", "subroot"), "tree", ["ordinal"], counts=sizes).select(
        "doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )


def _levels(name: str, first: str, heights: int) -> tuple[str, str]:
    """SQL steps that build trees over ``first`` (tree, i, h), and the name of the last one."""
    steps, last = [], first
    for k in range(heights):
        run = "PARTITION BY tree, i // 8 ORDER BY i ROWS BETWEEN"
        steps.append(f"""{name}r{k} AS MATERIALIZED (
            SELECT tree, i, h, i // 8 AS up, count(*) OVER (PARTITION BY tree) AS n,
                   coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
                   coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
            FROM {last})""")
        last = f"{name}l{k}"
        steps.append(f"""{last} AS MATERIALIZED (
            SELECT tree, up AS i, CASE WHEN any_value(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
            FROM {name}r{k} GROUP BY tree, up)""")
    return ", ".join(steps), last


def _folds(name: str, first: str, tree: str, heights: int) -> tuple[str, str]:
    """SQL steps that carry claims (``tree``, i, cur, proof) to the roots."""
    steps, last = [], first
    for k in range(heights):
        steps.append(f"""{name}f{k} AS MATERIALIZED (
            SELECT c.* EXCLUDE (i, cur, proof), c.i // 8 AS i,
                   CASE WHEN r.n = 1 THEN cur ELSE sha256(before || cur || after) END AS cur,
                   CASE WHEN r.n = 1 THEN proof ELSE proof || before || after END AS proof
            FROM {last} c JOIN {name}r{k} r ON r.tree = c.{tree} AND r.i = c.i)""")
        last = f"{name}f{k}"
    return ", ".join(steps), last


def _sql(heights: int = 9, root_heights: int = 4) -> str:
    """The same trees level by level, for up to 8 ** heights rows of a language."""

    def field(f: str) -> str:
        return f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen({f}::VARCHAR) || ':' || {f}::VARCHAR END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(text if f == "text" else f) for f in FIELDS) + ")"

    lowered = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    spoiled = f"{crc32('doc_id::VARCHAR')} % 3 = 0"
    trees, last = _levels("t", "leaves", heights)
    tops, root = _levels("s", "subs", root_heights)
    up, folded = _folds("t", "claims", "tree", heights)
    on, done = _folds("s", "carried", "whole", root_heights)
    return f"""WITH hashed AS MATERIALIZED (
          SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf('text')} AS h,
                 CASE WHEN {spoiled} THEN {leaf(lowered)} END AS spoilt FROM documents),
        placed AS MATERIALIZED (
          SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM hashed),
        leaves AS (SELECT tree, i, h FROM placed), {trees},
        subs AS MATERIALIZED (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, h, tree AS name FROM {last}), {tops},
        claims AS (SELECT doc_id, tree, '' AS whole, h AS leaf, i, coalesce(spoilt, h) AS cur, '' AS proof FROM placed), {up},
        carried AS (SELECT c.* EXCLUDE (i), s.i, s.h AS subroot FROM {folded} c JOIN subs s ON s.name = c.tree), {on}
        SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = r.h AS verified
        FROM {done}, {root} r"""


@query("op12_merkle_manifest", _sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(table(spark, sf_dir, "documents"))
