"""N-gram Jaccard join: documents whose shingle sets have a Jaccard similarity of 0.8 or more.

Method.  The distinct shingles of a text are XOR-hashed into a parity sketch: the sketch has ``k``
words of 64 bits, and every shingle XORs its hash into the word it falls on.  Two sketches of the
same size band differ in at most as many words as the two sets differ in shingles, so the Hamming
distance (in words, or in single bits) is a lower bound of the symmetric difference, which for a
pair that links is at most ``d = (|A| + |B|) / 9``.  By the pigeonhole principle, of any ``d + 1``
words of A at least one is equal in B; sorting the words of all sketches by one order (most
shingles first), it is enough that each text shows its first ``d + 1`` words.  Texts that show an
equal word of an equal band are candidates:

1. equal sets become one node (128 documents or a third of the corpus: one node each);
2. each bucket of nodes that show an equal word is compared with one centre, exactly, on the texts;
3. buckets whose nodes are not yet in one component are compared in full, in blocks of bounded size,
   by parity sketches of single bits, whose Hamming distance excludes nearly all pairs that do not
   link.  Of the rest, those that would join parts not yet joined are verified exactly;
4. the same once more for what is then still apart, now with every pair the sketches allow.

After step 4 every pair that shows an equal word is in one component, excluded by its sketches or
verified, so no link between components is lost, nothing is capped, and the pairs within a
component are not listed.

Sizes are cut into bands of four-fold width, each overlapping the next by the factor 1.25 that a
linked pair may differ in.  Small sets (below ``SMALL``) and the rare larger ones whose sketch has
too few used words show single shingles instead of words, which is the limit of many words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from posttrain_spark.llm.components import connected_components
from posttrain_spark.llm.hashing import mix, shingle_sets
from posttrain_spark.operators.skew import skew_join
from posttrain_spark.plans.registry import query, table
from posttrain_spark.session import durable

WIDTH = 5
# Two sets link when PARTS[1] * |A and B| >= PARTS[0] * |A or B|.
PARTS = (4, 5)

SMALL = 40
GROWTH = 4
# Shingles per word of a sketch, for the largest sets of a band.
PER_WORD = 3.2
# A block compared in one task has at most so many sets and shingles.
BLOCK_SETS = 2_000
BLOCK_SHINGLES = 500_000


def max_difference(n: int | np.ndarray, m: int | np.ndarray):
    """Largest symmetric difference of linked sets of these sizes."""
    return (n + m) * (PARTS[1] - PARTS[0]) // (PARTS[1] + PARTS[0])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and PARTS[1] * both >= PARTS[0] * (len(a) + len(b) - both)


def node_of(shingles: np.ndarray) -> int:
    """Identity of a set: 63 bits, independent of the order of its members; never 0."""
    return int(mix(mix(shingles ^ np.uint64(0xA5)).sum(keepdims=True) + np.uint64(len(shingles)))[0] >> np.uint64(1)) | 1


def _bands(n: int) -> Iterator[tuple[int, int]]:
    """Band number (from 1) and upper bound of every band a set of ``n`` shingles belongs to."""
    top, number = SMALL * GROWTH, 1
    while n * PARTS[0] >= top * PARTS[1]:
        top, number = top * GROWTH, number + 1
    while n * GROWTH >= top:
        yield number, top
        top, number = top * GROWTH, number + 1


def _first(n: int, top: int) -> int:
    """How many of its words a set of ``n`` shows: one more than can differ from any partner."""
    partner = min(n * PARTS[1] // PARTS[0], top * PARTS[1] // PARTS[0])
    return int(max_difference(n, partner if n < top else top - 1)) + 1


def shown_words(shingles: np.ndarray) -> np.ndarray:
    """Keys under which a set is looked for and found, one per shown word of its sketches."""
    n = len(shingles)
    keys = []
    single = n * PARTS[0] < SMALL * PARTS[1]
    if n >= SMALL:
        for band, top in _bands(n):
            k = int(top / PER_WORD)
            word = ((shingles >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            order = np.argsort(word, kind="stable")
            used, at, load = np.unique(word[order], return_index=True, return_counts=True)
            value = np.bitwise_xor.reduceat(mix(shingles)[order], at)
            first = _first(n, top)
            single |= len(used) < first
            pick = np.lexsort((used, -load))[:first]
            salt = np.uint64(band) << np.uint64(48)
            keys.append(mix(mix(value[pick] ^ (used[pick] + salt)) + load[pick].astype(np.uint64)))
    if single:
        keys.append(mix(np.sort(mix(shingles))[: _first(n, n * PARTS[1] // PARTS[0] + 1)]))
    return np.concatenate(keys)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column(1), WIDTH))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
            ],
            names=["doc_id", "n_shingles", "node"],
        )


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node); equal sets of one batch show their words once."""
    for batch in batches:
        seen, keys = {}, []
        for s in shingle_sets(batch.column(0), WIDTH):
            if len(s) and (node := node_of(s)) not in seen:
                shown = shown_words(s)
                seen[node] = len(shown)
                keys.append(shown)
        if seen:
            nodes = np.repeat(np.fromiter(seen, np.int64), np.fromiter(seen.values(), np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(nodes)], names=["key", "node"]
            )


def _verify_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both texts, those that link."""
    for batch in batches:
        a, b, text_a, text_b = (batch.column(i) for i in range(4))
        # Rows come sorted by the first node; its text is hashed once per batch.
        nodes, first, inverse = np.unique(a.to_numpy(), return_index=True, return_inverse=True)
        left = list(shingle_sets(text_a.take(pa.array(first)), WIDTH)) if len(nodes) else []
        right = shingle_sets(text_b, WIDTH)
        keep = pa.array([linked(left[i], s) for i, s in zip(inverse, right, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])


def _own_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text has the set of their node (an id may repeat with other texts)."""
    for batch in batches:
        nodes = batch.column(0).to_pylist()
        sets = shingle_sets(batch.column(1), WIDTH)
        yield batch.filter(pa.array([len(s) > 0 and node_of(s) == n for n, s in zip(nodes, sets, strict=True)], pa.bool_()))


def _sketch_bits(n: int) -> int:
    """Bits of the parity sketch of ``n`` shingles: a power of two, at least four per shingle."""
    return 1 << max(8, (4 * n - 1).bit_length())


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, sketches = [], []
        for s in shingle_sets(batch.column(1), WIDTH):
            bits = _sketch_bits(len(s))
            flips = np.bincount((mix(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
            sizes.append(len(s))
            sketches.append(np.packbits((flips & 1).astype(np.uint8)).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())],
            names=["node", "n", "sketch"],
        )


def _folded(sketches: np.ndarray) -> np.ndarray:
    """The same parities in half as many bits."""
    half = sketches.shape[1] // 2
    return sketches[:, :half] ^ sketches[:, half:]


def _near_pairs(sizes: np.ndarray, sketches: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Places ``i`` and the places whose sketches allow a link with it, nearest first, each pair once.

    Linked sets differ in size by a quarter at most, so their sketches have equal widths or one is
    twice as wide as the other.
    """
    width = np.fromiter(map(len, sketches), np.int64, len(sketches))
    rows = {
        w: np.frombuffer(b"".join(sketches[i] for i in np.flatnonzero(width == w)), np.uint64).reshape(-1, w // 8)
        for w in np.unique(width)
    }
    for w in rows:
        own, wider = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        at = np.concatenate([own, wider])
        bits = np.concatenate([rows[w], _folded(rows[2 * w])]) if len(wider) else rows[w]
        for k in range(len(own)):
            distance = np.bitwise_count(bits[k + 1 :] ^ bits[k]).sum(axis=1, dtype=np.int64)
            js = at[k + 1 :]
            near = distance <= max_difference(sizes[js], sizes[own[k]])
            yield own[k], js[near][np.argsort(distance[near], kind="stable")]


def _block_pairs(block: pa.Table, spanning: bool) -> pa.Table:
    """Pairs of one block (sets of one bucket, from one or two of its pieces) to be verified.

    Only sets of different parts are paired.  ``spanning``: only pairs that join parts not joined by
    the pairs before, so there are fewer pairs than sets.
    """
    nodes = block.column("node").to_numpy()
    piece = block.column("piece").to_numpy()
    two = block.column("low")[0].as_py() != block.column("high")[0].as_py()
    _, part = np.unique(block.column("part").to_numpy(), return_inverse=True)
    a, b = [], []
    for i, js in _near_pairs(block.column("n").to_numpy(), block.column("sketch").to_pylist()):
        for j in js[(part[js] != part[i]) & ((piece[js] != piece[i]) | (not two))]:
            if part[j] != part[i]:
                a.append(min(nodes[i], nodes[j]))
                b.append(max(nodes[i], nodes[j]))
                if spanning:
                    part[part == part[j]] = part[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_verify_rows, "a long, b long")


def _open_pairs(shared: DataFrame, roots: DataFrame, sketches: DataFrame, spanning: bool) -> DataFrame:
    """Pairs of nodes that show an equal word, are in different components so far and whose sketches
    allow a link; ``spanning`` as in ``_block_pairs``."""
    part = shared.select("key", "node").join(roots, "node", "left")
    part = part.withColumn("part", F.coalesce("root", "node"))
    open_buckets = part.groupBy("key").agg(F.min("part").alias("_a"), F.max("part").alias("_b"))
    members = durable(
        part.join(open_buckets.filter("_a <> _b"), "key", "left_semi")
        .join(sketches.select("node", "n"), "node")
        .select("key", "node", "part", "n"),
        "members",
    )
    # Buckets that hold the same nodes are compared once, under the smallest of their keys.
    load = members.groupBy("key").agg(
        F.count("*").alias("_sets"),
        F.sum("n").alias("_size"),
        F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("_x"),
        F.sum(F.xxhash64("node", F.lit(7)).cast("decimal(20,0)")).alias("_y"),
    )
    chosen = load.groupBy("_sets", "_size", "_x", "_y").agg(F.min("key").alias("key"))
    pieces = F.greatest(
        F.ceil(F.col("_sets") / BLOCK_SETS), F.ceil(F.col("_size") / BLOCK_SHINGLES)
    ).cast("int")
    placed = (
        members.join(chosen.select("key", pieces.alias("_pieces")), "key")
        .withColumn("piece", F.pmod(F.xxhash64("node"), "_pieces").cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
        .select(
            "key", "node", "part", "piece",
            F.least("piece", "_other").cast("int").alias("low"),
            F.greatest("piece", "_other").cast("int").alias("high"),
        )
    )
    return (
        placed.join(sketches, "node")
        .groupBy("key", "low", "high")
        .applyInArrow(lambda block: _block_pairs(block, spanning), "a long, b long")
        .distinct()
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``doc_id``, ``n_shingles``, ``component_id``, one row per row of ``docs``.

    ``component_id`` is the smallest id reachable by links, the row's own included.  Rows without a
    word (also NULL and empty texts) have 0 shingles, link with nothing and keep their own id.  A
    row whose id is NULL takes part like any other; its component's id is NULL only if no row of the
    component has one.  Rows that repeat an id with other texts stay rows of their own.  Other
    columns of ``docs``, whatever their names, play no part.  An empty table gives an empty result.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = durable(
        source.mapInArrow(_set_rows, "doc_id long, n_shingles long, node long"), "set-nodes"
    )
    nodes = durable(
        rows.filter("node IS NOT NULL").groupBy("node").agg(
            F.min("doc_id").alias("low_id"), F.count("*").alias("_rows")
        ),
        "nodes",
    )
    words = source.select("text").mapInArrow(_word_rows, "key long, node long")
    spread = words.repartition("key").dropDuplicates(["key", "node"])
    by_key = Window.partitionBy("key")
    centre = F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("node"))).over(by_key)
    shared = durable(
        spread.withColumn("_low", F.min("node").over(by_key))
        .withColumn("_high", F.max("node").over(by_key))
        .withColumn("centre", centre["node"])
        .filter("_low <> _high")
        .select("key", "node", "centre"),
        "shared-words",
    )
    wanted = shared.select("node").distinct().join(nodes, "node").select("node", "low_id")
    texts = durable(
        source.join(wanted, F.col("doc_id").eqNullSafe(F.col("low_id")))
        .select("node", "text")
        .mapInArrow(_own_text, "node long, text string")
        .dropDuplicates(["node"]),
        "candidate-texts",
    )
    sketches = durable(
        texts.select("node", "text").mapInArrow(_sketch_rows, "node long, n long, sketch binary"), "sketches"
    )
    ordered = (F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    tried = durable(shared.filter("node <> centre").select(*ordered).distinct(), "pairs-1")
    links = durable(_verified(tried, texts), "links-1")
    for step, spanning in ((2, True), (3, False)):
        roots = durable(connected_components(links), f"roots-{step}")
        pairs = durable(
            _open_pairs(shared, roots, sketches, spanning).join(tried, ["a", "b"], "left_anti"), f"pairs-{step}"
        )
        links = links.unionByName(durable(_verified(pairs, texts), f"links-{step}"))
        tried = tried.unionByName(pairs)
    merged = connected_components(links)
    placed = durable(
        nodes.join(merged, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed"
    )
    lowest = placed.groupBy("root").agg(F.min("low_id").alias("component_id"), F.count("*").alias("_nodes"))
    lowest = durable(lowest, "lowest")
    by_node = durable(
        skew_join(
            placed, lowest.drop("_nodes"), "root", ["node"],
            counts=lowest.select("root", F.col("_nodes").alias("_rows")),
        ).select("node", "component_id"),
        "node-components",
    )
    found = skew_join(
        rows.filter("node IS NOT NULL"), by_node, "node", ["doc_id"], counts=nodes.select("node", "_rows")
    ).select("doc_id", "n_shingles", "component_id")
    return found.unionByName(
        rows.filter("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    )


_ORACLE = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS MATERIALIZED (
  SELECT * FROM shingles WHERE x IN (SELECT x FROM shingles GROUP BY x HAVING count(*) > 1)),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shared a JOIN shared b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a)
SELECT s.doc_id, len(s.s) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = s.doc_id
"""


@query("op1_ngram_jaccard", _ORACLE)
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
