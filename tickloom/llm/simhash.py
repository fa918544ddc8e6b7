"""SimHash near-duplicates: pigeonhole blocks, then exact Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, prepare, sorted_groups, texts_of
from .components import connected_components

SEED = 42
#: Fingerprints of one block group that a task compares at once; larger groups are cut into tiles of two chunks.
TILE = 2048


def fingerprint(text: bytes, width: int = 3) -> int:
    """The majority bits of the XXH64 of each word shingle of a text; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - [len(w) + 1 for w in words]
    last = min(width, len(words)) - 1
    n = len(words) - last
    digest, view = xxhash.xxh64_intdigest, memoryview(flat)
    return majority(np.fromiter((digest(view[i:j], SEED) for i, j in zip(starts[:n].tolist(), (ends[last:] - 1).tolist())), "<u8", n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without any."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 15):
        part = hashes[lo : lo + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the 64-bit fingerprint as a signed long. Null text counts as empty."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, width) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("id").cast(pa.int64()), pa.array(fp)], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def spanning_edges(fp: np.ndarray, distance: int, chunk: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Tree edges (parent, child) that connect all that lies within the distance of each other, by breadth-first search."""
    left = np.arange(len(fp))
    parents, children = [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            step = max(1, chunk // len(left))
            found = np.full(len(left), -1, np.int64)
            for lo in range(0, len(front), step):
                near = np.bitwise_count(fp[front[lo : lo + step], None] ^ fp[None, left]) <= distance
                hit = near.any(axis=0) & (found < 0)
                found[hit] = front[lo + near[:, hit].argmax(axis=0)]
            new = found >= 0
            parents.append(found[new])
            children.append(left[new])
            front, left = left[new], left[~new]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *parents]), np.concatenate([none, *children])


def block_plan(n: int, distance: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Blocks of the 64 bits, and which of them form each key: keys of some more bits than n distinct values need.

    Two fingerprints that differ in at most `distance` bits agree on all but `distance` of the blocks, so on one key
    at least. More blocks give longer keys and smaller groups; the result is the same for any number of blocks.
    """
    b = distance + 1
    while 2 ** (64 * (b - distance) / b) < 4 * n and b < distance + 8:
        b += 1
    edges = [round(64 * i / b) for i in range(b + 1)]
    keys = list(combinations(range(b), b - distance))
    assert len(keys) == comb(b, distance)
    return list(zip(edges[:-1], edges[1:])), keys


def block_keys(n: int, distance: int) -> Column:
    """The keys of block_plan as an array, of the column fp."""
    blocks, keys = block_plan(n, distance)

    def masked(key: tuple[int, ...]):
        mask = sum(((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in (blocks[i] for i in key))
        return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))

    return F.array(*map(masked, keys))


def near_edges(nodes: DataFrame, n: int, distance: int = 3, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between nodes (node, fp) of distinct fp that connect whatever lies within the distance."""
    keyed = nodes.select("node", "fp", F.posexplode(block_keys(n, distance)).alias("k", "key"))
    sizes = keyed.groupBy("k", "key").agg(F.count("*").alias("size")).filter("size > 1")
    keyed = keyed.join(sizes, ["k", "key"])
    chunks = F.ceil(F.col("size") / F.lit(tile)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    keyed = keyed.withColumn("chunks", chunks).withColumn("own", own).select("k", "key", "node", "fp", F.explode(F.array_distinct(tiles)).alias("t"))
    keyed = keyed.select("k", "key", "node", "fp", F.col("t.i").alias("i"), F.col("t.j").alias("j"))
    by = ["k", "key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, by):
            fp = group.column("fp").to_numpy().view(np.uint64)
            node = group.column("node").to_numpy()
            p, c = spanning_edges(fp, distance)
            if len(p):
                yield pa.record_batch([pa.array(node[p]), pa.array(node[c])], names=["a", "b"])

    return keyed.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """(id_col, fingerprint, component_id) of every document.

    Words are runs without ASCII white space, with A-Z in lower case. Fingerprints within `distance` bits link;
    component_id is the smallest id reachable. Equal fingerprints become one node first, so copies cost one row each
    and never pairs. Null and empty texts have fingerprint zero and link like any other; very long texts are hashed
    whole, in steps of bounded memory. Repeated ids keep a row each. Rows with a null id link like any other, so they
    can join others into one group; component_id is null where no row of the group has an id. Other columns of docs are
    not read; an empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    edges = materialize(near_edges(nodes.select(F.col("fp").alias("node"), "fp"), nodes.count(), distance), "near")
    found = connected_components(edges).withColumnRenamed("node", "fp")
    discard(edges)
    linked = nodes.join(found, "fp")
    least = linked.groupBy("component").agg(F.min("least").alias("of_all"))
    linked = linked.join(least, "component").select("fp", "of_all")
    nodes = nodes.join(linked, "fp", "left").select("fp", F.coalesce("of_all", "least").alias("component_id"))
    return prints.join(nodes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
