"""Embedding near-duplicates: rotated vectors in low-dimensional blocks, range joins under shares of the distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, prepare, sorted_groups
from .components import connected_components
from .vectors import dimensions, even, keyed, matrix, usable

#: Rows of a tile on each side, and pairs that are compared at once.
TILE, PAIRS = 8192, 1 << 21
#: Relative slack of each block's share, against rounding.
SLACK = 1e-9
#: Leading coordinates of a block that make its grid: the first number, and one more beyond each of these many nodes.
GRID, FINER = 3, (200_000, 2_000_000)
#: Squared distances in single precision are off by less than this.
ROUNDING = 1e-5


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(nodes: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Principal axes of the unit vectors, dealt to blocks in turn by the caller, and the spread along each."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim))
        for batch in batches:
            u = _unit(matrix(batch.column("vec"), dim))
            total[:dim] += u.T @ u
            total[dim] += u.sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "x"])

    sums = nodes.select("vec").mapInArrow(moments, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i").x.to_numpy()
    n = max(1, nodes.count())
    mean = sums[dim * dim :] / n
    values, axes = np.linalg.eigh(sums[: dim * dim].reshape(dim, dim) / n - np.outer(mean, mean))
    return axes[:, ::-1], np.sqrt(np.maximum(values[::-1], 0))


def _near(a: np.ndarray, b: np.ndarray, budget: float, na: np.ndarray, nb: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) of block coordinates within the budget, by one product in single precision that lets
    a little more through; of two vectors whose home is the same cell, the smaller node asks."""
    left = np.column_stack([a, (a * a).sum(1), np.ones(len(a))]).astype(np.float32)
    right = np.column_stack([-2 * b, np.ones(len(b)), (b * b).sum(1)]).astype(np.float32)
    i, j = np.divmod(np.flatnonzero((left @ right.T).ravel() <= np.float32(budget + ROUNDING)), len(b))
    other = ~home[j] | (na[i] < nb[j])
    return i[other], j[other]


def _link(q: np.ndarray, c: np.ndarray, uq: np.ndarray, uc: np.ndarray, nq: np.ndarray, nc: np.ndarray, home: np.ndarray, block: int, blocks: list[slice], budgets: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of q, row of c) that link and whose first block within its share is this one."""
    s = blocks[block]
    i, j = _near(uq[:, s], uc[:, s], budgets[block], nq, nc, home)
    out_i, out_j = [], []
    for lo in range(0, len(i), 1 << 16):
        x, y = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
        apart = (uq[x] - uc[y]) ** 2
        mine = apart[:, s].sum(1) <= budgets[block]
        for earlier in range(block):
            mine &= apart[:, blocks[earlier]].sum(1) > budgets[earlier]
        x, y = x[mine], y[mine]
        ok = _cosines(q[x], c[y]) >= cosine
        out_i.append(x[ok])
        out_j.append(y[ok])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = even(x), even(y)
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least node reachable) of an edge list."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _told(node: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Rows (node, links, null) and (node, null, other) of the linked pairs (i, j) of a group."""
    links = (np.bincount(i, size[j], len(node)) + np.bincount(j, size[i], len(node))).astype(np.int64)
    some = np.flatnonzero(links)
    a, b = _forest(node[i], node[j])
    return pa.record_batch([pa.array(np.concatenate([node[some], a])), pa.array([*links[some].tolist(), *[None] * len(a)], pa.int64()), pa.array([*[None] * len(some), *b.tolist()], pa.int64())], names=["node", "links", "other"])


LINKS = "node long, links long, other long"


def few_links(nodes: DataFrame, cosine: float) -> DataFrame:
    """LINKS of nodes whose lengths have vectors.FEW rows at most: each length is compared by itself."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["len"]):
            x = matrix(group.column("vec"), group.column("len")[0].as_py())
            node, size = group.column("node").to_numpy(), group.column("size").to_numpy()
            found = [np.zeros((2, 0), np.int64)]
            for k in range(len(x) - 1):
                near = np.flatnonzero(_cosines(np.broadcast_to(x[k], x[k + 1 :].shape), x[k + 1 :]) >= cosine) + k + 1
                found.append(np.stack([np.full(len(near), k), near]))
            i, j = np.concatenate(found, axis=1)
            if len(i):
                yield _told(node, size, i, j)

    own = nodes.select("node", "size", "vec", F.size("vec").alias("len"))
    return own.repartition("len").sortWithinPartitions("len").mapInArrow(compare, LINKS)


def embedding_links(nodes: DataFrame, n: int, dim: int, cosine: float, n_blocks: int = 8) -> DataFrame:
    """Of nodes (node, size, vec) of one length, LINKS: rows (node, links, null) that count linked vectors, and edges
    (node, null, other).

    Unit vectors with cosine c differ by 2 - 2c in squared distance. It is shared among the blocks in proportion to
    their spread; a pair that links stays within its share in one block at least, whatever the rotation. There, each
    vector looks for partners in its own cell of a grid over the block's leading coordinates, to which all vectors
    of later cells within the share's radius are copied: of two cells, the earlier one compares. Cells are compared
    twice: first by the block's coordinates alone, in single precision, and then, of the vectors that had a partner,
    exactly by the whole vectors, which travel only here. A pair counts in the first block that has it, so nothing is
    counted twice; pairs never become rows.
    """
    axes, spread = rotation(nodes, dim)
    n_blocks = max(1, min(n_blocks, dim))
    deal = np.concatenate([np.arange(b, dim, n_blocks) for b in range(n_blocks)])  # each block gets strong and weak axes
    axes, spread = axes[:, deal], spread[deal]
    widths = [len(range(b, dim, n_blocks)) for b in range(n_blocks)]
    ends = np.cumsum(widths)
    blocks = [slice(int(e - w), int(e)) for e, w in zip(ends, widths)]
    energy = np.array([(spread[s] ** 2).sum() for s in blocks]) + 1e-12
    budgets = (2 - 2 * cosine) * energy / energy.sum() * (1 + SLACK) + 1e-12
    radius = np.sqrt(budgets) + 1e-9
    grid = GRID + sum(n > x for x in FINER)
    sides = [[max(2 * r, 1e-3, 4 * spread[j] * (TILE / max(n, 1)) ** (1 / grid)) for j in range(s.start, min(s.stop, s.start + grid))] for r, s in zip(radius, blocks)]

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = _unit(matrix(batch.column("vec"), dim)) @ axes
            rows = np.arange(batch.num_rows)
            for b, s in enumerate(blocks):
                cell, at = np.zeros(len(rows), np.int64), rows
                home = np.ones(len(rows), bool)  # so far; what is not has gone to an earlier cell
                for k, side in enumerate(sides[b]):
                    x = u[at, s.start + k]
                    own = np.floor(x / side).astype(np.int64)
                    parts = []
                    for step in (-1, 0, 1):
                        reached = own + step
                        ok = (x + radius[b] >= reached * side) & (x - radius[b] < (reached + 1) * side) if step else np.ones(len(x), bool)
                        if step > 0:
                            ok &= ~home
                        parts.append((cell[ok] * 4096 + reached[ok] + 2048, at[ok], home[ok] & (step == 0)))
                    cell, at, home = (np.concatenate(p) for p in zip(*parts))
                flat = np.ascontiguousarray(u[:, s], np.float32)
                packed = pa.array([r.tobytes() for r in flat], pa.binary()).take(pa.array(at))
                yield pa.record_batch([pa.array(np.full(len(at), b, np.int32)), pa.array(cell), pa.array(home), batch.column("node").take(pa.array(at)), packed], names=["b", "cell", "home", "node", "part"])

    placed = nodes.select("node", "vec").mapInArrow(copies, "b int, cell long, home boolean, node long, part binary")
    placed = materialize(placed, "cells")
    counts = placed.groupBy("b", "cell").agg(F.sum(F.col("home").cast("long")).alias("nq"), F.count("*").alias("nc")).filter("nq > 0 and nc > 1")
    counts = counts.select("b", "cell", F.ceil(F.col("nq") / TILE).cast("int").alias("nq"), F.ceil(F.col("nc") / TILE).cast("int").alias("nc"))
    own_i, own_j = F.pmod(F.xxhash64("node"), F.col("nq")).cast("int"), F.pmod(F.xxhash64("node"), F.col("nc")).cast("int")
    tiles = placed.join(counts, ["b", "cell"]).withColumn("i0", own_i).withColumn("j0", own_j)
    asked = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("nc") - 1), lambda j: F.struct(F.col("i0").alias("i"), j.alias("j"), F.lit(True).alias("q"), (j == F.col("j0")).alias("c"))))
    offered = F.transform(F.sequence(F.lit(0), F.col("nq") - 1), lambda i: F.struct(i.alias("i"), F.col("j0").alias("j"), F.lit(False).alias("q"), F.lit(True).alias("c")))
    offered = F.when(F.col("home"), F.filter(offered, lambda x: x["i"] != F.col("i0"))).otherwise(offered)
    every = F.concat(F.coalesce(asked, F.array().cast("array<struct<i:int,j:int,q:boolean,c:boolean>>")), offered)
    tiles = tiles.select("b", "cell", "home", "node", "part", F.explode(every).alias("t")).select("b", "cell", "t.i", "t.j", "t.q", "t.c", "home", "node", "part")
    by = ["b", "cell", "i", "j"]

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, by):
            node, home = group.column("node").to_numpy(), group.column("home").to_numpy()
            x = np.frombuffer(b"".join(group.column("part").to_pylist()), np.float32).reshape(len(node), -1)
            asks, offers = np.flatnonzero(group.column("q").to_numpy()), np.flatnonzero(group.column("c").to_numpy())
            budget = budgets[group.column("b")[0].as_py()] + ROUNDING  # the coordinates are rounded, too
            q, c = np.zeros(len(node), bool), np.zeros(len(node), bool)
            step = max(1, PAIRS // max(1, len(offers)))
            for lo in range(0, len(asks), step):
                rows = asks[lo : lo + step]
                i, j = _near(x[rows], x[offers], budget, node[rows], node[offers], home[offers])
                q[rows[i]], c[offers[j]] = True, True
            some = pa.array(np.flatnonzero(q | c))
            if len(some):
                yield pa.record_batch([*(group.column(k).combine_chunks().take(some) for k in (*by, "home", "node")), pa.array(q).take(some), pa.array(c).take(some)], names=[*by, "home", "node", "q", "c"])

    paired = tiles.repartition(*by).sortWithinPartitions(*by).mapInArrow(screen, "b int, cell long, i int, j int, home boolean, node long, q boolean, c boolean")
    paired = materialize(paired, "paired")
    discard(placed)
    whole = paired.hint("merge").join(nodes.select("node", "size", "vec"), "node").select(*by, "home", "node", "q", "c", "size", "vec")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, by):
            node, size = group.column("node").to_numpy(), group.column("size").to_numpy()
            x = matrix(group.column("vec"), dim)
            u = _unit(x) @ axes
            home = group.column("home").to_numpy()
            asks, offers = np.flatnonzero(group.column("q").to_numpy()), np.flatnonzero(group.column("c").to_numpy())
            block = group.column("b")[0].as_py()
            step = max(1, PAIRS // max(1, len(offers)))
            for lo in range(0, len(asks), step):
                rows = asks[lo : lo + step]
                i, j = _link(x[rows], x[offers], u[rows], u[offers], node[rows], node[offers], home[offers], block, blocks, budgets, cosine)
                if len(i):
                    yield _told(node, size, rows[i], offers[j])

    return whole.repartition(*by).sortWithinPartitions(*by).mapInArrow(join, LINKS)


def embedding_groups(rows: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row of an embedding table.

    Vectors link whose cosine in double precision is at least `cosine` (0 to 1); components are scaled by a power of
    two first, so very long and very short vectors link like others. Equal vectors are one node first, and count each
    other; nodes of near vectors are never expanded into pairs of rows, and cells with many vectors are cut into tiles,
    which all are compared. Vectors of each length are compared among themselves. Null, zero and non-finite vectors
    link with nothing. Repeated ids keep a row each. Rows with a null id link and count like any other; component_id is
    null where no row of the component has an id. An empty table gives no rows; extra columns are not read.
    """
    prepare(rows.sparkSession, 8 << 20)
    held = materialize(keyed(rows, id_col, vec_col), "vectors")
    nodes = held.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"), F.first("vec").alias("vec"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    large, few = dimensions(nodes)
    parts = [embedding_links(part, part.count(), dim, cosine) for dim in large for part in [nodes.filter(F.size("vec") == dim)]]
    if few:
        parts.append(few_links(nodes.filter(~F.size("vec").isin(large)), cosine))
    found = [materialize(p, "vector-links") for p in parts] or [nodes.select("node", F.lit(0).cast("long").alias("links"), F.lit(0).cast("long").alias("other")).limit(0)]
    found = reduce(DataFrame.unionByName, found)
    groups = connected_components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.filter("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    told = nodes.select("h1", "h2", "node", "least", "size").join(links, "node", "left").join(groups, "node", "left")
    told = told.withColumn("component", F.coalesce("component", "node"))
    of_all = told.groupBy("component").agg(F.min("least").alias("component_id"))
    told = told.join(of_all, "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    own = F.col(id_col).cast("long")
    every = rows.select(own.alias("vec_id"), F.xxhash64(vec_col).alias("h1"), F.xxhash64(F.lit(1), vec_col).alias("h2"), usable(vec_col).alias("part"))
    inside = every.filter("part").join(told, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    outside = every.filter("not part").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = inside.unionByName(outside)
    return out.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
