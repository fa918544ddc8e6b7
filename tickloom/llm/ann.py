"""Approximate nearest neighbours: a graph by NN-descent in Spark joins, searched greedily."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, prepare, sorted_groups
from .vectors import dimensions, keyed, matrix

#: Vectors of one stretch of a random line that the first graph compares with each other.
STRETCH = 512
#: Nodes whose neighbourhoods a task compares at once.
NODES = 128
#: Descent ends when a round changes no more than this share of the edges, search when a round opens no node.
SETTLED, MOST_ROUNDS = 0.05, 40


def _least(near: DataFrame, k: int) -> DataFrame:
    """The k nearest of each node's (node, nbr, d), each neighbour once. A node that very many name is cut down in two
    steps, so no task holds all of them."""
    near = near.groupBy("node", "nbr").agg(F.min("d").alias("d"))
    part = near.withColumn("salt", F.pmod(F.xxhash64("nbr"), F.lit(16)))
    rank = F.row_number().over(Window.partitionBy("node", "salt").orderBy("d", "nbr"))
    part = part.withColumn("r", rank).filter(F.col("r") <= k)
    rank = F.row_number().over(Window.partitionBy("node").orderBy("d", "nbr"))
    return part.select("node", "nbr", "d", rank.alias("r")).filter(F.col("r") <= k).select("node", "nbr", "d")


def _pairs(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each row among the rows."""
    n = len(ids)
    d = (x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * (x @ x.T)
    np.fill_diagonal(d, np.inf)
    k = min(k, n - 1)
    at = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.zeros((n, 0), np.int64)
    rows = np.repeat(np.arange(n), k)
    return ids[rows], ids[at.ravel()], np.maximum(d[rows, at.ravel()], 0).astype(np.float32)


def first_graph(nodes: DataFrame, dim: int, k: int, lines: int, seed: int) -> DataFrame:
    """(node, nbr, d): neighbours within stretches of random lines. Stretches have a set length, so equal projections
    crowd none."""
    directions = np.random.default_rng(seed).normal(size=(lines, dim))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = matrix(batch.column("vec"), dim) @ directions.T
            for line in range(lines):
                yield pa.record_batch([pa.array(np.full(batch.num_rows, line, np.int32)), pa.array(p[:, line]), batch.column("node"), batch.column("vec")], names=["line", "at", "node", "vec"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows >= 2 * STRETCH:
                yield out(held.slice(0, STRETCH))
                held = held.slice(STRETCH)
        if held is not None and held.num_rows:
            yield out(held)

    def out(part: pa.Table) -> pa.RecordBatch:
        a, b, d = _pairs(part.column("node").to_numpy(), matrix(part.column("vec"), dim), k)
        return pa.record_batch([pa.array(a), pa.array(b), pa.array(d)], names=["node", "nbr", "d"])

    kind = nodes.schema["vec"].dataType.simpleString()
    lined = nodes.select("node", "vec").mapInArrow(project, f"line int, at double, node long, vec {kind}")
    lined = lined.repartitionByRange("line", "at", "node").sortWithinPartitions("line", "at", "node")
    return _least(lined.mapInArrow(compare, "node long, nbr long, d float"), k)


def _short(nodes: DataFrame, dim: int) -> DataFrame:
    """(node, code): vectors as bytes of single precision."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vec"), dim, np.float32)
            yield pa.record_batch([batch.column("node"), pa.array([r.tobytes() for r in x], pa.binary())], names=["node", "code"])

    return nodes.select("node", "vec").mapInArrow(code, "node long, code binary")


def descend(graph: DataFrame, codes: DataFrame, dim: int, k: int, reverse: int, give: int) -> DataFrame:
    """One round: everyone's neighbours, and the nearest of those that name it, meet each other; who finds a nearer
    one than its farthest neighbour takes it."""
    back = _least(graph.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "d"), reverse)
    far = graph.groupBy("node").agg(F.max("d").alias("far"), F.count("*").alias("n")).select(F.col("node").alias("nbr"), F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(float("inf"))).alias("far"))
    met = graph.select("node", "nbr").unionByName(back.select("node", "nbr")).distinct()
    known = codes.withColumnRenamed("node", "nbr").join(far, "nbr", "left")
    met = met.join(known, "nbr").select("node", "nbr", "code", F.coalesce("far", F.lit(float("inf")).cast("float")).cast("float").alias("far"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            table = pa.concat_tables(held)
            host = table.column("node").to_numpy()
            if not len(host):
                continue
            whole = int(np.searchsorted(host, host[-1]))  # the last host may go on
            if whole:
                yield from compare(table.slice(0, whole))
            held = [table.slice(whole)]
        if held:
            yield from compare(pa.concat_tables(held))

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        host = table.column("node").to_numpy()
        if not len(host):
            return
        guest, far = table.column("nbr").to_numpy(), table.column("far").to_numpy()
        x = np.frombuffer(b"".join(table.column("code").to_pylist()), np.float32).reshape(-1, dim)
        starts = np.append(np.flatnonzero(np.diff(host, prepend=host[0] - 1)), len(host))
        for lo in range(0, len(starts) - 1, NODES):
            begin = starts[lo : min(lo + NODES, len(starts) - 1)]
            size = starts[lo + 1 : lo + 1 + len(begin)] - begin
            at = begin[:, None] + np.arange(size.max())
            there = np.arange(size.max()) < size[:, None]
            at = np.where(there, at, begin[:, None])
            v = x[at]
            square = np.einsum("ijk,ijk->ij", v, v)
            d = square[:, :, None] + square[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
            d[~(there[:, :, None] & there[:, None, :])] = np.inf
            d[:, np.arange(at.shape[1]), np.arange(at.shape[1])] = np.inf
            g = min(2 * give, d.shape[2])
            best = np.argpartition(d, g - 1, axis=2)[:, :, :g]
            apart = np.isinf(np.take_along_axis(d, best, axis=2))
            found = np.empty(best.shape, np.float32)
            for m in range(g):  # by differences: products of long or close vectors lose the small distances
                gap = v - v[np.arange(len(v))[:, None], best[:, :, m]]
                found[:, :, m] = np.einsum("ijk,ijk->ij", gap, gap)
            found[apart | (found >= far[at][:, :, None])] = np.inf
            if g > give:
                least = np.argpartition(found, give - 1, axis=2)[:, :, :give]
                best, found = np.take_along_axis(best, least, axis=2), np.take_along_axis(found, least, axis=2)
            i, j, m = np.nonzero(np.isfinite(found))
            yield pa.record_batch([pa.array(guest[at[i, j]]), pa.array(guest[at[i, best[i, j, m]]]), pa.array(np.maximum(found[i, j, m], 0))], names=["node", "nbr", "d"])

    fresh = met.repartition("node").sortWithinPartitions("node").mapInArrow(meet, "node long, nbr long, d float")
    return _least(graph.unionByName(fresh.filter("node != nbr")), k)


def neighbour_graph(nodes: DataFrame, dim: int, k: int = 32, lines: int = 4, reverse: int = 32, give: int = 12, settled: float = SETTLED, seed: int = 0) -> DataFrame:
    """(node, nbr, d) with about the k nearest of every node of (node, vec): rounds of descent until one changes no
    more than the share `settled` of the edges."""
    codes = materialize(_short(nodes, dim), "codes")
    graph = materialize(first_graph(nodes, dim, k, lines, seed), "graph")
    for _ in range(MOST_ROUNDS):
        new = materialize(descend(graph, codes, dim, k, reverse, give), "graph")
        changed, edges = new.join(graph, ["node", "nbr"], "left_anti").count(), new.count()
        discard(graph)
        graph = new
        if changed <= settled * edges:
            break
    discard(codes)
    return graph


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, dim: int, beam: int = 256, width: int = 128, reverse: int = 32) -> DataFrame:
    """(query, node, d): greedy search from each query (query, node, vec), where node is its own place in the graph.

    A round opens the `width` nearest unopened ones of the `beam` nearest nodes seen, and looks at their neighbours
    and at the nearest of those that name them; a query ends when its whole beam is open, and the beam is what it
    found. All queries go in one plan, whose state is their beams.
    Vectors meet their query by a sort, so nothing is sent to all tasks; d is the squared distance in double precision.
    """
    back = _least(graph.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "d"), reverse)
    links = materialize(graph.select("node", "nbr").unionByName(back.select("node", "nbr")).distinct(), "links")
    asked = queries.select("query", F.lit(-1).cast("long").alias("node"), "vec")  # comes before its nodes

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["query"]):
            x = matrix(group.column("vec"), dim)
            apart = x[1:] - x[0]
            yield pa.record_batch([group.column("query").combine_chunks()[1:], group.column("node").combine_chunks()[1:], pa.array(np.einsum("ij,ij->i", apart, apart))], names=["query", "node", "d"])

    def measured(pairs: DataFrame) -> DataFrame:
        rows = pairs.hint("merge").join(nodes.select("node", "vec"), "node").select("query", "node", "vec").unionByName(asked)
        return rows.repartition("query").sortWithinPartitions("query", "node").mapInArrow(measure, "query long, node long, d double")

    held = materialize(measured(queries.select("query", "node")).withColumn("opened", F.lit(False)), "beam")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "node"))
    for _ in range(MOST_ROUNDS):
        front = held.filter(~F.col("opened")).withColumn("r", rank).filter(F.col("r") <= width)
        if front.isEmpty():
            break
        # what fell out of a beam can be met again, but never comes back, as beams only get nearer
        new = front.select("query", "node").join(links, "node").select("query", F.col("nbr").alias("node")).distinct().join(held.select("query", "node"), ["query", "node"], "left_anti")
        left = F.row_number().over(Window.partitionBy("query", "opened").orderBy("d", "node"))
        after = held.withColumn("r", left).select("query", "node", "d", (F.col("opened") | (F.col("r") <= width)).alias("opened"))
        near = after.unionByName(measured(new).withColumn("opened", F.lit(False))).withColumn("r", rank)
        near = materialize(near.filter(F.col("r") <= beam).drop("r"), "beam")
        discard(held)
        held = near
    discard(links)
    return held.select("query", "node", "d")


def among_few(nodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, node, d) of the k + 1 nearest nodes (node, least, vec) of each query, where lengths have vectors.FEW rows
    at most: each length is compared by itself."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["len"]):
            x = matrix(group.column("vec"), group.column("len")[0].as_py())
            node, least = group.column("node").to_numpy(), group.column("least").to_numpy()
            for q in np.flatnonzero(group.column("asks").to_numpy()):
                d = ((x - x[q]) ** 2).sum(axis=1)
                best = np.lexsort((least, d))[: k + 1]
                yield pa.record_batch([pa.array(np.full(len(best), node[q])), pa.array(node[best]), pa.array(d[best])], names=["query", "node", "d"])

    rows = nodes.join(queries.select("node", F.lit(True).alias("asks")), "node", "left").select("node", "least", "vec", F.coalesce("asks", F.lit(False)).alias("asks"), F.size("vec").alias("len"))
    return rows.repartition("len").sortWithinPartitions("len").mapInArrow(compare, "query long, node long, d double")


def nearest(rows: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", **graph) -> DataFrame:
    """(query_id, rank, id_col, score): of each row whose id is divisible by `every`, the k nearest other rows found.

    All rows are in the graph of their length's vectors; vectors of different lengths are no candidates of each other.
    Equal vectors are one node, of which the k + 1 smallest ids can be answers (no others could be among the nearest
    k). score is the Euclidean distance of the original vectors in double precision, infinite where that overflows;
    ties go to the smaller id. Null, zero and non-finite vectors and null ids take no part; of rows that repeat an id
    each counts, but for the query's own id. Fewer than k other rows: all that the search finds. An empty table gives
    no rows; extra columns are not read.
    """
    spark = rows.sparkSession
    prepare(spark, 8 << 20)
    held = materialize(keyed(rows, id_col, vec_col).filter("vec_id is not null"), "vectors")
    nodes = held.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.first("vec").alias("vec"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    named = materialize(held.select("vec_id", "h1", "h2").join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("vec_id", "node"), "named")
    discard(held)
    salted = Window.partitionBy("node", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    firsts = named.distinct().withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k + 1)
    firsts = firsts.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).filter(F.col("r") <= k + 1).select("node", "vec_id")

    asking = named.filter(F.pmod("vec_id", F.lit(every)) == 0)
    queries = materialize(asking.select("node").distinct().join(nodes.select("node", "vec"), "node").select(F.col("node").alias("query"), "node", "vec"), "queries")
    large, few = dimensions(nodes)
    parts = []
    for dim in large:
        own = nodes.filter(F.size("vec") == dim).select("node", "vec")
        parts.append(search(neighbour_graph(own, dim, **graph), own, queries.filter(F.size("vec") == dim), dim))
    if few:
        parts.append(among_few(nodes.filter(~F.size("vec").isin(large)), queries, k))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double").withColumnRenamed("vec_id", id_col)
    found = reduce(DataFrame.unionByName, parts).join(nodes.select("node", "least"), "node")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "least"))
    found = found.withColumn("r", rank).filter(F.col("r") <= k + 1).select("query", "node", "d")
    answers = found.join(firsts, "node").select("query", "vec_id", "d")
    asked = asking.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")).distinct()
    answers = asked.join(answers, "query").filter("query_id != vec_id").groupBy("query_id", "vec_id").agg(F.min("d").alias("d"))
    last = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))
    answers = answers.withColumn("rank", last).filter(F.col("rank") <= k)
    return answers.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(id_col), F.sqrt("d").alias("score"))
