"""Documents' token counts from flat token files without an index: a scan for the separator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import END, default_paths, encoder
from .common import materialize, prepare

#: Tokens of one block of a flat file.
BLOCK = 1 << 18
#: Blocks whose sums one step of the prefix scan holds together.
SPAN = 1024
BLOCKS = "file long, block long, tokens binary"


def write_token_blocks(docs: DataFrame, block: int = BLOCK, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Flat token files: one for each input partition, the documents' ids each followed by END, cut into blocks of
    uint16 without regard to documents. Rows (file, block, tokens, doc_ids); doc_ids names the documents that end in
    the block, in order, and is for joining names back, not for finding ends: scan() does not read it."""
    prepare(docs.sparkSession)
    paths = paths or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file = encoder(*paths, True).ids, TaskContext.get().partitionId()
        held, size, number, ended = [], 0, 0, []
        names = ["file", "block", "tokens", "doc_ids"]

        def cut(data: np.ndarray, ids: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([data.tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint16(END))
                while size + len(ids) > block:
                    n = block - size
                    yield cut(np.concatenate([*held, ids[:n]]), ended)
                    held, size, ids, ended, number = [], 0, ids[n:], [], number + 1
                held.append(ids)
                size += len(ids)
                ended.append(doc_id)
        if size:
            yield cut(np.concatenate(held), ended)

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, BLOCKS + ", doc_ids array<long>")


def blocks_of_files(spark, path: str, block: int = BLOCK, width: int = 2) -> DataFrame:
    """BLOCKS of flat binary files of little-endian ids under a path that Spark can read; each file's rows numbered.
    A file is read whole by one task, so write files of a few hundred MB at most."""
    prepare(spark)
    read = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column("file").to_pylist(), batch.column("content")):
                view, step = data.as_buffer(), block * width
                for number, lo in enumerate(range(0, view.size, step)):
                    yield pa.record_batch([pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([view.slice(lo, min(step, view.size - lo)).to_pybytes()], pa.binary())], names=["file", "block", "tokens"])

    return read.mapInArrow(run, BLOCKS)


def scan(blocks: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """(file, ordinal, n_tokens, complete): each document of each file in order, its tokens without the separator.

    Each block is searched for separators at once. A document that began in an earlier block gets the tokens that
    earlier blocks left open, by a prefix scan in two steps: over the spans of SPAN blocks of a file, then inside each
    span, so no task holds more than a span's sums or a file's spans. Tokens after a file's last separator are one more
    document with complete = false. Empty blocks count as nothing; null tokens as an empty block.
    """
    prepare(blocks.sparkSession)
    kind = {1: "u1", 2: "<u2", 4: "<u4"}[width]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lengths, tails = [], [], []
            for data in batch.column("tokens"):
                ids = np.frombuffer(data.as_buffer() or b"" if data.is_valid else b"", kind)
                at = np.flatnonzero(ids == end)
                n.append(len(ids))
                lengths.append(np.diff(at, prepend=-1) - 1)
                tails.append(len(ids) - 1 - (at[-1] if len(at) else -1))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lengths])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *lengths]).astype(np.int64)))
            yield pa.record_batch([batch.column("file"), batch.column("block"), pa.array(tails, pa.int64()), lists], names=["file", "block", "tail", "lengths"])

    found = materialize(blocks.select("file", "block", "tokens").mapInArrow(search, "file long, block long, tail long, lengths array<long>"), "ends")
    found = found.withColumn("span", F.expr(f"block div {SPAN}")).withColumn("ends", F.size("lengths"))

    def run_of(over):  # a run starts at each block or span that has a separator; what its tails sum to stays open
        return F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(over.rowsBetween(Window.unboundedPreceding, 0))

    inside = Window.partitionBy("file", "span").orderBy("block")
    runs = found.withColumn("run", run_of(inside))
    spans = runs.groupBy("file", "span", "run").agg(F.sum("tail").alias("tail"), F.sum("ends").alias("ends"))
    spans = spans.groupBy("file", "span").agg(F.max_by("tail", "run").alias("tail"), F.sum("ends").alias("ends"))
    across = Window.partitionBy("file").orderBy("span")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("run", run_of(across))
    spans = spans.withColumn("open", F.sum("tail").over(Window.partitionBy("file", "run").orderBy("span")))
    spans = spans.select("file", "span", F.coalesce(F.lag("open").over(across), F.lit(0)).alias("span_open"), F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("span_ends"))

    runs = runs.withColumn("open", F.sum("tail").over(Window.partitionBy("file", "span", "run").orderBy("block")))
    runs = runs.withColumn("before", F.lag("open").over(inside)).withColumn("run_before", F.coalesce(F.lag("run").over(inside), F.lit(0)))
    runs = runs.withColumn("nth", F.coalesce(F.sum("ends").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = runs.join(spans, ["file", "span"])
    carried = F.coalesce("before", F.lit(0)) + F.when(F.col("run_before") == 0, F.col("span_open")).otherwise(0)
    runs = runs.select("file", "block", "tail", "ends", "lengths", carried.alias("carried"), (F.col("span_ends") + F.col("nth")).alias("first"))
    docs = runs.select("file", "carried", "first", F.posexplode("lengths").alias("i", "n"))
    docs = docs.select("file", (F.col("first") + F.col("i")).alias("ordinal"), (F.col("n") + F.when(F.col("i") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("complete"))
    last = runs.groupBy("file").agg(F.max_by(F.struct((F.col("first") + F.col("ends")).alias("ordinal"), (F.col("tail") + F.when(F.col("ends") == 0, F.col("carried")).otherwise(0)).alias("n_tokens")), "block").alias("x"))
    rest = last.select("file", "x.ordinal", "x.n_tokens", F.lit(False).alias("complete")).filter("n_tokens > 0")
    return docs.unionByName(rest)


def document_token_counts(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens, file, ordinal) of every document, by writing flat token files and scanning them.

    Null and empty texts have 0 tokens; repeated rows are counted each; null ids keep their row; an empty table gives
    no rows; extra columns are not read."""
    blocks = materialize(write_token_blocks(docs, block), "tokens")
    names = blocks.select("file", "block", "doc_ids")
    span = F.expr(f"block div {SPAN}")
    inside = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    spans = names.groupBy("file", span.alias("span")).agg(F.sum(F.size("doc_ids")).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("file", "span", F.coalesce(before, F.lit(0)).alias("base"))
    names = names.withColumn("span", span).withColumn("nth", F.coalesce(F.sum(F.size("doc_ids")).over(inside), F.lit(0))).join(spans, ["file", "span"])
    names = names.select("file", F.posexplode("doc_ids").alias("i", "doc_id"), (F.col("base") + F.col("nth")).alias("at")).select("file", (F.col("at") + F.col("i")).alias("ordinal"), "doc_id")
    return names.join(scan(blocks), ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
