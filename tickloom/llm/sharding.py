"""Shards of near equal bytes: sampled splitters, range partitions, overfull ranges cut further. Native operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Cells of the hash's leading bits, through which a record finds its splitters.
CELLS = 4096
SAMPLES_PER_RANGE = 32
#: Ranges of each shard at most, and by how much a range may exceed its share before it is cut again.
FINEST, OVERFULL = 100, 1.5
_KEY = ("h", "d", "u")


def _cell(h: str = "h") -> Column:
    return (F.shiftright(h, 52) + CELLS // 2).cast("int")


def _least(column: str) -> Column:
    return F.lit(-(1 << 63)).alias(column)


def _weight(stats: dict) -> Column:
    """A record's part of all bytes and of all rows, half each: ranges are even in both."""
    return (F.col("size") / F.lit(float(stats["total"])) + F.lit(1.0 / max(1, stats["n"]))) / 2


def _draw(keys: DataFrame, stats: dict, wanted: float, salt: int) -> DataFrame:
    """A weighted sample of about `wanted` keys."""
    draw = F.pmod(F.xxhash64(*_KEY, F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return keys.filter(draw < _weight(stats) * F.lit(float(wanted)))


def _splitters(keys: DataFrame, stats: dict, ranges: int) -> DataFrame:
    """Quantiles (h, d, u) of the sample. A splitter whose hash no other has starts at that hash's first record, so a
    range boundary cuts a group of equal texts only where the group alone fills several ranges."""
    nth = _draw(keys, stats, ranges * SAMPLES_PER_RANGE, 7).select(*_KEY).withColumn("nth", F.row_number().over(Window.orderBy(*_KEY)))
    nth = nth.filter(F.col("nth") % SAMPLES_PER_RANGE == 0)
    alone = F.count("*").over(Window.partitionBy("h")) == 1
    return nth.select("h", *(F.when(alone, _least(c)).otherwise(F.col(c)).alias(c) for c in ("d", "u"))).distinct()


def _cells(splitters: DataFrame) -> DataFrame:
    """For each cell, the number of splitters before it and its own ones: CELLS rows."""
    own = splitters.groupBy(_cell().alias("cell")).agg(F.array_sort(F.collect_list(F.struct(*_KEY))).alias("own"))
    every = splitters.sparkSession.range(CELLS).select(F.col("id").cast("int").alias("cell")).join(own, "cell", "left")
    before = F.coalesce(F.sum(F.size("own")).over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = every.withColumn("own", F.coalesce("own", F.array().cast("array<struct<h:bigint,d:bigint,u:bigint>>")))
    return every.select("cell", "own", before.alias("before"))


def _ranged(keys: DataFrame, splitters: DataFrame) -> DataFrame:
    """The keys with the number of the range that they lie in."""
    passed = F.size(F.filter("own", lambda s: s <= F.struct(*_KEY)))
    return keys.withColumn("cell", _cell()).join(F.broadcast(_cells(splitters)), "cell").withColumn("rng", (F.col("before") + passed).cast("int")).drop("cell", "own", "before")


def _filled(ranged: DataFrame) -> DataFrame:
    return ranged.groupBy("rng").agg(F.sum("size").alias("b"), F.count("*").alias("r"))


def _finer(keys: DataFrame, splitters: DataFrame, stats: dict, ranges: int) -> DataFrame:
    """The splitters, and more of them inside the ranges that hold more than OVERFULL shares of all bytes or rows, from
    a sample of those ranges that is eight times denser."""
    most = OVERFULL / ranges
    over = _filled(_ranged(keys, splitters)).filter((F.col("b") > F.lit(most * stats["total"])) | (F.col("r") > F.lit(most * stats["n"]))).select("rng")
    ranged = _ranged(_draw(keys, stats, ranges * SAMPLES_PER_RANGE * 8, 11), splitters).join(F.broadcast(over), "rng", "left_semi")
    nth = ranged.withColumn("nth", F.row_number().over(Window.partitionBy("rng").orderBy(*_KEY))).filter(F.col("nth") % (SAMPLES_PER_RANGE * 4) == 0)
    alone = F.count("*").over(Window.partitionBy("h")) == 1
    more = nth.select("h", *(F.when(alone, _least(c)).otherwise(F.col(c)).alias(c) for c in ("d", "u")))
    return splitters.unionByName(more).distinct()


def shard_assignments(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 100_000) -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard): law `bytes`.

    Records are ordered by a hash of the text, then by id; range i of that order by bytes is shard i. Equal texts
    stay in one shard unless their group holds over half a hundredth of a shard, which is cut by id. Shards differ
    from the mean by about that and one document. slot counts from 0 in each shard, in the same order. Sampled
    splitters, weighted by bytes and rows, cut the order into ranges that tasks sort, between 8 and FINEST for each
    shard; ranges that turn out overfull are cut again. No text is shuffled.

    Null text has size 8 and the empty text's checksum, and lies with the empty texts. Null ids come first. Repeated
    rows each have a slot, and ranges can cut between them. An empty table gives no rows; extra columns are not read.
    Very long texts count by their bytes; a text longer than a shard's share makes its shard that long.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("h"))
    keys = materialize(keys.withColumn("d", F.coalesce("id", _least("d"))).withColumn("u", F.monotonically_increasing_id()), "shard-keys")
    found = keys.agg(F.count("*").alias("n"), F.sum("size").alias("total")).first()
    n, total = found["n"], found["total"] or 1
    stats = {"n": n, "total": total}
    ranges = min(shards * FINEST, max(shards * 8, n // rows_per_range))
    splitters = materialize(_splitters(keys, stats, ranges), "splitters")
    ranged = _ranged(keys, materialize(_finer(keys, splitters, stats, ranges), "splitters"))

    order = Window.partitionBy("rng").orderBy(*_KEY)
    group = Window.partitionBy("rng", "h")
    placed = ranged.select("id", "size", "crc", "h", "rng", F.row_number().over(order).alias("nth"), (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("at"))
    placed = placed.withColumn("first", F.min("at").over(group)).withColumn("bytes", F.sum("size").over(group))

    before = Window.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    filled = _filled(ranged).select("rng", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r0"))

    placed = placed.join(F.broadcast(filled), "rng")
    whole = F.col("bytes") * F.lit(shards * 200) <= F.lit(total)
    middle = F.col("b0") + F.when(whole, F.col("first") + F.expr("bytes div 2")).otherwise(F.col("at") + F.expr("size div 2"))
    placed = placed.withColumn("middle", middle).withColumn("row", F.col("r0") + F.col("nth") - 1)
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"middle * {shards} div {total}")).cast("int"))
    placed = materialize(placed.select("id", "size", "crc", "shard", "row"), "shards")
    discard(keys, splitters)
    starts = placed.groupBy("shard").agg(F.min("row").alias("start"))
    return placed.join(F.broadcast(starts), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
