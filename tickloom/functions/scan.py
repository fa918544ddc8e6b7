"""Ordered computations over one long series without putting it into one task.

A series is keyed by a dense index. Chunks of the index are computed apart; what looks back or ahead gets the rows of
its neighbours that it needs (a halo), and what looks back without a bound carries one value for each chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a chunk.
CHUNK = 1 << 16


def beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """Every row with the columns of a frame that is one aggregate row, sent to all tasks."""
    return df.join(F.broadcast(one))


def with_halo(df: DataFrame, back: int = 0, ahead: int = 0, chunk: int = CHUNK, key: str = "bar_idx") -> DataFrame:
    """Every row in its own chunk and in each chunk whose halo it is in: column `_chunk`."""
    first, last = F.expr(f"(`{key}` - {ahead}) div {chunk}"), F.expr(f"(`{key}` + {back}) div {chunk}")
    return df.withColumn("_chunk", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))


def own_rows(df: DataFrame, chunk: int = CHUNK, key: str = "bar_idx") -> DataFrame:
    """Only the rows that are in their own chunk."""
    return df.filter(F.expr(f"`{key}` div {chunk} = `_chunk`")).drop("_chunk")


def over_frames(df: DataFrame, exprs: Callable[[WindowSpec], Mapping[str, Column]], back: int = 0, ahead: int = 0, chunk: int = CHUNK, key: str = "bar_idx") -> DataFrame:
    """Columns from frames of at most `back` rows before and `ahead` after, in index order."""
    order = Window.partitionBy("_chunk").orderBy(key)
    return own_rows(with_halo(df, back, ahead, chunk, key).withColumns(dict(exprs(order))), chunk, key)


def forward_fill(df: DataFrame, column: str, chunk: int = CHUNK, key: str = "bar_idx") -> DataFrame:
    """The last value that is not null, up to each row. One value for each chunk goes from chunk to chunk."""
    held = df.withColumn("_chunk", F.expr(f"`{key}` div {chunk}"))
    inside = Window.partitionBy("_chunk").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("_seen", F.last(column, ignorenulls=True).over(inside))
    ends = held.groupBy("_chunk").agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col(key))).alias("_end"))
    across = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk
    ends = ends.select("_chunk", F.last("_end", ignorenulls=True).over(across).alias("_carried"))
    held = held.join(ends, "_chunk").withColumn(column, F.coalesce("_seen", "_carried"))
    return held.drop("_chunk", "_seen", "_carried")


def running_sum(df: DataFrame, column: str, order: list[str], part: Column, out: str) -> DataFrame:
    """Sum of all rows up to each, in an order whose parts are told by a column that rises with it."""
    held = df.withColumn("_part", part)
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = held.groupBy("_part").agg(F.sum(column).alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    totals = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    held = held.withColumn(out, F.sum(column).over(inside)).join(totals, "_part")
    return held.withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before")


def positions(df: DataFrame, key: str, chunk: int = CHUNK, out: str = "pos", by: tuple[str, ...] = ()) -> DataFrame:
    """Position of each row in index order from 0, apart for each `by`: counts by chunk, then positions in the chunk."""
    held = df.withColumn("_chunk", F.expr(f"`{key}` div {chunk}"))
    counts = held.groupBy(*by, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_chunk").orderBy(key)
    held = held.withColumn(out, F.row_number().over(inside) - 1).join(counts, [*by, "_chunk"])
    return held.withColumn(out, F.col(out) + F.col("_before")).drop("_chunk", "_before")
