"""The fold of trades into bars on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.tape import TAPE_SCHEMA


def read_trades(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Headerless CSV files as they arrive."""
    return spark.readStream.schema(TAPE_SCHEMA).option("header", False).option("maxFilesPerTrigger", files_per_trigger).csv(path)


def stream_bars(trades: DataFrame, divisor: int = 1_000_000, bar_seconds: int = 1, late: str = "10 seconds") -> DataFrame:
    """(ts, price, qty, n_trades, ofi) of each bar that has trades, closed once the watermark has passed it; trades
    later than that are dropped. The clock's unit must be known: a stream has no first row to tell it from."""
    timed = trades.withColumn("event_time", F.timestamp_micros(F.expr(f"time * {1_000_000 // divisor}"))).withWatermark("event_time", late)
    signed = F.when(F.col("is_buyer_maker"), -F.col("qty")).otherwise(F.col("qty"))
    bars = timed.groupBy(F.window("event_time", f"{bar_seconds} seconds").alias("w")).agg(
        F.max_by("price", F.struct("time", "trade_id")).alias("price"), F.sum("qty").alias("qty"), F.count("*").alias("n_trades"), F.sum(signed).alias("ofi")
    )
    return bars.select(F.unix_seconds("w.start").alias("ts"), "price", "qty", "n_trades", "ofi")
