"""Trade tapes: headerless CSV with a fixed schema, time units, slices, and tapes derived from other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.scan import beside, running_sum

#: Column order of the archive's files.
TAPE_SCHEMA = T.StructType(
    [
        T.StructField("trade_id", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("qty", T.DoubleType()),
        T.StructField("quote_qty", T.DoubleType()),
        T.StructField("time", T.LongType()),
        T.StructField("is_buyer_maker", T.BooleanType()),
        T.StructField("is_best_match", T.BooleanType()),
    ]
)


def scan_trades(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Headerless CSV files or folders of them; the schema is never inferred."""
    return spark.read.schema(TAPE_SCHEMA).option("header", False).csv(path)


def with_event_time(tape: DataFrame) -> DataFrame:
    """The tape with `event_time`, whatever unit `time` is in."""
    return with_divisor(tape).withColumn("event_time", F.timestamp_micros(F.expr("time * (1000000 div divisor)"))).drop("divisor")


def time_divisor(least: Column) -> Column:
    """Ticks of the raw clock in a second, told by the size of the smallest stamp: micro-, milliseconds or seconds."""
    return F.when(least > 10**14, F.lit(1_000_000)).when(least > 10**11, F.lit(1_000)).otherwise(F.lit(1)).cast("long")


def with_divisor(tape: DataFrame) -> DataFrame:
    """The tape with its `divisor`, from one aggregate row."""
    return beside(tape, tape.agg(time_divisor(F.min("time")).alias("divisor")))


def time_slice(tape: DataFrame, hours: float | None = None, skip_hours: float = 0) -> DataFrame:
    """Rows of [start, start + hours), where start is the first stamp plus skip_hours."""
    if hours is not None and hours <= 0:
        raise ValueError("hours must be positive")
    if not hours and not skip_hours:
        return tape
    per_hour = 3600 * time_divisor(F.min("time"))
    start = (F.min("time") + F.lit(float(skip_hours)) * per_hour).cast("long")
    end = (F.min("time") + F.lit(float(skip_hours + (hours or 0))) * per_hour).cast("long")
    kept = beside(tape, tape.agg(start.alias("_start"), end.alias("_end"))).filter(F.col("time") >= F.col("_start"))
    if hours is not None:
        kept = kept.filter(F.col("time") < F.col("_end"))
    return kept.drop("_start", "_end")


def derived_tape(rows: DataFrame, key: str, stamp: str, cents: Column, qty: Column) -> DataFrame:
    """A deterministic tape of a table with a key and a stamp: integer price steps, summed in time order."""
    picked = rows.select(F.col(key).cast("long").alias("trade_id"), F.unix_micros(F.col(stamp).cast("timestamp")).alias("time"), cents.cast("long").alias("cents"))
    step = F.pmod(F.col("trade_id") * F.col("trade_id") * 31 + F.col("trade_id") * 7919 + F.col("cents") * 13, F.lit(101)) - 50
    day = F.expr("time div 86400000000")
    moved = running_sum(picked.withColumn("step", step), "step", ["time", "trade_id"], day, "moved")
    price = (F.lit(700_000) + F.col("moved")) / 100.0
    moved = moved.withColumn("price", price).withColumn("qty", qty)
    maker = F.pmod(F.col("trade_id") * 3 + F.col("cents"), F.lit(2)) == 0
    return moved.select("trade_id", "price", "qty", (F.col("price") * F.col("qty")).alias("quote_qty"), "time", maker.alias("is_buyer_maker"), F.lit(True).alias("is_best_match"))


def events_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return derived_tape(events, "event_id", "ts", F.round(F.col("value") * 100), F.col("cents") / 100.0)


def orders_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return derived_tape(orders, "o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") * 100), (F.pmod("cents", F.lit(1000)) + 1) / 100.0)
