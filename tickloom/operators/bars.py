"""Trades to a gap-free grid of bars, and grids to longer grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scan import CHUNK, forward_fill, positions
from tickloom.sources.tape import with_divisor

BAR_COLUMNS = ("bar_idx", "ts", "price", "qty", "n_trades", "ofi")


def sparse_bars(tape: DataFrame, bar_seconds: int = 1) -> DataFrame:
    """(ts, price, qty, n_trades, ofi) of each bar that has trades: last price by time and id, sums of quantity and of
    quantity signed by the aggressor. One partial and one final hash aggregate."""
    clock = F.expr(f"(time div divisor) div {bar_seconds} * {bar_seconds}")
    signed = F.when(F.col("is_buyer_maker"), -F.col("qty")).otherwise(F.col("qty"))
    return (
        with_divisor(tape)
        .groupBy(clock.alias("ts"))
        .agg(F.max_by("price", F.struct("time", "trade_id")).alias("price"), F.sum("qty").alias("qty"), F.count("*").alias("n_trades"), F.sum(signed).alias("ofi"))
    )


def regular_grid(sparse: DataFrame, bar_seconds: int = 1, chunk: int = CHUNK) -> DataFrame:
    """Every bar from the first to the last: empty ones carry the last price and have no flow.

    The index is dealt out by chunks, so no task makes more than one chunk of it at a time.
    """
    bounds = sparse.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).filter("lo is not null")
    last = f"(hi - lo) div {bar_seconds}"
    chunks = bounds.select("lo", F.expr(last).alias("last"), F.explode(F.expr(f"sequence(0L, {last} div {chunk})")).alias("c"))
    chunks = chunks.repartition("c")
    grid = chunks.select("lo", F.explode(F.sequence(F.col("c") * chunk, F.least(F.col("c") * chunk + chunk - 1, F.col("last")))).alias("bar_idx"))
    grid = grid.select("bar_idx", (F.col("lo") + F.col("bar_idx") * bar_seconds).alias("ts"))
    filled = grid.join(sparse, "ts", "left")
    zero = F.lit(0.0)
    filled = filled.select("bar_idx", "ts", "price", F.coalesce("qty", zero).alias("qty"), F.coalesce("n_trades", F.lit(0)).cast("long").alias("n_trades"), F.coalesce("ofi", zero).alias("ofi"))
    return forward_fill(filled, "price", chunk).select(*BAR_COLUMNS)


def fold_bars(tape: DataFrame, bar_seconds: int = 1) -> DataFrame:
    """Tape to bars."""
    return regular_grid(sparse_bars(tape, bar_seconds), bar_seconds)


def bar_meta(bars: DataFrame, source: str = "") -> DataFrame:
    """One row: source, n_bars, first_ts, last_ts, traded_seconds, empty_seconds."""
    traded = F.sum((F.col("n_trades") > 0).cast("long"))
    return bars.agg(F.lit(source).alias("source"), F.count("*").alias("n_bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.coalesce(traded, F.lit(0)).alias("traded_seconds"), (F.count("*") - F.coalesce(traded, F.lit(0))).alias("empty_seconds"))


def hourly_trades(bars: DataFrame, per_hour: int = 3600) -> DataFrame:
    """Trades in each whole hour of bars, the unfinished one left out."""
    grouped = bars.groupBy(F.expr(f"bar_idx div {per_hour}").alias("hour")).agg(F.sum("n_trades").alias("n_trades"), F.count("*").alias("n"))
    return grouped.filter(F.col("n") == per_hour).select("hour", "n_trades")


def dataset_stats(bars: DataFrame, bar_seconds: int = 1) -> DataFrame:
    """What a data sheet shows: sizes, span, volume and price range in one row."""
    return bars.agg(
        F.count("*").alias("n_bars"), (F.count("*") * bar_seconds / 86400.0).alias("days"), F.sum((F.col("n_trades") > 0).cast("long")).alias("traded"), F.sum((F.col("n_trades") == 0).cast("long")).alias("empty"),
        F.sum("n_trades").alias("trades"), F.sum("qty").alias("volume"), F.min("price").alias("low"), F.max("price").alias("high"),
    )


def check_no_overlap(spans: DataFrame) -> None:
    """Raise where a part (part, first_ts, last_ts) begins before the one before it ends. Parts are few."""
    after = F.lead("first_ts").over(Window.orderBy("first_ts", "part"))
    bad = spans.withColumn("next", after).filter("next <= last_ts").select("part", "last_ts", "next").first()
    if bad:
        raise ValueError(f"bar parts overlap: one starts at {bad['next']}, before {bad['last_ts']}")


def concat_bars(parts: list[DataFrame], bar_seconds: int = 1) -> DataFrame:
    """Parts of one series in time order, gaps between them filled as empty bars. Overlap raises."""
    if not parts:
        raise ValueError("no bars to join")
    if len(parts) == 1:
        return parts[0]
    tagged = [p.select(F.lit(i).alias("part"), "ts", "price", "qty", "n_trades", "ofi") for i, p in enumerate(parts)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    check_no_overlap(every.groupBy("part").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))
    return regular_grid(every.drop("part"), bar_seconds)


def month_label(ts: str = "ts"):
    return F.date_format(F.timestamp_seconds(F.col(ts)), "yyyy-MM")


def slice_months(bars: DataFrame, labels: list[str]) -> DataFrame:
    """The bars of the named months (yyyy-MM), indexed anew. A missing month raises, and so do months with one between
    them that is left out."""
    tagged = bars.withColumn("_month", month_label())
    blocks = tagged.groupBy("_month").agg(F.min("bar_idx").alias("lo"), F.max("bar_idx").alias("hi")).orderBy("lo").collect()  # a row for each month
    there = [r["_month"] for r in blocks]
    missing = sorted(set(labels) - set(there))
    if missing:
        raise ValueError(f"months {missing} are not in the bars")
    picked = [there.index(x) for x in sorted(set(labels))]
    if picked and picked != list(range(picked[0], picked[-1] + 1)):
        raise ValueError(f"months {sorted(labels)} are not contiguous")
    first = blocks[picked[0]]["lo"] if picked else 0
    kept = tagged.filter(F.col("_month").isin(sorted(set(labels)))).drop("_month")
    return kept.withColumn("bar_idx", F.col("bar_idx") - F.lit(first))


def reindex(bars: DataFrame) -> DataFrame:
    """bar_idx counted from 0 by time, for bars that are not on a grid."""
    return positions(bars.drop("bar_idx"), "ts", out="bar_idx", chunk=CHUNK * 64)
