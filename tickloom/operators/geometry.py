"""Which target to trade: what each barrier and horizon asks of a model, from prices alone."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.constants import BPS, SECONDS_PER_DAY
from tickloom.functions.quantiles import exact_quantiles
from tickloom.functions.scan import beside
from tickloom.operators.barriers import triple_barrier
from tickloom.operators.costs import required_hit_rate
from tickloom.operators.features import valid_windows


def geometry_grid(bars: DataFrame, gate: DataFrame, window: int, barriers_bps: Sequence[float], horizons: Sequence[int], round_trip_bps: float, gate_quantile: float = 0.9, bar_seconds: int = 1) -> DataFrame:
    """One row for each (barrier_bps, horizon_s): resolved shares of all and of gated windows, captured move, overshoot,
    hit rates that break even, hold and trades a day. Windows are the same for every cell, sized by the longest
    horizon; the gate (bar_idx, start, realized_variance) admits its upper share of them."""
    held = valid_windows(gate, bars, window, max(horizons))
    cut = exact_quantiles(held, "realized_variance", (gate_quantile,)).select(F.col("cut").alias("_cut"))
    held = beside(held, cut).select("bar_idx", (F.col("realized_variance") >= F.col("_cut")).alias("admitted"))
    cells = [triple_barrier(bars, h, b * BPS).select("bar_idx", "side", "exit_offset", "defined", F.lit(float(b)).alias("barrier_bps"), F.lit(h).alias("horizon_s")) for h in horizons for b in barriers_bps]
    every = reduce(DataFrame.unionByName, cells).join(held, "bar_idx")
    price = bars.select("bar_idx", "price")
    every = every.join(price, "bar_idx").withColumn("_exit", F.col("bar_idx") + F.col("exit_offset")).join(bars.select(F.col("bar_idx").alias("_exit"), F.col("price").alias("_out")), "_exit")
    resolved = (F.col("side") != 0) & F.col("defined")
    move = F.abs(F.col("_out") / F.col("price") - 1) / BPS
    admitted = F.col("admitted")
    rows = every.groupBy("barrier_bps", "horizon_s").agg(
        F.count("*").alias("n_windows"), F.avg(resolved.cast("double")).alias("resolved_share"), F.coalesce(F.avg(F.when(admitted, resolved.cast("double"))), F.lit(0.0)).alias("resolved_share_gated"),
        F.coalesce(F.avg(F.when(resolved, move)), F.lit(0.0)).alias("captured_bps"), F.avg(F.when(admitted, F.col("exit_offset"))).alias("mean_hold_s"),
    )
    return rows.select(
        "barrier_bps", "horizon_s", "n_windows", "resolved_share", "resolved_share_gated", "captured_bps", (F.col("captured_bps") / F.col("barrier_bps") - 1).alias("overshoot_pct"),
        required_hit_rate(F.col("resolved_share"), F.col("captured_bps"), round_trip_bps).alias("required_hit_rate"), required_hit_rate(F.col("resolved_share_gated"), F.col("captured_bps"), round_trip_bps).alias("required_hit_rate_gated"),
        "mean_hold_s", F.try_divide(F.lit(SECONDS_PER_DAY / bar_seconds), F.nullif("mean_hold_s", F.lit(0.0))).alias("trades_per_day"),
    )


def shortlist(cells: DataFrame, breakeven_bps: float, min_trades_per_day: float = 50, n: int = 8) -> DataFrame:
    """The n cells that ask least of a model, of those wider than the costs and with trades enough."""
    good = (F.col("barrier_bps") > breakeven_bps) & (F.col("trades_per_day") >= min_trades_per_day) & F.col("required_hit_rate_gated").isNotNull()
    return cells.filter(good).orderBy("required_hit_rate_gated", "barrier_bps", "horizon_s").limit(n)
