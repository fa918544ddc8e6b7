"""What trading costs: fees, spread, slippage, and the hit rate that pays for them."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.constants import BPS, MAKER_FEE_BPS, MAX_WAIT, MEASURED_SLIPPAGE_BPS, ORDER_SIZE, QUEUE_AHEAD, SECONDS_PER_DAY, TAKER_FEE_BPS, TICK_SIZE
from tickloom.functions.quantiles import exact_quantiles
from tickloom.functions.scan import beside, over_frames
from tickloom.sources.tape import with_divisor


@dataclass(frozen=True)
class Execution:
    entry: str = "taker"
    exit: str = "taker"
    queue_ahead: float = QUEUE_AHEAD
    max_wait: int = MAX_WAIT
    size: float = ORDER_SIZE

    def __post_init__(self) -> None:
        for side in (self.entry, self.exit):
            if side not in ("taker", "maker"):
                raise ValueError(f"execution is taker or maker, not {side!r}")


@dataclass(frozen=True)
class Costs:
    taker_fee_bps: float = TAKER_FEE_BPS
    maker_fee_bps: float = MAKER_FEE_BPS
    slippage_bps: float = MEASURED_SLIPPAGE_BPS
    half_spread_bps: float | None = None  # None: estimated from the bars; nothing where there are none

    def side_bps(self, how: str) -> float:
        return self.maker_fee_bps if how == "maker" else self.taker_fee_bps + (self.half_spread_bps or 0.0) + self.slippage_bps

    def round_trip_bps(self, execution: Execution) -> float:
        return self.side_bps(execution.entry) + self.side_bps(execution.exit)

    def with_spread(self, bars: DataFrame) -> Costs:
        if self.half_spread_bps is not None:
            return self
        return replace(self, half_spread_bps=half_spread(bars).first()["half_spread_bps"])


def required_hit_rate(resolved: Column, captured: Column, round_trip: float | Column) -> Column:
    """Hit rate among resolved trades that breaks even; null without a payoff, over 1 where none is enough."""
    payoff = resolved * captured
    cost = round_trip if isinstance(round_trip, Column) else F.lit(float(round_trip))
    return F.when(payoff > 0, 0.5 * (1 + F.try_divide(cost, payoff)))


def half_spread(bars: DataFrame, block: int = SECONDS_PER_DAY, least: int = 100) -> DataFrame:
    """One row: half_spread_bps, method, roll_blocks, tick_floor_bps.

    Roll's estimate of each block of bars from the serial covariance of its log price changes that are not zero, where
    it has `least` of them and the covariance is negative; the median block counts. Half a tick of the median price is
    the floor. The last block is left out, whole or not.
    """
    n = bars.agg((F.max("bar_idx") + 1).alias("_len"))
    moved = over_frames(bars.select("bar_idx", F.log("price").alias("p")), lambda w: {"d": F.col("p") - F.lag("p").over(w)}, back=1)
    moved = moved.withColumn("block", F.expr(f"bar_idx div {block}"))
    moved = beside(moved, n).filter((F.col("bar_idx") % block != 0) & (F.col("d") != 0) & (F.col("block") * block < F.col("_len") - block))
    inside = Window.partitionBy("block").orderBy("bar_idx")
    pairs = moved.withColumn("before", F.lag("d").over(inside))
    each = pairs.groupBy("block").agg(F.count("*").alias("n"), F.covar_samp("before", "d").alias("cov"))
    roll = each.filter((F.col("n") >= least) & (F.col("cov") < 0)).agg(F.count("*").alias("roll_blocks"), F.percentile(2 * F.sqrt(-F.col("cov")), 0.5).alias("spread"))
    floor = exact_quantiles(bars, "price", (0.5,)).agg((F.lit(0.5 * TICK_SIZE / BPS) / F.max("cut")).alias("tick_floor_bps"))
    both = beside(roll, floor).withColumn("roll", F.col("spread") / 2 / BPS)
    method = F.when(F.col("roll").isNull(), "tick floor (no block resolves)").when(F.col("roll") >= F.col("tick_floor_bps"), "Roll").otherwise("tick floor (above Roll)")
    return both.select(F.greatest(F.coalesce("roll", "tick_floor_bps"), "tick_floor_bps").alias("half_spread_bps"), method.alias("method"), "roll_blocks", "tick_floor_bps")


def sweep_slippage(tape: DataFrame, size: float = ORDER_SIZE, by: tuple[str, ...] = (), block: int = 3600) -> DataFrame:
    """(by..., trade_id, slippage_bps) of each run of trades by one side that reaches `size`: its volume-weighted price
    for that size against its first print, positive is adverse.

    Runs are islands in time order. Without `by`, trades are cut by hours of `block` seconds first, and a run that goes
    on from an hour before keeps its number: an hour's first run takes the last run's number where the side is equal.
    Quantities count as decimals, so reaching the size is exact.
    """
    qty = F.col("qty").cast("decimal(28,10)")
    rows = tape.withColumn("buy", ~F.col("is_buyer_maker")).withColumn("q", qty)
    if not by:
        rows = with_divisor(rows).withColumn("_hour", F.expr(f"(time div divisor) div {block}")).drop("divisor")
    keys = list(by) or ["_hour"]
    order = Window.partitionBy(*keys).orderBy("time", "trade_id")
    edge = F.coalesce(F.col("buy") != F.lag("buy").over(order), F.lit(True)).cast("long")
    rows = rows.withColumn("_edge", edge).withColumn("_run", F.sum("_edge").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if not by:  # number the runs over all hours
        sums = rows.groupBy("_hour").agg(F.sum("_edge").alias("n"), F.min_by("buy", F.struct("time", "trade_id")).alias("first"), F.max_by("buy", F.struct("time", "trade_id")).alias("last"))
        across = Window.orderBy("_hour")  # a row for each hour
        joined = F.coalesce((F.lag("last").over(across) == F.col("first")).cast("long"), F.lit(0))
        sums = sums.withColumn("_joined", joined)
        before = F.sum(F.col("n") - F.col("_joined")).over(across.rowsBetween(Window.unboundedPreceding, 0)) - (F.col("n") - F.col("_joined"))
        sums = sums.select("_hour", (F.coalesce(before, F.lit(0)) - F.col("_joined")).alias("_base"))
        rows = rows.join(sums, "_hour").withColumn("_run", F.col("_run") + F.col("_base"))
        keys = []
    run = Window.partitionBy(*keys, "_run").orderBy("time", "trade_id")
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    target = F.lit(str(size)).cast("decimal(28,10)")
    rows = rows.withColumn("cum", F.sum("q").over(upto)).withColumn("paid", F.sum(F.col("price") * F.col("qty")).over(upto)).withColumn("first", F.first("price").over(upto)).withColumn("id", F.first("trade_id").over(upto))
    last = rows.filter((F.col("cum") >= target) & (F.col("cum") - F.col("q") < target))
    need = (target - (F.col("cum") - F.col("q"))).cast("double")
    vwap = (F.col("paid") - F.col("price") * F.col("qty") + F.col("price") * need) / F.lit(float(size))
    signed = F.when(F.col("buy"), 1.0).otherwise(-1.0)
    return last.select(*by, F.col("id").alias("trade_id"), (signed * (vwap / F.col("first") - 1) / BPS).alias("slippage_bps"))


def slippage_summary(sweeps: DataFrame) -> DataFrame:
    """One row: mean, median, 95th percentile and number."""
    s = "slippage_bps"
    cuts = exact_quantiles(sweeps, s, (0.5, 0.95)).agg(*(F.max(F.when(F.col("q") == q, F.col("cut"))).alias(n) for q, n in ((0.5, "median_bps"), (0.95, "p95_bps"))))
    return beside(sweeps.agg(F.avg(s).alias(s), F.count("*").alias("n_sweeps")), cuts).select(s, "median_bps", "p95_bps", "n_sweeps")


def estimate_slippage(tape: DataFrame, size: float = ORDER_SIZE, sample_hours: int = 24, seed: int = 3) -> DataFrame:
    """slippage_summary over whole hours drawn without replacement. An hour's runs begin with the hour."""
    timed = with_divisor(tape)
    bounds = timed.agg(F.min("time").alias("lo"), F.max("time").alias("hi"), F.max("divisor").alias("d")).first()
    if bounds["lo"] is None:
        raise ValueError("the tape is empty")
    total = max((bounds["hi"] - bounds["lo"]) // bounds["d"] // 3600, 1)
    chosen = np.random.default_rng(seed).choice(total, size=min(sample_hours, total), replace=False)
    hour = F.expr(f"(time - {bounds['lo']}) div {bounds['d']} div 3600")
    sample = tape.withColumn("hour", hour).filter(F.col("hour").isin([int(h) for h in chosen]))
    out = slippage_summary(sweep_slippage(sample, size, by=("hour",)))
    row = out.first()
    if not row["n_sweeps"]:
        raise ValueError(f"no run in the sample reached {size}")
    return tape.sparkSession.createDataFrame([row], out.schema).withColumn("sample_hours", F.lit(len(chosen)))
