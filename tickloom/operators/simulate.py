"""Signals and their execution: one position at a time, taker or queued maker entries, results by trade and day."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.constants import BPS, SECONDS_PER_DAY, TRADING_DAYS
from tickloom.functions.scan import beside
from tickloom.operators.costs import Costs, Execution
from tickloom.operators.features import with_length
from tickloom.session import reachable


def signals_from_probabilities(scored: DataFrame, long_threshold: float = 0.5, short_threshold: float | None = None, gate_threshold: Column | float | None = None) -> DataFrame:
    """Rows of scored windows (..., bar_idx, p_up[, gate]) that are traded, with `direction`: long at or above one
    threshold, else short at or below the other (1 - long by default); gate at or above its threshold. The entry is
    the window's last bar, bar_idx. A tie goes long."""
    short = 1.0 - long_threshold if short_threshold is None else short_threshold
    up, down = F.col("p_up") >= long_threshold, F.col("p_up") <= short
    kept = scored.filter(up | down)
    if gate_threshold is not None:
        kept = kept.filter(F.col("gate") >= gate_threshold)
    return kept.withColumn("direction", F.when(up, 1).otherwise(-1))


def maker_fills(signals: DataFrame, bars: DataFrame, execution: Execution) -> DataFrame:
    """Signals with fill_bar and fill_price of a passive order at the signal's price, null where it is not filled.

    For each bar of the wait: a price past the limit fills, a price away from it cancels, else opposing flow adds up
    and fills when it covers the queue and the order. The first bar that settles it counts, as a keyed join.
    """
    wait = execution.max_wait
    path = bars.select(F.col("bar_idx").alias("t"), F.col("price").alias("_now"), F.col("ofi").alias("_flow"))
    limit = bars.select(F.col("bar_idx").alias("_s"), F.col("price").alias("_limit"))
    rows = signals.join(limit, F.col("bar_idx") == F.col("_s")).drop("_s")
    orders = rows.select("bar_idx", "direction", "_limit").distinct()
    steps = orders.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(wait)))).join(path, F.col("bar_idx") + F.col("k") == F.col("t"))
    past = (F.col("_limit") - F.col("_now")) * F.col("direction")
    opposing = F.greatest(-F.col("_flow") * F.col("direction"), F.lit(0.0))
    order = Window.partitionBy("bar_idx", "direction").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("_queue", F.sum(F.when(past == 0, opposing).otherwise(0.0)).over(order))
    kind = F.when(past > 0, "fill").when(past < 0, "gone").when(F.col("_queue") >= execution.queue_ahead + execution.size, "fill")
    done = steps.withColumn("_kind", kind).filter("_kind is not null").groupBy("bar_idx", "direction").agg(F.min_by(F.struct("_kind", "t"), "k").alias("_end"))
    rows = rows.join(done, ["bar_idx", "direction"], "left")
    filled = F.col("_end._kind") == "fill"
    return rows.withColumn("fill_bar", F.when(filled, F.col("_end.t"))).withColumn("fill_price", F.when(filled, F.col("_limit"))).drop("_limit", "_end")


def _walk(bar: np.ndarray, raw: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Status of each signal of one configuration in order: 0 blocked, else raw's (1 taken, 2 unfilled, 3 skipped).

    Jumps from one taken signal to the first one its exit lets in.
    """
    out = np.zeros(len(bar), np.int8)
    taken = np.flatnonzero(raw == 1)
    i = 0
    while i < len(bar):
        at = np.searchsorted(taken, i)
        stop = int(taken[at]) if at < len(taken) else len(bar)
        out[i:stop] = raw[i:stop]
        if stop == len(bar):
            break
        out[stop] = 1
        i = max(stop + 1, int(np.searchsorted(bar, free[stop], side="left")))
    return out


def admit(signals: DataFrame, bars: DataFrame, barriers: DataFrame, horizon: int, execution: Execution, by: tuple[str, ...] = ()) -> DataFrame:
    """Signals with entry_bar, entry_price, side, exit_offset and `status`: taken, blocked, unfilled or skipped.

    Positions never overlap: a signal before the last exit's next bar is blocked, even where it could not be traded;
    one past the last whole horizon is skipped; an unfilled order does not block. The order is by bar, ties by `ordinal` where there is one. Each configuration
    in `by` is walked apart; everything else is joins.
    """
    if execution.entry == "maker":
        rows = maker_fills(signals, bars, execution)
    else:
        price = bars.select(F.col("bar_idx").alias("_s"), F.col("price").alias("fill_price"))
        rows = signals.join(price, F.col("bar_idx") == F.col("_s")).drop("_s").withColumn("fill_bar", F.col("bar_idx"))
    exits = barriers.select(F.col("bar_idx").alias("_b"), "side", "exit_offset")
    known = barriers.select(F.col("bar_idx").alias("_k"), "defined")
    rows = rows.join(exits, F.col("fill_bar") == F.col("_b"), "left").join(known, F.col("bar_idx") == F.col("_k"))
    rows = with_length(rows, bars).withColumn("_last", F.col("_len") - (horizon + 1)).drop("_len")
    raw = F.when((F.col("bar_idx") > F.col("_last")) | ~F.col("defined"), 3).when(F.col("fill_bar").isNull(), 2).when(F.col("fill_bar") > F.col("_last"), 3).otherwise(1)
    rows = rows.withColumn("_raw", raw.cast("byte")).withColumn("_free", F.coalesce(F.col("fill_bar") + F.col("exit_offset") + 1, F.lit(0)))
    rows = rows.withColumn("_n", F.col("ordinal") if "ordinal" in signals.columns else F.lit(0).cast("long"))
    keys = list(by)
    reachable(bars.sparkSession)

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["bar_idx", "_n", "direction"], kind="stable")
        return part[[*keys, "bar_idx", "_n", "direction"]].assign(_status=_walk(part.bar_idx.to_numpy(), part._raw.to_numpy(), part._free.to_numpy()))

    slim = rows.select(*keys, "bar_idx", "_n", "direction", "_raw", "_free")
    fields = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in [*keys, "bar_idx", "_n", "direction"])
    one = slim if keys else slim.withColumn("_one", F.lit(0))
    told = one.groupBy(*(keys or ["_one"])).applyInPandas(walk, fields + ", _status byte")
    rows = rows.join(told, [*keys, "bar_idx", "_n", "direction"])
    status = F.element_at(F.array(*map(F.lit, ("blocked", "taken", "unfilled", "skipped"))), F.col("_status").cast("int") + 1)
    return rows.withColumn("status", status).withColumnsRenamed({"fill_bar": "entry_bar", "fill_price": "entry_price"}).drop("_b", "_k", "_last", "_raw", "_free", "_n", "_status", "defined")


def price_trades(admitted: DataFrame, bars: DataFrame, round_trip_bps: float, by: tuple[str, ...] = ()) -> DataFrame:
    """The taken signals as trades: entry and exit bar and time, direction, gross and net in basis points, hold, won,
    resolved."""
    exit_bar = F.col("entry_bar") + F.col("exit_offset")
    taken = admitted.filter(F.col("status") == "taken").withColumn("exit_bar", exit_bar)
    at_exit = bars.select(F.col("bar_idx").alias("exit_bar"), F.col("price").alias("_out"), F.col("ts").alias("exit_ts"))
    at_entry = bars.select(F.col("bar_idx").alias("entry_bar"), F.col("ts").alias("entry_ts"))
    rows = taken.join(at_exit, "exit_bar").join(at_entry, "entry_bar")
    gross = F.col("direction") * (F.col("_out") / F.col("entry_price") - 1) / BPS
    return rows.select(
        *by, "entry_bar", "exit_bar", "entry_ts", "exit_ts", F.col("direction").cast("int").alias("direction"), gross.alias("gross_bps"), (gross - F.lit(float(round_trip_bps))).alias("net_bps"),
        F.col("exit_offset").cast("long").alias("hold_s"), (F.col("side") == F.col("direction")).cast("int").alias("won"), (F.col("side") != 0).cast("int").alias("resolved"),
    )


def daily_pnl(trades: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., day, pnl_bps): net by the day of the exit; days without an exit are not there."""
    return trades.groupBy(*by, F.expr(f"exit_ts div {SECONDS_PER_DAY}").alias("day")).agg(F.sum("net_bps").alias("pnl_bps"))


def equity_curve(daily: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., day, pnl_bps, equity, drawdown): against the peak so far, which is 0 at first. A row for each day."""
    order = Window.partitionBy(*by).orderBy("day") if by else Window.orderBy("day")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = daily.withColumn("equity", F.sum("pnl_bps").over(upto) * BPS)
    return rows.withColumn("drawdown", F.least(F.col("equity") - F.greatest(F.max("equity").over(upto), F.lit(0.0)), F.lit(0.0)))


def track(daily: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n_days, total_return, max_drawdown, sharpe) of daily results; sharpe is null for one day or no spread."""
    sharpe = F.try_divide(F.avg("pnl_bps"), F.nullif(F.stddev_samp("pnl_bps"), F.lit(0.0))) * float(np.sqrt(TRADING_DAYS))
    return equity_curve(daily, by).groupBy(*by).agg(F.count("*").alias("n_days"), (F.sum("pnl_bps") * BPS).alias("total_return"), F.min("drawdown").alias("max_drawdown"), sharpe.alias("sharpe"))


def summarise(admitted: DataFrame, trades: DataFrame, costs: Costs, execution: Execution, by: tuple[str, ...] = (), draws: int = 0, seed: int = 7) -> DataFrame:
    """One row for each configuration, also where nothing was traded: counts, rates, averages and its track. draws (400
    in the study): the Sharpe ratio's 95 % interval over days drawn anew, as sharpe_lo and sharpe_hi."""
    counts = admitted.groupBy(*by).agg(F.count("*").alias("n_signals"), *(F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0)).alias(f"n_{n}") for s, n in (("taken", "trades"), ("blocked", "blocked"), ("unfilled", "unfilled"))))
    won, resolved = F.col("won").cast("double"), F.col("resolved").cast("double")
    means = trades.groupBy(*by).agg(
        F.avg(won).alias("hit_rate"), F.avg(resolved).alias("resolved_share"), F.avg(F.when(F.col("resolved") == 1, won)).alias("resolved_hit_rate"),
        F.avg("gross_bps").alias("gross_bps"), F.avg("net_bps").alias("net_bps"), F.avg("hold_s").alias("mean_hold_s"),
    )
    own = track(daily_pnl(trades, by), by)
    if by:
        rows = counts.join(means, list(by), "left").join(own, list(by), "left")
    else:
        rows = beside(beside(counts, means), own)
    if draws:
        interval = sharpe_interval(daily_pnl(trades, by), by, draws, seed).withColumnsRenamed({"lo": "sharpe_lo", "hi": "sharpe_hi"})
        rows = rows.join(interval, list(by), "left") if by else beside(rows, interval)
    zero = F.lit(0.0)
    return rows.withColumns({
        "n_days": F.coalesce("n_days", F.lit(0)), "total_return": F.coalesce("total_return", zero), "max_drawdown": F.coalesce("max_drawdown", zero),
        "cost_bps": F.lit(costs.round_trip_bps(execution)), "trades_per_day": F.try_divide(F.col("n_trades"), F.greatest("n_days", F.lit(1))),
    })


def sharpe_interval(daily: DataFrame, by: tuple[str, ...] = (), draws: int = 1000, seed: int = 11) -> DataFrame:
    """(by..., lo, hi): days drawn anew with replacement, for more than 5 days; the draws are numpy's, so they repeat.
    A configuration's days, some hundreds, are one group."""
    reachable(daily.sparkSession)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        pnl = part.sort_values("day").pnl_bps.to_numpy()
        lo = hi = None
        if len(pnl) > 5:
            sample = pnl[np.random.default_rng(seed).integers(0, len(pnl), (draws, len(pnl)))]
            with np.errstate(invalid="ignore", divide="ignore"):
                found = sample.mean(axis=1) / sample.std(axis=1, ddof=1) * np.sqrt(TRADING_DAYS)
            found = found[np.isfinite(found)]
            if len(found):
                lo, hi = (float(np.percentile(found, q)) for q in (2.5, 97.5))
        return pd.DataFrame([{**{k: part[k].iloc[0] for k in by}, "lo": lo, "hi": hi}])

    fields = "".join(f"`{k}` {daily.schema[k].dataType.simpleString()}, " for k in by)
    one = daily if by else daily.withColumn("_one", F.lit(0))
    return one.groupBy(*(by or ["_one"])).applyInPandas(run, fields + "lo double, hi double")


def pool(admitted: DataFrame, trades: DataFrame, keep: DataFrame, round_trip_bps: float) -> DataFrame:
    """One out-of-sample row for each (model, gate, q) over all folds, from the trades themselves: what averages of
    folds weighted by their trades give. keep: (fold, model, gate, q, keep_frac). Folds without a signal do not count."""
    by = ["model", "gate", "q"]
    won, resolved = F.col("won").cast("double"), F.col("resolved")
    means = trades.groupBy(*by).agg(
        F.count("*").alias("n_trades"), F.avg(won).alias("hit_rate"), F.avg(resolved.cast("double")).alias("resolved_share"), F.avg(F.when(resolved == 1, won)).alias("resolved_hit_rate"),
        F.avg("gross_bps").alias("gross_bps"), F.avg("net_bps").alias("net_bps"), F.avg("hold_s").alias("mean_hold_s"),
    )
    folds = admitted.select("fold", *by).distinct().join(keep, ["fold", *by]).groupBy(*by).agg(F.count("*").alias("n_folds"), F.avg("keep_frac").alias("gate_keep_frac"))
    # a day that two folds share counts once for each, as their series are joined end to end
    daily = daily_pnl(trades, ("fold", *by))
    order = Window.partitionBy(*by).orderBy("day", "fold").rowsBetween(Window.unboundedPreceding, 0)
    rows = daily.withColumn("equity", F.sum("pnl_bps").over(order) * BPS)
    rows = rows.withColumn("drawdown", F.least(F.col("equity") - F.greatest(F.max("equity").over(order), F.lit(0.0)), F.lit(0.0)))
    sharpe = F.try_divide(F.avg("pnl_bps"), F.nullif(F.stddev_samp("pnl_bps"), F.lit(0.0))) * float(np.sqrt(TRADING_DAYS))
    own = rows.groupBy(*by).agg(F.count("*").alias("n_days"), (F.sum("pnl_bps") * BPS).alias("total_return"), F.min("drawdown").alias("max_drawdown"), sharpe.alias("sharpe"))
    out = folds.join(means, by, "left").join(own, by, "left").withColumn("cost_bps", F.lit(float(round_trip_bps)))
    out = out.withColumn("n_trades", F.coalesce("n_trades", F.lit(0))).withColumn("trades_per_day", F.try_divide("n_trades", F.greatest(F.coalesce("n_days", F.lit(0)), F.lit(1))))
    return out.orderBy(F.desc_nulls_last("sharpe"), *by)


def common_gate(pooled: DataFrame) -> DataFrame:
    """The tightest (gate, q) that every model has, rather a gate than none: one row."""
    models = pooled.agg(F.countDistinct("model").alias("_all"))
    shared = beside(pooled.groupBy("gate", "q").agg(F.countDistinct("model").alias("n")), models).filter(F.col("n") == F.col("_all"))
    return shared.orderBy((F.col("gate") == "none").cast("int"), F.desc("q"), "gate").limit(1).select("gate", "q")
