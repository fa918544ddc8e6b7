"""Channels of each bar and features of each window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.constants import CHANNEL_SETS, EPSILON, FEATURES, HORIZON, PI_FACTOR, WINDOW_SIZE
from tickloom.functions.scan import CHUNK, beside, over_frames


def build_channels(bars: DataFrame, channels: str | list[str] = "raw", chunk: int = CHUNK) -> DataFrame:
    """(bar_idx, ts, channels...): returns, their squares and bipower products, flow, log volume and trades."""
    names = CHANNEL_SETS.get(channels) if isinstance(channels, str) else tuple(channels)
    if names is None:
        raise ValueError(f"unknown channel set {channels!r}; have {sorted(CHANNEL_SETS)}")
    unknown = [x for x in names if x not in CHANNEL_SETS["full"]]
    if unknown:
        raise ValueError(f"unknown channels {unknown}")
    wide = over_frames(bars, lambda w: {"_r": F.coalesce(F.log("price") - F.lag(F.log("price")).over(w), F.lit(0.0)), "_before": F.coalesce(F.lag(F.log("price")).over(w) - F.lag(F.log("price"), 2).over(w), F.lit(0.0))}, back=2, chunk=chunk)
    made = {
        "log_return": F.col("_r"),
        "realized_var": F.col("_r") * F.col("_r"),
        "bipower": F.lit(PI_FACTOR) * F.abs("_r") * F.abs("_before"),
        "ofi": F.col("ofi"),
        "log_volume": F.log1p("qty"),
        "log_trades": F.log1p("n_trades"),
    }
    return wide.select("bar_idx", "ts", *(made[x].alias(x) for x in names))


def window_features(bars: DataFrame, window: int = WINDOW_SIZE, chunk: int = CHUNK) -> DataFrame:
    """(start, bar_idx, ts, seven features) of each window, on its last bar.

    Realized variance sums window - 1 squared returns, bipower window - 2 products, flow all bars. No window is ever
    put together: sums come from frames, in chunks with the window's halo.
    """
    if window < 2:
        return bars.select(F.col("bar_idx").alias("start"), "bar_idx", "ts", *(F.lit(0.0).alias(x) for x in FEATURES)).limit(0)

    def frames(w):
        def over(k):
            return w.rowsBetween(-(window - k), 0)

        r2, two = F.col("_r") * F.col("_r"), F.lit(PI_FACTOR) * F.abs("_r") * F.abs("_before")
        bpv = F.sum(two).over(over(3)) if window > 2 else F.lit(0.0)
        return {"_rv": F.sum(r2).over(over(2)), "_bpv": bpv, "_flow": F.sum("ofi").over(over(1)), "_ret": F.col("_lp") - F.lag("_lp", window - 1).over(w)}

    held = bars.select("bar_idx", "ts", "ofi", F.log("price").alias("_lp"))
    held = over_frames(held, lambda w: {"_r": F.col("_lp") - F.lag("_lp").over(w), "_before": F.lag("_lp").over(w) - F.lag("_lp", 2).over(w)}, back=2, chunk=chunk)
    held = over_frames(held, frames, back=window - 1, chunk=chunk).filter(F.col("bar_idx") >= window - 1)
    jumps = F.greatest(F.col("_rv") - F.col("_bpv"), F.lit(0.0))
    return held.select(
        (F.col("bar_idx") - (window - 1)).alias("start"), "bar_idx", "ts",
        F.col("_rv").alias("realized_variance"), F.col("_bpv").alias("bipower_variation"), jumps.alias("jumps"), F.col("_flow").alias("order_flow"),
        F.col("_ret").alias("lookback_return"), (F.col("_flow") / (F.sqrt("_bpv") + EPSILON)).alias("vol_adjusted_ofi"), (jumps * F.signum("_ret")).alias("signed_jumps"),
    )


def rolling_realized_variance(bars: DataFrame, window: int = WINDOW_SIZE, chunk: int = CHUNK) -> DataFrame:
    """(start, bar_idx, realized_variance): the gate that needs no training."""
    return window_features(bars, window, chunk).select("start", "bar_idx", "realized_variance")


def rolling_metrics(bars: DataFrame, window: int, chunk: int = CHUNK) -> DataFrame:
    """(start, rv, bpv, jumps, ofi) of every window; none where the window is under 2 bars or longer than the series."""
    return window_features(bars, window, chunk).select("start", F.col("realized_variance").alias("rv"), F.col("bipower_variation").alias("bpv"), "jumps", F.col("order_flow").alias("ofi"))


def with_length(df: DataFrame, bars: DataFrame) -> DataFrame:
    """df with the series' length in `_len`."""
    return beside(df, bars.agg(F.coalesce(F.max("bar_idx") + 1, F.lit(0)).alias("_len")))


def valid_windows(windows: DataFrame, bars: DataFrame, window: int = WINDOW_SIZE, horizon: int = HORIZON) -> DataFrame:
    """The windows whose label has its whole horizon in the series."""
    return with_length(windows, bars).filter(F.col("start") <= F.col("_len") - (window + horizon)).drop("_len")


def check_windows(bars: DataFrame, window: int, horizon: int) -> int:
    """How many valid windows there are; none raises."""
    last = bars.agg(F.max("bar_idx")).first()[0]
    n = (0 if last is None else last + 1) - window - horizon + 1
    if n <= 0:
        raise ValueError(f"the series is too short for windows of {window} bars and a horizon of {horizon}")
    return n
