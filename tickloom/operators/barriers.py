"""Triple barrier: the first passage of a price path, and the targets made of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.constants import BARRIER, HORIZON, LABEL_MODES
from tickloom.functions.scan import CHUNK, with_halo
from tickloom.session import reachable
from tickloom.operators.features import with_length


def first_passage(log_price: np.ndarray, own: int, horizon: int, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first `own` bars, the smallest k up to the horizon at which the path is above by more than
    theta, and below; horizon + 1 where it never is.

    Tables hold the highest and lowest price of 2**j bars. Each bar skips whole stretches that stay inside, longest
    first, so the cost grows with the logarithm of the horizon.
    """
    n = len(log_price)
    out = []
    for sign in (1.0, -1.0):
        x = sign * log_price
        tables, width = [x], 1
        while width * 2 <= horizon:
            last = tables[-1]
            ahead = np.full(n, -np.inf)
            ahead[: n - width] = last[width:]
            tables.append(np.maximum(last, ahead))
            width *= 2
        level, k = x[:own], np.ones(own, np.int64)
        rows = np.arange(own)
        while len(rows):  # a pass over all powers of two moves a bar by their sum at most
            for j in range(len(tables) - 1, -1, -1):
                at = rows + k[rows]
                top = np.where(at < n, tables[j][np.minimum(at, n - 1)], -np.inf)
                k[rows] += np.where(top - level[rows] > theta, 0, 1 << j)
            at = rows + k[rows]
            rows = rows[(k[rows] <= horizon) & (at < n) & ~(x[np.minimum(at, n - 1)] - level[rows] > theta)]
        out.append(np.where((k > horizon) | (np.arange(own) + k >= n), horizon + 1, k))
    return out[0], out[1]


def triple_barrier(bars: DataFrame, horizon: int = HORIZON, barrier: float = BARRIER, chunk: int = CHUNK, method: str = "descent") -> DataFrame:
    """(bar_idx, side, exit_offset, defined) of every bar.

    side is +1 where the log price passes log1p(barrier) first, -1 where it passes the mirrored level first, else 0;
    comparisons are strict. exit_offset is the first touch or the horizon. The last `horizon` bars are not defined and
    have side 0, yet keep their offset. "descent" walks chunks with the horizon as their halo in Arrow batches;
    "join" is the same as a range join, for short horizons.
    """
    if method == "join":
        return _by_join(bars, horizon, barrier)
    if method != "descent":
        raise ValueError(f"unknown method {method!r}")
    theta = float(np.log1p(barrier))
    reachable(bars.sparkSession)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("bar_idx")
            mine = int((part.bar_idx // chunk == part._chunk).sum())
            up, down = first_passage(part.lp.to_numpy(), mine, horizon, theta)
            side = np.where(up < down, 1, np.where(down < up, -1, 0)).astype(np.int8)
            return pd.DataFrame({"bar_idx": part.bar_idx.to_numpy()[:mine], "side": side, "exit_offset": np.minimum(np.minimum(up, down), horizon).astype(np.int32)})

        for batch in batches:
            for number, part in batch.groupby("_chunk", sort=False):
                if held and held[0]._chunk.iloc[0] != number:
                    yield done(pd.concat(held))
                    held = []
                held.append(part)
        if held:
            yield done(pd.concat(held))

    placed = with_halo(bars.select("bar_idx", F.log("price").alias("lp")), ahead=horizon, chunk=chunk)
    placed = placed.repartition("_chunk").sortWithinPartitions("_chunk", "bar_idx")
    found = placed.mapInPandas(walk, "bar_idx long, side byte, exit_offset int")
    return _bounded(found, bars, horizon)


def _bounded(found: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    defined = F.col("bar_idx") < F.col("_len") - horizon
    return with_length(found, bars).withColumn("defined", defined).select("bar_idx", F.when(F.col("defined"), F.col("side")).otherwise(0).cast("byte").alias("side"), "exit_offset", "defined")


def _by_join(bars: DataFrame, horizon: int, barrier: float) -> DataFrame:
    theta = float(np.log1p(barrier))
    left = bars.select(F.col("bar_idx").alias("i"), F.log("price").alias("p"), F.explode(F.array(F.expr(f"bar_idx div {horizon}"), F.expr(f"bar_idx div {horizon} + 1"))).alias("b"))
    right = bars.select(F.col("bar_idx").alias("j"), F.log("price").alias("q"), F.expr(f"bar_idx div {horizon}").alias("b"))
    pairs = left.join(right, "b").filter((F.col("j") > F.col("i")) & (F.col("j") <= F.col("i") + horizon) & (F.abs(F.col("q") - F.col("p")) > theta))
    k, rise = F.col("j") - F.col("i"), F.col("q") > F.col("p")
    first = pairs.groupBy("i").agg(F.min(F.when(rise, k)).alias("up"), F.min(F.when(~rise, k)).alias("down"))
    told = bars.select("bar_idx").join(first, F.col("bar_idx") == F.col("i"), "left")
    up, down = (F.coalesce(c, F.lit(horizon + 1)) for c in ("up", "down"))
    side = F.when(up < down, 1).when(down < up, -1).otherwise(0).cast("byte")
    return _bounded(told.select("bar_idx", side.alias("side"), F.least(up, down, F.lit(horizon)).cast("int").alias("exit_offset")), bars, horizon)


def build_targets(barriers: DataFrame, label_mode: str = "triple_barrier") -> DataFrame:
    """(bar_idx, y, usable): which side first, of those that touch one; or whether one is touched."""
    if label_mode not in LABEL_MODES:
        raise ValueError(f"unknown label mode {label_mode!r}; have {LABEL_MODES}")
    touched = F.col("side") != 0
    if label_mode == "triple_barrier":
        return barriers.select("bar_idx", (F.col("side") > 0).cast("byte").alias("y"), (touched & F.col("defined")).alias("usable"))
    return barriers.select("bar_idx", touched.cast("byte").alias("y"), F.col("defined").alias("usable"))


def label_mix(barriers: DataFrame) -> DataFrame:
    """Defined bars by outcome: up, down, neither, and the share that touches."""
    side, defined = F.col("side"), F.col("defined")
    return barriers.agg(
        F.sum(defined.cast("long")).alias("defined"), F.sum((defined & (side > 0)).cast("long")).alias("up"), F.sum((defined & (side < 0)).cast("long")).alias("down"),
        F.sum((defined & (side == 0)).cast("long")).alias("timeout"), F.avg(F.when(defined, (side != 0).cast("double"))).alias("touch_rate"),
    )


def training_matrix(features: DataFrame, targets: DataFrame) -> DataFrame:
    """Features and y of the usable windows, joined on the window's last bar."""
    return features.join(targets.filter("usable").select("bar_idx", "y"), "bar_idx")
