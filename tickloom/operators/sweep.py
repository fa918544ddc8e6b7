"""The sweep over targets: each cell of barrier and horizon walked forward and priced, and its best configuration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.constants import BPS, purge_length
from tickloom.functions.scan import beside
from tickloom.functions.stored import settle
from tickloom.operators import barriers as br
from tickloom.operators import features as ft
from tickloom.operators import metrics as me
from tickloom.operators import splits as sp
from tickloom.operators.costs import Costs, Execution
from tickloom.operators.models import Trees
from tickloom.operators.walkforward import GATE_QUANTILES, walk_forward


def cell_windows(bars: DataFrame, window: int, horizon: int, barrier: float) -> tuple[DataFrame, DataFrame]:
    """(valid windows with features, touched and y; barriers) of one target."""
    told = br.triple_barrier(bars, horizon, barrier)
    marks = told.select("bar_idx", ((F.col("side") != 0) & F.col("defined")).alias("touched"), (F.col("side") > 0).cast("int").alias("y"))
    return ft.valid_windows(ft.window_features(bars, window), bars, window, horizon).join(marks, "bar_idx"), told


def evaluate_cell(
    bars: DataFrame, folds: DataFrame, window: int, horizon: int, barrier: float, costs: Costs, execution: Execution, train_stride: int = 1, trees: Trees = Trees(), quantiles: tuple[float, ...] = GATE_QUANTILES
) -> tuple[DataFrame, DataFrame]:
    """(pooled, folds) of one target, walked forward with boosted trees as the side model.

    pooled: the grid of walk_forward with barrier_bps, horizon_s and the touch rate of all valid windows beside it.
    folds: (fold, gate_auc, side_auc) of its test windows, the side's over touched ones.
    """
    ft.check_windows(bars, window, horizon)
    windows, told = cell_windows(bars, window, horizon, barrier)
    windows, told = settle(windows, "cell-windows"), settle(told, "barriers")
    held = settle(sp.fold_windows(windows, folds, purge_length(window, horizon), train_stride), "fold-windows")
    pooled, scored = walk_forward(bars, held, told, horizon, costs, execution, trees, ("trees",), quantiles=quantiles, with_scores=True)
    scored = scored.join(held.filter("part = 'test'").select("fold", "bar_idx", F.col("touched").cast("int").alias("t"), "y"), ["fold", "bar_idx"])
    gate = me.auc(scored, ("fold",), "t", "gate_trained").select("fold", F.col("auc").alias("gate_auc"))
    side = me.auc(scored.filter("t = 1"), ("fold",), "y", "p_trees").select("fold", F.col("auc").alias("side_auc"))
    rate = windows.agg(F.avg(F.col("touched").cast("double")).alias("touch_rate"))
    named = [F.lit(barrier / BPS).alias("barrier_bps"), F.lit(horizon).alias("horizon_s")]
    return beside(pooled, rate).select(*named, "touch_rate", *pooled.columns), gate.join(side, "fold", "left").select(*named, "fold", "gate_auc", "side_auc")


def sweep(bars: DataFrame, folds: DataFrame, window: int, targets: list[tuple[float, int]], costs: Costs, execution: Execution, **how) -> tuple[DataFrame, DataFrame]:
    """evaluate_cell for each (barrier, horizon), one under the other. The list of targets is a study's, tens of them."""
    cells = [evaluate_cell(bars, folds, window, horizon, barrier, costs, execution, **how) for barrier, horizon in targets]
    return tuple(reduce(DataFrame.unionByName, parts) for parts in zip(*cells))


def best_by_sharpe(pooled: DataFrame, by: tuple[str, ...] = ("barrier_bps", "horizon_s"), model: str | None = None) -> DataFrame:
    """The configuration of each cell with the largest finite Sharpe ratio, of one model or all; ties: the first by
    model, gate and quantile. Cells where none is finite are left out."""
    rows = pooled.filter(F.col("sharpe").isNotNull() & ~F.isnan("sharpe") & (F.abs("sharpe") != float("inf")))
    rows = rows.filter(F.col("model") == model) if model else rows
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("sharpe"), "model", "gate", "q"))
    return rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")
