"""Walk-forward pieces: gates cut on training scores, and the grid of configurations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.quantiles import exact_quantiles
from tickloom.functions.stored import settle
from tickloom.operators import models as mo
from tickloom.operators import simulate as si
from tickloom.operators.costs import Costs, Execution
from tickloom.operators.models import SIDE_MODELS, Trees

GATE_QUANTILES = (0.5, 0.8, 0.9)


def gate_cuts(train: DataFrame, gates: dict[str, str], quantiles: tuple[float, ...] = GATE_QUANTILES) -> DataFrame:
    """(fold, gate, q, cut): exact quantiles of each gate's scores (name to column) over a fold's training windows."""
    return reduce(DataFrame.unionByName, [exact_quantiles(train, column, quantiles, ("fold",)).select("fold", F.lit(gate).alias("gate"), "q", "cut") for gate, column in gates.items()])


def gated_windows(test: DataFrame, cuts: DataFrame, gates: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Test windows that each (gate, q) admits, gate none with q 0 admitting all; and (fold, gate, q, keep_frac), the
    share it keeps. Cuts are one row for each fold, gate and quantile, and are sent to all tasks."""
    none = test.withColumn("gate", F.lit("none")).withColumn("q", F.lit(0.0)).withColumn("_in", F.lit(True))
    every = none
    for gate, column in gates.items():
        own = test.join(F.broadcast(cuts.filter(F.col("gate") == gate)), "fold").withColumn("_in", F.col(column) >= F.col("cut")).drop("cut")
        every = every.unionByName(own)
    keep = every.groupBy("fold", "gate", "q").agg(F.avg(F.col("_in").cast("double")).alias("keep_frac"))
    return every.filter("_in").drop("_in"), keep


def walk_forward(
    bars: DataFrame, windows: DataFrame, barriers: DataFrame, horizon: int, costs: Costs, execution: Execution, trees: Trees = Trees(), side_models: tuple[str, ...] = tuple(SIDE_MODELS),
    outside: dict[str, DataFrame] | None = None, quantiles: tuple[float, ...] = GATE_QUANTILES, margin: float = 0.0, with_scores: bool = False,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """The pooled out-of-sample grid over model x gate x quantile, of windows in folds (fold, part, ...).

    Folds of at most models.ONE_TASK windows are fitted in tasks, all at once, larger ones by pyspark.ml, one after the
    other. Each fit's scores are settled, so that no plan holds the models; they become one table, and signals,
    execution and pooling of all configurations go through it step by step, each settled. bars, windows and barriers should be settled or read from files by the caller. outside: probabilities (fold, start, p_up) of other models by name. with_scores:
    also the test windows' scores (fold, bar_idx, gate_trained, gate_rv, p_<model>...).
    """
    costs = costs.with_spread(bars)
    names = [*side_models, *(outside or {})]
    trains, tests = [], []
    sizes = {r["fold"]: r["count"] for r in windows.groupBy("fold").count().orderBy("fold").collect()}  # a row for each fold
    small = [f for f, n in sizes.items() if n <= mo.ONE_TASK]
    for folds in ([small] if small else []) + [[f] for f in sizes if f not in small]:
        if folds is small:
            scored = settle(mo.run_folds(windows.filter(F.col("fold").isin(small)), len(small), trees, side_models), "fold-scores")
            train, test = scored.filter("part = 'train'"), scored.filter("part = 'test'")
        else:
            train, test = mo.run_fold(windows, folds[0], trees, side_models)
        for name, told in (outside or {}).items():
            test = mo.join_probabilities(test, told.filter(F.col("fold").isin(folds)), name)
        trains.append(settle(train.select("fold", "gate_trained", "gate_rv"), "train-scores"))
        tests.append(settle(test.select("fold", "bar_idx", "gate_trained", "gate_rv", *(f"p_{n}" for n in names)), "test-scores"))
    train, test = (reduce(DataFrame.unionByName, x) for x in (trains, tests))
    gates = {"rv": "gate_rv", "trained": "gate_trained"}
    kept, keep = gated_windows(test, settle(gate_cuts(train, gates, quantiles), "cuts"), gates)
    each = F.inline(F.array(*(F.struct(F.lit(n).alias("model"), F.col(f"p_{n}").alias("p_up")) for n in names)))
    scored = kept.select("fold", "gate", "q", "bar_idx", each)
    signals = settle(si.signals_from_probabilities(scored, 0.5 + margin, 0.5 - margin), "signals")
    keep = settle(keep.withColumn("model", F.explode(F.array(*map(F.lit, names)))), "keep")
    by = ("model", "fold", "gate", "q")
    told = settle(si.admit(signals, bars, barriers, horizon, execution, by), "admitted")
    trades = settle(si.price_trades(told, bars, costs.round_trip_bps(execution), by), "trades")
    pooled = si.pool(told, trades, keep, costs.round_trip_bps(execution))
    return (pooled, test) if with_scores else pooled
