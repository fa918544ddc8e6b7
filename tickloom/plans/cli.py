"""Command line of the study: bars, prices of targets, the sweep, the walk forward, and what training can afford."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame

from tickloom import constants as k
from tickloom.functions.stored import settle
from tickloom.operators import bars, costs, features, geometry, splits, sweep
from tickloom.operators.walkforward import walk_forward
from tickloom.plans import report
from tickloom.session import build_session
from tickloom.sources import cache


def target(text: str) -> tuple[float, int]:
    """BARRIER:HORIZON, in basis points and seconds."""
    barrier, horizon = text.split(":")
    return float(barrier) * k.BPS, int(horizon)


def route(text: str) -> tuple[str, str]:
    """ENTRY:EXIT, each taker or maker."""
    entry, leave = text.split(":")
    return entry, leave


def parser() -> argparse.ArgumentParser:
    """Options that jobs share are grouped: what is read, what trading costs, what is predicted."""
    source, price, goal = (argparse.ArgumentParser(add_help=False) for _ in range(3))
    source.add_argument("series", nargs="+", help="bar caches, in order of time")
    source.add_argument("--lookback", type=int, default=k.WINDOW_SIZE, metavar="BARS")
    source.add_argument("--save", metavar="PATH", help="write the result as JSON")
    price.add_argument("--route", type=route, default=("taker", "taker"), metavar="ENTRY:EXIT")
    price.add_argument("--fees", type=float, nargs=2, default=(k.TAKER_FEE_BPS, k.MAKER_FEE_BPS), metavar=("TAKER", "MAKER"))
    price.add_argument("--slip", type=float, default=k.MEASURED_SLIPPAGE_BPS, metavar="BP")
    price.add_argument("--spread", type=float, metavar="BP", help="half of it; measured on the series where left out")
    price.add_argument("--queue", type=float, default=k.QUEUE_AHEAD, metavar="SIZE", help="what is ahead of a passive order")
    goal.add_argument("--target", type=target, action="append", metavar="BARRIER:HORIZON", help="may be given again")
    goal.add_argument("--folds", choices=k.SCHEMES, default="anchored")
    goal.add_argument("--learn", type=int, default=3, metavar="MONTHS")
    goal.add_argument("--thin", type=int, default=1, metavar="STRIDE", help="of training windows")

    top = argparse.ArgumentParser(prog="tickloom", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)
    fold = jobs.add_parser("bars", help="fold trades to a bar cache")
    fold.add_argument("trades")
    fold.add_argument("cache")
    fold.add_argument("--span", type=float, nargs=2, metavar=("SKIP", "HOURS"), default=(0, None))
    geo = jobs.add_parser("targets", parents=[source, price, goal], help="what hit rate each target needs")
    geo.add_argument("--tail", type=float, default=0.9, help="share of windows that the variance gate drops")
    geo.add_argument("--busy", type=float, default=50, metavar="TRADES", help="a day, at least")
    geo.add_argument("--only", nargs="*", metavar="MONTH")
    jobs.add_parser("sweep", parents=[source, price, goal], help="walk each target forward, keep the best configuration")
    walk = jobs.add_parser("walk", parents=[source, price, goal], help="walk all models forward on one target")
    walk.add_argument("--unsure", type=float, default=0.0, metavar="MARGIN", help="no signal this near to one half")
    walk.add_argument("--outside", metavar="TABLE", help="probabilities of another model: fold, start, p_up")
    able = jobs.add_parser("stride", help="the finest training stride that a budget affords")
    for name, kind in (("windows", int), ("passes", int), ("per_second", float), ("hours", float)):
        able.add_argument(name, type=kind)
    return top


def _result(spark, args) -> DataFrame:
    series = cache.load_bars(spark, args.series)
    if args.job == "targets" and args.only:
        series = bars.slice_months(series, args.only)
    series = series.persist()
    how = costs.Execution(*args.route, args.queue)
    paid = costs.Costs(*args.fees, args.slip, args.spread).with_spread(series)
    targets = args.target or [(k.BARRIER, k.HORIZON)]
    if args.job == "targets":
        gate = features.rolling_realized_variance(series, args.lookback)
        spent = paid.round_trip_bps(how)
        cells = geometry.geometry_grid(series, gate, args.lookback, sorted({b / k.BPS for b, _ in targets}), sorted({h for _, h in targets}), spent, args.tail).persist()
        print(report.format_table(geometry.shortlist(cells, spent, args.busy)))
        return cells
    folds = splits.build_folds(series, args.folds, args.learn)
    if args.job == "sweep":
        pooled, by_fold = sweep.sweep(series, folds, args.lookback, targets, paid, how, train_stride=args.thin)
        print(report.format_table(by_fold))
        return sweep.best_by_sharpe(pooled)
    barrier, horizon = targets[0]
    features.check_windows(series, args.lookback, horizon)
    windows, told = sweep.cell_windows(series, args.lookback, horizon, barrier)
    held = splits.fold_windows(windows, folds, k.purge_length(args.lookback, horizon), args.thin)
    outside = {"outside": spark.read.parquet(args.outside)} if args.outside else None
    return walk_forward(series, settle(held, "fold-windows"), settle(told, "barriers"), horizon, paid, how, outside=outside, margin=args.unsure)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.job == "stride":
        print(splits.affordable_stride(args.windows, args.passes, args.per_second, args.hours))
        return
    spark = build_session()
    if args.job == "bars":
        skip, hours = args.span
        print(report.format_table(bars.bar_meta(cache.load_or_build_bars(spark, args.trades, args.cache, hours, skip), args.trades)))
        return
    out = _result(spark, args)
    print(report.format_table(out))
    if args.save:
        cache.write_results(out, args.save)


if __name__ == "__main__":
    main()
