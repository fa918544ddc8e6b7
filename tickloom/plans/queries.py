"""Every operator of the study as a query over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.constants import FEATURES
from tickloom.functions.quantiles import exact_quantiles
from tickloom.functions.scan import beside
from tickloom.functions.stored import settle
from tickloom.operators import barriers as br
from tickloom.operators import bars as bs
from tickloom.operators import costs as co
from tickloom.operators import features as ft
from tickloom.operators import geometry as ge
from tickloom.operators import metrics as me
from tickloom.operators import models as mo
from tickloom.operators import patch as pt
from tickloom.operators import simulate as si
from tickloom.operators import splits as sp
from tickloom.operators import sweep as sw
from tickloom.plans import sql
from tickloom.plans.sql import BAR, BARRIER, DAY_BARRIER, DAY_HORIZON, DAY_WINDOW, HALF_SPREAD, HORIZON, PURGE, ROUND_TRIP, SAMPLE_HOURS, SIZE, TRAIN_MONTHS, WINDOW
from tickloom.sources import tape as tp

COSTS = co.Costs(half_spread_bps=HALF_SPREAD)
TAKER = co.Execution()
MAKER = co.Execution(entry="maker")


def _r(column: str | Column, digits: int, scale: float = 1.0, name: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c * scale if scale != 1.0 else c, digits).alias(name or column)


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return bs.fold_bars(tp.events_tape(spark, d), BAR).persist()  # a grid is small beside its tape, and read many times


def _day_bars(spark: SparkSession, d: str) -> DataFrame:
    return settle(bs.fold_bars(tp.orders_tape(spark, d), 86_400), "day-bars")  # read by many steps of long plans


def _features(spark: SparkSession, d: str) -> DataFrame:
    return ft.window_features(_bars(spark, d), WINDOW)


def _valid(bars: DataFrame) -> DataFrame:
    return ft.valid_windows(ft.window_features(bars, WINDOW), bars, WINDOW, HORIZON)


def _barriers(bars: DataFrame) -> DataFrame:
    return br.triple_barrier(bars, HORIZON, BARRIER)


def _rounded_features() -> list[Column]:
    scale = {"order_flow": (4, 1.0), "lookback_return": (4, 1e4), "vol_adjusted_ofi": (2, 1e-6)}
    out = []
    for name in FEATURES:
        digits, by = scale.get(name, (4, 1e8))
        out.append(F.round(F.col(name) / 1e6, 2).alias(name) if by == 1e-6 else _r(name, digits, by))
    return out


# --- tape and bars ---


def tape_scan(spark, d):
    return tp.events_tape(spark, d).select("trade_id", "time", "price", "qty", _r("quote_qty", 4), "is_buyer_maker")


def tape_time_slice(spark, d):
    return tp.time_slice(tp.events_tape(spark, d), hours=48, skip_hours=24).agg(F.count("*").alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))


def tape_unit_inference(spark, d):
    tape = tp.events_tape(spark, d)
    out = []
    for unit, by in (("us", 1), ("ms", 1_000), ("s", 1_000_000)):
        held = tape.withColumn("time", F.expr(f"time div {by}"))
        n = bs.fold_bars(held, BAR).agg(F.count("*").alias("n_bars"))
        out.append(beside(held.agg(F.lit(unit).alias("unit"), tp.time_divisor(F.min("time")).alias("divisor")), n))
    return reduce(DataFrame.unionByName, out)


def bars_sparse(spark, d):
    return bs.sparse_bars(tp.events_tape(spark, d), BAR).select("ts", "price", _r("qty", 4), "n_trades", _r("ofi", 4))


def bars_grid(spark, d):
    return _bars(spark, d).select("bar_idx", "ts", "price", _r("qty", 4), "n_trades", _r("ofi", 4))


def bars_meta(spark, d):
    return bs.bar_meta(_bars(spark, d), "events")


def bars_hourly(spark, d):
    return bs.hourly_trades(_bars(spark, d), 6)


def bars_splice_gap(spark, d):
    bars = _bars(spark, d)
    parts = [bars.filter("bar_idx >= 1500"), bars.filter("bar_idx < 1000")]
    return bs.concat_bars(parts, BAR).select("bar_idx", "ts", "price", "n_trades", _r("qty", 4))


def dataset_stats(spark, d):
    return bs.dataset_stats(_bars(spark, d), BAR).withColumn("volume", F.round("volume", 2))


# --- channels, features, targets ---


def channels_full(spark, d):
    c = ft.build_channels(_bars(spark, d), "full")
    return c.select("bar_idx", "ts", _r("log_return", 4, 1e4), _r("realized_var", 4, 1e8), _r("bipower", 4, 1e8), _r("ofi", 4), _r("log_volume", 6), _r("log_trades", 6))


def channels_raw(spark, d):
    return ft.build_channels(_bars(spark, d), "raw").select("bar_idx", "ts", _r("log_return", 4, 1e4), _r("ofi", 4))


def _feature_query(*names: str):
    def run(spark, d):
        return _features(spark, d).select("start", *(c for c, n in zip(_rounded_features(), FEATURES) if n in names))

    return run


def features_7(spark, d):
    return _features(spark, d).select("start", "bar_idx", "ts", *_rounded_features())


def rv_gate(spark, d):
    bars = _bars(spark, d)
    gate = ft.valid_windows(ft.rolling_realized_variance(bars, WINDOW), bars, WINDOW, HORIZON)
    cut = exact_quantiles(gate, "realized_variance", (0.9,)).select("cut")
    return beside(gate, cut).select("start", "bar_idx", (F.col("realized_variance") >= F.col("cut")).alias("admitted"))


def rolling_metrics(spark, d):
    return ft.rolling_metrics(_bars(spark, d), WINDOW).select("start", _r("rv", 4, 1e8), _r("bpv", 4, 1e8), _r("jumps", 4, 1e8), _r("ofi", 4))


def windows_valid(spark, d):
    return _valid(_bars(spark, d)).agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("start").alias("last"))


def triple_barrier(spark, d):
    return _barriers(_bars(spark, d)).withColumn("side", F.col("side").cast("int"))


def triple_barrier_join(spark, d):
    return br.triple_barrier(_bars(spark, d), HORIZON, BARRIER, method="join").withColumn("side", F.col("side").cast("int"))


def targets_side(spark, d):
    return br.build_targets(_barriers(_bars(spark, d))).withColumn("y", F.col("y").cast("int"))


def targets_gate(spark, d):
    return br.build_targets(_barriers(_bars(spark, d)), "barrier_touched").withColumn("y", F.col("y").cast("int"))


def label_mix(spark, d):
    return br.label_mix(_barriers(_bars(spark, d))).withColumn("touch_rate", F.round("touch_rate", 8))


def training_matrix(spark, d):
    bars = _bars(spark, d)
    return br.training_matrix(ft.window_features(bars, WINDOW), br.build_targets(_barriers(bars))).select("start", F.col("y").cast("int").alias("y"), *_rounded_features())


# --- splits and folds ---


def split_purged(spark, d):
    return sp.chronological_split(_valid(_bars(spark, d)).select("start"), purge=WINDOW + HORIZON - 1, train_stride=3, val_stride=2)


def sequence_dataset(spark, d):
    bars = _bars(spark, d)
    held = sp.build_sequence_dataset(_valid(bars).select("start", "bar_idx"), br.build_targets(_barriers(bars)), purge=WINDOW + HORIZON - 1)
    return held.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg(F.col("y").cast("double")), 8).alias("positive_rate"))


def month_blocks(spark, d):
    return sp.month_blocks(_day_bars(spark, d))


def _folds_query(scheme: str):
    return lambda spark, d: sp.build_folds(_day_bars(spark, d), scheme, TRAIN_MONTHS)


def _day_windows(bars: DataFrame) -> DataFrame:
    held = ft.valid_windows(ft.window_features(bars, DAY_WINDOW), bars, DAY_WINDOW, DAY_HORIZON)
    told = br.triple_barrier(bars, DAY_HORIZON, DAY_BARRIER)
    return held.join(told.select("bar_idx", ((F.col("side") != 0) & F.col("defined")).alias("touched")), "bar_idx")


def _span(rows: DataFrame) -> DataFrame:
    return rows.groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("start").alias("last"))


def fold_masks(spark, d):
    bars = _day_bars(spark, d)
    return _span(sp.fold_windows(_day_windows(bars), sp.build_folds(bars, "rolling", TRAIN_MONTHS), PURGE, train_stride=2))


def fold_rows_touched(spark, d):
    bars = _day_bars(spark, d)
    return _span(sp.fold_rows(_day_windows(bars), sp.build_folds(bars, "rolling", TRAIN_MONTHS), PURGE))


def month_slice(spark, d):
    return bs.slice_months(_day_bars(spark, d), ["1996-04", "1996-03"]).select("bar_idx", "ts", "price")


# --- costs and geometry ---


def half_spread_roll(spark, d):
    return co.half_spread(_bars(spark, d), block=144).select(_r("half_spread_bps", 6), "method", "roll_blocks", _r("tick_floor_bps", 8))


def slippage_sweep(spark, d):
    return co.sweep_slippage(tp.events_tape(spark, d), SIZE).select("trade_id", _r("slippage_bps", 6))


def slippage_summary(spark, d):
    return co.slippage_summary(co.sweep_slippage(tp.events_tape(spark, d), SIZE)).select(_r("slippage_bps", 6), _r("median_bps", 6), _r("p95_bps", 6), "n_sweeps")


def slippage_hours(spark, d):
    rows = co.estimate_slippage(tp.events_tape(spark, d), SIZE, sample_hours=SAMPLE_HOURS)
    return rows.select(_r("slippage_bps", 6), _r("median_bps", 6), _r("p95_bps", 6), "n_sweeps", "sample_hours")


def round_trip_costs(spark, d):
    rows = [(a, b, round(COSTS.round_trip_bps(co.Execution(a, b)), 6)) for a in ("taker", "maker") for b in ("taker", "maker")]
    return spark.createDataFrame(rows, "entry string, exit string, round_trip_bps double")


def required_hit_rate(spark, d):
    cells = [(r, g, c) for r in (0.0, 0.3, 0.575, 1.0) for g in (6.0, 40.0, 61.9) for c in (5.15, 6.0)]
    held = spark.createDataFrame(cells, "rho double, captured double, cost double")
    return held.withColumn("h", F.round(co.required_hit_rate(F.col("rho"), F.col("captured"), F.col("cost")), 6))


def breakeven_curve(spark, d):
    held = spark.range(400).withColumn("h", 0.505 + F.col("id") * (0.8 - 0.505) / 399).withColumn("cost_bps", F.explode(F.array(*map(F.lit, (5.15, 2.65, 0.1)))))
    return held.select("cost_bps", F.round("h", 8).alias("hit_rate"), F.round(F.col("cost_bps") / (2 * F.col("h") - 1), 6).alias("barrier_bps"))


def _geometry(spark, d) -> DataFrame:
    bars = _bars(spark, d)
    return ge.geometry_grid(bars, ft.rolling_realized_variance(bars, WINDOW), WINDOW, (4.0, 6.0, 10.0), (30, 60), ROUND_TRIP, 0.9, BAR)


def geometry_grid(spark, d):
    digits = {"resolved_share": 6, "resolved_share_gated": 6, "captured_bps": 4, "overshoot_pct": 4, "required_hit_rate": 5, "required_hit_rate_gated": 5, "mean_hold_s": 4, "trades_per_day": 4}
    cells = _geometry(spark, d)
    return cells.select(*(_r(c, digits[c]) if c in digits else F.col(c) for c in cells.columns))


def geometry_shortlist(spark, d):
    return ge.shortlist(_geometry(spark, d), ROUND_TRIP, 2).select("barrier_bps", "horizon_s", _r("required_hit_rate_gated", 5))


# --- signals and backtests ---


def _p_up(x: Column) -> Column:
    return F.when(x > 0, 0.7).when(x < 0, 0.3).otherwise(0.5)


def _signals(bars: DataFrame) -> DataFrame:
    held = _valid(bars).select("start", "bar_idx", _p_up(F.col("lookback_return")).alias("p_up"))
    return si.signals_from_probabilities(held, 0.6).select("bar_idx", "direction")


def signals_momentum(spark, d):
    return _signals(_bars(spark, d))


def maker_fills(spark, d):
    bars = _bars(spark, d)
    return si.maker_fills(_signals(bars), bars, MAKER).select("bar_idx", "direction", "fill_bar", "fill_price")


def _run(spark, d, execution: co.Execution) -> tuple[DataFrame, DataFrame, DataFrame]:
    bars = _bars(spark, d)
    told = si.admit(_signals(bars), bars, _barriers(bars).persist(), HORIZON, execution).persist()
    return bars, told, si.price_trades(told, bars, COSTS.round_trip_bps(execution))


def _rounded_trades(trades: DataFrame) -> DataFrame:
    return trades.withColumn("gross_bps", F.round("gross_bps", 4)).withColumn("net_bps", F.round("net_bps", 4))


def backtest_taker(spark, d):
    return _rounded_trades(_run(spark, d, TAKER)[2])


def backtest_maker(spark, d):
    return _rounded_trades(_run(spark, d, MAKER)[2]).select("entry_bar", "exit_bar", "direction", "gross_bps", "net_bps")


def backtest_status(spark, d):
    return _run(spark, d, MAKER)[1].groupBy("status").agg(F.count("*").alias("n"))


def backtest_summary(spark, d):
    _, told, trades = _run(spark, d, TAKER)
    s = si.summarise(told, trades, COSTS, TAKER)
    return s.select("n_signals", "n_trades", _r("hit_rate", 8), _r("resolved_share", 8), _r("resolved_hit_rate", 8), _r("gross_bps", 4), _r("net_bps", 4), _r("mean_hold_s", 4), "n_days", _r("total_return", 6), _r("max_drawdown", 6), _r("sharpe", 4))


def backtest_daily(spark, d):
    return si.daily_pnl(_run(spark, d, TAKER)[2]).select("day", _r("pnl_bps", 4))


def drawdown(spark, d):
    return si.equity_curve(si.daily_pnl(_run(spark, d, TAKER)[2])).select("day", _r("equity", 6), _r("drawdown", 6))


def _grid(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Bars, gate cuts by fold, scored signals of every (fold, model, gate, q), and the share each gate keeps."""
    from tickloom.operators.walkforward import gate_cuts, gated_windows

    bars = _day_bars(spark, d)
    parts = sp.fold_windows(_day_windows(bars), sp.build_folds(bars, "rolling", TRAIN_MONTHS), PURGE)
    parts = settle(parts.withColumn("rv", F.col("realized_variance")), "fold-windows")
    cuts = settle(gate_cuts(parts.filter("part = 'train'"), {"rv": "rv"}), "cuts")
    kept, keep = gated_windows(parts.filter("part = 'test'"), cuts, {"rv": "rv"})
    each = F.explode(F.array(F.struct(F.lit("momentum").alias("model"), _p_up(F.col("lookback_return")).alias("p_up")), F.struct(F.lit("reversal").alias("model"), _p_up(-F.col("lookback_return")).alias("p_up"))))
    scored = kept.withColumn("_m", each).select("_m.model", "fold", "gate", "q", "bar_idx", "_m.p_up")
    keep = keep.withColumn("model", F.explode(F.array(F.lit("momentum"), F.lit("reversal"))))
    return bars, cuts, si.signals_from_probabilities(scored), keep


def gate_thresholds(spark, d):
    return _grid(spark, d)[1].select("fold", "q", F.round(F.col("cut") * 1e8, 4).alias("threshold"))


def signals_gated(spark, d):
    return _grid(spark, d)[2].groupBy("model", "fold", "gate", "q").agg(F.count("*").alias("n"), F.sum((F.col("direction") == 1).cast("long")).alias("longs"))


def _pool(spark, d) -> DataFrame:
    bars, _, signals, keep = _grid(spark, d)
    by = ("model", "fold", "gate", "q")
    barriers = settle(br.triple_barrier(bars, DAY_HORIZON, DAY_BARRIER), "barriers")
    told = settle(si.admit(settle(signals, "signals"), bars, barriers, DAY_HORIZON, TAKER, by), "admitted")
    return si.pool(told, settle(si.price_trades(told, bars, ROUND_TRIP, by), "trades"), settle(keep, "keep"), ROUND_TRIP)


def _pool_digits(rows: DataFrame) -> DataFrame:
    digits = {"gate_keep_frac": 6, "hit_rate": 6, "resolved_share": 6, "resolved_hit_rate": 6, "gross_bps": 4, "net_bps": 4, "mean_hold_s": 4, "total_return": 6, "max_drawdown": 6, "sharpe": 4, "trades_per_day": 6}
    return rows.select(*(_r(c, digits[c]) if c in digits else F.col(c) for c in rows.columns))


def pooled_grid(spark, d):
    return _pool_digits(_pool(spark, d).drop("cost_bps"))


def best_by_sharpe(spark, d):
    return sw.best_by_sharpe(_pool_digits(_pool(spark, d).drop("cost_bps")), ("gate",))


def common_gate(spark, d):
    return si.common_gate(_pool(spark, d))


# --- metrics ---


def _scored(spark, d) -> DataFrame:
    bars = _bars(spark, d)
    told = br.build_targets(_barriers(bars)).filter("usable").select("bar_idx", F.col("y").cast("int").alias("y"))
    held = _valid(bars).join(told, "bar_idx")
    return held.select("start", "y", F.round(F.col("lookback_return") * 1e4, 2).alias("score"), _p_up(F.col("lookback_return")).alias("p"))


def auc_exact(spark, d):
    return me.auc(_scored(spark, d)).select(_r("auc", 8), "n_pos", "n_neg")


def _metric_digits(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.col(c) if c.startswith("n") or c == "threshold" else _r(c, 8) for c in rows.columns))


def binary_metrics(spark, d):
    return _metric_digits(me.binary_metrics(_scored(spark, d), score="p"))


def threshold_sweep(spark, d):
    return _metric_digits(me.threshold_sweep(_scored(spark, d), score="p"))


def model_metrics(spark, d):
    rows = me.model_metrics(_scored(spark, d), score="p")
    return rows.select(*(_r(c, 8) if t == "double" else F.col(c) for c, t in rows.dtypes))


def bootstrap_auc(spark, d):
    return me.block_bootstrap_auc(_scored(spark, d), n_boot=100, block=WINDOW + HORIZON)


def bootstrap_sharpe(spark, d):
    return si.sharpe_interval(si.daily_pnl(_run(spark, d, TAKER)[2]))


# --- models and patches ---

#: Small trees for side_logistic and gate_trees, so that a query takes seconds; the operators' defaults are the study's.
SMALL_TREES = mo.Trees(rounds=5, depth=3, least=8)
PATCH = pt.PatchConfig(n_channels=2, seq_len=WINDOW, patch_len=8, stride=4, d_model=16, n_heads=2, n_layers=2, d_ff=32)
PATCH_CHANNELS = ("log_return", "ofi")


def _model_windows(spark, d, scheme: str = "holdout") -> tuple[DataFrame, DataFrame]:
    bars = _day_bars(spark, d)
    held = ft.valid_windows(ft.window_features(bars, DAY_WINDOW), bars, DAY_WINDOW, DAY_HORIZON)
    told = br.triple_barrier(bars, DAY_HORIZON, DAY_BARRIER).select("bar_idx", ((F.col("side") != 0) & F.col("defined")).alias("touched"), (F.col("side") > 0).cast("int").alias("y"))
    windows = sp.fold_windows(held.join(told, "bar_idx"), sp.build_folds(bars, scheme, TRAIN_MONTHS), PURGE)
    return bars, settle(windows, "fold-windows")


def _fold_scores(spark, d, side_models: tuple[str, ...]) -> tuple[DataFrame, str, DataFrame, DataFrame]:
    bars, windows = _model_windows(spark, d)
    fold = windows.select("fold").first()[0]
    return bars, fold, *mo.run_fold(windows, fold, SMALL_TREES, side_models)


def side_logistic(spark, d):
    _, _, _, test = _fold_scores(spark, d, ("logistic_ofi", "logistic_7"))
    touched = test.filter("touched")
    return reduce(DataFrame.unionByName, [me.auc(touched, score=f"p_{m}").withColumn("model", F.lit(m)) for m in ("logistic_ofi", "logistic_7")])


def gate_trees(spark, d):
    _, _, _, test = _fold_scores(spark, d, ())
    held = test.withColumn("t", F.col("touched").cast("int"))
    return reduce(DataFrame.unionByName, [me.auc(held, label="t", score=g).withColumn("gate", F.lit(g)) for g in ("gate_trained", "gate_rv")])


def walkforward_grid(spark, d):
    from tickloom.operators.walkforward import walk_forward

    bars, windows = _model_windows(spark, d, "anchored")
    barriers = settle(br.triple_barrier(bars, DAY_HORIZON, DAY_BARRIER), "barriers")
    return walk_forward(bars, windows, barriers, DAY_HORIZON, COSTS, TAKER, side_models=("logistic_7", "trees"))


def patch_instance_norm(spark, d):
    c = ft.build_channels(_bars(spark, d), "raw")
    z = pt.instance_norm(c, PATCH_CHANNELS, WINDOW)
    return z.select("start", _r("log_return_mean", 3, 1e6), _r("log_return_std", 3, 1e6), _r("log_return_z", 4), _r("ofi_mean", 4), _r("ofi_std", 4), _r("ofi_z", 4))


def patchify(spark, d):
    c = ft.build_channels(_bars(spark, d), "raw")
    held = pt.window_arrays(c, "log_return", WINDOW).select("start", F.posexplode(pt.patches(F.col("values"), PATCH.patch_len, PATCH.stride)).alias("patch", "v"))
    return held.select("start", "patch", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x) * 1e4, 4).alias("total"), F.round(F.element_at("v", -1) * 1e4, 4).alias("last"))


def patch_aux_stats(spark, d):
    c = ft.build_channels(_bars(spark, d), "raw")
    rows = pt.aux_stats(pt.window_stats(c, PATCH_CHANNELS, WINDOW), PATCH_CHANNELS)
    scale = F.when(F.col("aux") == "log_return_mean", 1e6).otherwise(1.0)
    return rows.select("aux", F.round(F.col("mean") * scale, 4).alias("mean"), F.round(F.col("std") * scale, 4).alias("std"))


def patch_scores(spark, d):
    bars = _bars(spark, d)
    return pt.predict(ft.build_channels(bars, "raw"), PATCH_CHANNELS, _valid(bars).select("start"), pt.init_weights(PATCH), PATCH)


def probability_exchange(spark, d):
    bars, windows = _model_windows(spark, d)
    test = windows.filter("part = 'test'").select("fold", "start", "y")
    told = test.select("fold", "start", _p_up(F.col("y") - 0.5).alias("p_up"))
    return mo.join_probabilities(test, told, "outside").groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg("p_outside"), 6).alias("mean"))


QUERIES = {
    f.__name__: f
    for f in (
        tape_scan, tape_time_slice, tape_unit_inference, bars_sparse, bars_grid, bars_meta, bars_hourly, bars_splice_gap, dataset_stats, channels_full, channels_raw, features_7, rv_gate, rolling_metrics,
        windows_valid, triple_barrier, triple_barrier_join, targets_side, targets_gate, label_mix, training_matrix, split_purged, sequence_dataset, month_blocks, fold_masks, fold_rows_touched, month_slice,
        half_spread_roll, slippage_sweep, slippage_summary, slippage_hours, round_trip_costs, required_hit_rate, breakeven_curve, geometry_grid, geometry_shortlist, signals_momentum, maker_fills,
        backtest_taker, backtest_maker, backtest_status, backtest_summary, backtest_daily, drawdown, gate_thresholds, signals_gated, pooled_grid, common_gate, best_by_sharpe, auc_exact, binary_metrics, model_metrics, threshold_sweep, bootstrap_auc, bootstrap_sharpe,
        side_logistic, gate_trees, walkforward_grid, patch_instance_norm, patchify, patch_aux_stats, patch_scores, probability_exchange,
    )
}
QUERIES |= {f"folds_{s}": _folds_query(s) for s in ("anchored", "rolling", "holdout")}
QUERIES |= {"feat_rv": _feature_query("realized_variance"), "feat_bipower_jumps": _feature_query("bipower_variation", "jumps", "signed_jumps"), "feat_ofi": _feature_query("order_flow", "vol_adjusted_ofi")}
ORACLE_SQL = dict(sql.ORACLE_SQL)
