from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from tickloom.functions.quantiles import exact_quantiles
from tickloom.operators import barriers as br
from tickloom.operators import costs as co
from tickloom.operators import features as ft
from tickloom.operators import metrics as me
from tickloom.operators import models as mo
from tickloom.operators import patch as pt
from tickloom.operators import simulate as si
from tickloom.operators import splits as sp


def column(df, name):
    return np.array([r[name] for r in df.orderBy("bar_idx").collect()])


@pytest.mark.parametrize("chunk", [64, 1 << 16])
def test_features_against_numpy(bars, chunk):
    w = 20
    got = ft.window_features(bars, w, chunk=chunk).orderBy("start").toPandas()
    p, flow = np.log(column(bars, "price")), column(bars, "ofi")
    assert got.start.tolist() == list(range(len(p) - w + 1))
    for s in (0, 1, 63, 64, 300, len(p) - w):
        r = np.diff(p[s : s + w])
        row = got.iloc[s]
        rv, bpv = (r**2).sum(), math.pi / 2 * (np.abs(r[1:]) * np.abs(r[:-1])).sum()
        assert np.isclose(row.realized_variance, rv) and np.isclose(row.bipower_variation, bpv) and np.isclose(row.order_flow, flow[s : s + w].sum())
        assert np.isclose(row.jumps, max(rv - bpv, 0)) and np.isclose(row.lookback_return, p[s + w - 1] - p[s])


def test_degenerate_windows(bars):
    assert ft.rolling_metrics(bars, 1).count() == 0 and ft.rolling_metrics(bars, 10_000).count() == 0
    two = ft.rolling_metrics(bars, 2).toPandas()
    assert (two.bpv == 0).all() and np.allclose(two.rv, two.jumps)
    with pytest.raises(ValueError):
        ft.build_channels(bars, "nothing")
    with pytest.raises(ValueError):
        ft.check_windows(bars, 500, 500)


def brute(price, h, b):
    lp, th, n = np.log(price), math.log1p(b), len(price)
    out = []
    for i in range(n):
        d = lp[i + 1 : i + 1 + h] - lp[i]
        up, dn = (next((k + 1 for k in range(len(d)) if s * d[k] > th), h + 1) for s in (1, -1))
        side = (up < dn) - (dn < up) if i < n - h else 0
        out.append((i, side, min(up, dn, h), i < n - h))
    return out


@pytest.mark.parametrize("method,chunk", [("descent", 50), ("descent", 1 << 16), ("join", 0)])
def test_triple_barrier(bars, method, chunk):
    got = br.triple_barrier(bars, 37, 5e-4, method=method, **({"chunk": chunk} if chunk else {}))
    assert sorted(map(tuple, got.collect())) == brute(column(bars, "price"), 37, 5e-4)


def stairs(*steps):
    """Prices from (price, bars it lasts)."""
    return [p for p, n in steps for _ in range(n)]


@pytest.mark.parametrize(
    "price,h,barrier,bar,want",
    [
        (stairs((200, 4), (200.5, 2), (203, 9)), 8, 0.002, 1, (1, 3)),  # up at the first price beyond, not the last
        (stairs((200, 4), (200.5, 2), (203, 3)), 7, 0.01, 0, (1, 6)),  # the lower step is inside
        (stairs((50, 2), (49, 1), (52, 9)), 6, 0.015, 0, (-1, 2)),  # down comes first, whatever follows
        (stairs((8, 30)), 11, 0.001, 7, (0, 11)),  # nothing happens in the horizon
        (stairs((10, 3), (10.01, 20)), 12, 0.001, 2, (0, 12)),  # ln(1.001) itself is not beyond the barrier
    ],
)
def test_stairs(spark, price, h, barrier, bar, want):
    df = spark.createDataFrame([(i, float(p)) for i, p in enumerate(price)], "bar_idx long, price double")
    row = br.triple_barrier(df, h, barrier).filter(f"bar_idx = {bar}").first()
    assert (row.side, row.exit_offset) == want


def test_targets(bars):
    b = br.triple_barrier(bars, 37, 5e-4).cache()
    side, gate = br.build_targets(b).toPandas(), br.build_targets(b, "barrier_touched").toPandas()
    assert side.usable.sum() == gate.y[gate.usable].sum()
    with pytest.raises(ValueError):
        br.build_targets(b, "other")


def test_split_is_purged_and_thinned(spark):
    starts = spark.range(1000).withColumnRenamed("id", "start")
    got = sp.chronological_split(starts, purge=50, train_stride=7, val_stride=3, chunk=64).toPandas()
    by = {k: sorted(v.start) for k, v in got.groupby("split")}
    val_end = int(1000 * (0.7 + 0.1))
    assert by["train"] == list(range(0, 650, 7)) and by["val"] == list(range(700, val_end - 50, 3)) and by["test"] == list(range(val_end, 1000))
    with pytest.raises(ValueError):
        sp.chronological_split(starts, purge=900)


@pytest.mark.parametrize("windows,passes,rate,hours", [(10**6, 3, 500.0, 1.0), (4_700_000, 10, 2000.0, 6.0), (7, 1, 1e9, 1.0), (10**12, 5, 10.0, 0.5), (10, 1, 1.0, 0.0)])
def test_affordable_stride(windows, passes, rate, hours):
    fits = [s for s in range(2, 65) if windows / s * passes * 1.25 / rate <= hours * 3600]
    assert sp.affordable_stride(windows, passes, rate, hours) == (fits[0] if fits else 64)


def plain_sweeps(rows, size):
    """Slippage of each run of (time, price, qty, sold) on one side that reaches the size, by walking through it."""
    out, run = [], []
    for at, row in enumerate([*rows, None]):
        if run and (row is None or row[3] != run[-1][3]):
            left, paid = size, 0.0
            for _, price, qty, _ in run:
                paid, left = paid + price * min(qty, left), left - min(qty, left)
            if left <= 1e-12:
                out.append((1 if not run[0][3] else -1) * (paid / size / run[0][1] - 1) / 1e-4)
            run = []
        if row is not None:
            run.append(row)
    return out


def test_sweeps(spark):
    rng = np.random.default_rng(21)
    rows = [(1_767_225_600 + i, round(40 + float(rng.normal(0, 0.2)), 2), round(float(rng.gamma(1, 0.03)), 3), bool(rng.random() < 0.5)) for i in range(400)]
    tape = [(i, p, q, p * q, t, sold, True, 0) for i, (t, p, q, sold) in enumerate(rows)]
    df = spark.createDataFrame(tape, "trade_id long, price double, qty double, quote_qty double, time long, is_buyer_maker boolean, is_best_match boolean, hour int")
    for size in (0.05, 0.2, 5.0):
        want = plain_sweeps(rows, size)
        for how in ({"by": ("hour",)}, {"block": 2}, {"block": 60}):
            got = [r.slippage_bps for r in co.sweep_slippage(df, size, **how).orderBy("trade_id").collect()]
            assert got == pytest.approx(want, abs=1e-7)
    assert plain_sweeps(rows, 0.05) and not plain_sweeps(rows, 5.0)


def test_costs(spark):
    c = co.Costs(half_spread_bps=0.001)
    assert c.round_trip_bps(co.Execution()) == pytest.approx(5.154) and c.round_trip_bps(co.Execution("maker", "maker")) == 0
    assert co.Costs().round_trip_bps(co.Execution()) == pytest.approx(5.152)
    with pytest.raises(ValueError):
        co.Execution(entry="other")


def test_flat_price_has_the_tick_floor(spark):
    flat = spark.range(3000).selectExpr("id as bar_idx", "80000D as price")
    row = co.half_spread(flat, block=1000).first()
    assert row.half_spread_bps == pytest.approx(0.5 * 0.01 / 80000 / 1e-4) and row.roll_blocks == 0


def plain_run(sig, off, defined, n, h):
    free, out = -1, []
    for bar in sig:
        if bar < free:
            out.append("blocked")
        elif bar > n - h - 1 or not defined[bar]:
            out.append("skipped")
        else:
            out.append("taken")
            free = bar + off[bar] + 1
    return out


def test_positions_do_not_overlap(spark, bars):
    h = 37
    b = br.triple_barrier(bars, h, 5e-4).cache()
    told = b.orderBy("bar_idx").toPandas()
    sig = spark.range(0, 600, 3).selectExpr("id as bar_idx", "if(id % 2 = 0, 1, -1) as direction")
    got = si.admit(sig, bars, b, h, co.Execution()).orderBy("bar_idx").toPandas()
    assert got.status.tolist() == plain_run(range(0, 600, 3), told.exit_offset, told.defined, 600, h)
    trades = si.price_trades(si.admit(sig, bars, b, h, co.Execution()), bars, 5.0).orderBy("entry_bar").toPandas()
    assert (trades.entry_bar.to_numpy()[1:] > trades.exit_bar.to_numpy()[:-1]).all() and np.allclose(trades.gross_bps - trades.net_bps, 5.0)


QUIET = [70.0] * 12


@pytest.mark.parametrize(
    "price,ofi,direction,want",
    [
        (QUIET, [0, -0.6, -0.6, -0.6, -0.8] + [0.0] * 7, 1, 4),  # selling eats the queue of 2 and the order of 0.5
        (QUIET, [0, 0.9, 0.9, 0.9] + [0.0] * 8, -1, 3),  # and buying that of an offer
        (QUIET, [0, 3.0, 3.0, 3.0] + [0.0] * 8, 1, None),  # flow of the other side eats nothing
        ([70.0, 70.0, 69.9] + [70.0] * 9, [0.0] * 12, 1, 2),  # the price trades through a bid
        ([70.0, 70.2] + [70.0] * 10, [0.0] * 12, 1, None),  # not on the far side of it
        ([70.0] * 3, [0.0, -9.0, 0.0], 1, 1),
    ],
)
def test_queue(spark, price, ofi, direction, want):
    b = spark.createDataFrame([(i, float(p), float(f)) for i, (p, f) in enumerate(zip(price, ofi))], "bar_idx long, price double, ofi double")
    sig = spark.createDataFrame([(0, direction)], "bar_idx long, direction int")
    row = si.maker_fills(sig, b, co.Execution(entry="maker", queue_ahead=2.0, size=0.5)).first()
    assert row.fill_bar == want and row.fill_price == (70.0 if want else None)


def test_auc_counts_ties_half(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 400), rng.integers(0, 20, 400) / 7.0 - 1
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, score double")
    d = s[y == 1][:, None] - s[y == 0]
    assert me.auc(df).first().auc == pytest.approx(((d > 0) + 0.5 * (d == 0)).mean())
    assert me.auc(df.filter("y = 1")).first().auc is None


def test_metrics_without_positives(spark):
    row = me.binary_metrics(spark.createDataFrame([(0, 0.1), (1, 0.2)], "y int, score double")).first()
    assert (row.precision, row.recall, row.f1, row.accuracy) == (0, 0, 0, 0.5)


def test_auc_of_small_and_signed_scores(spark):
    rng = np.random.default_rng(22)
    score = np.concatenate([rng.gamma(2, 1e-9, 300), -rng.gamma(2, 1e-9, 50), rng.normal(0.5, 1e-3, 200), np.zeros(20), rng.normal(0, 40, 60)])
    y = (rng.random(len(score)) < 0.4).astype(int)
    rows = spark.createDataFrame(list(zip(score.tolist(), y.tolist())), "score double, y int")
    pos, neg = score[y == 1], score[y == 0]
    want = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / len(pos) / len(neg)
    assert me.auc(rows).first().auc == pytest.approx(want, rel=1e-12)
    full = me.model_metrics(rows, 0.4).first()
    hit = score >= 0.4
    assert (full.tp, full.fp, full.fn, full.tn) == tuple(int((a & b).sum()) for a, b in ((hit, y == 1), (hit, y == 0), (~hit, y == 1), (~hit, y == 0)))
    assert full.roc_auc == pytest.approx(want) and full.n_flagged == hit.sum() and full.majority_accuracy == pytest.approx(1 - y.mean())


def test_check_windows(spark):
    one = spark.createDataFrame([(0, 1.0)], "bar_idx long, price double")
    assert ft.check_windows(one, 1, 0) == 1
    with pytest.raises(ValueError):
        ft.check_windows(one.limit(0), 1, 0)


def test_best_by_sharpe(spark):
    from tickloom.operators import sweep

    rows = [(20.0, 60, "trees", "rv", 0.9, 1.5), (20.0, 60, "trees", "none", 0.0, float("nan")), (20.0, 60, "logistic_7", "rv", 0.8, 2.0), (40.0, 60, "trees", "rv", 0.8, None), (40.0, 90, "trees", "rv", 0.8, -3.0)]
    df = spark.createDataFrame(rows, "barrier_bps double, horizon_s int, model string, gate string, q double, sharpe double")
    assert sorted((r.barrier_bps, r.horizon_s, r.model) for r in sweep.best_by_sharpe(df).collect()) == [(20.0, 60, "logistic_7"), (40.0, 90, "trees")]
    assert sorted((r.barrier_bps, r.sharpe) for r in sweep.best_by_sharpe(df, model="trees").collect()) == [(20.0, 1.5), (40.0, -3.0)]


@pytest.mark.parametrize("norm,hidden", [("layer", 0), ("batch", 5), ("layer", 5)])
def test_patch_options(norm, hidden):
    config = pt.PatchConfig(seq_len=32, patch_len=8, stride=4, d_model=8, n_heads=2, n_layers=1, d_ff=8, norm=norm, head_hidden=hidden)
    weights = pt.init_weights(config)
    x = np.random.default_rng(1).normal(size=(3, 2, 32))
    first = pt.forward(weights, config, x)
    assert first.shape == (3,) and np.isfinite(first).all()
    assert (norm == "layer") == np.allclose(first, pt.forward(weights | {"layer0.norm1.mean": np.ones(8)}, config, x))
    assert hidden == 0 or not np.allclose(first, pt.forward(weights | {"hidden.b": weights["hidden.b"] + 1}, config, x))
    assert pt.PatchConfig.from_json(config.to_json()) == config
    for bad in ({"norm": "none"}, {"n_heads": 3}, {"seq_len": 4}):
        with pytest.raises(ValueError):
            pt.PatchConfig(**{"d_model": 8, **bad})
    with pytest.raises(ValueError, match="depth"):
        pt.PatchConfig.from_json('{"depth": 3}')


def test_fit_head_learns(spark):
    config = pt.PatchConfig(n_channels=1, seq_len=16, patch_len=8, stride=4, d_model=8, n_heads=2, n_layers=1, d_ff=8)
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 200)
    x = rng.normal(size=(200, 1, 16)) + np.linspace(0, 3, 16) * (2 * y - 1)[:, None, None]
    weights = pt.fit_head(x, y, pt.init_weights(config), config, steps=150, rate=1e-2)
    assert np.mean((pt.forward(weights, config, x) > 0) == y) > 0.9


def test_command_line_options():
    from tickloom.plans import cli

    args = cli.parser().parse_args(["walk", "a", "b", "--target", "20:900", "--route", "maker:taker", "--fees", "2", "0.5"])
    assert args.series == ["a", "b"] and args.target == [(20 * 1e-4, 900)] and args.route == ("maker", "taker") and args.fees == [2.0, 0.5]
    assert cli.main(["stride", "1000000", "3", "500", "1"]) is None


def test_patches(spark, bars):
    df = spark.createDataFrame([([float(i) for i in range(10)],)], "v array<double>")
    got = df.select(pt.patches(df.v, 4, 3).alias("p")).first().p
    assert [list(map(int, x)) for x in got] == [[0, 1, 2, 3], [3, 4, 5, 6], [6, 7, 8, 9], [9, 9, 9, 9]]
    config = pt.PatchConfig(seq_len=32, patch_len=8, stride=4, d_model=16, n_heads=2, n_layers=2, d_ff=32)
    assert pt.n_parameters(pt.init_weights(pt.PatchConfig())) == 209_029 and pt.PatchConfig().n_patches == 37
    weights = pt.init_weights(config)
    c = ft.build_channels(bars, "raw").cache()
    x = np.array([[r.log_return, r.ofi] for r in c.orderBy("bar_idx").collect()]).T
    starts = spark.createDataFrame([(0,), (57,), (500,)], "start long")
    got = {r.start: r.p_up for r in pt.predict(c, ("log_return", "ofi"), starts, weights, config, chunk=64).collect()}
    for s in (0, 57, 500):
        assert got[s] == pytest.approx(1 / (1 + math.exp(-pt.forward(weights, config, x[None, :, s : s + 32])[0])))


@pytest.mark.parametrize("n, ties", [(1, 1), (7, 1), (60_000, 1), (60_000, 5_000)])
def test_exact_quantiles(spark, n, ties):
    x = np.random.default_rng(n).lognormal(-18, 2, n)
    x = x if ties == 1 else np.sort(x)[np.arange(n) // ties * ties]
    rows = spark.createDataFrame(pd.DataFrame({"g": np.arange(n) % 2, "x": x})).unionByName(spark.createDataFrame([(0, None), (9, None)], "g long, x double"))
    qs = (0.0, 0.5, 0.8, 0.95, 1.0)
    got = {(r["g"], r["q"]): r["cut"] for r in exact_quantiles(rows, "x", qs, ("g",)).collect()}
    want = {(g, q): np.quantile(x[g::2], q) for g in (0, 1) if len(x[g::2]) for q in qs}
    assert got == pytest.approx(want, rel=1e-12)
    assert {r["q"]: r["cut"] for r in exact_quantiles(rows, "x", qs).collect()} == pytest.approx({q: np.quantile(x, q) for q in qs}, rel=1e-12)


def plain_auc(y, score):
    up, down = score[y == 1], score[y == 0]
    return ((up[:, None] > down).sum() + (up[:, None] == down).sum() / 2) / (len(up) * len(down))


def test_block_bootstrap_auc(spark):
    rng = np.random.default_rng(2)
    n, block, draws = 300, 40, 25
    y = rng.integers(0, 2, n)
    score = np.round(y * 0.2 + rng.random(n), 2)
    rows = spark.createDataFrame([(3 * i, int(y[i]), float(score[i])) for i in range(n)], "start long, y int, score double")
    got = me.block_bootstrap_auc(rows, n_boot=draws, block=block, seed=5).first()
    again, found = np.random.default_rng(5), []
    for _ in range(draws):
        at = np.concatenate([np.arange(s, s + block) for s in again.integers(0, n - block, n // block)])
        found.append(plain_auc(y[at], score[at]))
    assert (got["lo"], got["hi"]) == pytest.approx((np.percentile(found, 2.5), np.percentile(found, 97.5)))
    assert got["p_le_half"] == pytest.approx(np.mean(np.array(found) <= 0.5)) and got["n_boot"] == draws


def test_sharpe_interval(spark):
    pnl = np.random.default_rng(4).normal(1, 3, 12)
    days = [(i, float(p)) for i, p in enumerate(pnl)]
    got = si.sharpe_interval(spark.createDataFrame(days[::-1], "day long, pnl_bps double"), draws=50, seed=9).first()
    drawn = np.random.default_rng(9).integers(0, 12, (50, 12))
    found = []
    for row in drawn:
        mean = sum(pnl[i] for i in row) / 12
        found.append(mean / math.sqrt(sum((pnl[i] - mean) ** 2 for i in row) / 11) * math.sqrt(365))
    assert (got["lo"], got["hi"]) == pytest.approx((np.percentile(found, 2.5), np.percentile(found, 97.5)))
    few = si.sharpe_interval(spark.createDataFrame(days[:5], "day long, pnl_bps double")).first()
    assert few["lo"] is None and few["hi"] is None


def test_logistic_is_the_weighted_ridge_optimum(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 2)) * (1, 1e-6)
    y = (x[:, 0] + x[:, 1] * 1e6 + rng.normal(size=200) > 0.8).astype(float)
    rows = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, t double")
    got = np.array([r["p"] for r in mo.fit_logistic(rows, "t", ("a", "b"))(rows, "p").orderBy("a").collect()])[np.argsort(np.argsort(x[:, 0]))]
    z = np.column_stack([np.ones(200), (x - x.mean(0)) / x.std(0, ddof=1)])
    weight, w = np.where(y == 1, 100 / y.sum(), 100 / (200 - y.sum())), np.zeros(3)
    for _ in range(60):  # Newton's steps on the weighted loss with a unit ridge on the slopes
        p = 1 / (1 + np.exp(-z @ w))
        slope, bend = z.T @ (weight * (p - y)) + w * (0, 1, 1), (z.T * (weight * p * (1 - p))) @ z + np.diag((0, 1, 1))
        w -= np.linalg.solve(bend, slope)
    assert got == pytest.approx(1 / (1 + np.exp(-z @ w)), abs=1e-3)


def test_one_tree_of_weighted_means(spark):
    rows = [(float(side), float(i < ones)) for side, ones, n in ((0, 10, 80), (1, 30, 40)) for i in range(n)]
    held = spark.createDataFrame(rows, "a double, t double")
    score = mo.fit_trees(held, "t", ("a",), mo.Trees(rounds=1, depth=1, rows=1.0, columns="all", least=1))
    got = {r["a"]: r["p"] for r in score(held, "p").distinct().collect() if r["t"] == 1}
    heavy = 80 / 40  # negatives for each positive
    want = {side: (heavy * p - q) / (heavy * p + q) for side, p, q in ((0.0, 10, 70), (1.0, 30, 10))}
    assert got == pytest.approx({k: 1 / (1 + math.exp(-2 * v)) for k, v in want.items()}, abs=1e-6)
