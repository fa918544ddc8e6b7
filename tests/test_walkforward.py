from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest

from tickloom.operators import models as mo
from tickloom.operators import walkforward as wf
from tickloom.plans import queries as qs


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Four orders a day over 30 months."""
    path = tmp_path_factory.mktemp("sf")
    days = pd.date_range(dt.datetime(1995, 1, 1), dt.datetime(1997, 6, 30), freq="6h")
    held = pd.DataFrame({"o_orderkey": range(len(days)), "o_orderdate": days, "o_totalprice": [1000.0 + (i * 7919 % 99991) / 100 for i in range(len(days))]})
    spark.createDataFrame(held).write.parquet(f"{path}/orders.parquet")
    return str(path)


def operators(df) -> int:
    """How many operators the driver's plan has, repeats counted."""
    return df._jdf.queryExecution().analyzed().toString().strip().count("\n") + 1


def test_plan_of_pooled_grid_is_small(spark, sf_dir):
    got = qs.pooled_grid(spark, sf_dir)
    assert operators(got) < 100
    rows = got.collect()
    assert {(r["model"], r["gate"], r["q"]) for r in rows} == {(m, g, q) for m in ("momentum", "reversal") for g, q in (("none", 0.0), ("rv", 0.5), ("rv", 0.8), ("rv", 0.9))}
    assert all(r["n_folds"] == 6 for r in rows if r["gate"] == "none")


def test_plan_of_best_by_sharpe_is_small(spark, sf_dir):
    got = qs.best_by_sharpe(spark, sf_dir)
    assert operators(got) < 100
    assert sorted(r["gate"] for r in got.collect()) == ["none", "rv"]


def test_plan_of_common_gate_is_small(spark, sf_dir):
    got = qs.common_gate(spark, sf_dir)
    assert operators(got) < 100
    assert [tuple(r) for r in got.collect()] == [("rv", 0.9)]


def test_plan_of_walkforward_grid_is_small(spark, sf_dir):
    got = qs.walkforward_grid(spark, sf_dir)
    assert operators(got) < 100
    rows = got.collect()
    gates = [("none", 0.0)] + [(g, q) for g in ("rv", "trained") for q in (0.5, 0.8, 0.9)]
    assert {(r["model"], r["gate"], r["q"]) for r in rows} == {(m, g, q) for m in ("logistic_7", "trees") for g, q in gates}
    none = [r for r in rows if r["gate"] == "none"]
    assert all(r["gate_keep_frac"] == 1.0 for r in none)
    assert len({r["n_trades"] for r in none}) == 1  # who is right does not change when a position ends


def test_walkforward_grid_walks_every_fold_with_the_study_s_trees(spark, sf_dir, monkeypatch):
    given = {}

    def walk(bars, windows, barriers, horizon, costs, execution, trees=mo.Trees(), side_models=tuple(mo.SIDE_MODELS)):
        given.update(windows=windows, trees=trees)
        return windows

    monkeypatch.setattr(wf, "walk_forward", walk)
    qs.walkforward_grid(spark, sf_dir)
    assert given["trees"] == mo.Trees()
    spans = given["windows"].groupBy("fold", "part").agg({"start": "min"}).toPandas().pivot(index="fold", columns="part", values="min(start)")
    assert [f.split(" -> ")[1] for f in sorted(spans.index)] == [f"1997-0{m}" for m in range(1, 7)]
    assert (spans["train"] == 0).all() and spans["test"].is_unique


def test_walkforward_grid_pools_every_fold(spark, sf_dir):
    rows = qs.walkforward_grid(spark, sf_dir).collect()
    assert {r["n_folds"] for r in rows if r["gate"] == "none"} == {6}


def test_folds_fitted_in_tasks_and_by_spark_are_scored_alike(spark, sf_dir, monkeypatch):
    bars, windows = qs._model_windows(spark, sf_dir, "anchored")
    windows = windows.filter("fold like '% -> 1997-01' or fold like '% -> 1997-02'")
    least, most = sorted(r["count"] for r in windows.groupBy("fold").count().collect())
    assert least < most
    barriers = qs.br.triple_barrier(bars, qs.DAY_HORIZON, qs.DAY_BARRIER)
    trees, scores = mo.Trees(rounds=3, depth=3, rows=1.0, columns="all", least=8), []
    for limit in (most, least, 0):
        monkeypatch.setattr(mo, "ONE_TASK", limit)
        _, told = wf.walk_forward(bars, windows, barriers, qs.DAY_HORIZON, qs.COSTS, qs.TAKER, trees, with_scores=True)
        scores.append(told.toPandas().sort_values(["fold", "bar_idx"], ignore_index=True))
    assert scores[0].p_trees.nunique() > 5
    for other in scores[1:]:
        pd.testing.assert_frame_equal(scores[0], other, check_like=True, rtol=0, atol=1e-4)
