from __future__ import annotations

import os
import sys

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tickloom.session import build_session, reachable  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.coalescePartitions.enabled": "true"})
    session.sparkContext.setLogLevel("ERROR")
    return reachable(session)


def series(n: int = 600, seed: int = 0, sigma: float = 2e-4) -> list[tuple]:
    rng = np.random.default_rng(seed)
    steps = rng.normal(0, sigma, n)
    steps[0] = 0
    price = 70_000 * np.exp(np.cumsum(steps))
    qty = rng.gamma(2, 0.5, n)
    return [(i, 1_767_225_600 + i, float(p), float(q), int(k), float(f)) for i, (p, q, k, f) in enumerate(zip(price, qty, rng.poisson(45, n), rng.normal(size=n) * qty))]


@pytest.fixture(scope="session")
def bars(spark):
    return spark.createDataFrame(series(), "bar_idx long, ts long, price double, qty double, n_trades long, ofi double").cache()
