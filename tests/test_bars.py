from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars as bs
from tickloom.sources import tape as tp

T0 = 1_767_225_600
ROWS = [(0, 100.0, 1.0, False), (0, 100.5, 2.0, True), (1, 101.0, 1.5, False), (3, 102.0, 3.0, True)]


def tape(spark, unit=1_000_000, rows=ROWS):
    held = [(i, p, q, p * q, (T0 + s) * unit, m, True) for i, (s, p, q, m) in enumerate(rows)]
    return spark.createDataFrame(held, tp.TAPE_SCHEMA)


@pytest.mark.parametrize("unit", [1, 1_000, 1_000_000])
def test_fold_is_the_same_in_every_unit(spark, unit):
    got = bs.fold_bars(tape(spark, unit)).orderBy("bar_idx").collect()
    assert [(r.ts - T0, r.price, r.qty, r.n_trades, r.ofi) for r in got] == [(0, 100.5, 3.0, 2, -1.0), (1, 101.0, 1.5, 1, 1.5), (2, 101.0, 0.0, 0, 0.0), (3, 102.0, 3.0, 1, -3.0)]


def test_grid_in_small_chunks(spark):
    rows = [(s, 100.0 + s, 1.0, s % 2 == 0) for s in (0, 1, 9, 23)]
    sparse = bs.sparse_bars(tape(spark, rows=rows))
    whole, cut = (sorted(map(tuple, bs.regular_grid(sparse, chunk=c).collect())) for c in (1 << 16, 4))
    assert whole == cut and len(whole) == 24 and whole[22][2] == 109.0


def test_slice_is_half_open(spark):
    rows = [(s, 100.0, 1.0, False) for s in (0, 3599, 3600, 7199, 7200)]
    got = tp.time_slice(tape(spark, rows=rows), hours=1, skip_hours=1).select("trade_id").collect()
    assert sorted(r[0] for r in got) == [2, 3]


def test_splice_fills_the_gap_and_overlap_raises(spark):
    bars = bs.fold_bars(tape(spark, rows=[(s, 100.0 + s, 1.0, False) for s in range(10)])).cache()
    joined = bs.concat_bars([bars.filter("bar_idx >= 7"), bars.filter("bar_idx < 4")]).orderBy("bar_idx").collect()
    assert [r.price for r in joined] == [100, 101, 102, 103, 103, 103, 103, 107, 108, 109] and [r.n_trades for r in joined][4:7] == [0, 0, 0]
    with pytest.raises(ValueError, match="overlap"):
        bs.concat_bars([bars.filter("bar_idx >= 3"), bars.filter("bar_idx < 4")])
    with pytest.raises(ValueError):
        bs.concat_bars([])


def test_months(spark):
    stamps = spark.createDataFrame([(i, t) for i, t in enumerate([1_764_547_200, 1_766_000_000, 1_767_225_600, 1_769_904_000])], "bar_idx long, ts long")
    bars = stamps.withColumn("price", F.lit(1.0))
    kept = bs.slice_months(bars, ["2026-01", "2025-12"])
    assert sorted(r.bar_idx for r in kept.collect()) == [0, 1, 2]
    with pytest.raises(ValueError, match="contiguous"):
        bs.slice_months(bars, ["2025-12", "2026-02"])
    with pytest.raises(ValueError, match="not in"):
        bs.slice_months(bars, ["2024-01"])
