from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars as bs
from tickloom.operators import models as mo
from tickloom.operators import patch as pt
from tickloom.operators import splits as sp
from tickloom.sources import cache
from tickloom.sources import tape as tp
from tickloom.streaming import ingest

T0 = 1_767_225_600


def write_csv(path, seconds):
    path.mkdir()
    rows = [f"{i},{100 + s * 0.01},1.5,{150 + s * 0.015},{(T0 + s) * 1_000_000},{str(s % 2 == 0).lower()},true" for i, s in enumerate(seconds)]
    (path / "trades.csv").write_text("\n".join(rows) + "\n")
    return str(path)


def test_cache_holds_exactly_its_slice(spark, tmp_path):
    csv, held = write_csv(tmp_path / "csv", [0, 1, 3, 10]), str(tmp_path / "cache")
    first = cache.load_or_build_bars(spark, csv, held)
    assert first.count() == 11 and cache.load_or_build_bars(spark, csv, held).count() == 11
    assert cache.load_meta(spark, held)["empty_seconds"] == 7
    with pytest.raises(ValueError, match="holds"):
        cache.load_or_build_bars(spark, csv, held, hours=1)


def test_checkpoint_round_trip(spark, tmp_path):
    config = pt.PatchConfig(seq_len=32, patch_len=8, stride=4, d_model=8, n_heads=2, n_layers=1, d_ff=8)
    weights = pt.init_weights(config)
    cache.save_checkpoint(spark, str(tmp_path / "c"), weights, config, metrics={"auc": 0.5})
    back, same, recipe = cache.load_checkpoint(spark, str(tmp_path / "c"))
    assert same == config and all((back[k] == w).all() for k, w in weights.items()) and "unrecorded" in cache.describe_checkpoint(recipe)
    assert cache.dataset_recipe({"window": 7})["window"] == 7


def test_stream_gives_the_batch_bars(spark, tmp_path):
    csv = write_csv(tmp_path / "csv", [0, 0, 1, 3, 10, 200])
    query = ingest.stream_bars(ingest.read_trades(spark, csv)).writeStream.format("memory").queryName("bars_out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {r.ts - T0: (r.price, r.qty, r.n_trades, r.ofi) for r in spark.table("bars_out").collect()}
    want = {r.ts - T0: (r.price, r.qty, r.n_trades, r.ofi) for r in bs.sparse_bars(tp.scan_trades(spark, csv)).collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_fold_schemes(spark):
    days = spark.range(0, 200).select((F.col("id")).alias("bar_idx"), (F.lit(T0) + F.col("id") * 86400).alias("ts"))
    for scheme, n in (("anchored", 4), ("rolling", 4), ("holdout", 1)):
        folds = sp.build_folds(days, scheme, 3).orderBy("test_lo").collect()
        assert len(folds) == n and all(f.train_lo < f.train_hi <= f.test_lo < f.test_hi for f in folds)
        assert (folds[-1].train_lo == 0) == (scheme != "rolling")
    assert sp.build_folds(days, "anchored", 3).orderBy("test_lo").first().name == "2026-01..2026-03 -> 2026-04"
    with pytest.raises(ValueError, match="months"):
        sp.build_folds(days, "holdout", 9)


def test_outside_probabilities_must_match(spark):
    test = spark.createDataFrame([("f", 1), ("f", 2)], "fold string, start long")
    good = spark.createDataFrame([("f", 2, 0.2), ("f", 1, 0.1)], "fold string, start long, p_up double")
    assert {r.start: r.p_x for r in mo.join_probabilities(test, good, "x").collect()} == {1: 0.1, 2: 0.2}
    for bad in (good.limit(1), good.unionByName(good)):
        with pytest.raises(ValueError, match="do not match"):
            mo.join_probabilities(test, bad, "x")
