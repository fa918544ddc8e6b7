"""Bars, checkpoints and results on disk."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.bars import BAR_COLUMNS, bar_meta, concat_bars, fold_bars
from tickloom.operators.patch import PatchConfig
from tickloom.sources.tape import scan_trades, time_slice

FORMAT_VERSION = 1


def save_bars(bars: DataFrame, path: str, source: str = "", **meta) -> str:
    """Bars by month, in time order, and a one-row description beside them."""
    tagged = bars.select(*BAR_COLUMNS).withColumn("month", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM"))
    tagged.repartition("month").sortWithinPartitions("ts").write.mode("overwrite").partitionBy("month").parquet(f"{path}/bars")
    told = bar_meta(bars, source).withColumn("extra", F.lit(json.dumps(meta, sort_keys=True)))
    told.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return path


def load_bars(spark: SparkSession, paths: str | list[str], bar_seconds: int = 1) -> DataFrame:
    """One cache as it is; several spliced in time order, gaps filled, overlap raising."""
    parts = [spark.read.parquet(f"{p}/bars").select(*BAR_COLUMNS) for p in ([paths] if isinstance(paths, str) else paths)]
    return concat_bars(parts, bar_seconds)


def load_meta(spark: SparkSession, path: str) -> dict:
    row = spark.read.parquet(f"{path}/meta").first().asDict()
    return {k: v for k, v in row.items() if k != "extra"} | json.loads(row["extra"])


def load_or_build_bars(spark: SparkSession, csv: str, cache: str, hours: float | None = None, skip_hours: float = 0, bar_seconds: int = 1) -> DataFrame:
    """The cache where it holds exactly this slice, else an error; built and saved where there is none."""
    wanted = {"hours": hours, "skip_hours": skip_hours, "bar_seconds": bar_seconds}
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/meta")
    if root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        held = {k: load_meta(spark, cache).get(k) for k in wanted}
        if held != wanted:
            raise ValueError(f"the cache holds {held}, not {wanted}")
        return load_bars(spark, cache)
    tape = time_slice(scan_trades(spark, csv), hours, skip_hours)
    if tape.isEmpty():
        raise ValueError(f"{csv} has no trades in the slice")
    save_bars(fold_bars(tape, bar_seconds), cache, csv, **wanted)
    return load_bars(spark, cache)


def save_checkpoint(spark: SparkSession, path: str, weights: dict[str, np.ndarray], config: PatchConfig, data_meta: dict | None = None, train_meta: dict | None = None, metrics: dict | None = None) -> None:
    """Weights as a table of named arrays, the recipe as JSON, under a format version."""
    rows = [(k, list(w.shape), w.ravel().astype(float).tolist()) for k, w in sorted(weights.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
    recipe = {"format_version": FORMAT_VERSION, "config": json.loads(config.to_json()), "data_meta": data_meta or {}, "train_meta": train_meta or {}, "metrics": metrics or {}}
    spark.createDataFrame([(json.dumps(recipe),)], "recipe string").coalesce(1).write.mode("overwrite").parquet(f"{path}/recipe")


def load_checkpoint(spark: SparkSession, path: str) -> tuple[dict[str, np.ndarray], PatchConfig, dict]:
    recipe = json.loads(spark.read.parquet(f"{path}/recipe").first()["recipe"])
    if recipe.get("format_version") != FORMAT_VERSION:
        raise ValueError(f"checkpoint format {recipe.get('format_version')!r} is not {FORMAT_VERSION}")
    rows = spark.read.parquet(f"{path}/weights").collect()  # a fixed number of arrays
    return {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in rows}, PatchConfig.from_json(json.dumps(recipe["config"])), recipe


def describe_checkpoint(recipe: dict) -> str:
    """A few lines on what a checkpoint is; what was not written down says so."""
    data = recipe.get("data_meta", {})
    lines = [f"format {recipe.get('format_version')}", f"config {recipe.get('config')}", f"label {data.get('label_mode', 'unrecorded')} at {data.get('barrier', 'unrecorded')}"]
    return "\n".join([*lines, *(f"{k} {v}" for k, v in sorted(recipe.get("metrics", {}).items()))])


def dataset_recipe(meta: dict) -> dict:
    """Arguments that rebuild a dataset, defaults where a checkpoint does not tell."""
    from tickloom.constants import BARRIER, HORIZON, WINDOW_SIZE

    defaults = {"window": WINDOW_SIZE, "horizon": HORIZON, "barrier": BARRIER, "label_mode": "triple_barrier", "channel_set": "raw", "train_frac": 0.7, "val_frac": 0.1, "train_stride": 1, "val_stride": 1}
    return {k: meta.get(k, v) for k, v in defaults.items()}


def write_results(rows: DataFrame, path: str) -> None:
    """Result tables, small by nature, as one JSON file."""
    rows.coalesce(1).write.mode("overwrite").json(path)
